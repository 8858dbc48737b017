"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over lower-case trigrams that every match must contain: an AND
of clauses, each an OR of literals, each an AND of trigrams. ``build_postings`` lists the documents of every trigram that
the rules ask for, ``candidates`` intersects the postings, and only candidate documents are matched against the
expression. A rule from which no trigram follows is matched against all documents.

Positions come from cutting the text at the matches: the lengths of pieces and matches add up to starts and ends. A text
with many matches becomes rows, summed in a window of its own matches.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants as node  # the parse tree of a pattern
from re import _parser as parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablehealth.session import stored


@dataclass(frozen=True)
class Rule:
    """``group`` must have ``least`` characters, or the match is dropped (after it has taken its characters)."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


# Fixed values of the contract. In the last two the least length stands in the pattern, which gives the same matches: a run
# of the class is matched from its first possible start to its end, so a shorter run has no match of the least length.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: What the method adds: formats that name themselves.
MORE = (
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----"),
)
RULES = BASE + MORE
_WIDEST = 64  # alternatives held exactly while a query is derived; beyond, the literal ends there


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """Clauses (all needed) of alternatives (one needed) of trigrams (all needed), in lower case; empty if nothing is mandatory."""
    clauses: list[set[str]] = []

    def end(texts: set[str]) -> set[str]:
        if texts and min(map(len, texts)) >= 3:
            clauses.append(texts)
        return {""}

    def walk(tree, so_far: set[str]) -> set[str]:
        for op, value in tree:
            options = _options(op, value)
            if options is not None and len(so_far) * len(options) <= _WIDEST:
                so_far = {a + b for a, b in product(so_far, options)}
                continue
            so_far = end(so_far)
            if op is node.SUBPATTERN:
                so_far = walk(value[3], so_far)
            elif op in (node.MAX_REPEAT, node.MIN_REPEAT) and value[0] >= 1:
                so_far = end(walk(value[2], so_far))
        return so_far

    end(walk(parser.parse(pattern), {""}))
    return [[sorted({text[i:i + 3] for i in range(len(text) - 2)}) for text in sorted(texts)] for texts in clauses]


def _options(op, value) -> set[str] | None:
    """All lower-case texts that a part of a pattern matches, if they are few."""
    if op is node.LITERAL:
        return {chr(value).lower()}
    if op is node.IN and all(kind is node.LITERAL for kind, _ in value):
        return {chr(code).lower() for _, code in value}
    if op is node.SUBPATTERN:
        return _sequence(value[3])
    if op is node.BRANCH:
        parts = [_sequence(branch) for branch in value[1]]
        return None if None in parts else set().union(*parts)
    if op is node.MAX_REPEAT and value[1] <= 2:
        once = _sequence(value[2])
        return None if once is None else {"".join(x) for n in range(value[0], value[1] + 1) for x in product(once, repeat=n)}
    return None


def _sequence(tree) -> set[str] | None:
    found = {""}
    for op, value in tree:
        options = _options(op, value)
        if options is None or len(found) * len(options) > _WIDEST:
            return None
        found = {a + b for a, b in product(found, options)}
    return found


def document_key() -> Column:
    """Rows with the same id and text share a key; a shared key of others would only add candidates."""
    return F.xxhash64("doc_id", "text")


def build_postings(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """(trigram, key): the documents that contain each of the trigrams in either case."""
    lower = F.lower("text")
    found = F.array(*[F.when(F.contains(lower, F.lit(t)), F.lit(t)) for t in trigrams])
    return docs.select(document_key().alias("key"), F.explode(F.array_compact(found)).alias("trigram")).select("trigram", "key").distinct()


def candidates(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(key, kinds): the rules whose trigram queries a document satisfies, without those that scan fully."""
    asked = [(r.kind, c, a, t, len(alternative)) for r in rules for c, clause in enumerate(trigram_query(r.pattern)) for a, alternative in enumerate(clause) for t in alternative]
    needs = [(r.kind, len(q)) for r in rules if (q := trigram_query(r.pattern))]
    spark = docs.sparkSession
    query = spark.createDataFrame(asked, "kind string, clause int, alternative int, trigram string, needed int")
    clauses = spark.createDataFrame(needs, "kind string, clauses int")
    # the two tables have a row for each trigram of a rule
    postings = build_postings(docs, sorted({row[3] for row in asked})).join(F.broadcast(query), "trigram")
    literals = postings.groupBy("key", "kind", "clause", "alternative").agg(F.count(F.lit(1)).alias("met"), F.max("needed").alias("needed")).where("met = needed")
    whole = literals.select("key", "kind", "clause").distinct().groupBy("key", "kind").agg(F.count(F.lit(1)).alias("met"))
    return whole.join(F.broadcast(clauses), "kind").where("met = clauses").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def spans(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(row, doc_id, found): one row for each row of ``docs``; ``found`` lists (start, rank, kind, end), sorted.

    Starts and ends count code points, the end exclusive. Matches of a rule are leftmost and don't overlap.
    """
    chosen = stored(candidates(docs, rules)).withColumnRenamed("key", "candidate")
    texts = docs.select("doc_id", "text", document_key().alias("key")).join(chosen, F.col("key") == F.col("candidate"), "left")
    parts = []
    for rank, rule in enumerate(rules):
        asked = F.array_contains("kinds", rule.kind) if trigram_query(rule.pattern) else F.lit(True)
        whole = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        group = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
        pieces = F.split("text", rule.pattern, -1)
        steps = F.zip_with(F.zip_with(pieces, whole, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"))), group,
                           lambda x, g: F.struct(F.lit(rank).alias("rank"), x["gap"].alias("gap"), x["size"].alias("size"), (F.length(g) >= rule.least).alias("good")))
        parts.append(F.when(F.coalesce(asked, F.lit(False)) & F.col("text").rlike(rule.pattern), steps))
    cut = stored(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.filter(F.array(*parts), lambda x: x.isNotNull()).alias("steps")))
    matches = cut.select("row", F.explode("steps").alias("steps")).select("row", F.posexplode("steps").alias("i", "s")).where(F.col("s.size").isNotNull())
    before = Window.partitionBy("row", "s.rank").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("s.gap") + F.col("s.size")).over(before)
    placed = matches.select("row", "s.*", end.alias("end")).where("good")
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rank") + 1)
    found = placed.groupBy("row").agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("size")).alias("start"), "rank", kind.alias("kind"), "end"))).alias("found"))
    return cut.select("row", "doc_id").join(found, "row", "left")


def secrets(docs: DataFrame, more: Sequence[Rule] = MORE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans; repeated rows are judged each; an empty table gives an empty result. Columns other
    than doc_id and text are ignored.
    """
    rules = (*BASE, *more)
    found = F.coalesce("found", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"))

    def listed(items):
        return F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    counts = [F.size(F.filter(found, _of_kind(rule.kind))).cast("long").alias(f"n_{rule.kind}") for rule in BASE]
    base = F.filter(found, lambda x: x["rank"] < len(BASE))
    return spans(docs, rules).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(found).alias("spans"))


def _of_kind(kind: str):
    return lambda x: x["kind"] == F.lit(kind)


def python_spans(text: str | None, rules: Sequence[Rule] = RULES) -> list[tuple[int, int, str, int]]:
    """The same spans by row-at-a-time matching, for tests."""
    return sorted(
        (m.start(), rank, rule.kind, m.end()) for rank, rule in enumerate(rules) for m in re.finditer(rule.pattern, text or "")
        if len(m[rule.group]) >= rule.least)
