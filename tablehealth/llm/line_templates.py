"""Line dedup by a log-template tree.

A line's way down the tree has a fixed depth: its token count, then its ``leading`` first tokens, with digits generalised.
In the leaf the remaining tokens are cut to ``FIELDS`` consecutive fields (single tokens or none in short lines). Two lines of
a leaf agree if at least ``agree`` of ``FIELDS`` fields are equal; in lines with fewer tokens than fields, the same share of tokens
must be, so a line may differ in a quarter of them. Agreeing lines form components, however many a leaf holds. The fields in which
a component's lines differ are variable, the others fixed; it is a template if as many are fixed as two lines must have in common.
A component with fewer is a chain, whose ends may share nothing, and is split: a line goes to the choice of fixed fields that most
lines of the chain share with it (of equal ones, the one with the greatest hash). So all lines of a template agree in its fixed
fields. A line that agrees with none is a template of its own, up to its digits.

Agreeing pairs are not compared: lines that may differ in m fields share one of m + 1 runs of fields, and lines without a partner
there are left out; the others get a key for every choice of the fields that must be equal, and each key's lines are linked to the
smallest of them.

A template that occurs in two or more documents is recurring: its lines stay in the document with the smallest id and are
dropped from the others; what is lost is the text of variable fields. Lines of fewer than ``min_words`` tokens are never
dropped, and only lines of at least ``min_general`` tokens are generalised beyond their digits: in shorter ones, no token
may differ.

The lines become rows of fixed size (hashes), so a line or document of any length and a line that a third of the
documents share are no special cases: counts are pre-aggregated, and joins on a template's key are left for adaptive
execution to split. Texts move once, by document id, to have their lines taken out.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth.llm.simhash import components
from tablehealth.session import stored

#: Number of fields of a line behind its leading tokens.
FIELDS = 8
#: White space other than blanks and line ends. With blanks in its place, lines are cut at a fixed character, without a pattern.
_BLANK = r"[\x09\x0B-\x0D]"
_NAMES = [f"f{i}" for i in range(FIELDS)]


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def parse_lines(docs: DataFrame, *, leading: int = 3, min_words: int = 3) -> DataFrame:
    """(doc_id, version, line, tokens, leaf, own, f0..f7) of every line of enough tokens, in documents with an id.

    ``version`` is the text's hash: it tells texts apart that share an id.
    """
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("version"), F.regexp_replace(F.regexp_replace("text", "[0-9]+", "<*>"), _BLANK, " ").alias("text"))
    lines = texts.select("doc_id", "version", F.posexplode(lines_of(F.col("text"))).alias("line", "content"))
    parts = F.array_remove(F.split("content", " "), "")
    if min_words < 2:  # a line without words is one empty token
        parts = F.when(F.col("content").rlike("[^ ]"), parts).otherwise(F.array(F.lit("")))
    # the one-element array binds the tokens to a name, so that the condition on their number does not cut the line again
    tokens = lines.select("doc_id", "version", "line", F.explode(F.array(parts)).alias("parts")).where(F.size("parts") >= min_words)
    rest = F.size("parts") - leading
    fields = [
        F.xxhash64(F.slice("parts", leading + 1 + F.floor(F.greatest(rest, F.lit(0)) * i / FIELDS).cast("int"),
                           F.floor(F.greatest(rest, F.lit(0)) * (i + 1) / FIELDS).cast("int") - F.floor(F.greatest(rest, F.lit(0)) * i / FIELDS).cast("int"))).alias(name)
        for i, name in enumerate(_NAMES)
    ]
    return tokens.select(
        "doc_id", "version", "line", F.size("parts").alias("tokens"), F.xxhash64(F.size("parts"), F.slice("parts", 1, leading)).alias("leaf"),
        F.xxhash64("parts").alias("own"), *fields,
    )


def _keys(choices: list[tuple[int, ...]]) -> Column:
    """A key for each choice of fields: equal in lines of a leaf that agree on them."""
    return F.array(*[F.xxhash64("leaf", F.lit(i), *[_NAMES[k] for k in fields]) for i, fields in enumerate(choices)])


def _variable(leading: int, agree: int) -> Column:
    """In how many fields agreeing lines of so many tokens may differ."""
    return F.floor(F.least(F.col("tokens") - leading, F.lit(FIELDS)) * (FIELDS - agree) / FIELDS)


def agreeing(lines: DataFrame, *, leading: int = 3, agree: int = 6) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between the distinct lines (leaf, own, tokens, f0..f7), whose components are those of all agreeing pairs, and
    (own, key) of the choices of fixed fields of every line that may have a partner."""
    most = FIELDS - agree
    allowed = _variable(leading, agree)

    def by_allowed(choices) -> Column:
        """Lines that may differ in m fields have a token count of their own, so keys for different m never meet."""
        found = F.array().cast("array<bigint>")
        for m in range(1, most + 1):
            found = F.when(allowed == m, _keys(choices(m))).otherwise(found)
        return found

    def runs(m: int) -> list[tuple[int, ...]]:
        ends = [FIELDS * i // (m + 1) for i in range(m + 2)]
        return [tuple(range(*pair)) for pair in zip(ends, ends[1:])]

    met = lines.select("own", F.explode(by_allowed(runs)).alias("key"))
    shared = met.groupBy("key").agg(F.min("own").alias("least"), F.max("own").alias("most")).where(F.col("least") < F.col("most")).select("key")
    partners = stored(met.join(shared, "key", "left_semi").select("own").distinct())
    met = stored(lines.join(partners, "own", "left_semi").select("own", F.explode(by_allowed(lambda m: list(combinations(range(FIELDS), FIELDS - m)))).alias("key")))
    hubs = met.groupBy("key").agg(F.min("own").alias("hub"), F.max("own").alias("most")).where(F.col("hub") < F.col("most")).select("key", "hub")
    links = met.join(hubs, "key").where(F.col("own") != F.col("hub")).select(F.col("own").alias("a"), F.col("hub").alias("b")).distinct()
    return links, met


def _split(chained: DataFrame, choices: DataFrame) -> DataFrame:
    """(leaf, own, keeper) of the lines of chains that recur through the choice of fixed fields that most lines share with them."""
    shared = choices.join(chained.select("own", "leaf", "first", "last"), "own")
    sizes = shared.groupBy("key").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1")
    chosen = shared.join(sizes, "key").groupBy("leaf", "own", "first", "last").agg(F.max_by("key", F.struct("lines", "key")).alias("key"))
    kept = chosen.groupBy("key").agg(F.min("first").alias("keeper"), F.max("last").alias("end")).where(F.col("keeper") < F.col("end")).select("key", "keeper")
    return chosen.join(kept, "key").select("leaf", "own", "keeper")


def recurring(parsed: DataFrame, *, leading: int = 3, agree: int = 6, min_general: int = 7) -> DataFrame:
    """(leaf, own, keeper) of the lines that recur as themselves or through a template of their leaf.

    ``keeper`` is the smallest id of a document with the template.
    """
    lines = stored(parsed.groupBy("leaf", "own").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("tokens").alias("tokens"), *[F.max(f).alias(f) for f in _NAMES]))
    crowded = lines.where(F.col("tokens") >= min_general).groupBy("leaf").agg(
        F.count(F.lit(1)).alias("lines"), F.min("first").alias("first"), F.max("last").alias("last")).where("lines > 1 and first < last").select("leaf")
    several = stored(lines.join(crowded, "leaf"))
    links, choices = agreeing(several, leading=leading, agree=agree)
    roots = components(links)
    fitting = stored(several.join(roots, several["own"] == roots["node"]).select("leaf", "own", "root", "first", "last", "tokens", *_NAMES))
    fixed = sum(((F.min(f) == F.max(f)).cast("int") for f in _NAMES), F.lit(0))
    groups = stored(fitting.groupBy("leaf", "root").agg(F.min("first").alias("keeper"), F.max("last").alias("end"), fixed.alias("fixed"), F.max("tokens").alias("tokens")))
    whole = F.col("fixed") >= FIELDS - _variable(leading, agree)
    templates = groups.where(whole & (F.col("keeper") < F.col("end"))).select("leaf", "root", "keeper")
    general = fitting.join(templates, ["leaf", "root"]).select("leaf", "own", "keeper")
    general = stored(general.unionByName(_split(fitting.join(groups.where(~whole).select("leaf", "root"), ["leaf", "root"], "left_semi"), choices)))
    exact = lines.where(F.col("first") < F.col("last")).join(general, ["leaf", "own"], "left_anti").select("leaf", "own", F.col("first").alias("keeper"))
    return general.union(exact)


def repeated_lines(docs: DataFrame, *, leading: int = 3, min_words: int = 3, agree: int = 6, min_general: int = 7) -> DataFrame:
    """(doc_id, version, dropped): the sorted line numbers, from 0, that each affected document loses."""
    parsed = stored(parse_lines(docs, leading=leading, min_words=min_words))
    found = recurring(parsed, leading=leading, agree=agree, min_general=min_general)
    lost = parsed.select("doc_id", "version", "line", "leaf", "own").join(found, ["leaf", "own"]).where(F.col("doc_id") != F.col("keeper"))
    return lost.select("doc_id", "version", "line").distinct().groupBy("doc_id", "version").agg(F.sort_array(F.collect_list("line")).alias("dropped"))


def without_repeated_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of ``text``, and n_lines, n_dropped, dropped beside it.

    Every row comes back; n_lines counts the lines before (a null text has none and stays null, an empty one has one).
    Rows with the same id count as one document, each losing its own lines; rows without an id lose nothing.
    Columns named n_lines, n_dropped or dropped are replaced; others stay as they are. An empty table gives an empty result.
    """
    found = stored(repeated_lines(docs, **settings)).select(F.col("doc_id").alias("__doc"), F.col("version").alias("__version"), F.col("dropped").alias("__dropped"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "dropped")]
    joined = docs.select(*[F.col(f"`{c}`") for c in own]).join(found, (F.col("doc_id") == F.col("__doc")) & (F.xxhash64("text") == F.col("__version")), "left")
    dropped = F.coalesce("__dropped", F.array().cast("array<int>"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines_of(F.col("text"))) - 1), dropped)
    # the one-element array binds the lines to a name, so that they are cut once and not per line
    rest = F.transform(F.array(lines_of(F.col("text"))), lambda lines: F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))[0]
    text = F.when(F.size(dropped) == 0, F.col("text")).otherwise(rest)
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in own],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines_of(F.col("text")))).cast("long").alias("n_lines"),
        F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"),
    )


def drop_repeated_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with its own columns, without recurring lines, and without the documents that have no other lines."""
    cleaned = without_repeated_lines(docs, **settings)
    return cleaned.where(F.col("n_dropped").isNull() | (F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
