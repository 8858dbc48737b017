"""SimHash near-duplicates: pigeonhole blocks, verified links, connected components.

A fingerprint has 64 bits. They are cut into ``blocks`` runs; two fingerprints that differ in at most
``max_bits`` bits agree on at least ``blocks - max_bits`` whole runs, so they share one of the
C(blocks, blocks - max_bits) keys made of that many runs. More blocks give more and longer keys: 7 suit up to
about a hundred million distinct fingerprints, 10 (210 keys of 38 bits) far more.

Copies with equal fingerprints are one node. The up to ``max_block`` fingerprints of a key are compared with each other in
one step that verifies the distances and returns a star for each component, so links grow with the members of a key, not
with their pairs. Fingerprints in a larger key are linked without pairs: each meets all points within half
of ``max_bits`` of it, and those that meet in a point are within ``max_bits`` of each other, while any two that close
have such a point in common. Both ways give exactly the
components of the definition.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tablehealth.session import stored

BITS = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PIECE = 1 << 16  # shingles whose bits are counted at a time


def fingerprint_of(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The signed 64-bit fingerprint of one text; zero if it has no words."""
    # bytes.split() cuts at the six characters of [\x20\x09-\x0D]
    tokens = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(tokens))
    total = len(tokens) - width + 1
    starts, ends = starts[:total].tolist(), ends[width - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, total, _PIECE):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:at + _PIECE], ends[at:at + _PIECE])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, words: int = 4, seed: int = 42) -> Column:
    """Fingerprint column of whole texts; null and empty texts give zero."""

    @F.pandas_udf(LongType())
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(text, words, seed) for text in texts], dtype="int64")

    return simhash(text)


def block_masks(blocks: int = 7, max_bits: int = 4) -> list[int]:
    """One signed mask for each choice of ``blocks - max_bits`` runs of bits."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [_signed(sum(chosen)) for chosen in combinations(runs, blocks - max_bits)]


def ball_masks(radius: int) -> list[int]:
    """All masks of at most ``radius`` set bits: the points around zero."""
    return [_signed(sum(1 << b for b in chosen)) for size in range(radius + 1) for chosen in combinations(range(BITS), size)]


def links(prints: DataFrame, *, max_bits: int = 4, blocks: int = 7, max_block: int = 1024) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` at ``max_bits`` or fewer differing bits.

    ``prints`` has distinct values in ``fp`` and should be stored, as it is read more than once.
    """
    if not max_bits < blocks or max_bits % 2:
        raise ValueError("max_bits must be even (an odd distance has no point half way) and below blocks")
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(blocks, max_bits)])).alias("block", "part"))
    shared = stored(keyed.groupBy("block", "part").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1))
    members = stored(keyed.join(shared, ["block", "part"]))
    small = members.where(F.col("size") <= max_block).groupBy("block", "part").agg(F.collect_list("fp").alias("fps"))
    stars = small.select(F.explode(_stars(max_bits)("fps")).alias("link")).select("link.a", "link.b")
    crowded = members.where(F.col("size") > max_block).select("fp").distinct()
    return stars.union(_met(crowded, max_bits)).distinct()


def _stars(max_bits: int):
    """Each list of at most ``max_block`` fingerprints as stars: its smallest member in every component of its links."""

    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def stars(groups: pd.Series) -> pd.Series:
        return pd.Series([_star_links(np.sort(np.asarray(group, np.int64)), max_bits) for group in groups], dtype=object)

    return stars


def _star_links(prints: np.ndarray, max_bits: int) -> list[dict[str, int]]:
    near = np.bitwise_count((prints[:, None] ^ prints[None, :]).view(np.uint64)) <= max_bits
    labels = np.arange(len(prints))
    while True:
        lower = np.where(near, labels[None, :], len(prints)).min(axis=1)
        lower = lower[lower]
        if (lower == labels).all():
            break
        labels = lower
    return [{"a": int(prints[root]), "b": int(prints[i])} for i, root in enumerate(labels) if root != i]


def _met(prints: DataFrame, max_bits: int) -> DataFrame:
    """Links among ``prints`` through common points half way, without comparing any two of them.

    Around a point at most as many fingerprints meet as the ball has points, so its list is bounded.
    """
    radius = max_bits // 2
    points = prints.select("fp", F.explode(F.array(*[F.lit(m) for m in ball_masks(radius)])).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
    met = points.groupBy("point").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return met.select("a", F.explode("all").alias("b")).where(F.col("a") < F.col("b"))


def components(edges: DataFrame, *, rounds: int = 64) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the links (a, b).

    Every round takes the smallest label among a node and its neighbours, then the label of that label, so the number of
    rounds grows with the logarithm of the longest path. Each round is written to the shared folder.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")))
    for _ in range(rounds):
        heard = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        after = stored(lower.join(jump, "root", "left").select("node", "old", F.coalesce("further", "root").alias("root")))
        labels, moved = after.select("node", "root"), after.where(F.col("old") != F.col("root"))
        if moved.isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, *, words: int = 4, seed: int = 42, max_bits: int = 4, blocks: int = 7, max_block: int = 1024) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``, with the links' components.

    Reads only ``doc_id`` and ``text``; other columns, of any name, are ignored. Null and empty texts, and texts without
    words, have fingerprint zero and link like any other. Repeated rows give repeated result rows. A row without an id
    keeps a null ``doc_id``; it takes part, but its id is never the smallest. An empty table gives an empty result.
    """
    prints = stored(docs.select("doc_id", fingerprint(F.col("text"), words, seed).alias("fp")))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes.select("fp"), max_bits=max_bits, blocks=blocks, max_block=max_block))
    linked = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "first")
    smallest = linked.groupBy("root").agg(F.min("first").alias("least"))
    labelled = linked.join(smallest, "root").select("fp", "least")
    classes = nodes.join(labelled, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest id, all columns as they were.

    Of rows that repeat an id, the one with the least SHA-256 of its text stays, then the one with the least JSON form.
    Rows without an id stay, as nothing can tell which document they are.
    """
    found = stored(near_duplicates(docs, **settings))
    copies = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    repeated = stored(found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"))
    kept = docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    order = F.struct(F.sha2(F.coalesce("text", F.lit("")), 256), F.to_json(row))
    one = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("row")).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(one.select(*docs.columns))


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value
