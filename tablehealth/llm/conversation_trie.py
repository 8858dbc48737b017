"""Prefix trie of conversations, by a splitter skeleton.

A rebuilt conversation is a path of turns; a turn is 32 hex digits of its hash, so paths are strings whose order puts each
node's members side by side. Splitters cut the order into shards of about equal numbers of turns. A node with members in two
shards must be a prefix of the splitter between them, so the prefixes of the splitters (the skeleton) are the only nodes that
a shard can't finish alone. The skeleton is broadcast; each shard is sorted and read once with the open path on a stack, and
emits every other node whole. For skeleton nodes it emits partial counts, which a reduction adds up.

Equal conversations become one row for every ``CHUNK`` ids before they are sorted, so a conversation that a third of all
are is a few rows; the digest of its ids is fed from them in order. One conversation is one row (a few dozen bytes a turn),
and a task holds the open path and the children of its nodes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth.session import stored

#: Hex digits of a turn, and conversation ids in one row of equal conversations.
DIGITS, CHUNK = 32, 4096
#: Turns that a shard is meant to hold up to the most shards, rows sampled for each shard, and the longest splitter in turns.
SHARD_TURNS, MAX_SHARDS, SAMPLED, SPLITTER_TURNS = 2_000, 8192, 10, 16

_NODES = ("kind STRING, key STRING, conv_id BIGINT, depth BIGINT, parent_conv_id BIGINT, n_convs BIGINT, n_children BIGINT, n_leaves BIGINT, "
          "saved_tokens BIGINT, chars BIGINT, ends_sha256 STRING")
_ARROW = pa.schema([(part.split()[0], pa.string() if part.split()[1] == "STRING" else pa.int64()) for part in _NODES.split(", ")])
_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
_NONE = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, *, group: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, turns): each conversation opened by the first turns of its group's, turns as (key, chars).

    Conversation c takes the first h = crc32(c) mod ``most`` turns of conversation c - c mod ``group``, then its own after
    its first h. Turns go by ``turn``, nulls first; of equal ones the one with the lesser hash comes first.
    """
    role, text = (F.coalesce(F.col(name), F.lit("")) for name in ("role", "text"))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGITS)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), key.alias("key"), F.length(text).alias("chars")).alias("row"))
    own = stored(rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("row")), lambda r: F.struct(r["key"].alias("key"), r["chars"].alias("chars"))).alias("own")))
    first = F.col("conv_id") - F.col("conv_id") % group
    heads = own.where(F.col("conv_id") == first).select(F.col("conv_id").alias("first"), F.slice("own", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    opened = F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), h)
    return own.withColumn("first", first).join(heads, "first", "left").select("conv_id", F.concat(opened, F.slice("own", h + 1, F.size("own"))).alias("turns"))


def equal_paths(conversations: DataFrame) -> DataFrame:
    """(path, chunk, first, n, ids, chars): one row for the conversations (conv_id, turns) of a chunk of ids with the same turns."""
    paths = conversations.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["key"]), "").alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    return paths.groupBy("path", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(
        F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"), F.any_value("chars").alias("chars"))


def splitters(paths: DataFrame, shards: int) -> list[str]:
    """At most ``shards`` - 1 paths that cut the sorted paths into runs of about equal numbers of turns.

    They are quantiles of a sample of ``SAMPLED`` rows a shard, cut to ``SPLITTER_TURNS`` turns. They decide how evenly the
    work is dealt out, not what comes out.
    """
    taken = paths.select(F.substring("path", 1, DIGITS * SPLITTER_TURNS).alias("path"), (F.size("chars") + 1).alias("turns")).orderBy(F.xxhash64("path", "chunk")).limit(SAMPLED * shards)
    sample = sorted((r["path"], r["turns"]) for r in taken.collect())  # bounded by the shards
    step, seen, ends = sum(turns for _, turns in sample) / shards, 0, []
    for path, turns in sample:
        if seen >= step * (len(ends) + 1) and len(ends) < shards - 1:
            ends.append(path)
        seen += turns
    return sorted(set(ends) - {""})


def skeleton_of(ends: list[str]) -> set[str]:
    return {path[:i] for path in ends for i in range(0, len(path) + 1, DIGITS)} | {""}


class _Node:
    __slots__ = ("key", "chars", "shared", "n", "first", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, key: str, chars: int, shared: bool):
        self.key, self.chars, self.shared = key, chars, shared
        self.n, self.first, self.children, self.leaves, self.saved, self.ends, self.waiting = 0, None, 0, 0, 0, None, []

    def row(self, kind: str, key: str | None, parent: int | None) -> tuple:
        return (kind, key, self.first, len(self.key) // DIGITS, parent, self.n, self.children, self.leaves, self.saved, self.chars, self.ends.hexdigest() if self.ends else _NONE)


def _finish(shared: set[str]):
    """Nodes of the sorted rows of whole shards: 'node' rows are complete but for the first member of a skeleton parent, whose key they name."""
    def close(stack: list[_Node], depth: int, out: list[tuple]) -> None:
        """Take the nodes deeper than ``depth`` off the stack."""
        while len(stack) > depth + 1:
            node = stack.pop()
            out.extend((*row[:4], node.first, *row[5:]) for row in node.waiting)
            parent = stack[-1] if stack else None
            if parent:
                parent.n += node.n
                parent.first = node.first if parent.first is None else min(parent.first, node.first)
            if node.shared:
                out.append(node.row("part", node.key, None))
                continue
            node.leaves += not node.children
            node.saved += (node.n - 1) * node.chars
            parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + node.leaves, parent.saved + node.saved
            if parent.shared:
                out.append(node.row("node", parent.key, None))
            else:
                parent.waiting.append(node.row("node", None, None))

    def batches_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out), _ARROW.types)], schema=_ARROW)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, shard, path, out = [], None, None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in ("shard", "path", "first", "n", "ids", "chars")}
                if row["shard"] != shard:
                    close(stack, -1, out)
                    shard, path, stack = row["shard"], "", [_Node("", 0, True)]
                if row["path"] != path:
                    common = 0
                    while row["path"][common:common + DIGITS] == path[common:common + DIGITS] and common < min(len(path), len(row["path"])):
                        common += DIGITS
                    path = row["path"]
                    close(stack, common // DIGITS, out)
                    for end in range(common + DIGITS, len(path) + 1, DIGITS):
                        key = path[:end]
                        stack.append(_Node(key, row["chars"][end // DIGITS - 1], end <= DIGITS * SPLITTER_TURNS and key in shared))
                top = stack[-1]
                if top.ends is None:
                    top.ends = hashlib.sha256(row["ids"].encode())
                else:
                    top.ends.update(f",{row['ids']}".encode())
                top.n += row["n"]
                top.first = row["first"] if top.first is None else min(top.first, row["first"])
                if len(out) > 5_000:
                    yield batches_of(out)
                    out = []
        close(stack, -1, out)
        if out:
            yield batches_of(out)
    return run


def reduced(parts: DataFrame) -> DataFrame:
    """The skeleton's nodes, whole, with their keys: partial counts of shards added up, subtrees summed over ancestors."""
    own = stored(parts.groupBy("key", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("local"), F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"), F.max("chars").alias("chars"), F.max(F.when(F.col("ends_sha256") != _NONE, F.col("ends_sha256"))).alias("ends")))
    above = F.when(F.col("depth") > 0, F.expr(f"substring(key, 1, length(key) - {DIGITS})"))
    kin = own.select(above.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("kin"))
    whole = own.join(kin, "key", "left").withColumn("n_children", F.col("local") + F.coalesce("kin", F.lit(0)))
    leaves, saved = F.col("leaves") + (F.col("n_children") == 0).cast("long"), F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")
    up = whole.select(leaves.alias("l"), saved.alias("s"), F.explode(F.transform(F.sequence(F.lit(0), F.col("depth").cast("int")), lambda i: F.col("key").substr(F.lit(1), i * DIGITS))).alias("key"))
    sums = up.groupBy("key").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    firsts = own.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(sums, "key").withColumn("above", above).join(firsts, "above", "left").select(
        "key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_NONE)).alias("ends_sha256"))


def trie(conversations: DataFrame, *, shards: int | None = None) -> DataFrame:
    """One row per node of the trie over the rebuilt ``conversations`` (conv_id, turn, role, text).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Rows
    without a conv_id are left out; a null role or text counts as empty; a null turn comes first; repeated rows are turns
    of their own. Other columns are ignored. An empty table has no nodes. ``shards`` changes how the work is dealt out,
    never the result.
    """
    paths = stored(equal_paths(rebuilt(conversations)))
    spark = paths.sparkSession
    if shards is None:
        turns = paths.agg(F.sum(F.size("chars") + 1)).first()[0] or 0  # one row
        shards = max(1, min(MAX_SHARDS, -(-turns // SHARD_TURNS)))
    ends = splitters(paths, shards)
    cut = spark.sparkContext.broadcast(ends)

    @F.pandas_udf("int")
    def shard(path: pd.Series) -> pd.Series:
        return path.map(lambda p: bisect_right(cut.value, p)).astype("int32")

    dealt = paths.withColumn("shard", shard("path")).repartitionById(len(ends) + 1, "shard").sortWithinPartitions("shard", "path", "chunk")
    found = stored(dealt.select("shard", "path", "first", "n", "ids", "chars").mapInArrow(_finish(skeleton_of(ends)), _NODES))
    skeleton = stored(reduced(found.where("kind = 'part'")))
    # at most MAX_SHARDS * SPLITTER_TURNS rows
    firsts = F.broadcast(skeleton.select("key", F.col("conv_id").alias("above")))
    local = found.where("kind = 'node'").join(firsts, "key", "left").withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id"))
    return local.select(*_COLUMNS).unionByName(skeleton.select(*_COLUMNS))
