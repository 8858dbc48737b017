"""Ranked lexical search by bit-sliced Bloom signatures.

Indexing reads the documents once. Documents of about the same number of distinct terms share a block; a block is a matrix
of bits whose rows (slices) are the positions of a Bloom signature and whose columns are its documents, so the AND of a
term's slices is a bitmap of all documents that may hold it. Terms that occur more often leave further marks, one for each
power of two, so the bitmaps bound term frequencies as well. A bit is set for every mark that is there: bitmaps
overestimate, never miss.

Searching reads the blocks twice. Weighted sums of bitmaps give every document an upper bound of its score. The documents
with the ten highest bounds are scored exactly, and the tenth best of these scores is a floor that no result lies below.
In the second reading every document whose bound reaches its item's floor is a candidate; all are scored exactly from
their whole texts. None is left out that is not proven to rank below the tenth.

A block is built from the rows of one task and has a fixed number of bits, so a hot source or a long text is no special
case. Items are worked off in groups of a bounded number of terms, the only data that goes through the driver. Blocks,
counts and candidates are tables in the shared folder.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablehealth.session import stored

# Fixed values of the contract.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Terms of a UTF-8 text: what is no letter, digit or part of a longer character becomes a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

#: Bits of a signature for each mark, and slices of a mark: less than one in a thousand bitmaps' columns is wrong.
BITS, HASHES = 16, 8
#: Bits of a block, and the growth of signature widths from one class of documents to the next.
BLOCK_BITS, WIDER = 1 << 22, 2 ** 0.5
#: The marks of a term say that it occurs more than 0, 1, 2, 4, 8 ... times.
LEVELS = 24
_OVER = np.array([0, *(1 << i for i in range(LEVELS - 1))], dtype=np.int64)
#: Terms of the items that are searched for together, on average.
GROUP_TERMS = 16_384
_ITEMS_AT_ONCE = 64
_FLUSH = 200_000

_INDEX = ("kind STRING, docs BIGINT, terms BIGINT, term STRING, df BIGINT, width BIGINT, ids ARRAY<BIGINT>, versions ARRAY<BIGINT>, "
          "lengths ARRAY<BIGINT>, slices BINARY")
_ARROW = pa.schema([
    ("kind", pa.string()), ("docs", pa.int64()), ("terms", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("width", pa.int64()),
    ("ids", pa.list_(pa.int64())), ("versions", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("slices", pa.binary()),
])


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads changes of any bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _marks(hashes: np.ndarray, level: int) -> np.ndarray:
    return _mixed(hashes + np.uint64((level * 0x9E3779B97F4A7C15) % 2**64))


def _positions(marks: np.ndarray, width: int) -> np.ndarray:
    """(marks, HASHES): the slices of each mark in signatures of ``width`` bits."""
    step = _mixed(marks ^ np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    return ((marks[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(width)).astype(np.int64)


class _Block:
    """Documents of one class, until there are enough of them for a block."""

    def __init__(self, size: int):
        self.width = BITS * size
        self.room = max(8, BLOCK_BITS // self.width // 8 * 8)
        self.docs: list[tuple[int, int, int, np.ndarray]] = []

    def row(self) -> dict:
        columns = -(-len(self.docs) // 8) * 8
        bits = np.zeros((self.width, columns), dtype=np.uint8)
        for i, (_, _, _, marks) in enumerate(self.docs):
            bits[_positions(marks, self.width).ravel(), i] = 1
        ids, versions, lengths, _ = zip(*self.docs)
        self.docs = []
        return {"kind": "block", "width": self.width, "ids": ids, "versions": versions, "lengths": lengths, "slices": np.packbits(bits, axis=1).tobytes()}


def _index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of three kinds: blocks, the number of documents that hold a term, and of all documents and terms."""
    blocks: dict[int, _Block] = {}
    df: Counter = Counter()
    known: dict[bytes, int] = {}
    docs = terms = held = 0

    def counted() -> Iterator[pa.RecordBatch]:
        rows = list(df.items())
        for i in range(0, len(rows), 50_000):
            yield _rows([{"kind": "term", "term": t.decode(), "df": n} for t, n in rows[i:i + 50_000]])

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for i, (doc_id, version) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("version").to_pylist())):
            words = (texts[i].as_py() or b"").translate(_TABLE).split()
            if not words:
                continue
            found = Counter(words)
            docs, terms = docs + 1, terms + len(words)
            df.update(found.keys())
            held += sum(map(len, found))
            if len(df) > _FLUSH or held > 64_000_000:
                yield from counted()
                df, held = Counter(), 0
            if doc_id is None:
                continue
            if len(known) > _FLUSH:
                known = {}
            hashes = np.fromiter((known.get(t) or known.setdefault(t, xxhash.xxh64_intdigest(t)) if len(t) < 64 else xxhash.xxh64_intdigest(t) for t in found), np.uint64, len(found))
            often = np.fromiter(found.values(), np.int64, len(found))
            marks = [_marks(hashes, 0)]
            for level in range(1, LEVELS):
                more = often > _OVER[level]
                if not more.any():
                    break
                hashes, often = hashes[more], often[more]
                marks.append(_marks(hashes, level))
            marks = np.concatenate(marks)
            # the class is the exponent of the growth that takes 16 marks to at least as many as there are
            step = max(0, int(np.ceil(np.log(len(marks) / 16) / np.log(WIDER) - 1e-9)))
            block = blocks.setdefault(step, _Block(int(np.ceil(16 * WIDER ** step))))
            block.docs.append((doc_id, version, len(words), marks))
            if len(block.docs) == block.room:
                yield _rows([block.row()])
    for block in blocks.values():
        if block.docs:
            yield _rows([block.row()])
    yield from counted()
    yield _rows([{"kind": "all", "docs": docs, "terms": terms}])


def build_index(docs: DataFrame) -> DataFrame:
    """The index of all rows of ``docs`` (doc_id, text): blocks of signatures, and partial counts of documents and terms.

    Rows without an id count as documents but are in no block; rows without terms are nowhere.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text").mapInArrow(_index, _INDEX)


class _Search:
    """Bounds of all documents of a block for the items of a group."""

    def __init__(self, queries: list[tuple[int, str, int]], docs: int, terms: int):
        """queries: (item number, term, weight times its repeats in the item)."""
        self.docs, self.terms = docs, terms
        names = sorted({term for _, term, _ in queries})
        place = {term: i for i, term in enumerate(names)}
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(t.encode()) for t in names), np.uint64, len(names))
        self.groups = []
        items = sorted({item for item, _, _ in queries})
        for start in range(0, len(items), _ITEMS_AT_ONCE):
            group = items[start:start + _ITEMS_AT_ONCE]
            line = {item: i for i, item in enumerate(group)}
            cells = [(line[item], place[term], w) for item, term, w in queries if item in line]
            columns = np.unique([c for _, c, _ in cells])
            weights = np.zeros((len(group), len(columns)))
            np.add.at(weights, ([r for r, _, _ in cells], np.searchsorted(columns, [c for _, c, _ in cells])), [float(w) for _, _, w in cells])
            self.groups.append((np.array(group), columns, weights))

    def bounds(self, width: int, lengths: np.ndarray, slices: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item numbers, bounds[item, document]), whole numbers at least as high as the scores."""
        packed = np.frombuffer(slices, dtype=np.uint8).reshape(width, -1)
        m = 25 + (75 * lengths * self.docs) // self.terms
        present, levels, below = np.arange(len(self.hashes)), [], np.zeros(len(lengths), dtype=np.int64)
        held = np.full((len(self.hashes), packed.shape[1]), 255, dtype=np.uint8)
        for level in range(LEVELS):
            # a document with a term's higher mark has its lower ones
            bitmaps = np.bitwise_and.reduce(packed[_positions(_marks(self.hashes[present], level), width)], axis=1) & held
            some = bitmaps.any(axis=1)
            present, held = present[some], bitmaps[some]
            if not len(present):
                break
            most = _OVER[level + 1] if level + 1 < LEVELS else None
            share = np.full(len(m), 1_000_000) if most is None else (1_000_000_000 * most) // (1000 * most + 8 * m)
            levels.append((present, np.unpackbits(held, axis=1, count=len(lengths)), (share - below).astype(float)))
            below = share
        for items, columns, weights in self.groups:
            total = np.zeros((len(items), len(lengths)))
            for present, columns_held, gain in levels:
                _, at, rows = np.intersect1d(columns, present, assume_unique=True, return_indices=True)
                if len(at):
                    total += (weights[:, at] @ columns_held[rows].astype(float)) * gain
            yield items, total


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, versions, lengths = (batch.column(name)[i].values.to_numpy(zero_copy_only=False) for name in ("ids", "versions", "lengths"))
            yield batch.column("width")[i].as_py(), ids, versions, lengths, batch.column("slices")[i].as_py()


_FOUND = "item BIGINT, doc_id BIGINT, version BIGINT, bound DOUBLE"
_FOUND_ARROW = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int64()), ("bound", pa.float64())])


def _highest(queries, docs: int, terms: int, top: int):
    """A task's documents with the highest bounds of each item, ties by document id."""
    def run(batches):
        search, best = _Search(queries.value, docs, terms), {}
        for width, ids, versions, lengths, slices in _blocks(batches):
            for items, total in search.bounds(width, lengths, slices):
                floor = np.array([best[i][-1][0] if len(best.get(i, ())) == top else 0.5 for i in items.tolist()])
                hits = total >= floor[:, None]
                for line in np.flatnonzero(hits.any(axis=1)):
                    at = np.flatnonzero(hits[line])
                    at = at[np.lexsort((versions[at], ids[at], -total[line, at]))[:top]]
                    item = int(items[line])
                    new = zip(total[line, at].tolist(), ids[at].tolist(), versions[at].tolist())
                    best[item] = sorted([*best.get(item, ()), *new], key=lambda x: (-x[0], x[1], x[2]))[:top]
        rows = [(item, d, v, b) for item, found in best.items() for b, d, v in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND_ARROW.types)], schema=_FOUND_ARROW)
    return run


def _reaching(queries, docs: int, terms: int, floors):
    """The documents whose bounds reach the item's floor; at the floor itself, those that don't come after its document."""
    def run(batches):
        search = _Search(queries.value, docs, terms)
        for width, ids, versions, lengths, slices in _blocks(batches):
            for items, total in search.bounds(width, lengths, slices):
                least = [floors.value.get(i, (1, 2**63 - 1)) for i in items.tolist()]
                score = np.array([x for x, _ in least], dtype=float)[:, None]
                last = np.array([x for _, x in least], dtype=np.int64)[:, None]
                line, at = np.nonzero((total > score) | ((total == score) & (ids[None, :] <= last)))
                if len(line):
                    yield pa.RecordBatch.from_arrays([pa.array(items[line]), pa.array(ids[at]), pa.array(versions[at]), pa.array(total[line, at])], schema=_FOUND_ARROW)
    return run


def terms_of(text):
    """The terms of a text column, null's as none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def exact_scores(docs: DataFrame, pairs: DataFrame, queries: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(item, doc_id, version, copies, score) of the pairs (item, doc_id, version), from the whole texts.

    ``copies`` is the number of rows with that id and text.
    """
    named = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    texts = named.join(pairs.select("doc_id", "version").distinct(), ["doc_id", "version"], "left_semi")
    texts = texts.groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("copies"), F.any_value("text").alias("text"))
    listed = texts.select("doc_id", "version", "copies", terms_of(F.col("text")).alias("terms"))
    found = listed.select("doc_id", "version", "copies", F.size("terms").cast("long").alias("n"), F.explode("terms").alias("term"))
    wanted = found.join(queries.select("term").distinct(), "term", "left_semi")
    tf = wanted.groupBy("doc_id", "version", "copies", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    m = F.expr(f"25 + (75 * n * {n_docs}L) div {n_terms}L")
    part = F.expr("weight * ((1000000000L * tf) div (1000 * tf + 8 * m))")
    return (
        tf.withColumn("m", m).join(pairs.select("item", "doc_id", "version"), ["doc_id", "version"]).join(queries, ["item", "term"])
        .groupBy("item", "doc_id", "version", "copies").agg(F.sum(part).alias("score"))
    )


def _ranked(scores: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each item, as often as their documents are there."""
    each = scores.where("score > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(top)).cast("int"))))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "version", "copy")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, *, top: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents (doc_id, text) of each item (item_id, text).

    Ties go by document id, then by the text's hash. Null and empty texts have no terms: such items have no results and
    such documents are never found nor counted. Documents without an id count but are not returned; items without an id
    are not searched for. Every row is a document, so repeated rows have ranks of their own; rows of ``items`` that
    repeat an id with different texts are searched for separately, equal ones once. Other columns are ignored. Empty
    tables give an empty result.
    """
    spark = docs.sparkSession
    index = stored(build_index(docs))
    totals = index.where("kind = 'all'").agg(F.sum("docs"), F.sum("terms")).first()  # one row
    n_docs, n_terms = totals[0] or 0, totals[1] or 0
    texts = items.where(F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    asked = texts.select("item_id", F.xxhash64("text").alias("query"), F.explode(terms_of(F.col("text"))).alias("term"))
    asked = asked.groupBy("item_id", "query", "term").agg(F.count(F.lit(1)).alias("said"))
    asked = asked.withColumn("item", F.xxhash64("item_id", "query"))
    df = index.where("kind = 'term'").select("term", "df").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1)))
    queries = stored(asked.join(df, "term").withColumn("weight", weight * F.col("said")).where("weight > 0").select("item_id", "item", "term", "weight"))
    groups = -(-queries.count() // GROUP_TERMS)
    blocks = index.where("kind = 'block'").select("width", "ids", "versions", "lengths", "slices")
    results = []
    for group in range(groups):
        mine = queries.where(F.pmod("item", F.lit(groups)) == group)
        shared = spark.sparkContext.broadcast([(r["item"], r["term"], r["weight"]) for r in mine.select("item", "term", "weight").collect()])  # GROUP_TERMS on average
        high = blocks.mapInArrow(_highest(shared, n_docs, n_terms, top), _FOUND)
        by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id", "version")
        first = stored(high.withColumn("rank", F.row_number().over(by_bound)).where(F.col("rank") <= top))
        ends = _ranked(exact_scores(docs, first, mine, n_docs, n_terms), top).where(F.col("rank") == top)
        floors = spark.sparkContext.broadcast({r["item"]: (r["score"], r["doc_id"]) for r in ends.select("item", "score", "doc_id").collect()})  # one row an item
        pairs = stored(blocks.mapInArrow(_reaching(shared, n_docs, n_terms, floors), _FOUND).select("item", "doc_id", "version").distinct())
        ranked = _ranked(exact_scores(docs, pairs, mine, n_docs, n_terms), top)
        names = mine.select("item", "item_id").distinct()
        results.append(ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    out = spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank INT, doc_id BIGINT, score BIGINT")
    for found in results:
        out = out.unionByName(stored(found))
    return out
