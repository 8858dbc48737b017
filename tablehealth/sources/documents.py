"""One large JSON document read by many tasks.

A document is read as text cut after every ``}``, so Spark splits the file by bytes as it splits any text. Whether a piece
starts inside a string, and at which depth, depends on all text before it; both are running sums, of quotes and of brackets,
taken in two levels: within a split and over the splits. A record of the wanted array is then the run of pieces up to the one
after which the depth is again that of the array.

No escape reaches from one piece into the next, as no JSON escape ends in a brace. A split has at most
``spark.sql.files.maxPartitionBytes``; the table of splits has one row each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablehealth.session import stored

SPLIT = ["file", "block"]
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[\[\]{}]', re.S)
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*(?:"|\Z)', re.S)


def _before(rows: DataFrame, amount: Column, name: str) -> DataFrame:
    """``rows`` and the sum of ``amount`` over all pieces before each in its file, as ``name``."""
    earlier = Window.unboundedPreceding, -1
    totals = rows.groupBy(*SPLIT).agg(F.sum(amount).alias("_total"))
    over_splits = Window.partitionBy("file").orderBy("block").rowsBetween(*earlier)
    starts = totals.select(*SPLIT, F.coalesce(F.sum("_total").over(over_splits), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*SPLIT).orderBy("row").rowsBetween(*earlier)
    found = rows.join(starts, SPLIT).withColumn(name, F.col("_start") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return found.drop("_start")


def _structure(text: Column, in_string: Column) -> Column:
    """The brackets of a piece that stand outside strings, in order."""
    plain = F.regexp_replace(text, r"(?s)\\.", "")
    outside = F.when(in_string, F.regexp_replace(plain, r'^[^"]*("|$)', "")).otherwise(plain)
    return F.regexp_replace(F.regexp_replace(outside, r'"[^"]*("|$)', ""), r"[^\[\]{]+", "")


def _count(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character)))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, row, value, in_string, depth, after): pieces of the documents, ordered by (block, row) within a file.

    ``value`` is without its closing brace; ``in_string`` and ``depth`` hold at its start, ``after`` is the depth behind the brace.
    The last piece of a file is taken to have a brace too: if it has none, its ``after`` is -1.
    """
    text = spark.read.option("lineSep", "}").text(path)
    found = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("row"), "value")
    found = stored(found.withColumn("quotes", _count(F.regexp_replace("value", r"(?s)\\.", ""), '"')))
    found = _before(found, F.col("quotes"), "quotes_before").withColumn("in_string", F.col("quotes_before") % 2 == 1)
    structure = _structure(F.col("value"), F.col("in_string"))
    closed = F.when((F.col("quotes_before") + F.col("quotes")) % 2 == 0, 1).otherwise(0)
    change = 2 * F.length(F.replace(structure, F.lit("]"))) - F.length(structure) - closed
    found = stored(found.select(*SPLIT, "row", "value", "in_string", structure.alias("structure"), change.alias("change"), (closed == 1).alias("closed")))
    return _before(found, F.col("change"), "depth").withColumn("after", F.col("depth") + F.col("change")).drop("change")


def array_starts(text: str, in_string: bool, depth: int, keys: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """(rank of the key, characters up to and with the bracket) of the arrays that open in a piece.

    Looked for are members of the outermost object with one of the keys, or the outermost array if there are no keys.
    """
    at = _REST_OF_STRING.match(text).end() if in_string else 0
    name, name_end = None, 0
    for token in _TOKEN.finditer(text, at):
        found = token.group()
        if found[0] == '"':
            name, name_end = found[1:-1], token.end()
            continue
        if found == "[" and not keys and depth == 0:
            yield 0, token.end()
        if found == "[" and depth == 1 and name in keys and text[name_end:token.start()].strip() == ":":
            yield keys.index(name), token.end()
        depth += 1 if found in "[{" else -1


def split_documents(spark: SparkSession, path: str, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Records and rests of the JSON documents below ``path``: (file, number, record), (file, key, rest).

    ``keys`` name the member of the outermost object that holds the records, the first one that a document has as an array;
    without keys the document itself is the array. ``record`` is the text of one element on one line, ``number`` its place. ``rest`` is
    the document without the elements of the array, in one row as with any reader; ``key`` is null if it has no such array
    (empty without keys). Of a key that stands twice the first holds. A document whose brackets don't close, or an element that is no
    object, is an error. A document without text has no row.
    """
    found = stored(pieces(spark, path))
    ends = found.groupBy("file").agg(F.max_by("after", F.struct("block", "row")).alias("after"), F.min("after").alias("least"))
    broken = ends.where(~F.col("after").isin(0, -1) | (F.col("least") < -1)).first()
    if broken:
        raise ValueError(f"not one complete JSON document: {broken['file']}")

    @F.pandas_udf("array<struct<rank: int, offset: int>>")
    def starts_in(value: pd.Series, in_string: pd.Series, depth: pd.Series) -> pd.Series:
        return pd.Series([[{"rank": r, "offset": o} for r, o in array_starts(*piece, keys)] for piece in zip(value, in_string, depth)])

    # only pieces that hold a key, or the start of the document, go through Python
    if keys:
        likely = F.lit(False)
        for key in keys:
            likely = likely | F.contains(F.col("value"), F.lit(f'"{key}"'))
    else:
        likely = F.col("depth") == 0
    places = found.where(likely).select("file", "block", "row", F.explode(starts_in("value", "in_string", "depth")).alias("p"))
    first = places.groupBy("file").agg(F.min(F.struct("p.rank", "block", "row", "p.offset")).alias("start"))
    name = F.element_at(F.array(*[F.lit(k) for k in keys or ("",)]), F.col("start.rank") + 1)
    first = first.withColumn("key", name)
    base = 2 if keys else 1
    marked = found.join(first, "file", "left")
    order, start = F.struct("block", "row"), F.struct("start.block", "start.row")
    inside = stored(marked.where(order >= start).withColumns({
        "opening": order == start,
        "value": F.when(order == start, F.expr("substring(value, start.offset + 1)")).otherwise(F.col("value")),
        "in_string": F.col("in_string") & (order != start),
        "depth": F.when(order == start, base).otherwise(F.col("depth")),
    }).withColumn("structure", F.when(F.col("opening"), _structure(F.col("value"), F.col("in_string"))).otherwise(F.col("structure"))))
    last = inside.where((F.col("depth") == base) & F.col("structure").startswith("]") & ~F.col("in_string")).groupBy("file").agg(
        F.min(F.struct("block", "row", "value")).alias("last"))
    last = stored(last)
    ends_at = F.struct("last.block", "last.row")
    body = inside.join(last, "file").where(order < ends_at).drop("last", "start")
    is_end = F.col("closed") & (F.col("after") == base)
    numbered = _before(stored(body), F.when(is_end, 1).otherwise(0), "number")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "row", "value"))), lambda p: F.concat(p["value"], F.lit("}")))
    joined = numbered.groupBy("file", "number").agg(F.regexp_replace(F.concat_ws("", parts), r"[\r\n]+", " ").alias("text"))
    separated = F.regexp_extract("text", r"(?s)^\s*(,?)\s*\{", 0) != ""
    record = F.when(separated, F.regexp_replace("text", r"^[\s,]+", "")).otherwise(
        F.raise_error(F.concat(F.lit("the array must hold objects only: "), F.substring("text", 1, 200))))
    records = joined.select("file", "number", record.alias("record"))

    tail = F.regexp_replace("last.value", r"^[^\]]*", "")
    blank = F.col("last.value").rlike(r"^\s*\]")
    checked = F.when(blank, tail).otherwise(F.raise_error(F.lit("the array must hold objects only")))
    outside = marked.join(last, "file", "left")
    known = F.col("start").isNotNull()
    brace = F.when(F.col("after") >= 0, "}").otherwise("")
    upto = F.expr("substring(value, 1, start.offset)")
    text = (F.when(~known | (order < start), F.concat("value", brace))
            .when((order == start) & (order == ends_at), F.concat(upto, checked, brace))
            .when(order == start, upto)
            .when(order == ends_at, F.concat(checked, brace))
            .when(order > ends_at, F.concat("value", brace)))
    kept = outside.select("file", "block", "row", text.alias("text"), "key").where("text is not null")
    whole = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("block", "row", "text"))), lambda p: p["text"]))
    whole = F.regexp_replace(whole, "^\ufeff", "")
    rests = kept.groupBy("file").agg(F.first("key").alias("key"), whole.alias("rest"))
    return records, rests
