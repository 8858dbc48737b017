"""Building blocks that stay parallel when one key holds a large share of the rows.

A plain ``Window.partitionBy(key)`` sorts all rows of a hot key in one task. The
functions here cut the ordering axis into chunks, do the work per (key, chunk),
and finish on one small row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_rows(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """The same rows; the job fails if a key occurs twice."""
    rest = [name for name in df.columns if name not in keys]
    message = F.concat(F.lit(f"duplicate {label}: "), F.concat_ws("/", *keys))
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_n"), F.any_value(F.struct(*rest)).alias("_row"))
        .withColumn("_row", F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(message)))
        .select(*keys, "_row.*")
    )


def latest_by(df: DataFrame, keys: Sequence[str | Column], order: Column) -> DataFrame:
    """One whole row per key: the one with the greatest ``order``.

    ``max_by`` combines on the map side, so a hot key costs one row per task.
    """
    names = [key if isinstance(key, str) else None for key in keys]
    assert all(names), "keys must be column names"
    rest = [name for name in df.columns if name not in names]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def numbered(
    df: DataFrame, keys: Sequence[str], order: str, *, chunk: int = 1_000_000, out: str = "occurrence"
) -> DataFrame:
    """Exact 1-based row number per key along a unique whole-number column.

    Same values as ``row_number() over (partition by keys order by order)``, but
    no task ever sorts more than ``chunk`` order values of one key: rows are
    numbered inside their chunk and shifted by the count of earlier chunks.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(order)
    local = chunked.withColumn("_local", F.row_number().over(inner))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.count("*").alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .select(*[F.col(key).alias(f"_k{i}") for i, key in enumerate(keys)], F.col("_chunk").alias("_c"), "_offset")
    )
    same = F.col("_chunk") == F.col("_c")
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_k{i}"))
    return (
        local.join(offsets, same, "inner")
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("bigint"))
        .drop("_chunk", "_local", "_offset", "_c", *[f"_k{i}" for i in range(len(keys))])
    )


def change_runs(
    rows: DataFrame, key: str, ts: str, tie: str, fields: Sequence[str], counted: Column, *, chunk: str = "hour"
) -> DataFrame:
    """Adjacent changes of each field along time, nulls skipped, per key.

    For field ``f`` the result has ``f_changes``, ``f_last_change`` (timestamp of
    the latest counted change) and ``f_samples`` (counted non-null rows). A change
    counts when its later row satisfies ``counted``.
    """
    steps = rows.withColumn("_counted", counted).withColumn("_chunk", F.date_trunc(chunk, ts))
    order = F.struct(ts, tie)
    before = (
        Window.partitionBy(key, "_chunk").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    )
    for field in fields:
        steps = steps.withColumn(f"_prev_{field}", F.last(field, ignorenulls=True).over(before))

    chunk_aggs = []
    for field in fields:
        changed = (F.col(f"_prev_{field}") != F.col(field)) & F.col("_counted")
        present = F.when(F.col(field).isNotNull(), order)
        chunk_aggs += [
            F.count_if(changed).alias(f"_{field}_changes"),
            F.max(F.when(changed, F.col(ts))).alias(f"_{field}_last"),
            F.count_if(F.col(field).isNotNull() & F.col("_counted")).alias(f"_{field}_samples"),
            F.min_by(F.struct(F.col(field).alias("v"), F.col(ts).alias("t"), F.col("_counted").alias("c")), present).alias(f"_{field}_head"),
            F.max_by(F.col(field), present).alias(f"_{field}_tail"),
        ]
    chunks = steps.groupBy(key, "_chunk").agg(*chunk_aggs)

    # one row per (key, chunk) from here on
    across = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    for field in fields:
        chunks = chunks.withColumn(f"_{field}_before", F.last(f"_{field}_tail", ignorenulls=True).over(across))
    final = []
    for field in fields:
        head = F.col(f"_{field}_head")
        crossing = (F.col(f"_{field}_before") != head["v"]) & head["c"]
        final += [
            (F.sum(f"_{field}_changes") + F.count_if(crossing)).alias(f"{field}_changes"),
            F.max(F.greatest(F.col(f"_{field}_last"), F.when(crossing, head["t"]))).alias(f"{field}_last_change"),
            F.sum(f"_{field}_samples").alias(f"{field}_samples"),
        ]
    return chunks.groupBy(key).agg(*final)


def change_events(
    rows: DataFrame, key: str, ts: str, tie: str, fields: Sequence[str], *, chunk: str = "hour"
) -> DataFrame:
    """The changes themselves: ``key, field, from_value, to_value, at``, nulls skipped.

    Changes inside a chunk come from that chunk's rows, changes between chunks from
    one head and one tail per chunk.
    """
    steps = rows.withColumn("_chunk", F.date_trunc(chunk, ts))
    order = F.struct(ts, tie)
    before = Window.partitionBy(key, "_chunk").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    for field in fields:
        steps = steps.withColumn(f"_prev_{field}", F.last(field, ignorenulls=True).over(before))

    def event(field: str, was: Column, now: Column, at: Column) -> Column:
        return F.when(was != now, F.struct(
            F.lit(field).alias("field"), was.cast("string").alias("from_value"), now.cast("string").alias("to_value"), at.alias("at"),
        ))

    def events(df: DataFrame, items: list[Column]) -> DataFrame:
        return df.select(key, F.inline(F.filter(F.array(*items), lambda item: item.isNotNull())))

    inside = events(steps, [event(f, F.col(f"_prev_{f}"), F.col(f), F.col(ts)) for f in fields])
    ends = []
    for field in fields:
        present = F.when(F.col(field).isNotNull(), order)
        ends += [
            F.min_by(F.struct(F.col(field).alias("v"), F.col(ts).alias("t")), present).alias(f"_{field}_head"),
            F.max_by(F.col(field), present).alias(f"_{field}_tail"),
        ]
    chunks = steps.groupBy(key, "_chunk").agg(*ends)
    across = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    for field in fields:
        chunks = chunks.withColumn(f"_{field}_before", F.last(f"_{field}_tail", ignorenulls=True).over(across))
    between = events(chunks, [
        event(f, F.col(f"_{f}_before"), F.col(f"_{f}_head")["v"], F.col(f"_{f}_head")["t"]) for f in fields
    ])
    return inside.unionByName(between)
