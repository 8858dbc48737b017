"""Sinks. Each write is one Spark job; nothing passes through the driver."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, base: str, *, version: str) -> str:
    """Write one complete version, then list it; readers only follow the list."""
    path = f"{base}/data/version={version}"
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(f"{base}/log")
    return path


def read_latest(spark: SparkSession, base: str) -> DataFrame:
    """The newest listed version (versions order as text)."""
    newest = spark.read.schema("version STRING").parquet(f"{base}/log").agg(F.max("version")).first()[0]
    if newest is None:
        raise ValueError(f"no version listed under {base}")
    return spark.read.parquet(f"{base}/data/version={newest}")


def _content(df: DataFrame) -> tuple:
    """Order-insensitive content digest: row count and two sums of independent row hashes."""
    columns = sorted(df.columns)
    plain = df.select(*[
        F.to_json(F.struct(F.col(f"`{name}`").alias("v")), {"ignoreNullFields": "false"}).alias(name) for name in columns
    ])
    hashes = [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)]
    row = plain.agg(F.count("*"), *[F.sum(value.cast("decimal(38,0)")) for value in hashes]).first()
    return tuple(columns), tuple(row)


def write_immutable(df: DataFrame, path: str) -> bool:
    """Create once. False when the same rows are there already, an error when others are."""
    spark = df.sparkSession
    try:
        existing = spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        df.write.mode("errorifexists").parquet(path)
        return True
    if _content(existing) == _content(df):
        return False
    raise ValueError(f"immutable table already exists with different content: {path}")


def archive_monthly(rows: DataFrame, base: str, *, run: str) -> None:
    """Write expired rows as gzip JSON, one folder per month and run; a run that is repeated replaces its own."""
    (
        rows.withColumn("month", F.date_format("observed_at", "yyyy-MM")).withColumn("run", F.lit(run))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "run").option("compression", "gzip").json(base)
    )


def write_telemetry(events: DataFrame, base: str) -> None:
    """Append stage events by UTC date; there is no rotation step."""
    events.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").json(base)


def write_usage(usage: DataFrame, base: str) -> None:
    """Append ledger rows by UTC date."""
    usage.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").json(base)


def write_history(history: DataFrame, base: str) -> None:
    """Replace the UTC-date partitions that occur in ``history``; other dates stay."""
    (
        history.withColumn("date", F.to_date("observed_at"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(base)
    )


def write_documents(df: DataFrame, base: str, *, key: str, by: str) -> None:
    """One JSON document per value of ``by``, ``{"<key>": [rows]}``, each written by one task as a stream of lines."""
    names = [name for name in df.columns if name != by]
    body = df.select(F.col(by), F.lit(1).alias("_kind"), F.to_json(F.struct(*[f"`{name}`" for name in names]), {"ignoreNullFields": "false"}).alias("_line"))
    groups = df.select(by).distinct()
    frame = [groups.select(by, F.lit(part).alias("_kind"), F.lit(line).alias("_line")) for part, line in ((0, f'{{"{key}": ['), (2, "]}"))]
    ordered = frame[0].union(body).union(frame[1])
    # every row but the first is led by a comma: the window only looks one row back
    before = F.lag("_kind").over(Window.partitionBy(by).orderBy("_kind", "_line"))
    lines = ordered.select(by, F.concat(F.when((F.col("_kind") == 1) & (before == 1), ",").otherwise(""), F.col("_line")).alias("value"))
    lines.write.partitionBy(by).text(base)
