"""Typed reads of histories, documents, ledgers and payloads."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tablehealth import schemas
from tablehealth.functions import times
from tablehealth.session import scratch_path
from tablehealth.sources import documents

WRAPPER_FIELDS = ("data", "result", "results", "records", "items", "rows")


def _fields(ddl: str) -> list[tuple[str, str]]:
    """(name, type) of a flat DDL schema."""
    return [tuple(part.split(None, 1)) for part in " ".join(ddl.split()).split(", ")]


def _typed(value: Column, kind: str) -> Column:
    """Text to a type; unusable text is null, and a boolean is never a number."""
    if kind == "STRING":
        return value
    if kind == "TIMESTAMP":
        return times.parse_instant(value)
    if kind == "DATE":
        return F.to_date(times.parse_instant(F.substring(value, 1, 10)))
    if kind in ("BIGINT", "INT"):
        return F.floor(value.try_cast("double")).try_cast(kind.lower())
    if kind == "BOOLEAN":
        return F.when(value == "true", True).when(value == "false", False)
    return value.try_cast(kind.lower())


def read_history(spark: SparkSession, path: str, *, mode: str = "tolerant") -> DataFrame:
    """JSON-lines history. Tolerant skips malformed lines and rows without a dataset id; strict fails on them.

    Every field is read as text first, so one odd value never costs the row.
    """
    if mode not in ("tolerant", "strict"):
        raise ValueError("mode must be 'tolerant' or 'strict'")
    columns = [(name, kind) for name, kind in _fields(schemas.HISTORY) if name != "seq"]
    text_schema = ", ".join(f"{name} STRING" for name, _ in columns) + ", _corrupt_record STRING"
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_file")).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    rows = lines.withColumn("_row", F.from_json("value", text_schema, options))
    shaped = F.ltrim(F.col("value")).startswith("{")
    has_id = shaped & F.col("_row._corrupt_record").isNull() & F.col("_row.dataset_id").isNotNull()
    if mode == "tolerant":
        rows = rows.where(has_id)
    else:
        complete = has_id & F.col("_row.cycle").isNotNull() & times.parse_instant(F.col("_row.observed_at")).isNotNull()
        message = F.concat(F.lit("invalid history line in "), F.col("_file"), F.lit(": "), F.substring("value", 1, 200))
        rows = rows.withColumn(
            "_row", F.when(complete, F.col("_row")).otherwise(F.raise_error(message))
        )
    return rows.select(
        *[_typed(F.col(f"_row.{name}"), kind).alias(name) for name, kind in columns], F.lit(None).cast("bigint").alias("seq")
    )


def _document(spark: SparkSession, path: str, ddl: str, head: str, *, array: str = "datasets", in_splits: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents (head fields and ``found``, whether they have the array), and their entries (head fields, ``entry``)."""
    if not in_splits:
        whole = spark.read.schema(f"{head}, {array} ARRAY<STRUCT<{ddl}>>").option("multiLine", True).json(path)
        heads = whole.withColumn("found", F.col(array).isNotNull()).drop(array)
        return heads, whole.withColumn("entry", F.explode(array)).drop(array)
    records, rests = documents.split_documents(spark, path, array)
    heads = rests.select("file", F.col("key").isNotNull().alias("found"), F.from_json("rest", head).alias("h")).select("file", "h.*", "found")
    entries = records.select("file", F.from_json("record", f"STRUCT<{ddl}>").alias("entry")).join(heads.drop("found"), "file")
    return heads.drop("file"), entries.drop("file")


def _entries(heads: DataFrame, entries: DataFrame, valid: Column, message: str) -> DataFrame:
    """``entries``, and an error if a document is not valid."""
    wrong = heads.where(~F.coalesce(valid, F.lit(False))).select(F.raise_error(F.lit(message)).cast("boolean").alias("wrong"))
    fields = [F.col(f"`{name}`") for name in entries.columns]
    bad = wrong.where("wrong").select(*[F.lit(None).cast(entries.schema[name].dataType).alias(name) for name in entries.columns])
    return entries.select(*fields).union(bad)


def _struct_ddl(columns: list[tuple[str, str]], text: tuple[str, ...] = ()) -> str:
    return ", ".join(f"{name}: {'STRING' if name in text else kind}" for name, kind in columns)


def read_catalog(spark: SparkSession, path: str, *, version_field: str = "$schema", in_splits: bool = False) -> DataFrame:
    """Catalogue document with a ``datasets`` array (``id`` becomes ``dataset_id``).

    ``supersedes`` may be one id or an array. A document without the array fails.
    One document is one task; ``in_splits`` reads a large one by many, at the price of two passes and three shuffles of its text.
    """
    columns = [("id" if name == "dataset_id" else name, kind) for name, kind in _fields(schemas.CATALOG)]
    heads, entries = _document(spark, path, _struct_ddl(columns, ("supersedes",)), f"`{version_field}` STRING", in_splits=in_splits)
    entries = _entries(heads, entries, F.col("found"), "the catalogue must contain a datasets array")
    rows = entries.select(F.col(f"`{version_field}`").alias("manifest_version"), "entry.*")
    listed = F.when(F.col("supersedes").startswith("["), F.from_json("supersedes", "array<string>")).when(
        F.col("supersedes").isNotNull(), F.array("supersedes")
    )
    return rows.withColumn("supersedes", listed).withColumnRenamed("id", "dataset_id")


def read_snapshot(spark: SparkSession, path: str, *, in_splits: bool = False) -> DataFrame:
    """Snapshot document; ``checked_at`` must be a timestamp with an offset. ``in_splits`` reads one document by many tasks."""
    columns = [
        ("dataset_id", "STRING"), ("last_checked", "STRING"), ("namespace", "STRING"), ("url", "STRING"), ("status", "STRING"),
        ("message", "STRING"), ("request_url", "STRING"), ("access_method", "STRING"), ("http_status", "INT"),
        ("content_length", "BIGINT"), ("last_modified", "STRING"), ("content_freshness_date", "STRING"),
        ("record_count", "BIGINT"), ("record_count_estimated", "BOOLEAN"), ("incomplete", "BOOLEAN"), ("column_count", "INT"),
        ("first_row_hash", "STRING"), ("content_shape_changed", "BOOLEAN"), ("expected_record_count", "BIGINT"),
        ("record_count_within_tolerance", "BOOLEAN"), ("staleness_days", "DOUBLE"), ("staleness_status", "STRING"),
        ("access_dependency", "STRING"), ("freshness_signal", "STRING"), ("freshness_signal_source", "STRING"),
        ("anomaly_detected", "BOOLEAN"),
    ]
    heads, entries = _document(spark, path, _struct_ddl(columns), "schema STRING, checked_at STRING", in_splits=in_splits)
    checked = times.parse_instant(F.col("checked_at"))
    entries = _entries(heads, entries, F.col("found") & checked.isNotNull(), "the snapshot must contain a datasets array and a checked_at with a UTC offset")
    rows = entries.select(checked.alias("checked_at"), "entry.*")
    return rows.withColumns({
        "last_checked": times.parse_instant(F.col("last_checked")),
        "last_modified": times.parse_instant(F.col("last_modified")),
        "content_freshness_date": F.to_date(times.parse_instant(F.col("content_freshness_date"))),
    })


def read_daily(spark: SparkSession, path: str, *, schema_name: str | None = None, mode: str = "tolerant", in_splits: bool = False) -> DataFrame:
    """Aggregates from a document with ``schema`` and ``aggregates``; an unsupported schema is empty, or an error when strict.

    ``in_splits`` reads one document by many tasks.
    """
    heads, entries = _document(spark, path, _nested_ddl(schemas.DAILY), "schema STRING", array="aggregates", in_splits=in_splits)
    named = F.lit(True) if schema_name is None else F.coalesce(F.col("schema") == schema_name, F.lit(False))
    if mode == "strict":
        return _entries(heads, entries, F.col("found") & named, "daily history has an unsupported schema").select("entry.*")
    return entries.where(named).select("entry.*")


def _nested_ddl(ddl: str) -> str:
    """Top-level ``name TYPE`` pairs as struct fields."""
    parts, depth, current = [], 0, ""
    for char in " ".join(ddl.split()):
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            parts.append(current.strip())
            current = ""
        else:
            current += char
    parts.append(current.strip())
    return ", ".join(f"{part.split(None, 1)[0]}: {part.split(None, 1)[1]}" for part in parts)


def _is_parquet(spark: SparkSession, path: str) -> bool:
    """Whether the first data file of a path starts with Parquet's magic bytes; four bytes are read."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = list(files.globStatus(target) or [])
    while found:
        entry = found.pop(0)
        name = entry.getPath().getName()
        if entry.isDirectory():
            found[:0] = list(files.listStatus(entry.getPath()))
        elif not name.startswith(("_", ".")) and entry.getLen() > 0:
            stream = files.open(entry.getPath())
            try:
                return [stream.read() for _ in range(4)] == list(b"PAR1")
            finally:
                stream.close()
    return False


def read_payload(spark: SparkSession, path: str, *, comment: str = "#", in_splits: bool = False) -> DataFrame:
    """An observed table: Parquet, JSON (plain array, one object, or wrapped rows) or CSV.

    The magic bytes tell Parquet, and a damaged Parquet file is an error; otherwise the
    first character decides between JSON and CSV. CSV columns stay text. ``in_splits`` reads one
    JSON document of objects by many tasks, by way of a JSON-lines copy in the scratch folder.
    """
    if _is_parquet(spark, path):
        return spark.read.parquet(path)
    start = F.substring(F.regexp_replace("value", "^[\ufeff\\s]+", ""), 1, 1).alias("start")
    first = spark.read.text(path).select(start).where(F.col("start") != "").limit(1).collect()  # one character
    if not first or first[0]["start"] not in ("{", "["):
        return spark.read.csv(path, header=True, comment=comment, enforceSchema=False)
    if in_splits:
        records, rests = documents.split_documents(spark, path, *(WRAPPER_FIELDS if first[0]["start"] == "{" else ()))
        lines = scratch_path(spark, "payload")
        single = rests.where("key is null").select(F.regexp_replace("rest", r"[\r\n]+", " "))  # one object
        records.select("record").union(single).write.text(lines)
        return spark.read.json(lines)
    rows = spark.read.option("multiLine", True).json(path)
    wrapped = next(
        (name for name in WRAPPER_FIELDS if name in rows.columns and isinstance(rows.schema[name].dataType, ArrayType)), None
    )
    if wrapped is None:
        return rows
    element = rows.schema[wrapped].dataType.elementType
    exploded = rows.select(F.explode(wrapped).alias("value"))
    return exploded.select("value.*") if isinstance(element, StructType) else exploded


def read_usage(spark: SparkSession, path: str, *, since: str, until: str) -> DataFrame:
    """Ledger rows of an inclusive UTC date range.

    Reads ``date=<day>`` partitions and ``<day>.jsonl`` files, whichever the folder
    has, or both; only the days asked for are listed.
    """
    start, end = date.fromisoformat(since), date.fromisoformat(until)
    if start > end:
        raise ValueError("since must be on or before until")
    days = [(start + timedelta(days=i)).isoformat() for i in range((end - start).days + 1)]
    found = spark.createDataFrame([], schemas.USAGE)
    for pattern in (f"{path}/date={{{','.join(days)}}}", f"{path}/{{{','.join(days)}}}.jsonl"):
        try:
            found = found.unionByName(spark.read.schema(schemas.USAGE).option("mode", "DROPMALFORMED").json(pattern))
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return found


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Stage events; lines that do not parse keep their text in ``_corrupt_record``."""
    return spark.read.schema(f"{schemas.TELEMETRY}, date DATE, _corrupt_record STRING").json(path)
