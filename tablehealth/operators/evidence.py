"""Per-record evidence for one payload table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth import params
from tablehealth.functions import cadence, times
from tablehealth.functions.text import canonical_json, sha256_text
from tablehealth.operators.skew import numbered


def dataset_freshness_status(entries: DataFrame, *, run_date: date | str) -> DataFrame:
    """``freshness_status`` and ``age_days`` of catalogue rows with ``source_last_modified``.

    A source modified after the run date fails the job.
    """
    def column(name: str, kind: str) -> Column:
        return F.col(name) if name in entries.columns else F.lit(None).cast(kind)

    modified = times.utc_day(F.col("source_last_modified"))
    raw_age = F.datediff(times.lit_day(run_date), modified)
    future = F.raise_error(F.lit("source last-modified timestamp is in the future")).cast("int")
    window = cadence.evidence_window_days(F.col("dataset_id"), F.col("refresh_frequency"))
    gone = F.coalesce(column("discontinued", "boolean"), F.lit(False)) | F.coalesce(
        column("real_status", "string") == "discontinued", F.lit(False)
    )
    age = F.col("age_days")
    status = (
        F.when(gone, "discontinued")
        .when(column("data_type", "string") == "reference", "reference")
        .when(age.isNull() | window.isNull(), "unknown-freshness")
        .when(age <= window, "fresh")
        .when(age <= 3 * window, "aging")
        .otherwise("stale")
    )
    return entries.withColumn("age_days", F.when(raw_age < 0, future).otherwise(raw_age)).withColumn(
        "freshness_status", status
    )


def identifier_field(columns: list[str]) -> str:
    """The first known identifier column, else the first column."""
    return next((name for name in params.IDENTIFIER_CANDIDATES if name in columns), columns[0])


def _explanation(modified: Column, age: Column, ok: Column, missing: Column, linked: Column, unmatched: Column) -> Column:
    return canonical_json({
        "alternatives": F.array().cast("array<string>"),
        "freshness": F.struct(age.alias("age_days"), modified.alias("source_last_modified")),
        "linkage": F.struct(linked.alias("linked_to"), unmatched.alias("unmatched")),
        "structural": F.struct(missing.alias("missing_required_fields"), ok.alias("schema_ok")),
    })


def record_evidence(
    records: DataFrame,
    *,
    dataset_id: str,
    freshness_status: str,
    source_last_modified: str | None,
    age_days: int | None,
    row_no: str = "row_no",
    id_col: str | None = None,
    width_col: str | None = None,
    link_fields: tuple = params.LINK_FIELDS,
) -> DataFrame:
    """One evidence row per record; record ids are unique through ``#n`` suffixes.

    ``row_no`` is a stable, unique, whole-number row key assigned at ingest.
    ``width_col`` may carry the parsed field count of ragged rows.
    """
    header = [name for name in records.columns if name not in (row_no, width_col)]
    field = id_col or identifier_field(header)
    registry = dataset_id == params.REGISTRY_DATASET
    identifier = F.trim(F.coalesce(F.col(field).cast("string"), F.lit("")))
    problems = []
    if width_col is not None:
        problems.append(F.when(F.col(width_col) != len(header), F.lit("$row_width")))
    blank = F.when(identifier == "", F.lit(field))
    if registry:
        blank = blank.when(~identifier.rlike(params.REGISTRATION_PATTERN), F.lit("reg_no:pattern"))
    problems.append(blank)
    missing = F.filter(F.array(*problems), lambda item: item.isNotNull())

    linked, unmatched = [], []
    for label_field, code_field, kind in link_fields if registry else ():
        label, code = (
            F.trim(F.coalesce(F.col(name), F.lit(""))) if name in header else F.lit("") for name in (label_field, code_field)
        )
        linked.append(F.when(code != "", F.struct(F.lit(kind).alias("kind"), F.concat(F.lit("osa_code:"), code).alias("to"))))
        unmatched.append(F.when((code == "") & (label != ""), F.concat(F.lit(f"{label_field}:"), label)))
    no_links = F.array().cast("array<struct<kind:string,to:string>>")
    linked_to = F.filter(F.array(*linked), lambda item: item.isNotNull()) if linked else no_links
    no_match = F.filter(F.array(*unmatched), lambda item: item.isNotNull()) if unmatched else F.array().cast("array<string>")

    shown = F.upper(identifier) if registry else identifier
    base = F.when(identifier == "", F.concat(F.lit("row:"), F.col(row_no).cast("string"))).otherwise(
        F.concat(F.lit(f"{field}:"), shown)
    )
    prepared = records.select(
        F.col(row_no).cast("bigint").alias("row_no"), base.alias("_base"), missing.alias("missing_required_fields"),
        linked_to.alias("linked_to"), no_match.alias("unmatched"),
    ).withColumn("schema_ok", F.size("missing_required_fields") == 0)
    explanation = _explanation(
        F.lit(source_last_modified).cast("string"), F.lit(age_days).cast("int"), F.col("schema_ok"),
        F.col("missing_required_fields"), F.col("linked_to"), F.col("unmatched"),
    )
    counted = numbered(prepared, ["_base"], "row_no", out="_nth")
    return counted.withColumn("explanation", explanation).select(
        "row_no",
        F.when(F.col("_nth") == 1, F.col("_base")).otherwise(
            F.concat("_base", F.lit("#"), F.col("_nth").cast("string"))
        ).alias("record_id"),
        F.when(F.col("schema_ok"), freshness_status).otherwise("degraded").alias("status"),
        "schema_ok",
        "missing_required_fields",
        "linked_to",
        "unmatched",
        "explanation",
        F.concat(F.lit("sha256:"), sha256_text(F.col("explanation"))).alias("evidence_digest"),
    )


def evidence_envelope(evidence: DataFrame, *, dataset_id: str, run_date: date | str) -> DataFrame:
    """Counts of one evidence table: total, schema-valid, and per status with zeros."""
    return evidence.agg(
        F.count("*").alias("record_count"),
        F.count_if("schema_ok").alias("schema_valid_count"),
        *[F.count_if(F.col("status") == name).alias(f"status_{name.replace('-', '_')}") for name in params.STATUSES],
    ).select(F.lit(dataset_id).alias("dataset_id"), times.lit_day(run_date).alias("run_date"), "*")


def validate_evidence(evidence: DataFrame, envelope: DataFrame, *, age_days: int | None, source_last_modified: str | None) -> DataFrame:
    """Findings (``rule``, ``subject``); empty when the evidence is consistent.

    Rules: unique record ids, digests that match their explanation, freshness equal
    to the envelope, status counts that match the records and sum to the total.
    """
    def finding(rule: str, subject: Column) -> list[Column]:
        return [F.lit(rule).alias("rule"), subject.cast("string").alias("subject")]

    repeated = (
        evidence.groupBy("record_id").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
        .select(*finding("record_id values must be unique", F.col("record_id")))
    )
    expected = F.concat(F.lit("sha256:"), sha256_text(F.col("explanation")))
    tampered = evidence.where(~F.col("evidence_digest").eqNullSafe(expected)).select(
        *finding("evidence_digest does not match explanation", F.col("record_id"))
    )
    stated_age = F.get_json_object("explanation", "$.freshness.age_days").cast("int")
    stated_time = F.get_json_object("explanation", "$.freshness.source_last_modified")
    differing = evidence.where(
        ~stated_age.eqNullSafe(F.lit(age_days).cast("int"))
        | ~stated_time.eqNullSafe(F.lit(source_last_modified).cast("string"))
    ).select(*finding("record freshness differs from envelope freshness", F.col("record_id")))
    names = [f"status_{name.replace('-', '_')}" for name in params.STATUSES]
    stored = envelope.select(
        "record_count", "schema_valid_count",
        F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in params.STATUSES]), F.array(*names))).alias("status", "stored"),
    )
    actual = evidence.groupBy("status").agg(F.count("*").alias("actual"))
    counts = stored.join(actual, "status", "full").where(
        F.coalesce("stored", F.lit(0)) != F.coalesce("actual", F.lit(0))
    ).select(*finding("status_distribution does not match records", F.col("status")))
    total = F.lit(0)
    for name in names:
        total = total + F.col(name)
    sums = envelope.where(total != F.col("record_count")).select(
        *finding("status_distribution counts must sum to record_count", F.col("dataset_id"))
    )
    valid = envelope.where(F.col("schema_valid_count") > F.col("record_count")).select(
        *finding("schema_valid_count must not exceed record_count", F.col("dataset_id"))
    )
    result = repeated
    for part in (tampered, differing, counts, sums, valid):
        result = result.unionByName(part)
    return result


def representative_excerpt(evidence: DataFrame, *, n: int = params.EXCERPT_SIZE) -> DataFrame:
    """The first record of each status in domain order, filled up to ``n`` in row order."""
    if n < 1:
        raise ValueError("excerpt size must be at least 1")
    firsts = evidence.groupBy("status").agg(F.min("row_no").alias("row_no"))
    rank = cadence.lookup(F.col("status"), {name: i for i, name in enumerate(params.STATUSES)})
    firsts = firsts.select("row_no", rank.alias("_rank"))
    marked = evidence.join(firsts, "row_no", "left")
    return marked.orderBy(F.col("_rank").asc_nulls_last(), "row_no").limit(n).drop("_rank").orderBy("row_no")
