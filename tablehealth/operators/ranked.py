"""The ranked query surface and point lookups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth import params
from tablehealth.functions import cadence, text, times


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    if limit is None:
        return df
    if limit < 1:
        raise ValueError("limit must be positive")
    return df.limit(limit)


def with_health(catalog: DataFrame, snapshot: DataFrame, columns: list[str], *, default_status: str = "unknown") -> DataFrame:
    """Catalogue rows with health columns; a missing health row has the default status."""
    health = snapshot.select("dataset_id", *columns)
    joined = catalog.join(health, "dataset_id", "left")
    if "status" in columns:
        joined = joined.withColumn("status", F.coalesce("status", F.lit(default_status)))
    return joined


def search_datasets(
    catalog: DataFrame, snapshot: DataFrame, *, query: str, licence: str | None = None, source: str | None = None,
    limit: int | None = 10,
) -> DataFrame:
    """Term matches in title (weight 5) and description, with phrase bonuses."""
    phrase = " ".join(query.lower().split())
    terms = re.findall(r"[a-z0-9]+", phrase)
    title = F.lower(F.coalesce("name", F.lit("")))
    description = F.lower(F.coalesce("description", F.lit("")))
    score = F.lit(0)
    for term in terms:
        score = score + 5 * text.occurrences(title, term) + text.occurrences(description, term)
    score = score + F.when(text.squash(title) == phrase, 100).when(
        F.lit(bool(phrase)) & F.contains(title, F.lit(phrase)), 15
    ).otherwise(0)
    rows = catalog
    if licence:
        rows = rows.where(F.lower("licence") == F.lower(text.canonical_licence(F.lit(licence))))
    if source:
        rows = rows.where(F.contains(F.lower("source"), F.lit(source.lower().strip())))
    ranked = with_health(rows.withColumn("score", score.cast("bigint")).where(F.col("score") != 0), snapshot, ["status"]).select(
        "dataset_id", F.col("name").alias("title"), "source", "licence", "status", "score"
    ).orderBy(
        F.desc("score"), F.when(F.col("dataset_id").startswith("gtfs_static_"), 0).otherwise(1), "title", "dataset_id"
    )
    return _limited(ranked, limit)


def find_stale(catalog: DataFrame, snapshot: DataFrame, *, as_of, max_age_hours: int = 24) -> DataFrame:
    """Datasets without a health row, at freshness risk, or in an old snapshot."""
    if max_age_hours < 0:
        raise ValueError("max_age_hours must not be negative")
    health = snapshot.select(
        "dataset_id", "status", "message", "staleness_days", "access_dependency",
        F.col("expected_record_count").alias("_expected"), F.lit(True).alias("_present"),
    )
    checked = snapshot.agg(F.max("checked_at")).scalar()
    seconds = F.greatest(F.lit(0), F.floor(times.seconds_between(times.lit_instant(as_of), checked)))
    rows = catalog.select("dataset_id", "expected_record_count").join(health, "dataset_id", "left").withColumn(
        "age_seconds", F.when(checked.isNotNull(), seconds.cast("bigint"))
    )
    old = F.col("age_seconds").isNull() | (F.col("age_seconds") > max_age_hours * 3600)
    missing = F.col("_present").isNull()
    risky = F.coalesce(F.col("status").isin("aging", "stale", "degraded"), F.lit(False))
    message = (
        F.when(missing, "Missing from latest health snapshot")
        .when(old & ~risky, "Latest health snapshot is older than the requested maximum age")
        .otherwise(F.col("message"))
    )
    kept = missing | (~F.col("status").eqNullSafe(F.lit("reference")) & (risky | old))
    return rows.where(kept).select(
        "dataset_id",
        F.coalesce("status", F.lit("unknown")).alias("status"),
        message.alias("message"),
        "age_seconds",
        "staleness_days",
        F.coalesce("access_dependency", F.lit("direct")).alias("access_dependency"),
        F.coalesce("_expected", "expected_record_count").alias("expected_record_count"),
    )


def _grade_at_least(grade: Column, minimum: str) -> Column:
    return cadence.grade_rank(grade) <= params.GRADES.index(minimum)


def find_anomalies(
    catalog: DataFrame, snapshot: DataFrame, trends: DataFrame, *, limit: int | None = 50, mode: str | None = None,
    min_reliability: str | None = None,
) -> DataFrame:
    """Detected anomalies by severity (latest / threshold), then staleness, then id."""
    if mode is not None and mode not in ("rolling_14d", "cadence_fallback", "not_evaluated"):
        raise ValueError(f"unknown anomaly mode: {mode}")
    if min_reliability is not None:
        min_reliability = min_reliability.strip().upper()
        if min_reliability not in params.GRADES:
            raise ValueError(f"unknown minimum reliability grade: {min_reliability}")
    found = snapshot.where(F.coalesce("anomaly_detected", F.lit(False))).select(
        "dataset_id", "status", "staleness_days", "anomaly_detection"
    )
    if mode is not None:
        found = found.where(F.col("anomaly_detection.mode") == mode)
    graded = trends.select("dataset_id", "publish_on_time_pct", "reliability_grade", "reliability_sample_days")
    rows = catalog.select("dataset_id", F.col("name").alias("title")).join(found, "dataset_id").join(graded, "dataset_id", "left")
    if min_reliability is not None:
        rows = rows.where(_grade_at_least(F.col("reliability_grade"), min_reliability))
    latest, threshold = F.col("anomaly_detection.latest_days"), F.col("anomaly_detection.threshold_days")
    ranked = rows.withColumn(
        "severity_ratio", F.coalesce(F.when(threshold > 0, latest / threshold), F.lit(0.0))
    ).select(
        "dataset_id", "title", "status", "staleness_days", F.col("anomaly_detection.mode").alias("mode"),
        latest.alias("latest_days"), threshold.alias("threshold_days"), "severity_ratio", "anomaly_detection",
        "publish_on_time_pct", "reliability_grade", "reliability_sample_days",
    ).orderBy(F.desc("severity_ratio"), F.desc_nulls_last("staleness_days"), "dataset_id")
    return _limited(ranked, limit)


_TREND_COLUMNS = (
    "dataset_id", "title", "trend", "latest_status", "cadence_days", "latest_staleness_days", "slope_days_per_week",
    "trend_sample_days", "history_span_days", "publish_on_time_pct", "reliability_grade", "reliability_sample_days",
    "anomaly_rate_pct", "anomaly_sample_days", "reason",
)


def _titled(catalog: DataFrame, table: DataFrame) -> DataFrame:
    return catalog.select("dataset_id", F.col("name").alias("title")).join(table.drop("name"), "dataset_id")


def find_deteriorating(
    catalog: DataFrame, trends: DataFrame, *, limit: int | None = 50, min_anomaly_rate: float | None = None
) -> DataFrame:
    rows = trends.where(F.col("trend") == "deteriorating")
    if min_anomaly_rate is not None:
        rows = rows.where(F.col("anomaly_rate_pct") >= min_anomaly_rate)
    ranked = _titled(catalog, rows).select(*_TREND_COLUMNS).orderBy(
        F.desc_nulls_last("slope_days_per_week"), F.desc(F.coalesce("anomaly_rate_pct", F.lit(-1.0))),
        F.coalesce("publish_on_time_pct", F.lit(101.0)), "dataset_id",
    )
    return _limited(ranked, limit)


def find_recovering(catalog: DataFrame, trends: DataFrame, *, limit: int | None = 50) -> DataFrame:
    ranked = _titled(catalog, trends.where(F.col("trend") == "recovering")).select(*_TREND_COLUMNS).orderBy(
        F.asc_nulls_last("slope_days_per_week"), "dataset_id"
    )
    return _limited(ranked, limit)


def find_unreliable(catalog: DataFrame, trends: DataFrame, *, limit: int | None = 50, at_or_below_grade: str = "C") -> DataFrame:
    grade = at_or_below_grade.strip().upper()
    if grade not in ("B", "C", "D", "F"):
        raise ValueError(f"unknown unreliable grade threshold: {grade}")
    rank = cadence.grade_rank(F.col("reliability_grade"))
    rows = _titled(catalog, trends.where(rank >= params.GRADES.index(grade)))
    ranked = rows.select(
        "dataset_id", "title", "reliability_grade", "publish_on_time_pct", "reliability_sample_days", "latest_status",
        "trend", "reason",
    ).orderBy(F.desc(rank), F.coalesce("publish_on_time_pct", F.lit(101.0)), "dataset_id")
    return _limited(ranked, limit)


def find_schema_drift(catalog: DataFrame, drifts: DataFrame, *, limit: int | None = 50, min_change_count: int = 0) -> DataFrame:
    changes = F.greatest("shape_change_count", "column_change_count")
    rows = drifts.where(F.col("verdict").isin("drift_detected", "record_count_drift") & (changes >= min_change_count))
    ranked = _titled(catalog, rows).select(
        "dataset_id", "title", "verdict", "shape_changed_recently", "shape_change_count", "last_shape_change_at",
        "column_count_changed", "column_change_count", "record_trend", "record_change_pct", "record_count",
        "column_count", "expected_record_count", "record_count_within_tolerance", "reason",
    ).orderBy(F.when(F.col("verdict") == "drift_detected", 0).otherwise(1), F.desc(changes), "dataset_id")
    return _limited(ranked, limit)


def check_reconciliation(catalog: DataFrame, members: DataFrame, groups: DataFrame, *, names: DataFrame) -> DataFrame:
    """Resolve each ``query`` of ``names`` to one dataset and show its group.

    An id match beats an exact name (any case), which beats a name that contains the
    text. A query without a match or with several at its best rank fails the job.
    Ids and exact names are looked up by equality. Queries still open meet the names
    that share their first three characters (the whole of a shorter one) by an
    equi-join on the names' character runs, and are then verified. Of the runs, many
    times the catalogue, only those that some open query begins with are kept; they
    are sorted and merged, as their estimated size says nothing about a broadcast's.
    """
    asked = names.select(F.trim("query").alias("query")).distinct()
    entries = catalog.select("dataset_id", "name")
    folded = asked.withColumn("_fold", F.lower("query"))
    by_id = asked.join(entries, asked["query"] == entries["dataset_id"]).select("query", "dataset_id", "name", F.lit(1).alias("_rank"))
    by_name = folded.join(entries, F.col("_fold") == F.lower("name")).select("query", "dataset_id", "name", F.lit(2).alias("_rank"))
    settled = by_id.unionByName(by_name)
    open_queries = folded.join(settled.select("query"), "query", "left_anti")
    lowered = F.lower("name")
    runs = F.flatten(F.transform(F.array(*[F.lit(n) for n in (1, 2, 3)]), lambda n: F.when(
        F.length(lowered) >= n, F.transform(F.sequence(F.lit(1), F.length(lowered) - n + 1), lambda i: F.substr(lowered, i, n))).otherwise(F.array().cast("array<string>"))))
    by_run = entries.where("name is not null").select("dataset_id", "name", F.explode(F.array_distinct(runs)).alias("_run"))
    begun = open_queries.withColumn("_run", F.substring("_fold", 1, 3))
    by_part = (
        by_run.join(begun.select("_run").distinct(), "_run", "left_semi").hint("merge").join(begun, "_run")
        .where(F.contains(F.lower("name"), F.col("_fold"))).select("query", "dataset_id", "name", F.lit(3).alias("_rank"))
    )
    candidates = settled.unionByName(by_part)
    best = candidates.groupBy("query").agg(F.min("_rank").alias("_rank"))
    matched = candidates.join(best, ["query", "_rank"]).groupBy("query").agg(
        F.count("*").alias("_n"), F.min("dataset_id").alias("dataset_id"), F.min_by("name", "dataset_id").alias("name")
    )
    resolved = asked.join(matched, "query", "left").select(
        "query",
        F.when(F.col("_n").isNull(), F.raise_error(F.concat(F.lit("unknown dataset name or id: "), F.col("query"))).cast("string"))
        .when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("ambiguous dataset name: "), F.col("query"))).cast("string"))
        .otherwise(F.col("dataset_id")).alias("dataset_id"),
        "name",
    )
    grouped = members.select("dataset_id", "group_key").join(
        groups.select("group_key", "logical_name", "verdict", "member_count", F.col("reason").alias("_reason")), "group_key"
    )
    return resolved.join(grouped, "dataset_id", "left").select(
        "query", F.col("dataset_id").alias("matched_dataset_id"), F.col("name").alias("dataset_name"), "group_key",
        "logical_name", F.coalesce("verdict", F.lit("single_source")).alias("verdict"), "member_count",
        F.coalesce(
            "_reason", F.lit("No reviewed or conservatively inferred reconciliation group contains this dataset.")
        ).alias("reason"),
    )


def paginate(df: DataFrame, *, order: list[str], limit: int = 50, cursor: int = 0) -> DataFrame:
    """One page of ``limit`` rows in a stable order with the total and the next cursor on every row."""
    if limit < 1 or cursor < 0:
        raise ValueError("limit must be positive and cursor must not be negative")
    page = df.orderBy(*order).offset(cursor).limit(limit).withColumn("total", df.agg(F.count("*")).scalar())
    following = cursor + limit
    return page.withColumn("next_cursor", F.when(F.col("total") > following, F.lit(str(following))))


def dataset_index(catalog: DataFrame, snapshot: DataFrame) -> DataFrame:
    return with_health(catalog, snapshot, ["status"]).select(
        "dataset_id", "status", F.col("name").alias("title"), "source", "licence",
        F.coalesce("namespace", F.lit("other")).alias("namespace"),
    )


def find_by_licence(catalog: DataFrame, snapshot: DataFrame, *, licence: str) -> DataFrame:
    """Datasets under one licence; the number of them is the row count."""
    canonical = text.canonical_licence(F.lit(licence))
    rows = catalog.where(F.lower("licence") == F.lower(canonical))
    return with_health(rows, snapshot, ["status"]).select(
        canonical.alias("licence"), "dataset_id", F.col("name").alias("title"), "source", "status"
    )


def _require_known(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """The requested ids; an id outside the catalogue fails the job."""
    known = catalog.select("dataset_id", F.lit(True).alias("_known"))
    return ids.select("dataset_id").distinct().join(known, "dataset_id", "left").select(
        F.when(F.col("_known"), F.col("dataset_id")).otherwise(
            F.raise_error(F.concat(F.lit("unknown dataset id: "), F.col("dataset_id"))).cast("string")
        ).alias("dataset_id")
    )


def _evidence_columns(snapshot: DataFrame, fields: tuple[str, ...]) -> list[Column]:
    return [F.col(name) if name in snapshot.columns else F.lit(None).cast("string").alias(name) for name in fields]


def project_evidence(snapshot: DataFrame, *, compact: bool = False) -> DataFrame:
    """The fixed evidence columns exactly as published."""
    fields = params.COMPACT_EVIDENCE_FIELDS if compact else params.EVIDENCE_FIELDS
    return snapshot.select("dataset_id", *_evidence_columns(snapshot, fields))


def get_evidence(catalog: DataFrame, snapshot: DataFrame, *, ids: DataFrame | None = None) -> DataFrame:
    """Full receipts of the requested datasets, or of the whole catalogue."""
    wanted = catalog.select("dataset_id") if ids is None else _require_known(catalog, ids)
    receipts = project_evidence(snapshot).withColumn("evidence_available", F.lit(True))
    return wanted.join(receipts, "dataset_id", "left").withColumn(
        "evidence_available", F.coalesce("evidence_available", F.lit(False))
    )


def get_provenance(catalog: DataFrame, snapshot: DataFrame, *, ids: DataFrame | None = None) -> DataFrame:
    """Steward, source, licence and compact receipts for citation."""
    wanted = catalog if ids is None else catalog.join(_require_known(catalog, ids), "dataset_id")
    receipts = project_evidence(snapshot, compact=True)
    nested = receipts.select(
        "dataset_id", F.struct(*params.COMPACT_EVIDENCE_FIELDS).alias("evidence"), F.lit(True).alias("_available")
    ).join(snapshot.select("dataset_id", F.col("access_method").alias("_access")), "dataset_id")
    return wanted.join(nested, "dataset_id", "left").select(
        "dataset_id", "steward", "source", "licence", text.licence_url(F.col("licence")).alias("licence_url"), "url",
        F.coalesce("_access", F.lit("unknown")).alias("access_method"),
        F.col("evidence.last_checked").alias("last_verified"),
        "evidence",
        F.coalesce("_available", F.lit(False)).alias("evidence_available"),
    )


def get_dataset(catalog: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Catalogue rows merged with health, with defaults for a missing health row.

    Filter the result for a single dataset; the filter reaches both scans.
    """
    health = snapshot.select(
        "dataset_id", F.lit(True).alias("_present"), "status", "message", "staleness_days", "access_dependency", "access_method",
        F.col("expected_record_count").alias("_expected"), "content_freshness_date", "last_modified",
        "freshness_signal_source", "record_count", "column_count", "last_checked", "checked_at",
    )
    alias = (
        F.when(F.col("freshness_signal_source") == "last_modified", "last_modified_header")
        .when(F.col("freshness_signal_source") == "content_parse", "content_date_parse")
        .otherwise(F.col("freshness_signal_source"))
    )
    missing = F.col("_present").isNull()
    signal = (
        F.when(missing, "none")
        .when(alias.isin(*params.SIGNAL_SOURCES), alias)
        .when(F.col("last_modified").isNotNull(), "last_modified_header")
        .when(F.col("content_freshness_date").isNotNull(), "content_date_parse")
        .otherwise("none")
    )
    return catalog.join(health, "dataset_id", "left").select(
        "dataset_id", "name", "source", "steward", "licence", "url", "refresh_frequency",
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.when(missing, "Missing from latest health snapshot").otherwise(F.col("message")).alias("message"),
        "staleness_days",
        F.coalesce("access_dependency", F.when(F.col("access_method") == "Camofox", "browser").otherwise("direct")).alias("access_dependency"),
        F.coalesce("_expected", "expected_record_count").alias("expected_record_count"),
        "content_freshness_date", signal.alias("freshness_signal_source"), "record_count", "column_count",
        F.col("checked_at").alias("last_verified"),
    )


def usability_gate(snapshot: DataFrame) -> DataFrame:
    """``usable`` for current decisions, ``blocked`` from them."""
    return snapshot.select(
        "dataset_id", "status", "last_checked", "staleness_days",
        F.col("status").isin(*params.USABLE_STATUSES).alias("usable"),
        F.col("status").isin(*params.BLOCKED_STATUSES).alias("blocked"),
    )


def latest_usable(snapshot: DataFrame, *, limit: int = 10) -> DataFrame:
    return usability_gate(snapshot).where("usable").orderBy(F.desc("last_checked"), "dataset_id").limit(limit)


def oldest_stale(snapshot: DataFrame) -> DataFrame:
    """The stalest dataset; the greater id wins a tie."""
    stale = snapshot.where(F.col("status") == "stale")
    order = F.struct(F.coalesce(F.nullif("staleness_days", F.lit(0)), F.lit(-1)), F.col("dataset_id"))
    return stale.agg(F.max_by(F.struct("dataset_id", "staleness_days", "last_checked"), order).alias("_row")).where(
        F.col("_row").isNotNull()
    ).select("_row.*")


def standard_checks(catalog: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Four checks per dataset in long form: reachable, row count, freshness, schema."""
    note = F.coalesce(
        F.col("probe_note") if "probe_note" in catalog.columns else F.lit(None).cast("string"),
        F.lit("The underlying probe has not produced this measurement."),
    )
    rows = catalog.select("dataset_id", note.alias("_note")).join(
        snapshot.select("dataset_id", "http_status", "status", "message", "access_method", "record_count",
                        "content_shape_changed", "column_count"), "dataset_id", "left")
    message = F.coalesce(F.nullif("message", F.lit("")), F.col("_note"))
    status = F.col("status")

    def check(name: str, verdict: Column, method: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), verdict.alias("result"), method.alias("method"))

    reachable = F.coalesce(F.col("http_status").between(200, 399), F.lit(False))
    measured = F.col("record_count").isNotNull()
    changed = F.col("content_shape_changed")
    steady = F.coalesce(~changed & F.col("column_count").isNotNull(), F.lit(False))
    checks = F.array(
        check(
            "file_reachable",
            F.when(reachable, "pass").when(status == "unreachable", "fail").otherwise("warn"),
            F.when(reachable, F.concat(
                F.lit("Probe received HTTP "), F.col("http_status").cast("string"), F.lit(" via "),
                F.coalesce("access_method", F.lit("the configured access method")))).otherwise(message),
        ),
        check(
            "row_count",
            F.when(measured, "pass").otherwise("warn"),
            F.when(measured, F.concat(F.lit("Probe measured "), F.col("record_count").cast("string"), F.lit(" record(s)"))).otherwise(F.col("_note")),
        ),
        check(
            "freshness",
            F.when(status == "fresh", "pass").when(status == "stale", "fail").otherwise("warn"),
            F.concat(
                F.lit("Health snapshot classifies the dataset as "), F.coalesce(status, F.lit("unknown"))),
        ),
        check(
            "schema_stable",
            F.when(changed, "fail").when(steady, "pass").otherwise("warn"),
            F.when(changed, "Probe detected a content-shape change").when(steady, F.concat(
                F.lit("Probe observed "), F.col("column_count").cast("string"),
                F.lit(" column(s) with no content-shape change"))).otherwise(F.col("_note")),
        ),
    )
    return rows.select("dataset_id", F.inline(checks))


def compare_receipts(recorded: DataFrame, observed: DataFrame) -> DataFrame:
    """Stored transport receipts against newly observed ones.

    ``recorded``: dataset_id, source_url, request_url, http_status, last_modified,
    content_length, access_dependency, access_method, source. ``observed``:
    dataset_id, http_status, last_modified, content_length; no row or a null status
    means the live request failed. A field match is null when not comparable.
    """
    live = observed.select(
        "dataset_id", F.col("http_status").alias("_http"), F.col("last_modified").alias("_modified"),
        F.col("content_length").alias("_length"),
    )
    rows = recorded.join(live, "dataset_id", "left")
    browser = (
        F.coalesce(F.col("access_dependency") == "browser", F.lit(False))
        | F.coalesce(F.lower(F.trim("access_method")) == params.BROWSER_ACCESS_METHOD, F.lit(False))
        | F.coalesce(F.contains(F.lower("source"), F.lit(params.BROWSER_SOURCE_MARK)), F.lit(False))
    )
    answered = F.col("_http").isNotNull() & ~browser
    either_date = F.col("last_modified").isNotNull() | F.col("_modified").isNotNull()
    matches = {
        "request_url_match": F.when(answered, F.col("source_url") == F.col("request_url")),
        "http_status_match": F.when(answered, F.col("_http") == F.col("http_status")),
        "last_modified_match": F.when(answered & either_date, F.col("last_modified").eqNullSafe(F.col("_modified"))),
        "content_length_match": F.when(answered, F.col("content_length") == F.col("_length")),
    }
    rows = rows.withColumns(matches)
    mismatched = F.filter(
        F.array(*[F.when(~F.col(name), F.lit(name)) for name in matches]), lambda name: name.isNotNull()
    )
    ok = F.col("_http").between(200, 299)
    return rows.withColumn("_mismatched", F.concat_ws(", ", mismatched)).select(
        "dataset_id", *matches,
        F.when(browser, "not_verifiable").when(F.col("_http").isNull() | ~ok, "unreachable")
        .when(F.col("_mismatched") != "", "mismatch").otherwise("match").alias("verdict"),
        F.when(ok & ~browser, F.col("_mismatched")).alias("mismatched_fields"),
    )
