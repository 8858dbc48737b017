"""Current-state snapshot and the policy classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth import params
from tablehealth.functions import cadence, times
from tablehealth.operators.skew import unique_rows

_PROBE_MEASUREMENTS = (
    "http_status", "last_modified", "content_freshness_date", "first_record_timestamp", "snapshot_chars",
    "record_count", "probe_timestamp", "header_timestamp", "newest_vehicle_timestamp",
)
_PROBE_DETAILS = (
    "message", "request_url", "access_method", "http_status", "content_length",
)


def _maybe(df: DataFrame, alias: str, name: str, dtype: str) -> Column:
    return F.col(f"{alias}.{name}") if name in df.columns else F.lit(None).cast(dtype)


def is_browser(access_method: Column) -> Column:
    return F.coalesce(F.lower(F.trim(access_method)) == params.BROWSER_ACCESS_METHOD, F.lit(False))


def build_snapshot(
    probes: DataFrame, catalog: DataFrame, previous: DataFrame | None, *, checked_at
) -> DataFrame:
    """One current-state row per probe: ages, structure flags, status and freshness signal.

    Status precedence: discontinued, browser-dependent, unreachable, reference,
    degraded (probe), unknown-freshness, degraded (shape or count), stale, aging,
    fresh. A browser probe without a content date keeps the previous one.
    """
    now = times.lit_instant(checked_at)
    entries = catalog.select(
        "dataset_id", F.col("refresh_frequency").alias("_frequency"), F.col("data_type").alias("_type"),
        F.col("discontinued").alias("_discontinued"), F.col("namespace").alias("_namespace"),
        F.col("expected_record_count").alias("_expected"),
    ).alias("c")
    rows = probes.alias("p").join(entries, F.col("p.dataset_id") == F.col("c.dataset_id"), "inner")
    if previous is None:
        old = {name: F.lit(None).cast(kind) for name, kind in (
            ("date", "date"), ("columns", "int"), ("hash", "string"), ("checked", "timestamp"))}
    else:
        before = previous.select(
            F.col("dataset_id").alias("_old_id"), F.col("content_freshness_date").alias("_old_date"),
            F.col("column_count").alias("_old_columns"), F.col("first_row_hash").alias("_old_hash"),
            F.col("last_checked").alias("_old_checked"),
        )
        rows = rows.join(before, F.col("p.dataset_id") == F.col("_old_id"), "left")
        old = {name: F.col(f"_old_{name}") for name in ("date", "columns", "hash", "checked")}

    dataset_id = F.col("p.dataset_id")
    browser = is_browser(_maybe(probes, "p", "access_method", "string"))
    http = _maybe(probes, "p", "http_status", "int")
    count = _maybe(probes, "p", "record_count", "bigint")
    modified = _maybe(probes, "p", "last_modified", "timestamp")
    columns = _maybe(probes, "p", "column_count", "int")
    shape = _maybe(probes, "p", "first_row_hash", "string")
    expected = F.col("c._expected")
    candidate = F.coalesce(_maybe(probes, "p", "content_freshness_date", "date"), F.when(browser, old["date"]))
    content_date = F.when(times.midnight(candidate) <= now, candidate)
    staleness = F.greatest(
        F.when(modified.isNotNull(), times.floored_age_days(now, modified)),
        F.when(content_date.isNotNull(), times.floored_age_days(now, times.midnight(content_date))),
    )
    comparable = old["hash"].startswith(params.SHAPE_PREFIX) & shape.startswith(params.SHAPE_PREFIX)
    shape_changed = F.coalesce(old["columns"] != columns, F.lit(False)) | F.coalesce(
        comparable & (old["hash"] != shape), F.lit(False)
    )
    measured = F.greatest(*[
        F.when(_maybe(probes, "p", name, "string").isNotNull(), 1).otherwise(0) for name in _PROBE_MEASUREMENTS
    ]) == 1
    expected_days = cadence.snapshot_cadence_days(F.col("c._frequency"))
    fresh_limit = F.coalesce(expected_days * params.FRESH_MULTIPLIER, F.lit(params.NULL_CADENCE_FRESH_DAYS))
    aging_limit = F.coalesce(expected_days * params.AGING_MULTIPLIER, F.lit(params.NULL_CADENCE_AGING_DAYS))
    age = F.col("staleness_days")
    staleness_status = (
        F.when(age.isNull(), "unknown-freshness").when(age <= fresh_limit, "fresh")
        .when(age <= aging_limit, "aging").otherwise("stale")
    )
    is_reference = F.coalesce(F.col("c._type") == "reference", F.lit(False))
    gone = F.coalesce(F.col("c._discontinued"), F.lit(False)) | F.coalesce(http.isin(404, 410), F.lit(False))
    short = F.coalesce(count < expected * params.RECORD_TOLERANCE_RATIO, F.lit(False))
    status = (
        F.when(~is_reference & gone, "discontinued")
        .when(browser, "browser-dependent")
        .when(http.isNull() | (http < 200) | (http >= 300), "unreachable")
        .when(is_reference, "reference")
        .when(_maybe(probes, "p", "status", "string") == "degraded", "degraded")
        .when(F.col("staleness_status") == "unknown-freshness", "unknown-freshness")
        .when(F.col("content_shape_changed") | short, "degraded")
        .otherwise(F.col("staleness_status"))
    )
    transit = dataset_id.startswith("gtfs_") & content_date.isNotNull()
    return (
        rows.withColumn("staleness_days", staleness)
        .withColumn("content_shape_changed", shape_changed)
        .withColumn("staleness_status", staleness_status)
        .select(
            dataset_id.alias("dataset_id"),
            now.alias("checked_at"),
            F.coalesce(F.when(measured, now), old["checked"]).alias("last_checked"),
            F.col("c._namespace").alias("namespace"),
            _maybe(probes, "p", "url", "string").alias("url"),
            status.alias("status"),
            *[
                _maybe(probes, "p", name, {"http_status": "int", "content_length": "bigint"}.get(name, "string")).alias(name)
                for name in _PROBE_DETAILS
            ],
            modified.alias("last_modified"),
            content_date.alias("content_freshness_date"),
            count.alias("record_count"),
            F.coalesce(_maybe(probes, "p", "record_count_estimated", "boolean"), F.lit(False)).alias("record_count_estimated"),
            (
                F.coalesce(_maybe(probes, "p", "incomplete", "boolean"), F.lit(False))
                | F.coalesce(count < expected, F.lit(False))
            ).alias("incomplete"),
            columns.alias("column_count"),
            shape.alias("first_row_hash"),
            "content_shape_changed",
            expected.alias("expected_record_count"),
            F.coalesce(count >= expected * params.RECORD_TOLERANCE_RATIO, F.lit(False)).alias("record_count_within_tolerance"),
            "staleness_days",
            "staleness_status",
            F.when(browser, "browser").otherwise("direct").alias("access_dependency"),
            F.when(transit, "content-date-parse").when(modified.isNotNull(), "last-modified-header")
            .when(content_date.isNotNull(), "content-date-parse").when(browser, "browser-only")
            .otherwise("no-header").alias("freshness_signal"),
            F.when(transit, "content_date_parse").when(modified.isNotNull(), "last_modified_header")
            .when(content_date.isNotNull(), "content_date_parse").otherwise("none").alias("freshness_signal_source"),
        )
    )


# ---- policy classifier -------------------------------------------------------

_POLICY_INPUTS = {
    "dataset_id": "string", "refresh_frequency": "string", "data_type": "string", "access_method": "string",
    "probe_status": "string", "http_status": "int", "last_checked": "string", "unknown_since": "string",
    "content_freshness_date": "string", "last_modified": "string", "policy_mode": "string",
    "policy_fallback": "string", "policy_date_field": "string",
}


def _policy_columns(df: DataFrame) -> dict[str, Column]:
    """The classifier's inputs as text; timestamps are rendered back to ISO, absent columns are null."""
    found = dict(df.dtypes)
    result = {}
    for name, kind in _POLICY_INPUTS.items():
        if name not in found:
            result[name] = F.lit(None).cast(kind)
        elif found[name] in ("timestamp", "timestamp_ntz"):
            result[name] = F.date_format(F.col(name), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        else:
            result[name] = F.col(name).cast(kind)
    return result


def freshness_signal(columns: dict[str, Column]) -> Column:
    """``struct(at, reason)``: content date first, Last-Modified as the configured fallback."""
    checked = times.parse_instant(columns["last_checked"], naive="utc")
    content, header = columns["content_freshness_date"], columns["last_modified"]
    content_at = times.parse_instant(content, naive="utc")
    header_at = times.parse_instant(header, naive="utc")
    mode = columns["policy_mode"]
    structural = F.coalesce(mode == "structural-hash", F.lit(False))
    has_policy = mode.isNotNull() | columns["policy_fallback"].isNotNull() | columns["policy_date_field"].isNotNull()
    wants_header = structural | (F.coalesce(columns["policy_fallback"], F.lit("last-modified")) == "last-modified")

    def error(at: Column) -> Column:
        return F.when(at.isNull(), "invalid").when(at > checked, "future")

    use_content = ~structural & content.isNotNull()
    use_header = wants_header & header.isNotNull()
    content_error = F.when(use_content, error(content_at))
    header_error = F.when(use_header, error(header_at))

    def picked(at: Column, reason: Column | str) -> Column:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(at.alias("at"), reason.alias("reason"))

    nothing = F.lit(None).cast("timestamp")
    return (
        F.when(use_content & content_error.isNull(), picked(content_at, "content-date"))
        .when(
            use_header & header_error.isNull(),
            picked(
                header_at,
                F.when(has_policy | content.isNotNull(), "last-modified-fallback").otherwise("last-modified"),
            ),
        )
        .when(content_error == "future", picked(nothing, "future-content-date"))
        .when(header_error == "future", picked(nothing, "future-last-modified"))
        .when((content_error == "invalid") | (header_error == "invalid"), picked(nothing, "invalid-freshness-signals"))
        .otherwise(picked(nothing, "no-freshness-signal"))
    )


def select_freshness_signal(rows: DataFrame) -> DataFrame:
    """Rows with ``signal_at`` and ``signal_reason``."""
    signal = freshness_signal(_policy_columns(rows))
    return rows.withColumn("_signal", signal).withColumns(
        {"signal_at": F.col("_signal.at"), "signal_reason": F.col("_signal.reason")}
    ).drop("_signal")


def classify_policy(rows: DataFrame, *, as_of, strict: bool = True) -> DataFrame:
    """Rows with ``policy_status`` and ``policy_reason`` from the scheduling policy.

    An unsupported refresh frequency is an error, or a null status when not strict.
    """
    columns = _policy_columns(rows)
    now = times.lit_instant(as_of)
    frequency = cadence.policy_frequency(columns["refresh_frequency"], columns["dataset_id"], strict=strict)
    checked = times.parse_instant(columns["last_checked"], naive="utc")
    since = times.parse_instant(columns["unknown_since"], naive="utc")
    probe_status = F.lower(columns["probe_status"])
    http = columns["http_status"]
    prepared = rows.withColumns({"_frequency": frequency, "_signal": freshness_signal(columns)})
    frequency = F.col("_frequency")
    at, reason = F.col("_signal.at"), F.col("_signal.reason")
    age_seconds = F.when(at <= now, times.seconds_between(now, at))
    baseline = cadence.baseline_seconds(frequency)
    verified_days = times.days_between(now, checked)
    publisher_field = F.coalesce(F.lower(columns["policy_date_field"]).startswith("date_"), F.lit(False))

    def verdict(status: str, why: Column | str) -> Column:
        why = F.lit(why) if isinstance(why, str) else why
        return F.struct(F.lit(status).alias("status"), why.alias("reason"))

    survey = frequency == params.SURVEY_FREQUENCY
    required = frequency == params.AS_REQUIRED
    result = (
        F.when(frequency.isNull(), F.lit(None).cast("struct<status:string,reason:string>"))
        .when(is_browser(columns["access_method"]), verdict("browser-dependent", "browser-access-required"))
        .when((probe_status == "unreachable") | ~http.between(200, 299), verdict("unreachable", "transport-failure"))
        .when(columns["data_type"] == "reference", verdict("reference", "versioned-reference-data"))
        .when(probe_status == "degraded", verdict("degraded", "probe-degraded"))
        .when(checked.isNull() & columns["last_checked"].isNotNull(), verdict("degraded", "invalid-last-checked"))
        .when(
            checked.isNull() & (times.days_between(now, since) > params.UNKNOWN_REVIEW_DAYS),
            verdict("unknown", "unknown-review-required"),
        )
        .when(checked.isNull(), verdict("unknown", "never-probed"))
        .when(checked > now, verdict("degraded", "future-last-checked"))
        .when(survey & (verified_days >= params.SURVEY_STALE_DAYS), verdict("stale", "survey-verification-stale"))
        .when(survey & (verified_days >= params.SURVEY_AGING_DAYS), verdict("aging", "survey-verification-aging"))
        .when(survey, verdict("fresh", "survey-verification-current"))
        .when(required & ~publisher_field, verdict("unknown-freshness", "as-required-no-publisher-date"))
        .when(required & (reason == "content-date") & (at <= now), verdict("fresh", "as-required-publisher-date"))
        .when(required, verdict("unknown-freshness", reason))
        .when(age_seconds.isNull(), verdict("unknown-freshness", reason))
        .when(age_seconds <= baseline * params.FRESH_MULTIPLIER, verdict("fresh", "freshness-within-window"))
        .when(age_seconds <= baseline * params.AGING_MULTIPLIER, verdict("aging", "freshness-aging"))
        .otherwise(verdict("stale", "freshness-stale"))
    )
    return (
        prepared.withColumn("_verdict", result)
        .withColumns({"policy_status": F.col("_verdict.status"), "policy_reason": F.col("_verdict.reason")})
        .drop("_frequency", "_signal", "_verdict")
    )


def compare_classifiers(snapshot: DataFrame, catalog: DataFrame, *, as_of) -> DataFrame:
    """Stored status against the policy classifier, per dataset.

    Duplicate, missing or unknown ids fail the job.
    """
    left = unique_rows(snapshot, ["dataset_id"], "health dataset id").withColumn("_in_health", F.lit(True))
    right = unique_rows(
        catalog.select("dataset_id", F.col("refresh_frequency"), F.col("data_type")), ["dataset_id"], "catalogue dataset id"
    ).withColumn("_in_catalog", F.lit(True))
    joined = left.drop("refresh_frequency", "data_type").join(right, "dataset_id", "full")
    checked_id = (
        F.when(F.col("_in_catalog").isNull(), F.raise_error(F.concat(F.lit("dataset absent from catalogue: "), F.col("dataset_id"))).cast("string"))
        .when(F.col("_in_health").isNull(), F.raise_error(F.concat(F.lit("snapshot is missing dataset: "), F.col("dataset_id"))).cast("string"))
        .otherwise(F.col("dataset_id"))
    )
    own = F.col("probe_status") if "probe_status" in snapshot.columns else F.lit(None).cast("string")
    candidate = joined.withColumn("dataset_id", checked_id).withColumn(
        "probe_status", F.when(F.col("status").isin("degraded", "unreachable"), F.col("status")).otherwise(own)
    )
    old_reason = F.col("status_reason") if "status_reason" in snapshot.columns else F.lit(None).cast("string")
    return classify_policy(candidate, as_of=as_of).select(
        "dataset_id",
        F.col("status").alias("old_status"),
        F.col("policy_status").alias("new_status"),
        (~F.col("status").eqNullSafe(F.col("policy_status"))).alias("status_changed"),
        old_reason.alias("old_reason"),
        F.col("policy_reason").alias("new_reason"),
        (~old_reason.eqNullSafe(F.col("policy_reason"))).alias("reason_changed"),
    )


# ---- scheduling --------------------------------------------------------------


def select_due(
    catalog: DataFrame,
    previous: DataFrame,
    *,
    as_of,
    tier: str | None = None,
    cadence_override_minutes: int | None = None,
    retry_minutes: int = params.RETRY_MINUTES,
) -> DataFrame:
    """Catalogue entries whose last check is at least one interval old.

    Failed datasets use the retry interval; a dataset never checked is due. A
    ``daily (weekdays…`` frequency of any wording is probed hourly.
    """
    text = F.lower(F.coalesce(F.col("refresh_frequency"), F.lit("")))
    weekday = text.startswith("daily (weekdays")
    name = F.when(weekday, "daily").otherwise(cadence.cadence_tier(text))
    scheduled = F.when(weekday, 60).otherwise(cadence.lookup(cadence.cadence_tier(text), params.TIER_DUE_SECONDS) / 60)
    unsupported = F.raise_error(F.concat(F.lit("Unsupported refresh_frequency: "), F.col("refresh_frequency"))).cast("string")
    old = previous.select(
        "dataset_id", F.col("status").alias("_status"), F.col("message").alias("_message"), F.col("last_checked").alias("_checked")
    )
    rows = catalog.join(old, "dataset_id", "left")
    failed = (
        F.col("_status").isin("unreachable", "degraded")
        | ((F.col("_status") == "browser-dependent") & F.coalesce(F.col("_message").rlike("(?i)unavailable|failed|error"), F.lit(False)))
    )
    minutes = F.lit(cadence_override_minutes) if cadence_override_minutes is not None else F.col("_scheduled")
    effective = F.when(F.coalesce(failed, F.lit(False)), retry_minutes).otherwise(minutes)
    overdue = times.seconds_between(times.lit_instant(as_of), F.col("_checked")) >= effective * 60
    due = rows.withColumn("tier", F.coalesce(name, unsupported)).withColumn("_scheduled", scheduled.cast("double"))
    if tier is not None:
        due = due.where(F.col("tier") == tier)
    return (
        due.withColumn("due_minutes", effective.cast("double"))
        .where(F.col("_checked").isNull() | overdue)
        .withColumnRenamed("_checked", "last_checked")
        .drop("_status", "_message", "_scheduled")
    )


def is_due_policy(catalog: DataFrame, previous: DataFrame, *, as_of) -> DataFrame:
    """The policy's plain due test: closed frequency list, no retry rule."""
    frequency = cadence.policy_frequency(F.col("refresh_frequency"), F.col("dataset_id"))
    rows = catalog.join(previous.select("dataset_id", F.col("last_checked").alias("_checked")), "dataset_id", "left")
    elapsed = times.seconds_between(times.lit_instant(as_of), F.col("_checked"))
    return rows.withColumn(
        "is_due", F.col("_checked").isNull() | (elapsed >= cadence.due_seconds(frequency))
    ).drop("_checked")


def merge_due(prior: DataFrame, updates: DataFrame, catalog: DataFrame, *, strict: bool = True) -> DataFrame:
    """Updated rows replace prior rows; the result covers the catalogue exactly.

    Duplicate ids on any side, ids outside the catalogue and catalogue ids
    without a row fail the job when strict; otherwise they are left out.
    """
    columns = prior.columns
    if strict:
        prior = unique_rows(prior, ["dataset_id"], "dataset id in prior rows")
        updates = unique_rows(updates, ["dataset_id"], "dataset id in updates")
    kept = prior.join(updates.select("dataset_id"), "dataset_id", "left_anti")
    merged = kept.select(*columns).unionByName(updates.select(*columns))
    ids = catalog.select("dataset_id")
    if not strict:
        return merged.join(ids, "dataset_id", "left_semi")
    ids = unique_rows(ids.withColumn("_listed", F.lit(True)), ["dataset_id"], "catalogue dataset id")
    whole = merged.withColumn("_merged", F.lit(True)).join(ids, "dataset_id", "full")
    checked = (
        F.when(F.col("_listed").isNull(), F.raise_error(F.concat(F.lit("unknown dataset id: "), F.col("dataset_id"))).cast("string"))
        .when(F.col("_merged").isNull(), F.raise_error(F.concat(F.lit("missing dataset id after merge: "), F.col("dataset_id"))).cast("string"))
        .otherwise(F.col("dataset_id"))
    )
    return whole.withColumn("dataset_id", checked).select(*columns)


