"""Schema and record-count drift."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth import params
from tablehealth.functions import times
from tablehealth.functions.numbers import published
from tablehealth.operators import history as hist
from tablehealth.operators.skew import change_events, change_runs, latest_by

_FIELDS = ("shape_hash", "column_count")


def _window_rows(history: DataFrame, daily: DataFrame | None, as_of, window_days: int) -> DataFrame:
    """Observations up to now with raw rows taking precedence, plus ``in_window``."""
    now = times.lit_instant(as_of)
    columns = [
        "dataset_id", "observed_at", "cycle", "probe_outcome", "record_count", "shape_hash", "column_count", "seq",
    ]
    kept = hist.between(history, until=now) if daily is None else history  # later raw days still hide stored ones
    rows = kept.select(*columns).withColumn("_day", times.utc_day(F.col("observed_at")))
    if daily is not None:
        stored = hist.daily_evidence(daily, "latest_observation").select(*columns).withColumn(
            "_day", times.utc_day(F.col("observed_at"))
        )
        rows = hist.raw_over_daily(rows, stored, day="_day")
    cutoff = now - F.make_dt_interval(F.lit(window_days))
    return (
        rows.where(F.col("observed_at") <= now)
        .withColumn(
            "shape_hash", F.when(F.col("shape_hash").startswith(params.SHAPE_PREFIX), F.col("shape_hash"))
        )
        .withColumn("in_window", F.col("observed_at") >= cutoff)
    )


def transitions(
    history: DataFrame,
    daily: DataFrame | None = None,
    *,
    as_of: datetime | str,
    window_days: int = params.DRIFT_WINDOW_DAYS,
) -> DataFrame:
    """Adjacent shape and column-count changes inside the window, per dataset.

    The latest row before the window seeds the comparison but is not counted.
    The history is keyed by (dataset_id, cycle), see ``upsert_history``.
    """
    return _transitions(_window_rows(history, daily, as_of, window_days))


def _transitions(rows: DataFrame) -> DataFrame:
    thin = ["dataset_id", "observed_at", "cycle", "shape_hash", "column_count", "in_window", "seq"]
    # observed_at is compared first, and only rows before the window take part
    seed = latest_by(
        rows.where(~F.col("in_window")).select(*thin),
        ["dataset_id"],
        F.struct("observed_at", -F.coalesce(F.col("seq"), F.lit(0))),
    )
    compared = rows.where("in_window").select(*thin).unionByName(seed.select(*thin))
    runs = change_runs(compared, "dataset_id", "observed_at", "cycle", _FIELDS, F.col("in_window"))
    shapes = compared.groupBy("dataset_id").agg(F.count_distinct("shape_hash").alias("distinct_shape_count"))
    return runs.join(shapes, "dataset_id").select(
        "dataset_id",
        F.col("shape_hash_changes").alias("shape_change_count"),
        F.col("shape_hash_last_change").alias("last_shape_change_at"),
        F.col("shape_hash_samples").alias("shape_sample_count"),
        "distinct_shape_count",
        F.col("column_count_changes").alias("column_change_count"),
        F.col("column_count_last_change").alias("last_column_change_at"),
        F.col("column_count_samples").alias("column_sample_count"),
    )


def transition_events(history: DataFrame, *, fields: tuple[str, ...] = ("status", *_FIELDS)) -> DataFrame:
    """Every adjacent change of status, shape and column count of a history."""
    return change_events(history, "dataset_id", "observed_at", "cycle", fields)


def record_trend(
    history: DataFrame,
    daily: DataFrame | None = None,
    *,
    as_of: datetime | str,
    window_days: int = params.DRIFT_WINDOW_DAYS,
    threshold_pct: float = params.RECORD_TREND_PCT,
) -> DataFrame:
    """First against last daily record count of the window."""
    return _record_trend(_window_rows(history, daily, as_of, window_days), threshold_pct)


def _record_trend(rows: DataFrame, threshold_pct: float) -> DataFrame:
    points = latest_by(
        rows.where(
            F.col("in_window") & (F.col("probe_outcome") == "success") & F.col("record_count").isNotNull()
        ).select("dataset_id", "_day", "observed_at", "record_count", "seq"),
        ["dataset_id", "_day"],
        F.struct("observed_at", -F.coalesce(F.col("seq"), F.lit(0))),
    )
    ends = points.groupBy("dataset_id").agg(
        F.count("*").alias("record_sample_days"),
        F.min_by(F.struct("observed_at", "record_count"), "_day").alias("_first"),
        F.max_by(F.struct("observed_at", "record_count"), "_day").alias("_last"),
    )
    first, last = F.col("_first.record_count"), F.col("_last.record_count")
    span = F.when(
        F.col("record_sample_days") >= 2, times.days_between(F.col("_last.observed_at"), F.col("_first.observed_at"))
    ).otherwise(0.0)
    short = (F.col("record_sample_days") < params.RECORD_MIN_SAMPLE_DAYS) | (
        F.col("_span") < params.RECORD_MIN_SPAN_DAYS
    )
    pct = F.when(~short & (first != 0), 100 * (last - first) / F.abs(first))
    verdict = (
        F.when(short, "insufficient_data")
        .when((first == 0) & (last > 0), "growing")
        .when(F.col("_pct") > threshold_pct, "growing")
        .when(F.col("_pct") < -threshold_pct, "shrinking")
        .otherwise("stable")
    )
    return (
        ends.withColumn("_span", span)
        .withColumn("_pct", pct)
        .select(
            "dataset_id",
            verdict.alias("record_trend"),
            published("_pct", 1).alias("record_change_pct"),
            "record_sample_days",
            published("_span", 3).alias("record_history_span_days"),
        )
    )


def within_tolerance(record_count: Column, expected: Column, ratio: float = params.RECORD_TOLERANCE_RATIO) -> Column:
    """Null unless both numbers exist."""
    return record_count >= expected * ratio


def _plain(value: Column) -> Column:
    return value.cast("string")


def drift(
    catalog: DataFrame,
    snapshot: DataFrame,
    history: DataFrame,
    daily: DataFrame | None = None,
    *,
    as_of: datetime | str,
    window_days: int = params.DRIFT_WINDOW_DAYS,
    tolerance_ratio: float = params.RECORD_TOLERANCE_RATIO,
) -> DataFrame:
    """Structure changes first, then a record count below tolerance, then stable, then insufficient."""
    rows = _window_rows(history, daily, as_of, window_days)
    current = snapshot.select(
        "dataset_id",
        F.col("record_count").alias("record_count"),
        F.col("column_count").alias("column_count"),
        F.col("expected_record_count").alias("_expected"),
        F.coalesce(F.col("content_shape_changed"), F.lit(False)).alias("content_shape_changed_latest"),
    )
    entries = catalog.select("dataset_id", "name", F.col("expected_record_count").alias("_declared"))
    joined = (
        entries.join(current, "dataset_id", "left")
        .join(_transitions(rows), "dataset_id", "left")
        .join(_record_trend(rows, params.RECORD_TREND_PCT), "dataset_id", "left")
    )
    zero = F.lit(0)
    counts = {
        name: F.coalesce(F.col(name), zero)
        for name in ("shape_change_count", "shape_sample_count", "distinct_shape_count",
                     "column_change_count", "column_sample_count", "record_sample_days")
    }
    shape_changes, column_changes = counts["shape_change_count"], counts["column_change_count"]
    latest_flag = F.coalesce(F.col("content_shape_changed_latest"), F.lit(False))
    expected = F.coalesce("_declared", "_expected")
    tolerance = within_tolerance(F.col("record_count"), expected, tolerance_ratio)
    shape_changed = (shape_changes > 0) | latest_flag
    column_changed = F.when(column_changes > 0, True).when(counts["column_sample_count"] >= 2, False)
    trend_name = F.coalesce("record_trend", F.lit("insufficient_data"))
    structural = shape_changed | F.coalesce(column_changed, F.lit(False))
    below = F.coalesce(~tolerance, F.lit(False))
    evaluated = (
        (counts["shape_sample_count"] >= 2) | (counts["column_sample_count"] >= 2)
        | tolerance.isNotNull() | (trend_name != "insufficient_data")
    )
    verdict = (
        F.when(structural, "drift_detected").when(below, "record_count_drift")
        .when(evaluated, "stable").otherwise("insufficient_data")
    )
    reason = (
        F.when(
            structural & (shape_changes > 0),
            F.concat(_plain(shape_changes), F.lit(f" structural fingerprint change(s) detected in the {window_days}-day window")),
        )
        .when(
            structural & (column_changes > 0),
            F.concat(_plain(column_changes), F.lit(f" column-count change(s) detected in the {window_days}-day window")),
        )
        .when(structural, "latest health snapshot reports a structural comparison change")
        .when(
            below,
            F.concat(
                F.lit("record count "), _plain(F.col("record_count")),
                F.lit(f" is below {tolerance_ratio:.0%} of expected count "), _plain(expected),
            ),
        )
        .when(evaluated, "no structural transition or record-count tolerance failure was detected")
        .otherwise("requires two comparable structural or record-count observations, or an evaluable expected count")
    )
    return joined.select(
        "dataset_id",
        "name",
        verdict.alias("verdict"),
        shape_changed.alias("shape_changed_recently"),
        shape_changes.alias("shape_change_count"),
        "last_shape_change_at",
        counts["shape_sample_count"].alias("shape_sample_count"),
        counts["distinct_shape_count"].alias("distinct_shape_count"),
        column_changed.alias("column_count_changed"),
        column_changes.alias("column_change_count"),
        "last_column_change_at",
        counts["column_sample_count"].alias("column_sample_count"),
        trend_name.alias("record_trend"),
        "record_change_pct",
        counts["record_sample_days"].alias("record_sample_days"),
        F.coalesce("record_history_span_days", F.lit(0.0)).alias("record_history_span_days"),
        "record_count",
        "column_count",
        expected.alias("expected_record_count"),
        tolerance.alias("record_count_within_tolerance"),
        latest_flag.alias("content_shape_changed_latest"),
        reason.alias("reason"),
    )
