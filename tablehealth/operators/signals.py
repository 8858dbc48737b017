"""Time-series signals: anomalies, trends, probe counts, heartbeats."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablehealth import params
from tablehealth.functions import cadence, times
from tablehealth.functions.numbers import published
from tablehealth.operators import history as hist


def _day_of(as_of: datetime | str) -> date:
    value = as_of if isinstance(as_of, datetime) else datetime.fromisoformat(str(as_of).replace("Z", "+00:00"))
    return value.date()


def detect_anomalies(
    catalog: DataFrame,
    snapshot: DataFrame,
    history: DataFrame,
    *,
    as_of: datetime | str,
    window_days: int = params.ANOMALY_WINDOW_DAYS,
    min_sample_days: int = params.ANOMALY_MIN_SAMPLE_DAYS,
    sigmas: float = params.ANOMALY_SIGMAS,
) -> DataFrame:
    """Latest staleness against its own previous days; today is never in the baseline.

    With at least ``min_sample_days`` baseline days the limit is mean + 2
    population standard deviations; otherwise three cadences. The comparison uses
    unrounded values; only the published columns are rounded.
    """
    today = _day_of(as_of)
    baseline = (
        hist.latest_per_day(
            history, first_day=today - timedelta(days=window_days), last_day=today - timedelta(days=1)
        )
        .groupBy("dataset_id")
        .agg(
            F.count("*").alias("_days"),
            F.avg("age_days").alias("_mean"),
            F.stddev_pop("age_days").alias("_stdev"),
        )
    )
    rows = (
        snapshot.select("dataset_id", "status", F.col("staleness_days").cast("double").alias("_latest"))
        .join(catalog.select("dataset_id", "refresh_frequency"), "dataset_id", "left")
        .join(baseline, "dataset_id", "left")
    )
    latest = F.when(F.col("_latest") >= 0, F.col("_latest"))
    expected = cadence.cadence_days(F.col("refresh_frequency"))
    eligible = ~F.coalesce(F.col("status").isin(*params.INELIGIBLE_STATUSES), F.lit(False)) & latest.isNotNull()
    rolling = F.coalesce(F.col("_days"), F.lit(0)) >= min_sample_days
    mode = (
        F.when(~eligible, "not_evaluated")
        .when(rolling, "rolling_14d")
        .when(expected.isNull(), "not_evaluated")
        .otherwise("cadence_fallback")
    )
    return (
        rows.withColumn("mode", mode)
        .withColumn(
            "_limit",
            F.when(F.col("mode") == "rolling_14d", F.col("_mean") + sigmas * F.col("_stdev")).when(
                F.col("mode") == "cadence_fallback", params.ANOMALY_CADENCE_MULTIPLIER * expected
            ),
        )
        .select(
            "dataset_id",
            F.coalesce(latest > F.col("_limit"), F.lit(False)).alias("anomaly_detected"),
            F.struct(
                F.lit(params.ANOMALY_METRIC).alias("metric"),
                F.lit(window_days).alias("window_days"),
                F.coalesce(F.col("_days"), F.lit(0)).alias("sample_days"),
                F.when(F.col("mode") == "rolling_14d", published("_mean", 3)).alias("mean_days"),
                F.when(F.col("mode") == "rolling_14d", published("_stdev", 3)).alias("stdev_days"),
                F.when(F.col("mode") == "rolling_14d", published("_limit", 3))
                .otherwise(F.col("_limit"))
                .alias("threshold_days"),
                latest.alias("latest_days"),
                F.col("mode").alias("mode"),
            ).alias("anomaly_detection"),
        )
    )


def annotate(snapshot: DataFrame, anomalies: DataFrame) -> DataFrame:
    """The snapshot with the two anomaly columns."""
    bare = snapshot.drop("anomaly_detected", "anomaly_detection")
    return bare.join(anomalies, "dataset_id", "left")


def _trend_samples(history: DataFrame, daily: DataFrame | None, first: date, last: date) -> DataFrame:
    samples = hist.latest_per_day(history, first_day=first, last_day=last)
    if daily is None:
        return samples
    stored = hist.daily_evidence(daily, "latest_successful_evaluable_observation").drop("date")
    compacted = hist.latest_per_day(stored, first_day=first, last_day=last)
    return hist.raw_over_daily(samples, compacted, day="day")


def trend(
    catalog: DataFrame,
    history: DataFrame,
    daily: DataFrame | None = None,
    *,
    as_of: datetime | str,
    window_days: int = params.TREND_WINDOW_DAYS,
    min_sample_days: int = params.TREND_MIN_SAMPLE_DAYS,
    min_span_days: float = params.TREND_MIN_SPAN_DAYS,
    slope_threshold: float = params.TREND_SLOPE_THRESHOLD,
    on_time_multiplier: float = params.ON_TIME_MULTIPLIER,
) -> DataFrame:
    """Least-squares slope of staleness over the trailing UTC days, with reliability.

    Compacted days are used wherever a day has no raw row, also when there is no
    raw history at all.
    """
    today = _day_of(as_of)
    first = today - timedelta(days=window_days - 1)
    samples = _trend_samples(history, daily, first, today)
    # x is measured from the window start: the slope does not depend on the origin
    elapsed = times.days_between(F.col("observed_at"), times.lit_day(first).cast("timestamp"))
    order = F.struct("observed_at", "day")
    entries = catalog.select(
        "dataset_id", "name", cadence.cadence_days(F.col("refresh_frequency")).alias("_cadence")
    )
    # cadence is needed inside the aggregate (on-time share), so it joins the small daily samples first
    per_dataset = (
        samples.join(entries.select("dataset_id", "_cadence"), "dataset_id")
        .groupBy("dataset_id")
        .agg(
            F.count("*").alias("_n"),
            F.min("observed_at").alias("_first"),
            F.max("observed_at").alias("_last"),
            F.regr_slope(F.col("age_days"), elapsed).alias("_slope"),
            F.max_by(F.struct("status", "age_days"), order).alias("_latest"),
            F.count_if(F.col("age_days") <= F.col("_cadence") * on_time_multiplier).alias("_on_time"),
            F.count("anomaly_detected").alias("_flags"),
            F.count_if("anomaly_detected").alias("_flagged"),
        )
    )
    rows = entries.join(per_dataset, "dataset_id", "left")
    status, expected = F.col("_latest.status"), F.col("_cadence")
    n = F.coalesce(F.col("_n"), F.lit(0))
    span = F.when(n >= 2, times.days_between(F.col("_last"), F.col("_first"))).otherwise(0.0)
    ineligible = F.coalesce(status.isin(*params.INELIGIBLE_STATUSES), F.lit(False))
    enough = (n >= min_sample_days) & (F.col("_span") >= min_span_days)
    evaluable = expected.isNotNull() & ~ineligible & enough
    usable = evaluable & F.col("_slope").isNotNull()
    slope, latest = F.col("_slope"), F.col("_latest.age_days")
    worse = (slope > slope_threshold) & (latest > expected * on_time_multiplier)
    verdict = (
        F.when(~usable, "insufficient_data")
        .when(slope < -slope_threshold, "recovering")
        .when(worse, "deteriorating")
        .otherwise("stable")
    )
    reason = (
        F.when(ineligible, F.concat(F.lit("status "), status, F.lit(" is not freshness-evaluable")))
        .when(expected.isNull(), "refresh cadence is not mapped")
        .when(~enough, f"requires {min_sample_days} daily samples spanning at least {min_span_days:g} days")
        .when(slope.isNull(), "observation times have no measurable span")
        .when(slope < -slope_threshold, "staleness is decreasing faster than the recovery threshold")
        .when(worse, "staleness is increasing and latest freshness is beyond the on-time cadence boundary")
        .otherwise("slope is within the stable band or latest freshness remains on time")
    )
    on_time = F.when(evaluable, published(100 * F.col("_on_time") / n, 1))
    return (
        rows.withColumn("_span", span)
        .withColumn("_pct", on_time)
        .select(
            "dataset_id",
            "name",
            status.alias("latest_status"),
            published(expected, 6).alias("cadence_days"),
            verdict.alias("trend"),
            reason.alias("reason"),
            n.alias("trend_sample_days"),
            published("_span", 3).alias("history_span_days"),
            published(latest, 3).alias("latest_staleness_days"),
            F.when(usable, published(slope, 3)).alias("slope_days_per_day"),
            F.when(usable, published(slope * 7, 3)).alias("slope_days_per_week"),
            F.col("_pct").alias("publish_on_time_pct"),
            cadence.reliability_grade(F.col("_pct")).alias("reliability_grade"),
            F.when(evaluable, n).otherwise(F.lit(0)).alias("reliability_sample_days"),
            F.when(F.col("_flags") > 0, published(100 * F.col("_flagged") / F.col("_flags"), 1)).alias("anomaly_rate_pct"),
            F.coalesce("_flags", F.lit(0)).alias("anomaly_sample_days"),
        )
    )


def probe_counts(history: DataFrame, *, as_of: datetime | str) -> DataFrame:
    """Observations per dataset in the trailing 14 days and 24 hours."""
    now = times.lit_instant(as_of)
    since_14d = now - F.make_dt_interval(F.lit(14))
    since_24h = now - F.make_dt_interval(F.lit(1))
    return (
        hist.between(history, since=since_14d)
        .groupBy("dataset_id")
        .agg(
            F.count("*").alias("probe_count_14d"),
            F.count_if(F.col("observed_at") >= since_24h).alias("probe_count_24h"),
        )
    )


def heartbeat(
    history: DataFrame, *, as_of: datetime | str, minutes: int = params.HEARTBEAT_MINUTES, by: tuple[str, ...] = ()
) -> DataFrame:
    """Latest success and whether it is older than the limit; whole table or per ``by`` columns."""
    last = F.max(F.when(F.col("probe_outcome") == "success", F.col("observed_at")))
    cutoff = times.lit_instant(as_of) - F.make_dt_interval(mins=F.lit(minutes))
    return history.groupBy(*by).agg(last.alias("last_success_at")).withColumn(
        "alert", F.coalesce(F.col("last_success_at") < cutoff, F.lit(True))
    )


def heartbeat_gaps(
    history: DataFrame, *, minutes: int = params.HEARTBEAT_MINUTES, chunk: str = "hour"
) -> DataFrame:
    """Every pair of neighbouring successes of a dataset further apart than the limit.

    Neighbours inside an hour are compared in that hour's task; across hours only
    each hour's first and last success take part.
    """
    success = (
        history.where(F.col("probe_outcome") == "success")
        .select("dataset_id", "observed_at")
        .withColumn("_chunk", F.date_trunc(chunk, "observed_at"))
    )
    inside = Window.partitionBy("dataset_id", "_chunk").orderBy("observed_at")
    within = success.withColumn("gap_start", F.lag("observed_at").over(inside)).select(
        "dataset_id", "gap_start", F.col("observed_at").alias("gap_end")
    )
    ends = success.groupBy("dataset_id", "_chunk").agg(
        F.min("observed_at").alias("gap_end"), F.max("observed_at").alias("_tail")
    )
    between = ends.withColumn(
        "gap_start", F.lag("_tail").over(Window.partitionBy("dataset_id").orderBy("_chunk"))
    ).select("dataset_id", "gap_start", "gap_end")
    seconds = times.seconds_between(F.col("gap_end"), F.col("gap_start"))
    return (
        within.unionByName(between)
        .where(seconds > minutes * 60)
        .withColumn("gap_minutes", published(seconds / 60, 3))
    )
