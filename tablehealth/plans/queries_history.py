"""History and signal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablehealth.functions import times
from tablehealth.operators import drift, history, signals, snapshot
from tablehealth.plans.bindings import AS_OF, Tables
from tablehealth.plans.oracle import (
    NOW, SNAPSHOT_COLUMNS, TODAY, days, pub, record_trend_sql, transitions_sql,
)
from tablehealth.plans.registry import query

HISTORY_COLUMNS = (
    "dataset_id", "observed_at", "cycle", "status", "last_modified", "content_date", "record_count",
    "record_count_estimated", "http_status", "latency_ms", "probe_outcome", "message", "url", "shape_hash",
    "column_count", "anomaly_detected", "seq",
)
SPLIT = "2024-01-16 00:00:00"


@query("infer_probe_outcome", """
SELECT seq, CASE WHEN regexp_matches(message, '(?i)timed?\\s*out|timeout') THEN 'timeout'
  WHEN http_status BETWEEN 200 AND 299 THEN 'success' ELSE 'error' END AS outcome FROM obs""")
def _infer_probe_outcome(t: Tables):
    return t.history.select(
        "seq", history.infer_probe_outcome(F.lit(None).cast("string"), F.col("message"), F.col("http_status")).alias("outcome")
    )


@query("to_observations", f"""
SELECT s.dataset_id, {NOW} AS observed_at, '2024-01-30T23:59' AS cycle, s.status, s.freshness_signal, s.last_modified,
  s.content_freshness_date AS content_date, s.record_count, s.record_count_estimated, s.http_status,
  CASE WHEN regexp_matches(s.message, '(?i)timed?\\s*out|timeout') THEN 'timeout'
    WHEN s.http_status BETWEEN 200 AND 299 THEN 'success' ELSE 'error' END AS probe_outcome,
  s.message, c.name, c.url, s.first_row_hash AS shape_hash, s.column_count
FROM bare s LEFT JOIN cat c ON c.dataset_id = s.dataset_id""")
def _to_observations(t: Tables):
    rows = history.to_observations(t.bare_snapshot, t.catalog, cycle="2024-01-30T23:59")
    return rows.drop("latency_ms", "anomaly_detected", "seq")


@query("upsert_history", f"""
SELECT {', '.join(HISTORY_COLUMNS)} FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, cycle ORDER BY
  observed_at >= TIMESTAMP '{SPLIT}' DESC, seq DESC) AS rn FROM obs) WHERE rn = 1""")
def _upsert_history(t: Tables):
    new = F.col("observed_at") >= times.lit_instant(SPLIT)
    return history.upsert_history(t.history.where(~new), t.history.where(new)).select(*HISTORY_COLUMNS)


@query("latest_before_cycle", """
SELECT dataset_id, cycle, observed_at, status, record_count, shape_hash, seq FROM (SELECT *, row_number() OVER
  (PARTITION BY dataset_id ORDER BY cycle DESC, observed_at DESC, seq) AS rn FROM obs
  WHERE cycle < '2024-01-25T00:00' AND probe_outcome = 'success') WHERE rn = 1""")
def _latest_before_cycle(t: Tables):
    return history.latest_before_cycle(t.history, before_cycle="2024-01-25T00:00").select(
        "dataset_id", "cycle", "observed_at", "status", "record_count", "shape_hash", "seq"
    )


@query("historical_age", f"SELECT seq, {pub('age_days', 6)} AS age_days FROM aged")
def _historical_age(t: Tables):
    age = times.historical_age(F.col("observed_at"), F.col("probe_outcome"), F.col("last_modified"), F.col("content_date"))
    return t.history.select("seq", signals.published(age, 6).alias("age_days"))


@query("latest_per_day", f"""
SELECT dataset_id, day, observed_at, cycle, status, anomaly_detected, {pub('age_days', 6)} AS age_days, seq FROM per_day""")
def _latest_per_day(t: Tables):
    return history.latest_per_day(t.history).withColumn("age_days", signals.published("age_days", 6))


def _daily_columns():
    flat = [
        "dataset_id", "date", "first_observed_at", "last_observed_at", "observations", "availability_percent",
        *[F.col("status_distribution")[name].alias(f"n_{name}") for name in ("fresh", "aging", "stale", "degraded", "unreachable")],
        *[F.col("probe_outcome_distribution")[name].alias(f"n_{name}") for name in ("success", "error", "timeout")],
        *[F.col(f"record_count.{name}").alias(f"count_{name}") for name in ("min", "mean", "max", "samples", "sum")],
        F.col("latency_ms.mean").alias("latency_mean"), F.col("latency_ms.samples").alias("latency_samples"),
    ]
    for field, short in (
        ("latest_observation", "any"), ("latest_successful_observation", "ok"),
        ("latest_successful_evaluable_observation", "evaluable"),
    ):
        flat += [F.col(f"{field}.observed_at").alias(f"{short}_at"), F.col(f"{field}.status").alias(f"{short}_status")]
    return flat


DAILY_SQL = f"""
SELECT dataset_id, CAST(observed_at AS DATE) AS date, min(observed_at) AS first_observed_at, max(observed_at) AS last_observed_at,
  count(*) AS observations, {pub("100.0 * count(*) FILTER (WHERE probe_outcome = 'success') / count(*)", 3)} AS availability_percent,
  {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in ("fresh", "aging", "stale", "degraded", "unreachable"))},
  {', '.join(f"count(*) FILTER (WHERE probe_outcome = '{s}') AS n_{s}" for s in ("success", "error", "timeout"))},
  min(record_count) AS count_min, {pub('sum(record_count) / count(record_count)', 3)} AS count_mean, max(record_count) AS count_max,
  count(record_count) AS count_samples, CAST(sum(record_count) AS BIGINT) AS count_sum,
  {pub('sum(latency_ms) / count(latency_ms)', 3)} AS latency_mean, count(latency_ms) AS latency_samples,
  max(observed_at) AS any_at, arg_max(status, observed_at) AS any_status,
  max(observed_at) FILTER (WHERE probe_outcome = 'success') AS ok_at,
  arg_max(status, observed_at) FILTER (WHERE probe_outcome = 'success') AS ok_status,
  max(observed_at) FILTER (WHERE age_days IS NOT NULL) AS evaluable_at,
  arg_max(status, observed_at) FILTER (WHERE age_days IS NOT NULL) AS evaluable_status
FROM aged GROUP BY dataset_id, CAST(observed_at AS DATE)"""


@query("aggregate_daily", DAILY_SQL)
def _aggregate_daily(t: Tables):
    return history.aggregate_daily(t.history).select(*_daily_columns())


@query("merge_daily", DAILY_SQL)
def _merge_daily(t: Tables):
    odd = F.col("seq") % 2 == 1
    stored, new = history.aggregate_daily(t.history.where(~odd)), history.aggregate_daily(t.history.where(odd))
    return history.merge_daily(stored, new).select(*_daily_columns())


@query("raw_over_daily", """
SELECT dataset_id, day, observed_at, seq FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, day ORDER BY raw DESC, observed_at DESC, seq) AS rn
  FROM (SELECT *, seq % 4 = 0 AS raw FROM aged WHERE age_days IS NOT NULL)) WHERE rn = 1""")
def _raw_over_daily(t: Tables):
    is_raw = F.col("seq") % 4 == 0
    raw = history.latest_per_day(t.history.where(is_raw)).select("dataset_id", "day", "observed_at", "seq")
    daily = history.latest_per_day(t.history.where(~is_raw)).select("dataset_id", "day", "observed_at", "seq")
    return history.raw_over_daily(raw, daily, day="day")


@query("compact_history", f"""
SELECT dataset_id, CAST(observed_at AS DATE) AS date, count(*) AS observations, max(observed_at) AS last_observed_at
FROM obs WHERE observed_at < {NOW} - INTERVAL 7 DAY AND cycle >= '2024-01-05T00:00' GROUP BY ALL""")
def _compact_history(t: Tables):
    done = t.history.where(F.col("cycle") < "2024-01-05T00:00").select("cycle").distinct()
    result = history.compact_history(t.history, None, done, now=AS_OF)
    return result.daily.select("dataset_id", "date", "observations", "last_observed_at")


@query("history_slice", f"""
SELECT dataset_id, observed_at, cycle, status, record_count, seq FROM obs
WHERE dataset_id = 'ds_00003' AND observed_at >= {NOW} - INTERVAL 10 DAY ORDER BY observed_at, cycle, seq LIMIT 20 OFFSET 5""")
def _history_slice(t: Tables):
    page = history.history_slice(t.history, dataset_id="ds_00003", as_of=AS_OF, days=10, limit=20, cursor=5)
    return page.select("dataset_id", "observed_at", "cycle", "status", "record_count", "seq")


@query("snapshot_as_of", """
SELECT dataset_id, version_date, observed_at, status FROM (SELECT *, CAST(observed_at AS DATE) AS version_date FROM obs)
WHERE version_date = (SELECT max(CAST(observed_at AS DATE)) FROM obs WHERE CAST(observed_at AS DATE) < DATE '2024-01-25')""")
def _snapshot_as_of(t: Tables):
    versions = t.history.withColumn("version_date", F.to_date("observed_at"))
    return history.snapshot_as_of(versions, cutoff="2024-01-25").select("dataset_id", "version_date", "observed_at", "status")


@query("build_snapshot", f"SELECT {', '.join(SNAPSHOT_COLUMNS)} FROM bare")
def _build_snapshot(t: Tables):
    return t.bare_snapshot.select(*SNAPSHOT_COLUMNS)


@query("detect_anomalies", """
SELECT dataset_id, anomaly_detected, mode, sample_days, mean_days, stdev_days, threshold_days, latest_days FROM anom""")
def _detect_anomalies(t: Tables):
    detail = F.col("anomaly_detection")
    return t.anomalies.select(
        "dataset_id", "anomaly_detected",
        *[detail[name].alias(name) for name in ("mode", "sample_days", "mean_days", "stdev_days", "threshold_days", "latest_days")],
    )


@query("trend", "SELECT * FROM trends")
def _trend(t: Tables):
    return t.trends


@query("transitions", transitions_sql(7))
def _transitions(t: Tables):
    return drift.transitions(t.history, as_of=AS_OF, window_days=7)


@query("record_trend", record_trend_sql(14))
def _record_trend(t: Tables):
    return drift.record_trend(t.history, as_of=AS_OF, window_days=14)


@query("drift", "SELECT * FROM drifts")
def _drift(t: Tables):
    return t.drifts


@query("probe_counts", f"""
SELECT dataset_id, count(*) AS probe_count_14d, count(*) FILTER (WHERE observed_at >= {NOW} - INTERVAL 1 DAY) AS probe_count_24h
FROM obs WHERE observed_at >= {NOW} - INTERVAL 14 DAY GROUP BY dataset_id""")
def _probe_counts(t: Tables):
    return signals.probe_counts(t.history, as_of=AS_OF)


@query("heartbeat", f"""
SELECT dataset_id, max(observed_at) FILTER (WHERE probe_outcome = 'success') AS last_success_at,
  coalesce(max(observed_at) FILTER (WHERE probe_outcome = 'success') < {NOW} - INTERVAL 720 MINUTE, true) AS alert
FROM obs GROUP BY dataset_id""")
def _heartbeat(t: Tables):
    return signals.heartbeat(t.history, as_of=AS_OF, minutes=720, by=("dataset_id",))


@query("heartbeat_gap", f"""
SELECT dataset_id, gap_start, gap_end, {pub('(epoch_us(gap_end) - epoch_us(gap_start)) / 1e6 / 60', 3)} AS gap_minutes
FROM (SELECT dataset_id, observed_at AS gap_end, lag(observed_at) OVER (PARTITION BY dataset_id ORDER BY observed_at) AS gap_start
      FROM obs WHERE probe_outcome = 'success')
WHERE (epoch_us(gap_end) - epoch_us(gap_start)) / 1e6 > 15 * 60""")
def _heartbeat_gap(t: Tables):
    return signals.heartbeat_gaps(t.history)


@query("select_due", f"""
SELECT c.dataset_id, p.last_checked, CASE WHEN f LIKE 'daily%' THEN 'daily' WHEN f IN ('hourly', '30 seconds') THEN 'realtime'
    WHEN f IN ('weekly', 'monthly', 'quarterly') THEN 'weekly-monthly' ELSE 'slow' END AS tier, due_minutes
FROM (SELECT c.dataset_id, c.refresh_frequency AS f, CAST(CASE WHEN coalesce(p.status IN ('unreachable', 'degraded')
      OR (p.status = 'browser-dependent' AND regexp_matches(coalesce(p.message, ''), '(?i)unavailable|failed|error')), false) THEN 240
    WHEN c.refresh_frequency LIKE 'daily (weekdays%' THEN 60 WHEN c.refresh_frequency = 'daily' THEN 1440
    WHEN c.refresh_frequency IN ('hourly', '30 seconds') THEN 15
    WHEN c.refresh_frequency IN ('weekly', 'monthly', 'quarterly') THEN 10080 ELSE 43200 END AS DOUBLE) AS due_minutes
  FROM cat c LEFT JOIN prev p ON p.dataset_id = c.dataset_id) c
LEFT JOIN prev p ON p.dataset_id = c.dataset_id
WHERE p.last_checked IS NULL OR (epoch_us({NOW}) - epoch_us(p.last_checked)) / 1e6 >= due_minutes * 60""")
def _select_due(t: Tables):
    return snapshot.select_due(t.catalog, t.previous, as_of=AS_OF).select("dataset_id", "last_checked", "tier", "due_minutes")
