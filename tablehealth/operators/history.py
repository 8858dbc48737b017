"""Observation history: keyed upserts, latest-row lookups, daily aggregates, compaction."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth import params, schemas
from tablehealth.functions import times
from tablehealth.functions.numbers import published
from tablehealth.operators.skew import latest_by, unique_rows



def _first_loaded(prefix: str = "") -> Column:
    """Tie order for "the first of equal timestamps wins"."""
    return -F.coalesce(F.col(f"{prefix}seq"), F.lit(0))


def _latest_first_loaded(ts: str = "observed_at") -> Column:
    return F.struct(F.col(ts), _first_loaded())


def infer_probe_outcome(probe_outcome: Column, message: Column, http_status: Column) -> Column:
    """An explicit outcome, else a timeout message, else 2xx is success and the rest error."""
    return (
        F.when(probe_outcome.isin(*params.PROBE_OUTCOMES), probe_outcome)
        .when(message.rlike(r"(?i)timed?\s*out|timeout"), "timeout")
        .when(http_status.between(200, 299), "success")
        .otherwise("error")
    )


def to_observations(snapshot: DataFrame, catalog: DataFrame, *, cycle: str, observed_at=None) -> DataFrame:
    """Snapshot rows as history rows; one per dataset, status domain enforced."""
    def optional(name: str, dtype: str) -> Column:
        return F.col(f"s.{name}") if name in snapshot.columns else F.lit(None).cast(dtype)

    rows = unique_rows(snapshot, ["dataset_id"], "dataset id in snapshot").alias("s")
    entries = catalog.select("dataset_id", F.col("name").alias("_name"), F.col("url").alias("_url")).alias("c")
    when = F.col("s.checked_at") if observed_at is None else times.lit_instant(observed_at)
    status = F.coalesce(F.col("s.status"), F.lit("unknown"))
    checked_status = F.when(status.isin(*params.STATUSES), status).otherwise(
        F.raise_error(F.concat(F.col("s.dataset_id"), F.lit(": unsupported status "), status)).cast("string")
    )
    dataset_id = F.when(F.col("s.dataset_id") != "", F.col("s.dataset_id")).otherwise(
        F.raise_error(F.lit("every health row must have a non-empty dataset_id")).cast("string")
    )
    return rows.join(entries, F.col("s.dataset_id") == F.col("c.dataset_id"), "left").select(
        dataset_id.alias("dataset_id"),
        when.alias("observed_at"),
        F.lit(cycle).alias("cycle"),
        checked_status.alias("status"),
        optional("freshness_signal", "string").alias("freshness_signal"),
        optional("last_modified", "timestamp").alias("last_modified"),
        optional("content_freshness_date", "date").alias("content_date"),
        optional("record_count", "bigint").alias("record_count"),
        F.coalesce(optional("record_count_estimated", "boolean"), F.lit(False)).alias("record_count_estimated"),
        optional("http_status", "int").alias("http_status"),
        optional("latency_ms", "double").alias("latency_ms"),
        infer_probe_outcome(
            optional("probe_outcome", "string"), optional("message", "string"), optional("http_status", "int")
        ).alias("probe_outcome"),
        F.when(optional("message", "string") != "", optional("message", "string")).alias("message"),
        F.coalesce("_name", optional("name", "string")).alias("name"),
        F.coalesce("_url", optional("url", "string")).alias("url"),
        optional("first_row_hash", "string").alias("shape_hash"),
        optional("column_count", "int").alias("column_count"),
        optional("anomaly_detected", "boolean").alias("anomaly_detected"),
        F.lit(None).cast("bigint").alias("seq"),
    )


def keyed_history(rows: DataFrame) -> DataFrame:
    """One row per (dataset_id, cycle): the one loaded last."""
    return latest_by(rows, ["dataset_id", "cycle"], F.coalesce(F.col("seq"), F.lit(0))).select(*rows.columns)


def upsert_history(prior: DataFrame, current: DataFrame, *, prior_is_keyed: bool = False) -> DataFrame:
    """Last write wins on (dataset_id, cycle).

    With ``prior_is_keyed`` (a stored table that earlier upserts kept unique) the
    prior rows are only anti-joined with the new keys, so a large prior is not
    regrouped. Otherwise both inputs may hold duplicates and are reduced together.
    """
    keys = ["dataset_id", "cycle"]
    newest = F.struct("_load", F.coalesce(F.col("seq"), F.lit(0)))
    if prior_is_keyed:
        fresh = keyed_history(current)
        return prior.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh.select(*prior.columns))
    both = prior.withColumn("_load", F.lit(0)).unionByName(current.withColumn("_load", F.lit(1)))
    return latest_by(both, keys, newest).drop("_load").select(*prior.columns)


def latest_before_cycle(history: DataFrame, *, before_cycle: str) -> DataFrame:
    """Each dataset's latest successful observation of an earlier cycle."""
    eligible = history.where((F.col("cycle") < before_cycle) & (F.col("probe_outcome") == "success"))
    return latest_by(eligible, ["dataset_id"], F.struct("cycle", "observed_at", _first_loaded()))


def raw_over_daily(raw: DataFrame, daily: DataFrame, *, day: str = "date") -> DataFrame:
    """Raw rows, plus compacted rows of days that have no raw row.

    Both inputs carry (dataset_id, ``day``); the anti-join reads only these two
    columns of the raw side.
    """
    raw_days = raw.select("dataset_id", day).distinct()
    return raw.unionByName(daily.join(raw_days, ["dataset_id", day], "left_anti"), allowMissingColumns=True)


def between(
    history: DataFrame, *, since: Column | None = None, before: Column | None = None, until: Column | None = None
) -> DataFrame:
    """Rows with ``since <= observed_at < before`` (or ``<= until``).

    A history stored by UTC date (``write_history``) carries the partition column
    ``date``; the same bounds are put on it, so whole partitions are skipped.
    """
    at, rows = F.col("observed_at"), history
    partitioned = dict(history.dtypes).get("date") == "date"
    if since is not None:
        rows = rows.where(at >= since)
        if partitioned:
            rows = rows.where(F.col("date") >= F.to_date(since))
    upper = until if before is None else before
    if upper is not None:
        rows = rows.where(at <= until if before is None else at < before)
        if partitioned:
            rows = rows.where(F.col("date") <= F.to_date(upper))
    return rows


def latest_per_day(
    history: DataFrame, *, first_day=None, last_day=None, require_age: bool = True, extra: tuple[str, ...] = ()
) -> DataFrame:
    """The latest successful evaluable observation of every (dataset, UTC day).

    Adds ``day`` and ``age_days``. The day bounds are inclusive and become scan
    filters on ``observed_at``.
    """
    since = None if first_day is None else times.lit_day(first_day).cast("timestamp")
    before = None if last_day is None else F.date_add(times.lit_day(last_day), 1).cast("timestamp")
    rows = between(history, since=since, before=before).withColumn("day", times.utc_day(F.col("observed_at"))).withColumn(
        "age_days",
        times.historical_age(
            F.col("observed_at"), F.col("probe_outcome"), F.col("last_modified"), F.col("content_date")
        ),
    )
    if require_age:
        rows = rows.where(F.col("age_days").isNotNull())
    kept = ["dataset_id", "day", "observed_at", "cycle", "status", "anomaly_detected", "age_days", "seq", *extra]
    return latest_by(rows.select(*kept), ["dataset_id", "day"], _latest_first_loaded())


def _evidence() -> Column:
    return F.struct(*schemas.EVIDENCE)


def _count_summary(count: Column, total: Column) -> Column:
    return F.when(count > 0, published(total / count, 3))


def _distribution(names: tuple[str, ...], counts: list[Column]) -> Column:
    pairs = [item for name, count in zip(names, counts) for item in (F.lit(name), count)]
    return F.create_map(*pairs)


def _daily_aggregates(columns: list[str]) -> list[Column]:
    order = _latest_first_loaded()
    success = F.col("probe_outcome") == "success"
    evaluable = times.freshness_evaluable({name: F.col(name) for name in columns})
    return [
        F.min("observed_at").alias("first_observed_at"),
        F.max("observed_at").alias("last_observed_at"),
        F.count("*").alias("observations"),
        *[F.count_if(F.col("status") == name).alias(f"_s{i}") for i, name in enumerate(params.STATUSES)],
        *[F.count_if(F.col("probe_outcome") == name).alias(f"_o{i}") for i, name in enumerate(params.PROBE_OUTCOMES)],
        F.min("record_count").alias("_rc_min"),
        F.max("record_count").alias("_rc_max"),
        F.count("record_count").alias("_rc_n"),
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("_rc_sum"),
        F.count("latency_ms").alias("_lat_n"),
        F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("_lat_sum"),
        F.max_by(_evidence(), order).alias("latest_observation"),
        F.max_by(_evidence(), F.when(success, order)).alias("latest_successful_observation"),
        F.max_by(_evidence(), F.when(evaluable, order)).alias("latest_successful_evaluable_observation"),
    ]


def aggregate_daily(history: DataFrame) -> DataFrame:
    """One row per (dataset, UTC day): counts, means and three kinds of latest evidence.

    Also works on a stream with a watermark on ``observed_at``: the day is a
    tumbling window, so a finished day is emitted once.
    """
    day = F.window("observed_at", "1 day")
    grouped = history.groupBy("dataset_id", day).agg(*_daily_aggregates(history.columns))
    return _daily_shape(grouped.withColumn("date", F.to_date("window.start")))


def merge_daily(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Combine stored and new aggregates of the same (dataset, day); both are partial results."""
    return combine_daily(stored.withColumn("_rank", F.lit(1)).unionByName(new.withColumn("_rank", F.lit(0))))


def combine_daily(partials: DataFrame) -> DataFrame:
    """One aggregate per (dataset, day) from any number of partial ones.

    ``_rank`` settles equal timestamps in the evidence: the greater rank is kept.
    """

    def latest(name: str, keep) -> Column:
        item = F.col(name)
        order = F.struct(item["observed_at"], F.col("_rank"))
        return F.max_by(item, F.when(item["observed_at"].isNotNull() & keep(item), order)).alias(name)

    grouped = partials.groupBy("dataset_id", "date").agg(
        F.min("first_observed_at").alias("first_observed_at"),
        F.max("last_observed_at").alias("last_observed_at"),
        F.sum("observations").alias("observations"),
        *[
            F.sum(F.coalesce(F.col("status_distribution")[name], F.lit(0))).alias(f"_s{i}")
            for i, name in enumerate(params.STATUSES)
        ],
        *[
            F.sum(F.coalesce(F.col("probe_outcome_distribution")[name], F.lit(0))).alias(f"_o{i}")
            for i, name in enumerate(params.PROBE_OUTCOMES)
        ],
        F.min("record_count.min").alias("_rc_min"),
        F.max("record_count.max").alias("_rc_max"),
        F.sum("record_count.samples").alias("_rc_n"),
        F.sum("record_count.sum").alias("_rc_sum"),
        F.sum("latency_ms.samples").alias("_lat_n"),
        F.sum("latency_ms.sum").alias("_lat_sum"),
        latest("latest_observation", lambda item: F.lit(True)),
        latest("latest_successful_observation", lambda item: item["probe_outcome"] == "success"),
        latest("latest_successful_evaluable_observation", times.freshness_evaluable),
    )
    return _daily_shape(grouped)


def _daily_shape(grouped: DataFrame) -> DataFrame:
    success = F.col("_o0")
    return grouped.select(
        "dataset_id", "date", "first_observed_at", "last_observed_at", "observations",
        _distribution(params.STATUSES, [F.col(f"_s{i}") for i in range(len(params.STATUSES))]).alias("status_distribution"),
        _distribution(params.PROBE_OUTCOMES, [F.col(f"_o{i}") for i in range(len(params.PROBE_OUTCOMES))]).alias("probe_outcome_distribution"),
        published(100 * success / F.col("observations"), 3).alias("availability_percent"),
        F.struct(
            F.col("_rc_min").alias("min"), _count_summary(F.col("_rc_n"), F.col("_rc_sum")).alias("mean"),
            F.col("_rc_max").alias("max"), F.col("_rc_n").alias("samples"), F.col("_rc_sum").alias("sum"),
        ).alias("record_count"),
        F.struct(
            _count_summary(F.col("_lat_n"), F.col("_lat_sum")).alias("mean"),
            F.col("_lat_n").alias("samples"), F.col("_lat_sum").alias("sum"),
        ).alias("latency_ms"),
        "latest_observation", "latest_successful_observation", "latest_successful_evaluable_observation",
    )


def daily_evidence(daily: DataFrame, field: str) -> DataFrame:
    """Stored evidence structs as history-shaped rows (``seq`` absent)."""
    return (
        daily.where(F.col(f"{field}.observed_at").isNotNull())
        .select("dataset_id", "date", f"{field}.*")
        .withColumn("seq", F.lit(None).cast("bigint"))
    )


@dataclass(frozen=True)
class Compaction:
    retained: DataFrame
    daily: DataFrame
    compacted_cycles: DataFrame
    archived: DataFrame


def compact_history(
    history: DataFrame,
    daily: DataFrame | None,
    compacted_cycles: DataFrame,
    *,
    now: datetime | str | Column,
    retention_days: int = params.RETENTION_DAYS,
) -> Compaction:
    """Move expired rows into daily aggregates and an archive.

    An expired row whose cycle was compacted before is dropped: it is neither
    aggregated again nor archived. A late row of a new cycle merges into its day.
    """
    cutoff = times.lit_instant(now) - F.make_dt_interval(F.lit(retention_days))
    expired = history.where(F.col("observed_at") < cutoff)
    archived = expired.join(compacted_cycles.select("cycle"), "cycle", "left_anti").select(*history.columns)
    fresh = aggregate_daily(archived)
    return Compaction(
        retained=history.where(F.col("observed_at") >= cutoff),
        daily=fresh if daily is None else merge_daily(daily, fresh),
        compacted_cycles=compacted_cycles.select("cycle").unionByName(expired.select("cycle")).distinct(),
        archived=archived,
    )


def history_slice(
    history: DataFrame, *, dataset_id: str, as_of, days: int = 30, limit: int = 50, cursor: int = 0
) -> DataFrame:
    """One dataset's last days, oldest first, as one page."""
    if days < 1 or limit < 1 or cursor < 0:
        raise ValueError("days and limit must be positive and cursor must not be negative")
    since = times.lit_instant(as_of) - F.make_dt_interval(F.lit(days))
    rows = between(history, since=since).where(F.col("dataset_id") == dataset_id)
    return rows.orderBy("observed_at", "cycle", "seq").offset(cursor).limit(limit)


def snapshot_as_of(versions: DataFrame, *, cutoff, date_col: str = "version_date") -> DataFrame:
    """Rows of the newest stored version strictly before the cutoff day; empty if there is none.

    The version table is partitioned by ``date_col``; the maximum is a scalar
    subquery and becomes a partition filter.
    """
    newest = versions.where(F.col(date_col) < times.lit_day(cutoff)).agg(F.max(date_col)).scalar()
    return versions.where(F.col(date_col) == newest)
