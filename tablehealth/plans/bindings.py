"""The shared test tables read as the engine's inputs.

``Tables`` turns the given parquet tables into observations, a catalogue,
probes and so on with plain column expressions, so every derived input grows with
the table it comes from. Each binding has a twin in ``oracle.py``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehealth import params
from tablehealth.functions.cadence import lookup
from tablehealth.functions.times import lit_instant
from tablehealth.operators import drift as drift_ops
from tablehealth.operators import reconcile, signals, snapshot, trust
from tablehealth.operators.skew import latest_by
from tablehealth.session import configure, cut_lineage

AS_OF = "2024-01-30 23:59:59"
PREVIOUS_AT = "2024-01-23 23:59:59"
FREQUENCIES = {
    0: "hourly", 1: "daily", 2: "weekly", 3: "monthly", 4: "quarterly", 5: "annual", 6: "as-required",
    7: "daily (weekdays, 0900 myt)", 8: "biennial to triennial (survey years)", 9: "30 seconds",
}


def dataset_id(n: Column) -> Column:
    text = n.cast("string")
    return F.concat(F.lit("ds_"), F.lpad(text, F.greatest(F.lit(5), F.length(text)), F.lit("0")))


def _label(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


class Tables:
    """Lazy inputs for one data directory."""

    def __init__(self, spark: SparkSession, directory: str, *, cut: bool = False):
        self.spark = configure(spark)
        self.directory = directory
        self.cut = cut

    @cached_property
    def stored(self) -> Tables:
        """The same inputs with each derived per-dataset table written once.

        For queries that read several derived tables in several branches: without a
        cut every branch would plan and run the whole lineage again. Observations
        are never written.
        """
        return Tables(self.spark, self.directory, cut=True)

    def _shared(self, df: DataFrame) -> DataFrame:
        return cut_lineage(df) if self.cut else df

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    @cached_property
    def observations(self) -> DataFrame:
        """Probe observations, one per event."""
        n, k = F.col("n"), F.col("k")
        reshaped = (n % 5 == 0) & (F.col("di") >= 20)
        events = self.read("events").select(
            F.col("event_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("user_id").alias("n"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
            F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("di"),
            "event_type",
            "value",
        )
        failed = F.col("event_type") == "error"
        outcome = F.when(failed & (k < 20), "timeout").when(failed, "error").otherwise("success")
        lag = F.when(n % 3 == 0, F.col("di")).when(n % 3 == 1, 30 - F.col("di")).otherwise(0)
        day = F.to_date("ts")
        last_modified = F.when((n % 2 == 0) & (k < 95), F.timestamp_micros(F.unix_micros("ts") - k * 1_000_000))
        return events.select(
            dataset_id(n).alias("dataset_id"),
            F.col("ts").alias("observed_at"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:00").alias("cycle"),
            F.when(outcome != "success", "unreachable")
            .when(k < 50, "fresh").when(k < 75, "aging").when(k < 90, "stale").otherwise("degraded")
            .alias("status"),
            F.when(last_modified.isNotNull(), "last-modified-header").otherwise("content-date-parse").alias("freshness_signal"),
            last_modified.alias("last_modified"),
            F.when(k >= 95, F.date_add(day, 1)).otherwise(F.date_sub(day, (k % 3 + lag).cast("int"))).alias("content_date"),
            F.floor(F.col("value") * 10).cast("bigint").alias("record_count"),
            (k % 11 == 0).alias("record_count_estimated"),
            F.when(outcome == "timeout", F.lit(None)).when((outcome == "error") & (k % 10 == 1), 404)
            .when(outcome == "error", 503).otherwise(200).cast("int").alias("http_status"),
            F.floor("value").cast("double").alias("latency_ms"),
            outcome.alias("probe_outcome"),
            F.when(outcome == "timeout", "request timed out").when(outcome == "error", "probe failed").alias("message"),
            _label("Dataset ", n).alias("name"),
            F.concat(
                F.lit("https://host"), (n % 7).cast("string"), F.lit(".example.org/d/"), n.cast("string"),
                F.when((n % 6 == 0) & (F.col("di") >= 15), "?v=2").otherwise(""),
            ).alias("url"),
            F.concat(F.lit(params.SHAPE_PREFIX), F.sha2(F.when(reshaped, "1").otherwise("0"), 256)).alias("shape_hash"),
            F.when(reshaped, 4).otherwise(3).cast("int").alias("column_count"),
            F.when(k % 4 != 0, k >= 90).alias("anomaly_detected"),
            F.col("event_id").alias("seq"),
            n.alias("n"),
            k.alias("k"),
        )

    @property
    def history(self) -> DataFrame:
        return self.observations.drop("n", "k")

    @cached_property
    def catalog(self) -> DataFrame:
        """One entry per distinct user of the events table."""
        return self._shared(self._catalog())

    def _catalog(self) -> DataFrame:
        n = F.col("n")
        block, member = F.floor(n / 40), n % 20
        numbers = self.read("events").select(F.col("user_id").alias("n")).distinct()
        shared = F.floor(n / 15).cast("string")
        return numbers.select(
            dataset_id(n).alias("dataset_id"),
            F.concat(
                F.when(F.floor(n / 20) % 2 == 1, "OpenDOSM: ").otherwise(""),
                F.when(member % 3 == 0, "State ").otherwise(""),
                F.lit("Series "), member.cast("string"), F.lit(" block "), block.cast("string"),
            ).alias("name"),
            F.concat(F.lit("Counts of series "), member.cast("string"), F.lit(" for region "), (n % 6).cast("string")).alias("description"),
            F.when(n % 25 != 24, _label("Source ", n % 5)).alias("source"),
            F.when(n % 12 != 11, _label("Steward ", n % 12)).alias("steward"),
            _label("Custodian ", n % 4).alias("custodian"),
            F.when(n % 15 == 7, F.concat(F.lit("HTTPS://Data.Example.org/shared/"), shared, F.lit("/?b=2&a=1")))
            .when(n % 15 == 8, F.concat(F.lit("https://data.example.org/shared/"), shared, F.lit("?a=1&b=2#top")))
            .otherwise(F.concat(F.lit("https://host"), (n % 7).cast("string"), F.lit(".example.org/d/"), n.cast("string")))
            .alias("url"),
            F.when(n % 2 == 0, params.CC_BY_4).otherwise(params.OGL).alias("licence"),
            lookup(n % 7, dict(enumerate(params.NAMESPACES))).alias("namespace"),
            F.when(n % 6 != 5, _label("Region ", n % 6)).alias("geography"),
            lookup(n % 10, FREQUENCIES).alias("refresh_frequency"),
            F.when(n % 29 == 28, "reference").otherwise("timeseries").alias("data_type"),
            (n % 31 == 30).alias("discontinued"),
            F.when(n % 37 == 36, "discontinued").otherwise("active").alias("real_status"),
            F.when(n % 4 != 3, 400 * (1 + n % 3)).cast("bigint").alias("expected_record_count"),
            F.when(n % 5 != 4, _label("SER-", F.floor(n / 10))).alias("series_code"),
            F.when(n % 3 == 0, _label("schema-", n % 9)).alias("schema_id"),
            F.when(n % 16 == 15, F.array(dataset_id(n - 1))).alias("supersedes"),
            n.alias("n"),
        )

    def probes_at(self, at: str) -> DataFrame:
        """Each dataset's newest observation up to ``at`` as a probe result."""
        n, k = F.col("n"), F.col("k")
        newest = latest_by(
            self.observations.where(F.col("observed_at") <= lit_instant(at)), ["dataset_id"], F.struct("observed_at", "seq")
        )
        return newest.select(
            "dataset_id",
            F.when(k % 17 == 0, "degraded").otherwise("fresh").alias("status"),
            "message",
            "url",
            F.col("url").alias("request_url"),
            F.when(n % 13 == 0, "Camofox").otherwise("direct GET").alias("access_method"),
            "http_status",
            (n * 1000 + k).cast("bigint").alias("content_length"),
            "last_modified",
            F.when(n % 8 != 7, F.col("content_date")).alias("content_freshness_date"),
            F.when(n % 9 != 8, F.col("record_count")).alias("record_count"),
            "record_count_estimated",
            "column_count",
            F.col("shape_hash").alias("first_row_hash"),
        )

    @cached_property
    def previous(self) -> DataFrame:
        return self._shared(
            snapshot.build_snapshot(self.probes_at(PREVIOUS_AT), self.catalog, None, checked_at=PREVIOUS_AT)
        )

    @cached_property
    def bare_snapshot(self) -> DataFrame:
        return self._shared(
            snapshot.build_snapshot(self.probes_at(AS_OF), self.catalog, self.previous, checked_at=AS_OF)
        )

    @cached_property
    def anomalies(self) -> DataFrame:
        return self._shared(signals.detect_anomalies(self.catalog, self.bare_snapshot, self.history, as_of=AS_OF))

    @cached_property
    def snapshot(self) -> DataFrame:
        """The current snapshot with its anomaly columns."""
        return signals.annotate(self.bare_snapshot, self.anomalies)

    @cached_property
    def trends(self) -> DataFrame:
        return self._shared(signals.trend(self.catalog, self.history, as_of=AS_OF))

    @cached_property
    def drifts(self) -> DataFrame:
        return self._shared(drift_ops.drift(self.catalog, self.bare_snapshot, self.history, as_of=AS_OF))

    @cached_property
    def seeds(self) -> DataFrame:
        """Reviewed groups: the pairs (n, n+1) with n%30=1, every third one of different granularity."""
        n = F.col("n")
        follower = self.catalog.select(F.col("n").alias("m"), (F.col("n") - 1).alias("n"))
        return (
            self.catalog.where(n % 30 == 1).select("n", "name").join(follower, "n")
            .select(
                _label("pair-", n).alias("key"),
                F.col("name").alias("logical_name"),
                F.array(dataset_id(n), dataset_id(F.col("m"))).alias("members"),
                F.when(F.floor(n / 30) % 3 == 2, "different_granularity").otherwise("equivalent").alias("relationship"),
                F.lit("reviewed pair").alias("rationale"),
                F.when(F.floor(n / 30) % 2 == 0, "strict").otherwise("context_only").alias("record_count_policy"),
                F.lit(5.0).alias("record_count_tolerance_pct"),
                F.lit(2).alias("content_date_tolerance_days"),
            )
        )

    @cached_property
    def group_members(self) -> DataFrame:
        return self._shared(reconcile.discover_groups(self.catalog, self.seeds))

    @cached_property
    def groups(self) -> DataFrame:
        return self._shared(reconcile.reconcile(self.group_members, self.catalog, self.bare_snapshot))

    @cached_property
    def scores(self) -> DataFrame:
        verdicts = trust.verdict_by_dataset(self.group_members, self.groups)
        return self._shared(trust.trust_score(self.catalog, self.bare_snapshot, self.trends, self.drifts, verdicts))

    @cached_property
    def usage(self) -> DataFrame:
        """Events as audit-ledger rows."""
        n, k = F.col("user_id"), F.get_json_object("props", "$.k").cast("int")
        tool = F.when(F.col("event_type") == "purchase", "trust_verdict").otherwise(F.col("event_type"))
        return self.read("events").select(
            F.col("event_id").alias("request_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            tool.alias("tool"),
            _label("buyer_", n % 10).alias("buyer_id"),
            F.when(k % 3 != 0, F.create_map(F.lit("dataset_id"), dataset_id(n))).alias("args"),
            F.struct(
                F.when((F.col("event_type") == "purchase") & (k % 5 != 0), k.cast("double")).alias("score")
            ).alias("result_summary"),
        )
