"""Counts, distributions and report summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth import params
from tablehealth.functions.numbers import published


def _key(status: str) -> str:
    return status.replace("-", "_")


def trust_summary(snapshot: DataFrame) -> DataFrame:
    """One row: counts by status and signal source, null counts, Last-Modified range."""
    return snapshot.agg(
        F.count("*").alias("datasets_total"),
        *[F.count_if(F.col("status") == name).alias(f"status_{_key(name)}") for name in params.STATUSES],
        *[
            F.count_if(F.col("freshness_signal_source") == name).alias("signal_" + ("neither" if name == "none" else name))
            for name in params.SIGNAL_SOURCES
        ],
        F.count_if(F.col("last_modified").isNull()).alias("without_last_modified"),
        F.count_if(F.col("record_count").isNull()).alias("without_record_count"),
        F.min("last_modified").alias("oldest_last_modified"),
        F.max("last_modified").alias("newest_last_modified"),
    )


def stale_datasets(snapshot: DataFrame) -> DataFrame:
    """Stale datasets by age, the oldest first, unknown age last."""
    return snapshot.where(F.col("status") == "stale").select(
        "dataset_id", F.col("staleness_days").alias("days_since_modified")
    ).orderBy(F.desc_nulls_last("days_since_modified"), F.desc("dataset_id"))


def count_by(df: DataFrame, column: str, *, domain: Sequence[str] | None = None, with_total: bool = False) -> DataFrame:
    """(key, count); with a domain its missing values count zero and others are left out."""
    counted = df.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("count"))
    if domain is not None:
        names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(name) for name in domain])).alias("key"))
        counted = names.join(counted, "key", "left").select("key", F.coalesce("count", F.lit(0)).alias("count"))
    if with_total:
        counted = counted.unionByName(df.agg(F.count("*").alias("count")).select(F.lit("all").alias("key"), "count"))
    return counted


def status_distribution(snapshot: DataFrame, *, domain: Sequence[str] = params.STATUSES) -> DataFrame:
    """Counts and one-decimal percentages that sum to exactly 100.

    The rounding residual goes to the largest status, the first in domain order on ties.
    """
    counts = snapshot.agg(
        F.count("*").alias("_total"),
        *[
            F.count_if(F.replace(F.coalesce("status", F.lit("unknown")), F.lit("_"), F.lit("-")) == name).alias(f"_c{i}")
            for i, name in enumerate(domain)
        ],
    )
    cells = [F.col(f"_c{i}") for i in range(len(domain))]
    total = F.col("_total")
    rounded = [F.when(total > 0, published(cell * 100 / total, 1)).otherwise(0.0) for cell in cells]
    counts = counts.withColumns({f"_p{i}": value for i, value in enumerate(rounded)})
    added = F.lit(0.0)
    for i in range(len(domain)):
        added = added + F.col(f"_p{i}")
    counts = counts.withColumn("_residual", published(F.lit(100.0) - added, 1)).withColumn("_largest", F.greatest(*cells))
    first = F.array_position(F.array(*cells), F.col("_largest"))
    counts = counts.withColumn("_first", first)
    items = F.array(*[
        F.struct(
            F.lit(name).alias("status"), F.col(f"_c{i}").alias("count"),
            F.when((total > 0) & (F.col("_first") == i + 1), published(F.col(f"_p{i}") + F.col("_residual"), 1))
            .otherwise(F.col(f"_p{i}")).alias("percent"),
        )
        for i, name in enumerate(domain)
    ])
    return counts.select(F.inline(items))


def usage_summary(usage: DataFrame, *, buyer_id: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Calls per buyer in an inclusive UTC date range: total, by tool, by dataset, by trust-score band.

    Long form (``buyer_id, metric, key, calls``) from one pass over the ledger.
    """
    if since and until and since > until:
        raise ValueError("since must be on or before until")
    rows = usage
    if since:
        rows = rows.where(F.col("ts") >= F.lit(since).cast("date").cast("timestamp"))
    if until:
        rows = rows.where(F.col("ts") < F.date_add(F.lit(until).cast("date"), 1).cast("timestamp"))
    if buyer_id is not None:
        rows = rows.where(F.col("buyer_id") == buyer_id)
    tool = F.coalesce("tool", F.lit("unknown"))
    return (
        rows.select("buyer_id", F.explode(_usage_items(tool)).alias("_item"))
        .groupBy("buyer_id", F.col("_item.metric").alias("metric"), F.col("_item.key").alias("key"))
        .agg(F.count("*").alias("calls"))
    )


def trust_band(score: Column) -> Column:
    return (
        F.when(score >= 90, "90-100").when(score >= 75, "75-89").when(score >= 50, "50-74")
        .when(score >= 25, "25-49").when(score.isNotNull(), "0-24")
    )


def _usage_items(tool: Column) -> Column:
    """The summary lines one call contributes to."""
    def item(metric: str, key: Column) -> Column:
        return F.when(key.isNotNull(), F.struct(F.lit(metric).alias("metric"), key.alias("key")))

    band = F.when(tool == "trust_verdict", trust_band(F.col("result_summary.score")))
    items = F.array(
        item("total_calls", F.lit("all")), item("by_tool", tool),
        item("by_dataset", F.try_element_at("args", F.lit("dataset_id"))), item("trust_distribution", band),
    )
    return F.filter(items, lambda entry: entry.isNotNull())


def source_staleness(
    families: DataFrame, catalog: DataFrame, snapshot: DataFrame, *, threshold_days: int = params.SOURCE_STALENESS_DAYS
) -> DataFrame:
    """Families (``family, dataset_id``) whose whole feed is old.

    All members must exist in both tables, share one steward, and each be older than
    the threshold.
    """
    entries = catalog.select("dataset_id", "steward", F.lit(True).alias("_listed"))
    health = snapshot.select("dataset_id", "staleness_days", "content_freshness_date", F.lit(True).alias("_checked"))
    rows = families.join(entries, "dataset_id", "left").join(health, "dataset_id", "left")
    steward = F.coalesce("steward", F.lit(""))
    facts = rows.groupBy("family").agg(
        F.count("*").alias("dataset_count"),
        F.count_if(F.col("_listed") & F.col("_checked")).alias("_complete"),
        F.min(steward).alias("_low"),
        F.max(steward).alias("_high"),
        F.any_value("steward", ignoreNulls=True).alias("steward"),
        F.count_if(F.col("staleness_days") > threshold_days).alias("_old"),
        F.min("staleness_days").alias("minimum_staleness_days"),
        F.max("content_freshness_date").alias("latest_data_as_of"),
    )
    return facts.where(
        (F.col("_complete") == F.col("dataset_count")) & (F.col("_low") == F.col("_high")) & (F.col("_old") == F.col("dataset_count"))
    ).select(
        "family", "steward", "dataset_count", F.lit(threshold_days).alias("threshold_days"), "minimum_staleness_days",
        "latest_data_as_of",
    )


def family_summary(families: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Per dataset family: size, fresh, stale, last check and latest source update."""
    return families.join(snapshot, "dataset_id").groupBy("family").agg(
        F.count("*").alias("datasets"),
        F.count_if(F.col("status") == "fresh").alias("fresh"),
        F.count_if(F.col("status") == "stale").alias("stale"),
        F.max("checked_at").alias("last_checked"),
        F.max("last_modified").alias("latest_source_update"),
    )


def _count_value(value: Column) -> Column:
    """A counter as text or number; unusable values count zero."""
    return F.coalesce(F.floor(value.try_cast("double")).cast("bigint"), F.lit(0))


def popular_topk(metrics: DataFrame, catalog: DataFrame, *, limit: int = params.POPULAR_LIMIT) -> DataFrame:
    """Tracked datasets by views plus downloads, ties by id."""
    tracked = metrics.join(catalog.select("dataset_id"), "dataset_id", "left_semi")
    engagement = sum((_count_value(F.col(name)) for name in ("views", "download_csv", "download_parquet")), F.lit(0))
    return tracked.select("dataset_id", engagement.alias("engagement")).orderBy(F.desc("engagement"), "dataset_id").limit(limit)


def assign_sections(
    catalog: DataFrame, categories: DataFrame, popular: DataFrame, *, hansard: DataFrame | None = None,
    transit_prefix: str = "gtfs_",
) -> DataFrame:
    """Every dataset in exactly one section, plus the popular overlay.

    ``categories`` is (``section, priority, dataset_id``). Reference, transit and
    parliamentary datasets are reserved for their own sections and stay there when
    popular; other popular datasets appear in the overlay only.
    """
    flags = catalog.select(
        "dataset_id",
        F.col("dataset_id").startswith(transit_prefix).alias("_transit"),
        F.coalesce(F.col("data_type") == "reference", F.lit(False)).alias("_reference"),
    )
    if hansard is None:
        flags = flags.withColumn("_hansard", F.lit(False))
    else:
        listed = hansard.select("dataset_id", F.lit(True).alias("_h")).distinct()
        flags = flags.join(listed, "dataset_id", "left").withColumn("_hansard", F.coalesce("_h", F.lit(False))).drop("_h")
    best = categories.groupBy("dataset_id").agg(F.min_by("section", "priority").alias("_category"))
    overlay = popular.select("dataset_id", F.lit(True).alias("_popular"))
    rows = flags.join(best, "dataset_id", "left").join(overlay, "dataset_id", "left")
    # a reserved dataset of two kinds is listed in each of its sections
    own = F.filter(
        F.array(
            F.when(F.col("_transit"), "gtfs"), F.when(F.col("_hansard"), "hansard"), F.when(F.col("_reference"), "reference"),
        ),
        lambda entry: entry.isNotNull(),
    )
    plain = F.when(F.col("_popular").isNotNull(), F.array().cast("array<string>")).otherwise(
        F.array(F.coalesce("_category", F.lit("other_government_open_data")))
    )
    overlaid = F.when(F.col("_popular").isNotNull(), F.array(F.lit("top_visited"))).otherwise(F.array().cast("array<string>"))
    sections = F.concat(overlaid, F.when(F.size(own) > 0, own).otherwise(plain))
    return rows.select("dataset_id", F.explode(sections).alias("section"))


def reliability_summary(trends: DataFrame) -> DataFrame:
    return count_by(trends, "reliability_grade", domain=(*params.GRADES, "insufficient_data"))


def licence_summary(catalog: DataFrame) -> DataFrame:
    return count_by(catalog, "licence")


def with_lookups(
    fact: DataFrame, item: DataFrame, premise: DataFrame, *, item_key: str = "item_code", premise_key: str = "premise_code"
) -> DataFrame:
    """Fact rows with both lookups attached; unmatched facts are kept.

    No broadcast is forced: Spark broadcasts a lookup under its size threshold and
    otherwise shuffles with skew splitting.
    """
    return fact.join(item, item_key, "left").join(premise, premise_key, "left")


