"""Grouping datasets that describe the same thing, and comparing what they publish.

Groups are kept as member rows, never as one array per group, and a group's
verdict comes from aggregates over its members, so a group may hold any share of
the catalogue. Pair rows are produced for chosen datasets, or against each group's
anchor, but never for all pairs of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth import params
from tablehealth.functions import text
from tablehealth.functions.numbers import published
from tablehealth.operators.skew import unique_rows

_GROUP_COLUMNS = (
    "group_key", "logical_name", "grouping_method", "relationship", "confidence", "dataset_id",
    "record_count_policy", "record_count_tolerance_pct", "content_date_tolerance_days", "rationale",
)


def _seed_members(catalog: DataFrame, seeds: DataFrame) -> DataFrame:
    """Reviewed groups as member rows; any violated seed rule fails the job."""
    key = F.col("key")

    def require(ok: Column, label: str) -> Column:
        return F.when(F.coalesce(ok, F.lit(False)), key).otherwise(
            F.raise_error(F.concat(F.lit(f"seed group {label}: "), F.coalesce(key, F.lit("null")))).cast("string")
        )

    rules = (
        (key.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$"), "has an invalid key"),
        ((F.size("members") >= 2) & (F.size(F.array_distinct("members")) == F.size("members")), "needs two unique members"),
        (F.col("relationship").isin("equivalent", "different_granularity"), "has an unsupported relationship"),
        (F.col("record_count_policy").isin("strict", "context_only"), "needs a record_count_policy"),
    )
    checked = unique_rows(seeds, ["key"], "reconciliation seed key")
    for ok, label in rules:
        checked = checked.withColumn("key", require(ok, label))
    members = unique_rows(
        checked.select("*", F.explode("members").alias("dataset_id")).drop("members"), ["dataset_id"], "seed member"
    )
    known = catalog.select(F.col("dataset_id").alias("_known"))
    joined = members.join(known, members["dataset_id"] == known["_known"], "left")
    return joined.select(
        F.concat(F.lit("seed:"), key).alias("group_key"),
        "logical_name",
        F.lit("seed").alias("grouping_method"),
        "relationship",
        F.lit("reviewed").alias("confidence"),
        F.when(F.col("_known").isNotNull(), F.col("dataset_id")).otherwise(
            F.raise_error(F.concat(F.lit("seed member is not in the catalogue: "), F.col("dataset_id"))).cast("string")
        ).alias("dataset_id"),
        "record_count_policy",
        F.coalesce("record_count_tolerance_pct", F.lit(params.NAME_TOLERANCE_PCT)).alias("record_count_tolerance_pct"),
        F.coalesce("content_date_tolerance_days", F.lit(params.NAME_TOLERANCE_DAYS)).alias("content_date_tolerance_days"),
        "rationale",
    )


def _url_members(open_entries: DataFrame) -> DataFrame:
    keyed = open_entries.withColumn("_url", text.canonical_url(F.col("url"))).where(F.col("_url") != "")
    shared = (
        keyed.groupBy("_url")
        .agg(F.count("*").alias("_n"), F.min_by("name", "dataset_id").alias("logical_name"))
        .where(F.col("_n") >= 2)
    )
    return keyed.select("_url", "dataset_id").join(shared, "_url").select(
        F.concat(F.lit("url:"), F.substring(text.sha256_text(F.col("_url")), 1, 16)).alias("group_key"),
        "logical_name",
        F.lit("exact_url").alias("grouping_method"),
        F.lit("equivalent").alias("relationship"),
        F.lit("high").alias("confidence"),
        "dataset_id",
        F.lit("strict").alias("record_count_policy"),
        F.lit(0.0).alias("record_count_tolerance_pct"),
        F.lit(0).alias("content_date_tolerance_days"),
        F.concat(F.lit("members publish the same canonical URL: "), F.col("_url")).alias("rationale"),
    )


def _title_members(open_entries: DataFrame) -> DataFrame:
    keys = ["_custodian", "_title", "_frequency", "_granularity"]
    keyed = open_entries.select(
        "dataset_id",
        "name",
        text.normalise_words(F.col("custodian")).alias("_custodian"),
        text.semantic_title(F.col("name")).alias("_title"),
        text.normalise_words(F.col("refresh_frequency")).alias("_frequency"),
        F.to_json(text.granularity_signature(F.col("dataset_id"), F.col("name"))).alias("_granularity"),
        text.endpoint_channel(F.col("url")).alias("_channel"),
    ).where((F.col("_custodian") != "") & (F.col("_title") != "") & (F.col("_frequency") != ""))
    channel = F.when(F.col("_channel") != "", F.col("_channel"))
    matched = (
        keyed.groupBy(*keys)
        .agg(
            F.count("*").alias("_n"),
            F.min(channel).alias("_low"),
            F.max(channel).alias("_high"),
            F.min_by("name", "dataset_id").alias("logical_name"),
        )
        .where((F.col("_n") >= 2) & (F.col("_low") != F.col("_high")))  # at least two distinct hosts
    )
    identity = F.concat(
        F.lit('["'), F.concat_ws('","', "_custodian", "_title", "_frequency"), F.lit('",'), F.col("_granularity"), F.lit("]")
    )
    return keyed.drop("name").join(matched, keys).select(
        F.concat(
            F.lit("name:"), F.replace("_custodian", F.lit(" "), F.lit("-")), F.lit(":"),
            F.replace("_title", F.lit(" "), F.lit("-")), F.lit(":"), F.substring(text.sha256_text(identity), 1, 12),
        ).alias("group_key"),
        "logical_name",
        F.lit("semantic_title").alias("grouping_method"),
        F.lit("equivalent").alias("relationship"),
        F.lit("moderate").alias("confidence"),
        "dataset_id",
        F.lit("context_only").alias("record_count_policy"),
        F.lit(params.NAME_TOLERANCE_PCT).alias("record_count_tolerance_pct"),
        F.lit(params.NAME_TOLERANCE_DAYS).alias("content_date_tolerance_days"),
        F.lit("exact semantic title, custodian, cadence, and granularity match across endpoint channels").alias("rationale"),
    )


def discover_groups(catalog: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Member rows of every group: reviewed seeds, then equal URL, then guarded title.

    A dataset claimed by one tier takes no part in the next.
    """
    entries = catalog.select("dataset_id", "name", "url", "custodian", "refresh_frequency")
    tiers = []
    if seeds is not None:
        tiers.append(_seed_members(catalog, seeds).select(*_GROUP_COLUMNS))
        entries = entries.join(tiers[0].select("dataset_id"), "dataset_id", "left_anti")
    by_url = _url_members(entries).select(*_GROUP_COLUMNS)
    tiers.append(by_url)
    entries = entries.join(by_url.select("dataset_id"), "dataset_id", "left_anti")
    tiers.append(_title_members(entries).select(*_GROUP_COLUMNS))
    result = tiers[0]
    for tier in tiers[1:]:
        result = result.unionByName(tier)
    return result


def member_rows(members: DataFrame, catalog: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Members with the published signals that are compared."""
    entries = catalog.select(
        "dataset_id", "name", "source", text.normalise_words(F.col("custodian")).alias("source_family"), "url"
    )
    health = snapshot.select(
        "dataset_id",
        "status",
        text.availability_class(F.col("status")).alias("availability_class"),
        "record_count",
        F.coalesce("record_count_estimated", F.lit(False)).alias("record_count_estimated"),
        F.col("content_freshness_date").alias("content_date"),
        F.col("freshness_signal_source").alias("content_date_source"),
    )
    return (
        members.join(entries, "dataset_id")
        .join(health, "dataset_id", "left")
        .withColumns({
            "status": F.coalesce("status", F.lit("unknown")),
            "availability_class": F.coalesce("availability_class", F.lit("unknown")),
            "record_count_estimated": F.coalesce("record_count_estimated", F.lit(False)),
        })
    )


def _allowed_count_gap(largest: Column, tolerance_pct: Column) -> Column:
    return F.when(tolerance_pct == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(1.0), largest * tolerance_pct / 100))


def reconcile(members: DataFrame, catalog: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One verdict per group, equal to comparing all pairs of members.

    For counts of zero or more the pair (smallest, largest) has the largest gap
    relative to its allowance, dates likewise, and the availability test fails for
    some pair exactly when both classes occur. Each needs a minimum and a maximum.
    """
    rows = member_rows(members, catalog, snapshot)
    comparable = F.when(~F.col("record_count_estimated"), F.col("record_count"))
    facts = rows.groupBy("group_key").agg(
        *[F.any_value(name).alias(name) for name in _GROUP_COLUMNS if name not in ("group_key", "dataset_id")],
        F.count("*").alias("member_count"),
        F.count(comparable).alias("_counts"),
        F.min(comparable).alias("_low"),
        F.max(comparable).alias("_high"),
        F.count("content_date").alias("_dates"),
        F.datediff(F.max("content_date"), F.min("content_date")).alias("content_date_spread_days"),
        F.count_if(F.col("availability_class") == "available").alias("_available"),
        F.count_if(F.col("availability_class") == "failed").alias("_failed"),
    )
    strict = F.col("record_count_policy") == "strict"
    has_counts, has_dates = strict & (F.col("_counts") >= 2), F.col("_dates") >= 2
    gap = F.col("_high") - F.col("_low")
    largest = F.greatest(F.abs("_low"), F.abs("_high"))
    count_ok = F.when(has_counts, gap <= _allowed_count_gap(largest, F.col("record_count_tolerance_pct")))
    date_ok = F.when(has_dates, F.col("content_date_spread_days") <= F.col("content_date_tolerance_days"))
    known = F.col("_available") + F.col("_failed")
    availability_ok = F.when(known >= 2, (F.col("_available") == 0) | (F.col("_failed") == 0))
    failed = ~F.coalesce(count_ok, F.lit(True)) | ~F.coalesce(date_ok, F.lit(True)) | ~F.coalesce(availability_ok, F.lit(True))
    separate = F.col("relationship") == "different_granularity"
    verdict = (
        F.when(separate, "different_granularity").when(failed, "discrepancy")
        .when(has_counts | has_dates, "agree").otherwise("insufficient_data")
    )
    reason = (
        F.when(separate, "reviewed relationship: members describe different geographic or dimensional granularity")
        .when(failed, "one or more comparable publication signals exceed the declared tolerance")
        .when(has_counts | has_dates, "all evaluable publication signals are within the declared tolerance")
        .otherwise("no pair has an evaluable strict count, content-date, or availability comparison")
    )
    return facts.withColumn("verdict", verdict).select(
        "group_key", "logical_name", "grouping_method", "relationship", "confidence", "verdict",
        (F.col("verdict") == "discrepancy").alias("requires_human_review"),
        reason.alias("reason"), "rationale", "record_count_policy", "record_count_tolerance_pct",
        "content_date_tolerance_days", "member_count",
        count_ok.alias("record_counts_within_tolerance"),
        date_ok.alias("content_dates_within_tolerance"),
        availability_ok.alias("availability_matches"),
        F.when(has_dates, F.col("content_date_spread_days")).alias("content_date_spread_days"),
    )


def _compare(left: str, right: str) -> list[Column]:
    def pick(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    counts = pick(left, "record_count"), pick(right, "record_count")
    delta = counts[1] - counts[0]
    largest = F.greatest(F.abs(counts[0]), F.abs(counts[1]))
    estimated = pick(left, "record_count_estimated") | pick(right, "record_count_estimated")
    strict = (pick(left, "record_count_policy") == "strict") & ~estimated
    date_gap = F.abs(F.datediff(pick(right, "content_date"), pick(left, "content_date")))
    classes = pick(left, "availability_class"), pick(right, "availability_class")
    both_known = (classes[0] != "unknown") & (classes[1] != "unknown")
    both_counts = counts[0].isNotNull() & counts[1].isNotNull()
    return [
        pick(left, "group_key").alias("group_key"),
        pick(left, "dataset_id").alias("left_id"),
        pick(right, "dataset_id").alias("right_id"),
        delta.alias("record_count_delta"),
        F.when(both_counts & (largest == 0), F.lit(0.0))
        .when(both_counts, published(100 * F.abs(delta) / largest, 3)).alias("record_count_delta_pct"),
        F.when(
            strict & both_counts,
            F.abs(delta) <= _allowed_count_gap(largest, pick(left, "record_count_tolerance_pct")),
        ).alias("record_count_within_tolerance"),
        date_gap.alias("content_date_delta_days"),
        (date_gap <= pick(left, "content_date_tolerance_days")).alias("content_date_within_tolerance"),
        F.when(both_known, classes[0] == classes[1]).alias("availability_match"),
    ]


_COMPARED = (
    "group_key", "dataset_id", "record_count", "record_count_estimated", "content_date", "availability_class",
    "record_count_policy", "record_count_tolerance_pct", "content_date_tolerance_days",
)


def compare_with_anchor(rows: DataFrame) -> DataFrame:
    """Each member of a group compared with the group's smallest id.

    A group of two yields its one pair. In a larger group the deltas of every
    other pair follow from these rows by subtraction.
    """
    thin = rows.select(*_COMPARED)
    anchors = thin.groupBy("group_key").agg(F.min_by(F.struct(*_COMPARED), "dataset_id").alias("l"))
    others = thin.select(F.col("group_key").alias("_key"), F.struct(*_COMPARED).alias("r"))
    return (
        others.join(anchors, F.col("_key") == F.col("group_key"))
        .where(F.col("r.dataset_id") != F.col("l.dataset_id"))
        .select(*_compare("l", "r"))
    )


def compare_for(rows: DataFrame, focus: DataFrame) -> DataFrame:
    """All comparisons of the focus datasets with the other members of their groups."""
    thin = rows.select(*_COMPARED)
    chosen = thin.join(focus.select("dataset_id"), "dataset_id", "left_semi")
    pairs = chosen.select(F.col("group_key").alias("_key"), F.struct(*_COMPARED).alias("a")).join(
        thin.select("group_key", F.struct(*_COMPARED).alias("b")), F.col("_key") == F.col("group_key")
    )
    smaller = F.col("a.dataset_id") < F.col("b.dataset_id")
    ordered = pairs.where(F.col("a.dataset_id") != F.col("b.dataset_id")).select(
        F.when(smaller, F.col("a")).otherwise(F.col("b")).alias("l"),
        F.when(smaller, F.col("b")).otherwise(F.col("a")).alias("r"),
    )
    return ordered.select(*_compare("l", "r")).dropDuplicates(["left_id", "right_id"])


def verdict_by_dataset(members: DataFrame, groups: DataFrame) -> DataFrame:
    return members.select("group_key", "dataset_id").join(
        groups.select("group_key", F.col("verdict").alias("reconciliation_verdict")), "group_key"
    ).select("dataset_id", "reconciliation_verdict", "group_key")
