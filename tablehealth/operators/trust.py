"""Composite trust scores and the all-evidence verdict row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth import params
from tablehealth.functions.cadence import lookup
from tablehealth.functions.numbers import published
from tablehealth.operators.reconcile import verdict_by_dataset

__all__ = ["trust_score", "trust_verdict", "verdict_by_dataset"]


def _state(reason: Column) -> Column:
    return F.struct(reason.isin("measured", "classified").alias("available"), reason.alias("reason"))


def trust_score(
    catalog: DataFrame,
    snapshot: DataFrame,
    trends: DataFrame,
    drifts: DataFrame,
    verdicts: DataFrame,
    *,
    weights: Mapping[str, float] = params.SCORE_WEIGHTS,
) -> DataFrame:
    """Weighted mean of the available components, renormalised, floored and capped.

    A component without evidence keeps its neutral value in ``components`` but does
    not enter the score.
    """
    rows = (
        catalog.select("dataset_id")
        .join(
            snapshot.select("dataset_id", "status", "staleness_days", F.col("last_checked").alias("observed_at"),
                            F.lit(True).alias("_h")), "dataset_id", "left")
        .join(trends.select("dataset_id", "trend", "publish_on_time_pct", F.lit(True).alias("_t")), "dataset_id", "left")
        .join(drifts.select("dataset_id", "verdict", F.lit(True).alias("_d")), "dataset_id", "left")
        .join(verdicts.select("dataset_id", "reconciliation_verdict"), "dataset_id", "left")
    )
    status, trend, drift = F.col("status"), F.col("trend"), F.col("verdict")
    on_time, agreement = F.col("publish_on_time_pct"), F.col("reconciliation_verdict")
    neutral = F.lit(params.SCORE_DEFAULT)

    def scored(key: Column, table: dict) -> Column:
        return F.coalesce(lookup(key, {name: float(score) for name, score in table.items()}), neutral)

    values = {
        "freshness": scored(status, params.STATUS_SCORE),
        "reliability": F.coalesce(on_time, neutral),
        "trend": scored(trend, params.TREND_SCORE),
        "drift": scored(drift, params.DRIFT_SCORE),
        "cross_source_agreement": scored(agreement, params.RECON_SCORE),
    }
    reasons = {
        "freshness": F.when(F.col("_h").isNull(), "missing_record")
        .when(status.isin(*params.CLASSIFIED_STATUSES), "classified")
        .when(status.isin(*params.STATUS_SCORE), "measured").otherwise("unknown_status"),
        "reliability": F.when(on_time.isNotNull(), "measured").otherwise("missing_record"),
        "trend": F.when(F.col("_t").isNull(), "missing_record").when(trend == "insufficient_data", "insufficient_history")
        .when(trend.isin(*params.TREND_SCORE), "measured").otherwise("unknown_status"),
        "drift": F.when(F.col("_d").isNull(), "missing_record").when(drift == "insufficient_data", "insufficient_history")
        .when(drift.isin(*params.DRIFT_SCORE), "measured").otherwise("unknown_status"),
        "cross_source_agreement": F.when(agreement.isNull(), "not_applicable")
        .when(agreement == "insufficient_data", "insufficient_history")
        .when(agreement.isin(*params.RECON_SCORE), "measured").otherwise("unknown_status"),
    }
    rows = rows.withColumn("components", F.struct(*[value.alias(name) for name, value in values.items()]))
    rows = rows.withColumn(
        "component_availability", F.struct(*[_state(reason).alias(name) for name, reason in reasons.items()])
    )

    def present(name: str, value: Column) -> Column:
        return F.when(F.col(f"component_availability.{name}.available"), value).otherwise(F.lit(0.0))

    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + present(name, F.lit(weight))
    rows = rows.withColumn("_weight", total)
    score = F.lit(0.0)
    for name, weight in weights.items():
        score = score + present(name, F.lit(weight) / F.col("_weight") * F.col(f"components.{name}"))
    rows = rows.withColumn(
        "_score",
        F.greatest(
            F.when(F.col("_weight") > 0, published(score, 1)).otherwise(neutral), F.lit(params.SCORE_FLOOR)
        ),
    )
    long_stale = (status == "stale") & (F.col("staleness_days") >= params.SCORE_STALE_CAP_DAYS)
    return rows.select(
        "dataset_id",
        F.lit(3).alias("methodology_version"),
        F.when(long_stale, F.least("_score", F.lit(params.SCORE_STALE_CAP))).otherwise(F.col("_score")).alias("score"),
        "components",
        "component_availability",
        "observed_at",
    )


def trust_verdict(
    catalog: DataFrame,
    snapshot: DataFrame,
    trends: DataFrame,
    drifts: DataFrame,
    verdicts: DataFrame,
    scores: DataFrame,
    links: DataFrame,
) -> DataFrame:
    """Health, trend, drift, reconciliation, score and attestation side by side, one row per dataset.

    Every input is keyed by ``dataset_id``, so the joins share one partitioning.
    Filter the result for a single dataset; the filter reaches all scans.
    """
    def nested(df: DataFrame, name: str) -> DataFrame:
        return df.select("dataset_id", F.struct(*[c for c in df.columns if c != "dataset_id"]).alias(name))

    entries = catalog.select("dataset_id", "name", "source")
    result = entries
    for df, name in (
        (snapshot, "health"), (trends, "trend"), (drifts, "drift"), (verdicts, "reconciliation"),
        (scores, "score"), (links, "attestation"),
    ):
        result = result.join(nested(df, name), "dataset_id", "left")
    citation = F.concat(
        F.col("name"), F.lit(" — "), F.col("source"), F.lit("; observed "),
        F.date_format("attestation.observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("; attestation "),
        F.col("attestation.chain_link"), F.lit("."),
    )
    return result.withColumn("citation_text", citation)
