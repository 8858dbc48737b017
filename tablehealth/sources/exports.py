"""Catalogue exports: schema.org documents and feed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehealth import params


def to_jsonld(
    catalog: DataFrame, snapshot: DataFrame, *, base_url: str, publisher: str, country: str = "Malaysia",
    demonym: str = "Malaysian",
) -> DataFrame:
    """One schema.org Dataset document per catalogue row (``dataset_id``, ``document``).

    Reads the optional catalogue columns ``health_report``, ``geo_coverage`` and
    ``verified_at``. The documents are JSON text; write them with ``df.write.text``.
    """
    def optional(name: str, default):
        return F.col(name) if name in catalog.columns else default

    health = snapshot.select("dataset_id", F.col("status"), F.col("record_count"), F.col("checked_at"))
    rows = catalog.join(health, "dataset_id", "left")
    report = F.concat(
        F.lit(f"{base_url}/"), optional("health_report", F.concat(F.lit("data/"), F.col("dataset_id"), F.lit(".md")))
    )
    name, steward, source = F.col("name"), F.col("steward"), F.col("source")
    described = F.concat(
        F.lit(f"{demonym} public dataset: "), name,
        F.lit(". Steward: "), F.coalesce(steward, F.lit("unknown")), F.lit(". Source: "), F.coalesce(source, F.lit("unknown")), F.lit("."),
    )
    document = F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("Dataset").alias("@type"),
        report.alias("@id"),
        name.alias("name"),
        described.alias("description"),
        report.alias("url"),
        F.col("url").alias("sameAs"),
        F.col("dataset_id").alias("identifier"),
        F.array(source, steward, F.lit(country), F.lit("open data")).alias("keywords"),
        F.struct(F.lit("Organization").alias("@type"), steward.alias("name")).alias("creator"),
        F.struct(
            F.lit("Organization").alias("@type"), F.lit(f"{base_url}/#org").alias("@id"), F.lit(publisher).alias("name")
        ).alias("publisher"),
        F.struct(F.lit("Place").alias("@type"), optional("geo_coverage", F.col("geography")).alias("name")).alias("spatialCoverage"),
        F.col("licence").alias("license"),
        F.lit(True).alias("isAccessibleForFree"),
        F.array(F.struct(
            F.lit("DataDownload").alias("@type"), F.lit("text/markdown").alias("encodingFormat"), report.alias("contentUrl"),
            F.concat(F.lit(f"{publisher} health record for "), name).alias("name"),
        )).alias("distribution"),
        F.lit(f"Continuous HTTP + content-shape probing by {publisher}").alias("measurementTechnique"),
        F.coalesce(optional("verified_at", F.lit(None).cast("string")), F.date_format("checked_at", "yyyy-MM-dd")).alias("dateModified"),
        F.array(
            F.struct(F.lit("PropertyValue").alias("@type"), F.lit("freshness").alias("name"),
                     F.coalesce("status", F.lit("unknown")).alias("value")),
            F.struct(F.lit("PropertyValue").alias("@type"), F.lit("record_count").alias("name"),
                     F.col("record_count").cast("string").alias("value")),
        ).alias("variableMeasured"),
    )
    return rows.select("dataset_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def to_feed_rows(catalog: DataFrame, snapshot: DataFrame, *, base_url: str) -> DataFrame:
    """One feed item per dataset; statuses a feed does not know collapse to ``unknown``."""
    known = [name for name in params.STATUSES if name != "discontinued"]
    health = snapshot.select("dataset_id", "status", "message", F.col("checked_at").alias("published_at"))
    rows = catalog.select("dataset_id", F.coalesce("name", "dataset_id").alias("name")).join(health, "dataset_id", "left")
    status = F.when(F.col("status").isin(*known), F.col("status")).otherwise("unknown")
    message = F.coalesce("message", F.lit("No health data available"))
    return rows.select(
        "dataset_id",
        F.concat(F.lit("["), status, F.lit("] "), F.col("name")).alias("title"),
        F.concat(F.lit(f"{base_url}/data/"), F.col("dataset_id"), F.lit(".md")).alias("link"),
        F.concat(F.col("name"), F.lit(": "), status, F.lit(". "), message).alias("description"),
        "published_at",
    )
