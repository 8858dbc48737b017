"""Cross-table integrity findings: one row per violation, empty when sound."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth import params


def _findings(df: DataFrame, rule: str, subject: Column | str, detail: Column | str | None = None) -> DataFrame:
    subject = F.col(subject) if isinstance(subject, str) else subject
    detail = F.lit(detail) if detail is None or isinstance(detail, str) else detail
    return df.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def duplicates(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    return _findings(repeated, rule, F.concat_ws("|", *keys), F.col("_n"))


def _presence(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Occurrences of every key in every table, by one grouping over the union of the keys."""
    labels = list(tables)
    marked = [
        tables[label].select(F.col(key).alias("_id"), F.lit(i).alias("_table")) for i, label in enumerate(labels)
    ]
    return reduce(DataFrame.unionByName, marked).groupBy("_id").agg(
        *[F.count_if(F.col("_table") == i).alias(f"_n{i}") for i in range(len(labels))]
    )


def _explode_findings(df: DataFrame, rules: list[tuple[Column, str, Column | None]]) -> DataFrame:
    """One finding per row and violated rule; ``df`` has ``_id``."""
    items = F.array(*[
        F.when(broken, F.struct(
            F.lit(rule).alias("rule"), F.col("_id").cast("string").alias("subject"),
            (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
        ))
        for broken, rule, detail in rules
    ])
    return df.select(F.inline(F.filter(items, lambda item: item.isNotNull())))


def id_set_findings(left: DataFrame, right: DataFrame, *, key: str = "dataset_id", left_name: str = "catalogue", right_name: str = "health") -> DataFrame:
    """Ids on one side only, and ids that occur twice on the right."""
    here, there = F.col("_n0"), F.col("_n1")
    return _explode_findings(_presence({left_name: left, right_name: right}, key), [
        ((here > 0) & (there == 0), f"missing from {right_name}", None),
        ((here == 0) & (there > 0), f"missing from {left_name}", None),
        (there > 1, f"duplicate in {right_name}", there),
    ])


def integrity_findings(
    catalog: DataFrame,
    snapshot: DataFrame,
    *,
    custodians: DataFrame | None = None,
    summary: Mapping[str, int] | None = None,
) -> DataFrame:
    """Duplicate ids, id-set differences, custodian references, and summary arithmetic.

    ``summary`` holds ``datasets_total`` and one count per status (hyphens or underscores).
    """
    parts = [duplicates(catalog, ["dataset_id"], "duplicate in catalogue"), id_set_findings(catalog, snapshot)]
    if custodians is not None:
        used = catalog.where(F.col("custodian").isNotNull()).select("custodian").distinct()
        registered = custodians.select("custodian").distinct()
        parts.append(_findings(used.join(registered, "custodian", "left_anti"), "unresolved custodian", "custodian"))
        parts.append(_findings(registered.join(used, "custodian", "left_anti"), "unreferenced custodian", "custodian"))
    if summary is not None:
        counts = {name.replace("_", "-"): value for name, value in summary.items() if name != "datasets_total"}
        total = F.lit(summary.get("datasets_total")).cast("bigint")
        rows = snapshot.agg(F.count("*").alias("_n"))
        parts.append(_findings(
            rows.where(~F.col("_n").eqNullSafe(total)), "summary total differs from rows", F.lit("datasets_total"), F.col("_n")
        ))
        stored = sum(counts.values())
        parts.append(_findings(
            rows.where(F.col("_n") != stored), "summary status counts do not sum to rows", F.lit("by_status"), F.col("_n")
        ))
        reported = catalog.sparkSession.createDataFrame(list(counts.items()), "status string, reported bigint")
        actual = snapshot.groupBy("status").agg(F.count("*").alias("actual"))
        wrong = reported.join(actual, "status", "full").where(
            F.coalesce("reported", F.lit(0)) != F.coalesce("actual", F.lit(0))
        )
        parts.append(_findings(
            wrong, "summary status count differs from rows", "status",
            F.concat(F.coalesce("reported", F.lit(0)).cast("string"), F.lit("/"), F.coalesce("actual", F.lit(0)).cast("string")),
        ))
    return _all(parts)


def output_invariants(
    catalog: DataFrame,
    *,
    trends: DataFrame | None = None,
    drifts: DataFrame | None = None,
    members: DataFrame | None = None,
    groups: DataFrame | None = None,
    scores: DataFrame | None = None,
    edges: DataFrame | None = None,
    memberships: DataFrame | None = None,
) -> DataFrame:
    """Invariants of the derived tables: complete unique keys, closed domains, known endpoints.

    ``memberships`` (kind, key, publisher, dataset_id) stand for all undirected edges: a dataset that is in one group of a kind once has
    no edge to itself and none twice.
    """
    parts = []
    domains = (
        (trends, "trends", "trend", tuple(params.TREND_SCORE)),
        (trends, "trends", "reliability_grade", (*params.GRADES, "insufficient_data")),
        (drifts, "drift", "verdict", tuple(params.DRIFT_SCORE)),
        (groups, "reconciliation", "verdict", tuple(name for name in params.RECON_SCORE if name != "single_source")),
    )
    for table, label, column, domain in domains:
        if table is not None:
            outside = table.where(~F.coalesce(F.col(column).isin(*domain), F.lit(False)))
            key = "group_key" if label == "reconciliation" else "dataset_id"
            parts.append(_findings(outside, f"{label}.{column} outside its domain", key, F.col(column)))
    keyed = {label: table for label, table in (("trends", trends), ("drift", drifts), ("scores", scores)) if table is not None}
    tables = {"catalogue": catalog, **keyed}
    if members is not None:
        tables["groups"] = members
    if edges is not None:
        tables["edges"] = edges.select(F.explode(F.array("from_id", "to_id")).alias("dataset_id"))
    if memberships is not None:
        tables["memberships"] = memberships.select("dataset_id")
    counts = {label: F.col(f"_n{i}") for i, label in enumerate(tables)}
    listed = counts["catalogue"] > 0
    rules = []
    for label in keyed:
        rules += [
            (listed & (counts[label] == 0), f"missing from {label}", None),
            (~listed & (counts[label] > 0), "missing from catalogue", F.lit(label)),
            (counts[label] > 1, f"duplicate in {label}", counts[label]),
        ]
    if members is not None:
        rules += [
            (~listed & (counts["groups"] > 0), "group member missing from catalogue", None),
            (counts["groups"] > 1, "dataset in more than one group", counts["groups"]),
        ]
    if edges is not None:
        rules.append((~listed & (counts["edges"] > 0), "edge endpoint missing from catalogue", None))
    if memberships is not None:
        rules.append((~listed & (counts["memberships"] > 0), "edge group member missing from catalogue", None))
    parts.append(_explode_findings(_presence(tables, "dataset_id"), rules))
    if scores is not None:
        parts.append(_findings(
            scores.where(~F.col("score").between(0, 100)), "score outside 0..100", "dataset_id", F.col("score")
        ))
    if edges is not None:
        parts.append(duplicates(edges, ["kind", "from_id", "to_id"], "duplicate edge"))
        parts.append(_findings(edges.where(F.col("from_id") == F.col("to_id")), "edge to itself", "from_id"))
        weight = F.lit(None).cast("int")
        for kind, value in params.EDGE_WEIGHTS.items():
            weight = F.when(F.col("kind") == kind, value).otherwise(weight)
        parts.append(_findings(edges.where(~F.col("weight").eqNullSafe(weight)), "edge weight differs", "from_id", F.col("kind")))
    if memberships is not None:
        parts.append(duplicates(memberships, ["kind", "dataset_id"], "dataset twice in edge groups of a kind"))
        outside = memberships.where(~F.coalesce(F.col("kind").isin(*params.EDGE_WEIGHTS), F.lit(False)))
        parts.append(_findings(outside, "edge kind without weight", "dataset_id", F.col("kind")))
    return _all(parts)
