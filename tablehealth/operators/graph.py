"""Catalogue relationship graph.

Four of the six relations connect every pair of datasets that share a declared
value. Such a clique is stored as its membership rows, from which pair counts,
node degrees and isolated nodes are exact sums; the edges of chosen datasets are
expanded on demand. Only literal values are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth import params
from tablehealth.functions.cadence import lookup
from tablehealth.session import cut_lineage


def nodes(catalog: DataFrame) -> DataFrame:
    return catalog.select(
        "dataset_id", F.coalesce("name", "dataset_id").alias("title"), "steward", F.col("source").alias("agency")
    )


def memberships(catalog: DataFrame) -> DataFrame:
    """(kind, key, publisher, dataset_id): one row per dataset and declared value.

    ``publisher`` is set only for ``same_agency``, where two datasets of the same
    known publisher are not linked (they are linked by ``same_steward`` already).
    """
    def declared(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name))

    def item(kind: str, key: Column, publisher: Column | None = None) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), key.alias("key"),
            (F.lit(None).cast("string") if publisher is None else publisher).alias("publisher"),
        )

    both = F.when(
        declared("source").isNotNull() & declared("steward").isNotNull(),
        F.to_json(F.array(declared("source"), declared("steward"))),
    )
    items = F.array(
        item("same_steward", both),
        item("same_agency", declared("steward"), declared("source")),
        item("same_geography", declared("geography")),
        item("canonical_series", declared("series_code")),
        item("shared_schema", declared("schema_id")),
    )
    return catalog.select("dataset_id", F.inline(items)).where(F.col("key").isNotNull()).select(
        "kind", "key", "publisher", "dataset_id"
    )


def _pairs(n: Column) -> Column:
    return F.shiftright(n.cast("bigint") * (n - 1), 1)  # whole numbers: the product is even


def _group_sizes(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes per (kind, key, publisher) and per (kind, key)."""
    parts = members.groupBy("kind", "key", "publisher").agg(F.count("*").alias("_part"))
    whole = parts.groupBy("kind", "key").agg(
        F.sum("_part").alias("members"),
        F.sum(F.when(F.col("publisher").isNotNull(), _pairs(F.col("_part"))).otherwise(0)).alias("_excluded"),
    )
    return parts, whole


def groups(catalog: DataFrame) -> DataFrame:
    """Every clique with its size, number of edges and edge weight."""
    _, whole = _group_sizes(memberships(catalog))
    return whole.select(
        "kind", "key", "members", (_pairs(F.col("members")) - F.col("_excluded")).alias("edges"),
        lookup(F.col("kind"), params.EDGE_WEIGHTS).alias("weight"),
    )


def successor_edges(catalog: DataFrame) -> DataFrame:
    """Directed edges to superseded datasets; unknown, empty or own ids fail the job."""
    declared = catalog.select("dataset_id", F.explode("supersedes").alias("target"))
    known = catalog.select(F.col("dataset_id").alias("_known"))

    def fail(label: str) -> Column:
        return F.raise_error(
            F.concat(F.col("dataset_id"), F.lit(f".supersedes {label}: "), F.coalesce("target", F.lit("null")))
        ).cast("string")

    target = (
        F.when(F.col("target") == F.col("dataset_id"), fail("cannot reference itself"))
        .when(F.col("_known").isNull(), fail("references unknown dataset"))
        .otherwise(F.col("target"))
    )
    return declared.join(known, F.col("target") == F.col("_known"), "left").select(
        F.lit("successor_to").alias("kind"), F.col("dataset_id").alias("from_id"), target.alias("to_id"),
        F.lit(params.EDGE_WEIGHTS["successor_to"]).alias("weight"),
    )


def degrees(catalog: DataFrame) -> DataFrame:
    """Number of edges per (dataset, kind); zero rows are left out."""
    members = memberships(catalog)
    parts, whole = _group_sizes(members)
    part = parts.select(
        F.col("kind").alias("_kind"), F.col("key").alias("_key"), F.col("publisher").alias("_publisher"), "_part"
    )
    same = (
        (F.col("kind") == F.col("_kind")) & (F.col("key") == F.col("_key"))
        & F.col("publisher").eqNullSafe(F.col("_publisher"))
    )
    own = F.when(F.col("publisher").isNull(), 1).otherwise(F.col("_part"))
    sized = members.join(part, same).join(whole, ["kind", "key"]).select(
        "dataset_id", "kind", (F.col("members") - own).alias("degree")
    )
    successors = successor_edges(catalog)
    directed = successors.select(F.explode(F.array("from_id", "to_id")).alias("dataset_id"), "kind").select(
        "dataset_id", "kind", F.lit(1).cast("bigint").alias("degree")
    )
    return (
        sized.unionByName(directed).where(F.col("degree") > 0)
        .groupBy("dataset_id", "kind").agg(F.sum("degree").alias("degree"))
    )


def isolated(catalog: DataFrame) -> DataFrame:
    return catalog.select("dataset_id").join(degrees(catalog).select("dataset_id"), "dataset_id", "left_anti")


def edge_kinds(catalog: DataFrame) -> DataFrame:
    """Edges per kind, kinds without edges included, in a fixed order of names."""
    counted = (
        groups(catalog).select("kind", "edges")
        .unionByName(successor_edges(catalog).select("kind", F.lit(1).cast("bigint").alias("edges")))
        .groupBy("kind").agg(F.sum("edges").alias("edges"))
    )
    kinds = catalog.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(kind) for kind in params.EDGE_WEIGHTS])).alias("kind")
    )
    return kinds.join(counted, "kind", "left").select("kind", F.coalesce("edges", F.lit(0)).alias("edges"))


def _linkable(catalog: DataFrame, focus: DataFrame) -> DataFrame:
    """One row per (kind, key, dataset_id) with what a pair's test needs.

    ``low`` and ``high`` bound the known publishers, ``open`` tells of a row without one, ``several`` of
    an id with further keys of the kind, ``chosen`` of one in focus.
    """
    rows = memberships(catalog).where(F.col("dataset_id").isNotNull()).groupBy("kind", "key", "dataset_id").agg(
        F.min("publisher").alias("low"), F.max("publisher").alias("high"), (F.count("publisher") < F.count("*")).alias("open")
    )
    several = rows.groupBy("kind", "dataset_id").agg(F.count("*").alias("_keys")).where("_keys > 1").select(
        "kind", "dataset_id", F.lit(True).alias("several")
    )
    ids = focus.select("dataset_id").distinct().withColumn("chosen", F.lit(True))
    return rows.join(several, ["kind", "dataset_id"], "left").join(ids, "dataset_id", "left").select(
        "kind", "key", "dataset_id", "low", "high", "open",
        F.coalesce("several", F.lit(False)).alias("several"), F.coalesce("chosen", F.lit(False)).alias("chosen"),
    )


def _clique_pairs(chosen: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """(kind, from_id, to_id) of the linked pairs of a chosen and any member of the same key.

    Both sides of a large clique are dealt into blocks, and each block meets each block of the other side, so
    that no task gets a whole clique. The copies are sorted and merged: their number is not what Spark estimates.
    """
    def sized(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("kind", "key").agg(F.count("*").alias("_n")).where(F.col("_n") > block).select(
            "kind", "key", F.ceil(F.col("_n") / block).cast("int").alias(name)
        )

    own, other = sized(chosen, "_own"), sized(members, "_other")

    def dealt(df: DataFrame, mine: str, its: str) -> DataFrame:
        tiled = df.join(own, ["kind", "key"], "left").join(other, ["kind", "key"], "left")
        place = F.pmod(F.xxhash64("dataset_id"), F.coalesce(mine, F.lit(1))).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(its, F.lit(1)) - 1))
        return tiled.withColumn(f"{mine}_block", place).withColumn(f"{its}_block", copies)

    tile = ["kind", "key", "_own_block", "_other_block"]
    left = dealt(chosen, "_own", "_other").select(*tile, F.struct("dataset_id", "low", "high", "open").alias("a"))
    right = dealt(members, "_other", "_own").select(*tile, F.struct("dataset_id", "low", "high", "open", "chosen").alias("b"))
    a, b = F.col("a.dataset_id"), F.col("b.dataset_id")
    once = (a < b) | (~F.col("b.chosen") & (a != b))  # two chosen ones meet twice
    publishers = F.col("a.open") | F.col("b.open") | (F.least("a.low", "b.low") < F.greatest("a.high", "b.high"))
    return left.hint("merge").join(right, tile).where(once & publishers).select(
        "kind", F.least(a, b).alias("from_id"), F.greatest(a, b).alias("to_id")
    )


def edges_of(catalog: DataFrame, focus: DataFrame, *, block: int = 1024) -> DataFrame:
    """All edges that touch the focus datasets; ids of an undirected edge are ordered.

    Each edge is made once, so the edges, as many as a clique's pairs, are neither shuffled nor held. Only where both
    ids have several keys of a kind can an edge come from more than one, and those edges are made distinct.
    """
    members = cut_lineage(_linkable(catalog, focus))
    several = members.where("several")
    once = _clique_pairs(members.where("chosen and not several"), members, block).unionByName(
        _clique_pairs(several.where("chosen"), members.where("not several"), block)
    )
    pairs = once.unionByName(_clique_pairs(several.where("chosen"), several, block).distinct())
    undirected = pairs.select("kind", "from_id", "to_id", lookup(F.col("kind"), params.EDGE_WEIGHTS).alias("weight"))
    ids = focus.select(F.col("dataset_id").alias("_focus"))
    directed = successor_edges(catalog)
    touching = directed.join(ids, (directed["from_id"] == ids["_focus"]), "left_semi").unionByName(
        directed.join(ids, directed["to_id"] == ids["_focus"], "left_semi")
    )
    return undirected.unionByName(touching.distinct())
