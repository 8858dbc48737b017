"""Membership of one dataset's link in the head of its day, by stored digest trees and audit paths.

A day's tree (``head_tree``) is published beside its head: the listed links, and the digests of leaves, nodes and root that
``chain.ordered_digest`` makes of them. A path is a dataset's item, its leaf, its node and the root, and it holds if every
digest on it covers what is listed below it and the root is the one that the head signs. Soundness is found once for each
place of the tree, by grouping children under their parents, and joined to the datasets by place: no day passes through one
task, and a leaf holds a 16.7-millionth of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehealth.functions.text import canonical_json, chain_digest, sha256_text
from tablehealth.operators import chain

_LEAF, _NODE, _ROOT = chain.LEVELS
_LEVELS = {_LEAF: "leaf", _NODE: "node", _ROOT: "root"}
TREE = "date DATE, level STRING, place STRING, dataset_id STRING, chain_link STRING, rows BIGINT, digest STRING"


def _place(digits: int):
    return F.substring(sha256_text(F.col("dataset_id")), 1, digits)


def _item():
    return canonical_json({"chain_link": F.col("chain_link"), "dataset_id": F.col("dataset_id")})


def _joined(value: str, by: str, separator: str):
    pairs = F.array_sort(F.collect_list(F.struct(F.col(by).alias("o"), F.col(value).alias("i"))))
    return F.array_join(F.transform(pairs, lambda pair: pair["i"]), separator)


def _leaves(items: DataFrame) -> DataFrame:
    """(date, place, rows, digest) of the leaves that listed links (date, place, dataset_id, chain_link) add up to."""
    return items.withColumn("_item", _item()).groupBy("date", "place").agg(
        F.count(F.lit(1)).alias("rows"), sha256_text(F.concat(F.lit("["), _joined("_item", "dataset_id", ","), F.lit("]"))).alias("digest"))


def _above(children: DataFrame, digits: int) -> DataFrame:
    """(date, place, rows, digest) of the parents that digests (date, place, rows, digest) add up to."""
    placed = children.withColumn("_above", F.substring("place", 1, digits))
    return placed.groupBy("date", F.col("_above")).agg(
        F.sum("rows").alias("rows"), sha256_text(_joined("digest", "place", "")).alias("digest")).withColumnRenamed("_above", "place")


def head_tree(links: DataFrame) -> DataFrame:
    """The tree (``TREE``) of each day of ``links`` (date, dataset_id, chain_link): items, leaves, nodes and root.

    The root's digest is the ``dataset_links_sha256`` of ``chain.daily_chain_head``. Items carry the place of their leaf.
    """
    items = links.select("date", _place(_LEAF).alias("place"), "dataset_id", "chain_link")
    level = _leaves(items)
    none = F.lit(None).cast("string")
    tree = items.select("date", F.lit("item").alias("level"), "place", "dataset_id", "chain_link", F.lit(1).cast("bigint").alias("rows"), none.alias("digest"))
    for digits in chain.LEVELS:
        if digits != _LEAF:
            level = _above(level, digits)
        tree = tree.unionByName(level.select("date", F.lit(_LEVELS[digits]).alias("level"), "place", none.alias("dataset_id"), none.alias("chain_link"), "rows", "digest"))
    return tree


def _sound(stored: DataFrame, found: DataFrame, label: str) -> DataFrame:
    """(date, place, label): whether a stored place is what lies below it adds up to; a place that only one side has is not."""
    pair = stored.select("date", "place", F.col("rows").alias("_rows"), F.col("digest").alias("_digest")).join(found, ["date", "place"], "full_outer")
    holds = F.col("digest").eqNullSafe(F.col("_digest")) & F.col("rows").eqNullSafe(F.col("_rows"))
    # a place that is stored twice holds only if both do
    return pair.groupBy("date", "place").agg((F.min(holds) & (F.count(F.lit(1)) == 1)).alias(label))


def audit_paths(tree: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, nodes, roots): ``leaf_holds``, ``node_holds`` and ``root_holds`` by date and place.

    ``root_holds`` also asks that the head of the day names the root's digest and number of links.
    """
    at = {level: tree.where(F.col("level") == level) for level in ("item", *_LEVELS.values())}
    leaves = _sound(at["leaf"], _leaves(at["item"]), "leaf_holds")
    nodes = _sound(at["node"], _above(at["leaf"], _NODE), "node_holds")
    roots = _sound(at["root"], _above(at["node"], _ROOT), "_adds_up")
    named = at["root"].groupBy("date").agg(F.max("digest").alias("_root"), F.max("rows").alias("_count"))
    signed = heads.select("date", "dataset_links_sha256", "dataset_count")
    roots = signed.join(named, "date", "left").join(roots.drop("place"), "date", "left").select(
        "date", F.coalesce(F.col("_adds_up") & (F.col("_root") == F.col("dataset_links_sha256")) & (F.col("_count") == F.col("dataset_count")), F.lit(False)).alias("root_holds"))
    return leaves, nodes, roots


def verify_membership(links: DataFrame, tree: DataFrame, heads: DataFrame) -> DataFrame:
    """``links`` (date, dataset_id, chain_link, ...) with ``membership``, one row each:

    ``no_head`` if the day has no head, ``invalid_path`` if the leaf, node or root of the dataset's place doesn't add up or
    isn't the one that the head names, ``omitted`` if the path holds but doesn't list the dataset, ``other_link`` if it lists it
    with another link only, else ``member``. A link without a date or dataset is in no head: ``no_head`` and ``omitted``.
    Heads have one row a day.
    """
    leaves, nodes, roots = audit_paths(tree, heads)
    listed = tree.where(F.col("level") == "item").groupBy("date", "dataset_id").agg(F.collect_set("chain_link").alias("_listed"))
    rows = links.withColumns({"_leaf": _place(_LEAF), "_node": _place(_NODE)})
    rows = (
        rows.join(listed, ["date", "dataset_id"], "left")
        .join(leaves.withColumnRenamed("place", "_leaf"), ["date", "_leaf"], "left")
        .join(nodes.withColumnRenamed("place", "_node"), ["date", "_node"], "left")
        .join(roots, "date", "left")
    )
    # a place that the tree doesn't have at all is no fault: its parent adds up without it
    path = F.coalesce("leaf_holds", F.lit(True)) & F.coalesce("node_holds", F.lit(True)) & F.col("root_holds")
    membership = (
        F.when(F.col("root_holds").isNull(), "no_head").when(~path, "invalid_path").when(F.col("_listed").isNull(), "omitted")
        .when(~F.coalesce(F.array_contains("_listed", F.col("chain_link")), F.lit(False)), "other_link").otherwise("member")
    )
    return rows.select(*[F.col(f"`{name}`") for name in links.columns], membership.alias("membership"))


def verify_attestations(links: DataFrame, tree: DataFrame, heads: DataFrame, registry: DataFrame, *, anchors: DataFrame | None = None) -> DataFrame:
    """The verdict of every dataset's attestation: its own link and key, its membership, and the replay of its day's head.

    (date, dataset_id, link_valid, key_registry_match, key_time_valid, membership, replayed, verified, reason). The key is
    the payload's; signatures themselves are out of scope. ``reason`` names the first check that fails.
    """
    judged = verify_membership(links, tree, heads)
    own = F.coalesce(F.col("chain_link") == chain_digest(F.col("previous_chain_head"), F.col("payload")), F.lit(False))
    keyed = judged.withColumns({
        "link_valid": own, "key_id": F.get_json_object("payload", "$.key_id"), "public_key": F.get_json_object("payload", "$.signer_pubkey_base64")})
    keyed = chain.key_validity(keyed, registry)
    days = chain.verify_chain(links, heads, anchors=anchors).select("date", "head_valid", "replayed")
    rows = keyed.join(days, "date", "left").withColumn("replayed", F.coalesce("replayed", F.lit(False)))
    reason = (
        F.when(~F.col("link_valid"), "link").when(~F.col("key_valid"), "key").when(F.col("membership") != "member", "membership")
        .when(~F.col("replayed"), "replay")
    )
    return rows.select("date", "dataset_id", "link_valid", "key_registry_match", "key_time_valid", "membership", "replayed", reason.isNull().alias("verified"), reason.alias("reason"))
