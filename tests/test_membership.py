"""Audit paths, keys as of an instant, and the verdict of each attestation, with planted faults."""

from __future__ import annotations

import pytest
from conftest import ts
from pyspark.sql import functions as F
from test_trust_and_chain import links_for

from tablehealth.operators import chain, membership
from tablehealth.session import stored

IDS = tuple("abcdefgh")


@pytest.fixture(scope="module")
def day(spark):
    links = stored(links_for(spark, "2026-08-14", None, ids=IDS))
    return links, stored(membership.head_tree(links)), stored(chain.daily_chain_head(links, key_id="k"))


def verdicts(links, tree, heads):
    return {r["dataset_id"]: r["membership"] for r in membership.verify_membership(links, tree, heads).collect()}


def test_root_is_the_digest_of_the_head(day):
    links, tree, heads = day
    root = tree.where("level = 'root'").collect()
    assert [(r["digest"], r["rows"]) for r in root] == [(heads.first()["dataset_links_sha256"], len(IDS))]
    assert set(verdicts(links, tree, heads).values()) == {"member"}


def test_planted_faults(day):
    links, tree, heads = day
    without = links.where("dataset_id != 'b'")
    tree_without, heads_without = membership.head_tree(without), chain.daily_chain_head(without, key_id="k")
    # the head never held b; c's published link was exchanged afterwards
    shown = links.withColumn("chain_link", F.when(F.col("dataset_id") == "c", F.reverse("chain_link")).otherwise(F.col("chain_link")))
    found = verdicts(shown, tree_without, heads_without)
    assert found == {i: {"b": "omitted", "c": "other_link"}.get(i, "member") for i in IDS}
    # an item taken out of the listing, a leaf digest exchanged, and a root that the head doesn't name
    assert verdicts(links, tree.where("level != 'item' or dataset_id != 'b'"), heads) == {i: "invalid_path" if i == "b" else "member" for i in IDS}
    leaf = links.where("dataset_id = 'd'").select(F.substring(F.sha2("dataset_id", 256), 1, 6)).first()[0]
    forged = tree.withColumn("digest", F.when((F.col("level") == "leaf") & (F.col("place") == leaf), F.reverse("digest")).otherwise(F.col("digest")))
    assert verdicts(links, forged, heads)["d"] == "invalid_path"
    assert set(verdicts(links, tree, heads_without).values()) == {"invalid_path"}
    assert set(verdicts(links, tree, heads.limit(0)).values()) == {"no_head"}
    twice = tree.unionByName(tree.where("level = 'item' and dataset_id = 'e'").withColumn("chain_link", F.reverse("chain_link")))
    assert verdicts(links, twice, heads)["e"] == "invalid_path"


def test_null_and_empty(day):
    links, tree, heads = day
    odd = links.limit(1).withColumn("dataset_id", F.lit(None).cast("string")).unionByName(links.limit(1).withColumn("date", F.lit(None).cast("date")))
    assert sorted(r["membership"] for r in membership.verify_membership(odd, tree, heads).collect()) == ["no_head", "omitted"]
    assert membership.verify_membership(links.limit(0), tree, heads).collect() == []
    assert set(verdicts(links, tree.limit(0), heads).values()) == {"invalid_path"}


KEYS = "key_id string, public_key string, not_before timestamp, not_after timestamp, algorithm string, status string, compromised_at timestamp"


def key(public, start, end, status="active", name="k"):
    return (name, public, ts(f"2026-08-{start:02}"), ts(f"2026-08-{end:02}"), "Ed25519", status, None)


def test_one_row_per_attestation_with_repeated_and_overlapping_keys(spark):
    registry = spark.createDataFrame([
        key("p1", 1, 10), key("p1", 1, 10), key("p2", 8, 20), key("p3", 8, 12), key("p4", 25, 26), key("p4", 25, 26, "compromised")], KEYS)
    asked = [("p1", 5), ("p2", 5), ("p2", 9), ("p3", 9), ("p1", 9), ("p2", 22), ("p4", 25), ("p1", None)]
    rows = [(i, "k", public, ts(f"2026-08-{at:02}") if at else None) for i, (public, at) in enumerate(asked)] + [(8, "other", "p1", ts("2026-08-05")), (9, None, None, ts("2026-08-05"))]
    df = spark.createDataFrame([(i, k, p, at) for i, k, p, at in rows] + [(10, "k", "p1", ts("2026-07-01"))], "i int, key_id string, public_key string, observed_at timestamp")
    found = {r["i"]: (r["key_registry_match"], r["key_time_valid"], r["key_valid"]) for r in chain.key_validity(df, registry).collect()}
    yes, no, late = (True, True, True), (False, True, False), (True, False, False)
    # of equal starts the later end holds; of equal intervals 'compromised' comes after 'active'; before all, the first entry
    assert found == {0: yes, 1: no, 2: yes, 3: no, 4: no, 5: late, 6: (True, True, False), 7: late, 8: (False,) * 3, 9: (False,) * 3, 10: late}


def test_verdict_of_each_attestation(spark, day):
    links, tree, heads = day
    registry = spark.createDataFrame([key("", 1, 30)], KEYS)
    anyhow = membership.verify_attestations(links, tree, heads, registry).collect()
    assert len(anyhow) == len(IDS) and all(r["verified"] and r["reason"] is None for r in anyhow)
    forged = links.withColumn("payload", F.when(F.col("dataset_id") == "a", F.replace("payload", F.lit("fresh"), F.lit("stale"))).otherwise(F.col("payload")))
    reasons = {r["dataset_id"]: r["reason"] for r in membership.verify_attestations(forged, tree, heads, registry).collect()}
    assert reasons == {i: "link" if i == "a" else "replay" for i in IDS}
    late = {r["reason"] for r in membership.verify_attestations(links, tree, heads, spark.createDataFrame([key("", 20, 30)], KEYS)).collect()}
    assert late == {"key"}
