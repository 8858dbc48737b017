from __future__ import annotations

import hashlib
import itertools
import json

import pytest
from conftest import by_id, catalog_rows, snapshot_rows, ts
from pyspark.sql import functions as F

from tablehealth import params
from tablehealth.session import cut_lineage
from tablehealth.operators import chain, evidence, ranked, reconcile, trust

NOW = "2026-08-14 12:00:00"


def score(spark, health, trend=None, drift=None, verdict=None):
    catalog = catalog_rows(spark, [{"dataset_id": "a"}])
    snap = snapshot_rows(spark, [{"dataset_id": "a", **health}] if health else [])
    trends = spark.createDataFrame([("a", *trend)] if trend else [], "dataset_id STRING, trend STRING, publish_on_time_pct DOUBLE")
    drifts = spark.createDataFrame([("a", drift)] if drift else [], "dataset_id STRING, verdict STRING")
    verdicts = spark.createDataFrame([("a", verdict)] if verdict else [], "dataset_id STRING, reconciliation_verdict STRING")
    return trust.trust_score(catalog, snap, trends, drifts, verdicts).first().asDict(recursive=True)


def test_trust_score(spark):
    full = score(spark, {"status": "fresh"}, ("stable", 90.0), "stable", "agree")
    assert full["score"] == 92.0  # 30 + 27 + 15 + 10 + 10
    assert score(spark, None)["score"] == 50.0
    assert score(spark, {"status": "unreachable"})["score"] == 25.0
    stale = {"status": "stale", "staleness_days": 365}
    assert score(spark, stale, ("recovering", 100.0), "stable")["score"] == 30.0
    assert score(spark, stale | {"staleness_days": 364}, ("recovering", 100.0), "stable")["score"] == 73.3  # 66 / 0.9
    part = score(spark, {"status": "reference"}, ("insufficient_data", None), "insufficient_data")
    assert part["score"] == 90.0 and part["component_availability"]["freshness"] == {"available": True, "reason": "classified"}
    assert {k: v["reason"] for k, v in part["component_availability"].items() if not v["available"]} == {
        "reliability": "missing_record", "trend": "insufficient_history", "drift": "insufficient_history", "cross_source_agreement": "not_applicable"}
    assert score(spark, {"status": "odd"})["component_availability"]["freshness"]["reason"] == "unknown_status"


def links_for(spark, day, head, ids=("a", "b")):
    catalog = catalog_rows(spark, [{"dataset_id": i, "url": f"https://x/{i}é"} for i in ids])
    snap = snapshot_rows(spark, [{"dataset_id": i, "status": "fresh", "last_checked": ts(NOW), "checked_at": ts(NOW), "access_dependency": "direct"} for i in ids])
    counts = spark.createDataFrame([("a", 3, 1)], "dataset_id STRING, probe_count_14d BIGINT, probe_count_24h BIGINT")
    return chain.attestation_links(catalog, snap, counts, day=day, previous_head=head, key_id="k")


def canonical(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()


def tree_digest_by_hand(links):
    """Leaf, node and root of the day's digest tree: not one flat digest over the sorted list of links.

    A link's place is the start of its dataset id's hash: six digits name its leaf, three its node.
    """
    leaves, nodes = {}, {}
    for row in sorted(links, key=lambda r: r["dataset_id"]):
        item = canonical({"dataset_id": row["dataset_id"], "chain_link": row["chain_link"]}).decode()
        leaves.setdefault(hashlib.sha256(row["dataset_id"].encode()).hexdigest()[:6], []).append(item)
    for place, items in sorted(leaves.items()):
        nodes.setdefault(place[:3], []).append(hashlib.sha256(f"[{','.join(items)}]".encode()).hexdigest())
    above = [hashlib.sha256("".join(digests).encode()).hexdigest() for _, digests in sorted(nodes.items())]
    return hashlib.sha256("".join(above).encode()).hexdigest()


def test_links_and_head_by_hand(spark):
    links = links_for(spark, "2026-08-14", None).collect()
    for row in links:
        payload = json.loads(row["payload"])
        assert canonical(payload) == row["payload"].encode()
        assert row["chain_link"] == hashlib.sha256(bytes.fromhex(params.GENESIS) + canonical(payload)).hexdigest()
    head = chain.daily_chain_head(links_for(spark, "2026-08-14", None), key_id="k").first()
    assert head["dataset_links_sha256"] == tree_digest_by_hand(links)
    assert head["chain_head"] == hashlib.sha256(bytes.fromhex(params.GENESIS) + head["payload"].encode()).hexdigest()


def test_verify_chain_finds_tampering(spark):
    links, heads, previous = [], [], None
    for day in ("2026-08-12", "2026-08-13", "2026-08-14"):
        links.append(links_for(spark, day, previous))
        heads.append(chain.daily_chain_head(links[-1], key_id="k"))
        previous = heads[-1].first()["chain_head"]
    all_links = cut_lineage(links[0].unionByName(links[1]).unionByName(links[2]))
    all_heads = cut_lineage(heads[0].unionByName(heads[1]).unionByName(heads[2]))
    assert [r["replayed"] for r in chain.verify_chain(all_links, all_heads).orderBy("date").collect()] == [True] * 3
    middle = F.col("date") == F.lit("2026-08-13").cast("date")
    forged = all_links.withColumn("payload", F.when(middle, F.replace("payload", F.lit("fresh"), F.lit("stale"))).otherwise(F.col("payload")))
    rows = chain.verify_chain(forged, all_heads).orderBy("date").collect()
    assert [(r["links_valid"], r["replayed"]) for r in rows] == [(True, True), (False, False), (True, False)]
    gap = chain.verify_chain(all_links, all_heads.where(~middle)).orderBy("date").collect()
    assert [(r["previous"], r["replayed"]) for r in gap] == [("genesis", True), ("missing", False)]
    anchors = all_heads.where(middle).select("chain_head")
    anchored = chain.verify_chain(all_links, all_heads, anchors=anchors).orderBy("date").collect()
    assert [r["replayed"] for r in anchored] == [False, True, True]
    lost = chain.verify_chain(all_links.where(~middle | (F.col("dataset_id") != "a")), all_heads).orderBy("date").collect()
    assert [r["digest_valid"] for r in lost] == [True, False, True]


HEADER = ("reg_no", "product", "holder", "holder_osa", "manufacturer", "manufacturer_osa", "importer", "importer_osa")


def register(spark, rows):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows, start=1)], "row_no BIGINT, " + ", ".join(f"{h} STRING" for h in HEADER))


def test_record_evidence(spark):
    rows = [
        ("mal00000001a", "p", "H", "873.0", "M", "", "", ""), ("MAL00000001A", "p", "", "", "", "", "I", "9"),
        ("BAD", "p", "", "", "", "", "", ""), ("  ", "p", "", "", "", "", "", ""),
    ]
    table = evidence.record_evidence(
        register(spark, rows), dataset_id=params.REGISTRY_DATASET, freshness_status="fresh", source_last_modified="2026-08-14T00:00:00Z", age_days=0)
    got = {r["row_no"]: r for r in table.collect()}
    assert [got[i]["record_id"] for i in (1, 2, 3, 4)] == ["reg_no:MAL00000001A", "reg_no:MAL00000001A#2", "reg_no:BAD", "row:4"]
    assert [got[i]["status"] for i in (1, 2, 3, 4)] == ["fresh", "fresh", "degraded", "degraded"]
    assert [got[i]["missing_required_fields"] for i in (3, 4)] == [["reg_no:pattern"], ["reg_no"]]
    expected = {
        "freshness": {"source_last_modified": "2026-08-14T00:00:00Z", "age_days": 0}, "structural": {"schema_ok": True, "missing_required_fields": []},
        "linkage": {"linked_to": [{"kind": "held_by", "to": "osa_code:873.0"}], "unmatched": ["manufacturer:M"]}, "alternatives": [],
    }
    assert got[1]["evidence_digest"] == "sha256:" + hashlib.sha256(canonical(expected)).hexdigest()
    envelope = evidence.evidence_envelope(table, dataset_id="x", run_date="2026-08-14")
    row = envelope.first()
    assert (row["record_count"], row["schema_valid_count"], row["status_fresh"], row["status_degraded"], row["status_stale"]) == (4, 2, 2, 2, 0)
    check = dict(age_days=0, source_last_modified="2026-08-14T00:00:00Z")
    assert evidence.validate_evidence(table, envelope, **check).count() == 0
    rules = {r["rule"] for r in evidence.validate_evidence(table.withColumn("record_id", F.lit("x")), envelope, age_days=1, source_last_modified=None).collect()}
    assert rules == {"record_id values must be unique", "record freshness differs from envelope freshness"}
    assert [r["row_no"] for r in evidence.representative_excerpt(table, n=2).collect()] == [1, 3]
    assert [r["row_no"] for r in evidence.representative_excerpt(table, n=3).collect()] == [1, 2, 3]


def test_dataset_freshness_status(spark):
    ddl = "dataset_id STRING, refresh_frequency STRING, data_type STRING, discontinued BOOLEAN, real_status STRING, source_last_modified TIMESTAMP"
    rows = [
        ("gone", "daily", None, True, None, None), ("also_gone", "daily", None, None, "discontinued", None), ("ref", "daily", "reference", None, None, None),
        ("none", "daily", None, None, None, None), ("fresh", "weekly", None, None, None, ts("2026-08-07 23:00:00")), ("aging", "weekly", None, None, None, ts("2026-07-24 01:00:00")),
        ("stale", "weekly", None, None, None, ts("2026-07-23 23:59:00")), (params.REGISTRY_DATASET, "monthly", None, None, None, ts("2026-08-12 00:00:00")),
        ("odd", "fortnightly", None, None, None, ts("2026-08-12 00:00:00")),
    ]
    got = by_id(evidence.dataset_freshness_status(spark.createDataFrame(rows, ddl), run_date="2026-08-14"))
    assert [got[r[0]]["freshness_status"] for r in rows] == [
        "discontinued", "discontinued", "reference", "unknown-freshness", "fresh", "aging", "stale", "aging", "unknown-freshness"]
    future = spark.createDataFrame([("f", "daily", None, None, None, ts("2026-08-15 00:00:00"))], ddl)
    with pytest.raises(Exception, match="future"):
        evidence.dataset_freshness_status(future, run_date="2026-08-14").collect()


def test_reconciliation_cases(spark):
    catalog = catalog_rows(spark, [
        {"dataset_id": "a", "name": "OpenDOSM: Monthly Births", "custodian": "DOSM", "refresh_frequency": "monthly", "url": "https://one.example/a", "source": "x"},
        {"dataset_id": "b", "name": "monthly births", "custodian": "dosm", "refresh_frequency": "monthly", "url": "https://two.example/b", "source": "y"},
        {"dataset_id": "c", "name": "C", "custodian": "q", "refresh_frequency": "daily", "url": "HTTPS://Three.example/c#x"},
        {"dataset_id": "d", "name": "D", "custodian": "q", "refresh_frequency": "daily", "url": "https://three.example/c"},
        {"dataset_id": "e", "name": "Monthly Births", "custodian": "dosm", "refresh_frequency": "monthly", "url": "https://one.example/e", "geography": "k"},
        {"dataset_id": "alone", "name": "Alone births"},
    ])
    snap = snapshot_rows(spark, [
        {"dataset_id": "a", "record_count": 100, "status": "fresh", "content_freshness_date": ts("2026-08-01 00:00:00").date()},
        {"dataset_id": "b", "record_count": 140, "status": "fresh", "content_freshness_date": ts("2026-08-02 00:00:00").date()},
        {"dataset_id": "c", "record_count": 100, "status": "fresh"}, {"dataset_id": "d", "record_count": 101, "status": "fresh"}])
    seeds = spark.createDataFrame([("pair", "Pair", ["e", "alone"], "different_granularity", "why", "strict", 5.0, 2)],
                                  "key STRING, logical_name STRING, members ARRAY<STRING>, relationship STRING, rationale STRING, record_count_policy STRING, record_count_tolerance_pct DOUBLE, content_date_tolerance_days INT")
    members = cut_lineage(reconcile.discover_groups(catalog, seeds))
    table = cut_lineage(reconcile.reconcile(members, catalog, snap))
    groups = {r["grouping_method"]: r for r in table.collect()}
    assert {k: v["verdict"] for k, v in groups.items()} == {"seed": "different_granularity", "exact_url": "discrepancy", "semantic_title": "agree"}
    pair = next(r for r in reconcile.compare_with_anchor(reconcile.member_rows(members, catalog, snap)).collect() if r["left_id"] == "a")
    assert (pair["right_id"], pair["record_count_delta_pct"], pair["record_count_within_tolerance"]) == ("b", 28.571, None)
    names = lambda *queries: spark.createDataFrame([(q,) for q in queries], "query STRING")
    got = {r["query"]: r for r in ranked.check_reconciliation(catalog, members, table, names=names("c", "alone BIRTHS", "opendosm")).collect()}
    assert {k: (v["matched_dataset_id"], v["verdict"]) for k, v in got.items()} == {
        "c": ("c", "discrepancy"), "alone BIRTHS": ("alone", "different_granularity"), "opendosm": ("a", "agree")}
    for query, message in (("births", "ambiguous dataset name"), ("nothing", "unknown dataset name")):
        with pytest.raises(Exception, match=message):
            ranked.check_reconciliation(catalog, members, table, names=names(query)).collect()
    bad = seeds.withColumn("members", F.array(F.lit("e"), F.lit("zz")))
    with pytest.raises(Exception, match="not in the catalogue"):
        reconcile.discover_groups(catalog, bad).collect()


def test_reconciliation_name_runs_stay_off_the_driver(spark):
    # a stored table: its size is known, and that of what is made from its rows only guessed
    catalog = cut_lineage(catalog_rows(spark, [{"dataset_id": f"d{i:03}", "name": f"Series {i:03} of the catalogue"} for i in range(200)] + [{"dataset_id": "nameless"}]))
    members = spark.createDataFrame([("d007", "g")], "dataset_id STRING, group_key STRING")
    groups = spark.createDataFrame([("g", "G", "agree", 2, "why")], "group_key STRING, logical_name STRING, verdict STRING, member_count INT, reason STRING")
    names = spark.createDataFrame([("d001",), (" series 002 OF the catalogue",), ("SERIES 007",), ("s 199",), ("d001",)], "query STRING")
    got = ranked.check_reconciliation(catalog, members, groups, names=names)
    lines = got._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*")) for line in lines]
    for i, line in enumerate(lines):
        if line.lstrip(" :+-*").startswith("BroadcastExchange"):
            below = itertools.takewhile(lambda k: depth[k] > depth[i], range(i + 1, len(lines)))
            assert not any("Generate explode" in lines[k] for k in below), "the names' runs are broadcast"
    assert sorted((r["query"], r["matched_dataset_id"], r["verdict"]) for r in got.collect()) == [
        ("SERIES 007", "d007", "agree"), ("d001", "d001", "single_source"), ("s 199", "d199", "single_source"),
        ("series 002 OF the catalogue", "d002", "single_source")]
