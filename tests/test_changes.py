from __future__ import annotations

import datetime as dt

import pytest
from conftest import catalog_rows, history_rows, snapshot_rows, ts
from pyspark.sql import functions as F

from tablehealth.operators import changes, integrity, summary

CYCLE = "2026-08-14T09:46"


def ledger(spark, catalog, snap, rows):
    frame = changes.dataset_deltas(catalog_rows(spark, catalog), snapshot_rows(spark, snap), history_rows(spark, rows), cycle=CYCLE)
    return {(r["change_type"], r["dataset_id"]): r for r in frame.collect()}


def obs(dataset, cycle, **extra):
    return {"dataset_id": dataset, "observed_at": ts(cycle + ":00"), "cycle": cycle, **extra}


def test_delta_types(spark):
    got = ledger(
        spark,
        [{"dataset_id": "same", "name": "Same", "url": "u"}, {"dataset_id": "moved", "url": "new"}, {"dataset_id": "new_one"}, {"dataset_id": "absent"}],
        [
            {"dataset_id": "same", "status": "fresh", "record_count": 5, "first_row_hash": "h"},
            {"dataset_id": "moved", "status": "stale", "record_count": 9, "first_row_hash": "g", "anomaly_detected": True, "freshness_signal_source": "none", "content_shape_changed": True},
        ],
        [
            obs("same", CYCLE), obs("same", "2026-08-14T09:00", record_count=5, url="u", shape_hash="h"),
            obs("moved", "2026-08-14T08:00", record_count=4, url="old", shape_hash="f", anomaly_detected=False),
            obs("moved", "2026-08-14T09:00", probe_outcome="error", record_count=777),
            obs("absent", "2026-08-14T09:00", status="aging"),
            obs("gone", "2026-08-14T09:00", status="aging", name=""), obs("never_ok", "2026-08-14T09:00", probe_outcome="error"),
        ],
    )
    assert set(got) == {
        ("added", "new_one"), ("removed", "gone"), ("status_changed", "moved"), ("anomaly_changed", "moved"),
        ("url_changed", "moved"), ("schema_changed", "moved"), ("record_count_changed", "moved"),
    }
    assert got[("added", "new_one")]["name"] == "New One" and got[("removed", "gone")]["name"] == "Gone"
    count = got[("record_count_changed", "moved")]
    assert (count["from_value"], count["to_value"], count["detail"], count["from_cycle"]) == ("4", "9", "5", "2026-08-14T08:00")
    assert got[("status_changed", "moved")]["detail"] == "content-shape-changed"


def test_absent_baseline_evidence_is_no_change(spark):
    catalog, snap = [{"dataset_id": "a", "url": "u"}], [{"dataset_id": "a", "status": "fresh", "anomaly_detected": True, "record_count": 3, "first_row_hash": "h"}]
    assert ledger(spark, catalog, snap, [obs("a", CYCLE), obs("a", "2026-08-14T09:00")]) == {}
    assert ledger(spark, catalog, snap, [obs("a", CYCLE), obs("a", "2026-08-14T09:00", record_count=1, record_count_estimated=True)]) == {}


def test_ledger_without_a_baseline_is_empty(spark):
    catalog, snap = [{"dataset_id": "a"}], [{"dataset_id": "a", "status": "fresh"}]
    assert ledger(spark, catalog, snap, [obs("a", CYCLE)]) == {}
    frame = history_rows(spark, [obs("a", "2026-08-14T09:00")])
    assert changes.delta_baseline(frame, cycle=CYCLE).first()["previous_cycle_skipped_reason"] == f"no_history_line_for_cycle_{CYCLE}"
    with pytest.raises(ValueError):
        changes.delta_baseline(frame, cycle="today")


def test_record_count_classes(spark):
    cases = [
        (100, 112, "direct", "Blocker", "Structural"), (100, 105, "direct", "Approved", "Structural"), (100, 85, "gtfs-realtime", "Volatile", "Volatile"),
        (100, 40, "gtfs-realtime", "Blocker", "Operational"), (2, 0, "gtfs-realtime", "Blocker", "Operational"), (0, 1, "direct", "Blocker", "Structural"),
        (100, 124, "browser", "Approved", "Structural"), (100, 110, "odd", "Blocker", "Structural"),
    ]
    frame = spark.createDataFrame(
        [(float(b), float(a), k) for b, a, k, _, _ in cases], "b DOUBLE, a DOUBLE, k STRING")
    rows = frame.select(changes.classify_record_count(F.col("b"), F.col("a"), F.col("k")).alias("v")).select("v.*").collect()
    assert [(r["classification"], r["category"]) for r in rows] == [case[3:] for case in cases]
    codes = ["count-jumped", "count-within", "count-lively", "count-jumped", "count-stalled", "count-jumped", "count-within", "count-jumped"]
    assert [r["reason"] for r in rows] == [changes.RULES[code][1] for code in codes]


def test_compare_snapshots_sets_and_summary(spark):
    catalog = catalog_rows(spark, [{"dataset_id": "a"}, {"dataset_id": "b"}])
    at = ts("2026-08-14 00:00:00")
    live = snapshot_rows(spark, [{"dataset_id": "a", "status": "fresh", "last_checked": at, "staleness_days": 1, "record_count": 100}, {"dataset_id": "old", "status": "fresh"}])
    new = snapshot_rows(spark, [{"dataset_id": "a", "status": "stale", "last_checked": at + dt.timedelta(hours=1), "staleness_days": 5, "record_count": 100}, {"dataset_id": "x", "status": "fresh"}])
    found = {(r["dataset_id"], r["field"], r["reason"]): r["classification"] for r in changes.compare_snapshots(
        live, new, catalog, candidate_summary={"datasets_total": 9, "fresh": 2, "stale": 1}).collect()}
    assert found[("a", "status", changes.RULES["status-aged-at-once"][1])] == "Approved"
    assert found[("b", "dataset_id", changes.RULES["id-missing"][1])] == "Blocker"
    assert found[("x", "dataset_id", changes.RULES["id-unlisted"][1])] == "Blocker"
    assert found[("x", "dataset_id", changes.RULES["id-new"][1])] == "Blocker"
    assert found[("old", "dataset_id", changes.RULES["id-dropped"][1])] == "Blocker"
    assert found[("(summary)", "by_status.fresh", changes.RULES["sum-status"][1])] == "Blocker"
    assert found[("(summary)", "datasets_total", changes.RULES["sum-total"][1])] == "Blocker"
    assert len(found) == 9


def test_integrity_summary_findings(spark):
    catalog = catalog_rows(spark, [{"dataset_id": "a"}, {"dataset_id": "a"}, {"dataset_id": "b"}])
    snap = snapshot_rows(spark, [{"dataset_id": "a", "status": "fresh"}, {"dataset_id": "c", "status": "unknown-freshness"}])
    found = {(r["rule"], r["subject"]) for r in integrity.integrity_findings(
        catalog, snap, summary={"datasets_total": 2, "fresh": 1, "unknown_freshness": 2}).collect()}
    assert found == {
        ("duplicate in catalogue", "a"), ("missing from health", "b"), ("missing from catalogue", "c"),
        ("summary status counts do not sum to rows", "by_status"), ("summary status count differs from rows", "unknown-freshness"),
    }


def test_output_invariants_find_each_violation(spark):
    catalog = catalog_rows(spark, [{"dataset_id": "a"}, {"dataset_id": "b"}])
    trends = spark.createDataFrame([("a", "sideways", "A"), ("a", "stable", "A")], "dataset_id STRING, trend STRING, reliability_grade STRING")
    edges = spark.createDataFrame([("same_agency", "a", "z", 1), ("same_agency", "a", "z", 2)], "kind STRING, from_id STRING, to_id STRING, weight INT")
    members = spark.createDataFrame([("g", "a"), ("h", "a")], "group_key STRING, dataset_id STRING")
    rules = {r["rule"] for r in integrity.output_invariants(catalog, trends=trends, edges=edges, members=members).collect()}
    assert rules == {
        "trends.trend outside its domain", "missing from trends", "duplicate in trends", "duplicate edge", "edge weight differs",
        "edge endpoint missing from catalogue", "dataset in more than one group",
    }


def test_output_invariants_of_edges_as_memberships(spark):
    catalog = catalog_rows(spark, [{"dataset_id": "a", "data_type": "series"}, {"dataset_id": "b"}])
    rows = [("same_geography", "x", None, "a"), ("same_geography", "y", None, "a"), ("shared_schema", "s", None, "z"), ("odd", "s", None, "b")]
    members = spark.createDataFrame(rows, "kind STRING, key STRING, publisher STRING, dataset_id STRING")
    rules = {r["rule"] for r in integrity.output_invariants(catalog, memberships=members).collect()}
    assert rules == {"edge group member missing from catalogue", "dataset twice in edge groups of a kind", "edge kind without weight"}


def test_output_invariants_query_checks_all_edges(spark, monkeypatch):
    from tablehealth.plans import registry

    seen = {}
    check = integrity.output_invariants
    monkeypatch.setattr(integrity, "output_invariants", lambda catalog, **tables: seen.update(tables, catalog=catalog) or check(catalog, **tables))
    assert registry.queries()["output_invariants"](spark, "/root/testdata/sf0.001").count() == 0
    declared = seen["catalog"].where("geography <> ''").count()
    assert declared > 0 and seen["memberships"].where("kind = 'same_geography'").count() == declared


def test_percentages_sum_to_100(spark):
    snap = snapshot_rows(spark, [{"dataset_id": str(i), "status": s} for i, s in enumerate(["fresh", "aging", "stale"])])
    rows = {r["status"]: r["percent"] for r in summary.status_distribution(snap).collect()}
    assert (rows["fresh"], rows["aging"], rows["stale"]) == (33.4, 33.3, 33.3)
    assert sum(r["percent"] for r in summary.status_distribution(snap.limit(0)).collect()) == 0


def test_sections_keep_reserved_ids_when_popular(spark):
    catalog = catalog_rows(spark, [
        {"dataset_id": "gtfs_x"}, {"dataset_id": "ref", "data_type": "reference"}, {"dataset_id": "hot"}, {"dataset_id": "plain"}, {"dataset_id": "h1"}])
    categories = spark.createDataFrame([("bnm", 1, "hot"), ("met", 2, "plain"), ("bnm", 1, "plain")], "section STRING, priority INT, dataset_id STRING")
    popular = spark.createDataFrame([("gtfs_x",), ("hot",)], "dataset_id STRING")
    hansard = spark.createDataFrame([("h1",)], "dataset_id STRING")
    got = {tuple(r) for r in summary.assign_sections(catalog, categories, popular, hansard=hansard).collect()}
    assert got == {("gtfs_x", "top_visited"), ("gtfs_x", "gtfs"), ("ref", "reference"), ("hot", "top_visited"), ("plain", "bnm"), ("h1", "hansard")}


def test_source_staleness_needs_the_whole_family(spark):
    catalog = catalog_rows(spark, [{"dataset_id": d, "steward": "s"} for d in "abc"])
    snap = snapshot_rows(spark, [{"dataset_id": "a", "staleness_days": 61}, {"dataset_id": "b", "staleness_days": 99}, {"dataset_id": "c", "staleness_days": 60}])
    families = spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "a"), ("g", "c"), ("h", "a"), ("h", "zz")], "family STRING, dataset_id STRING")
    rows = summary.source_staleness(families, catalog, snap).collect()
    assert [(r["family"], r["minimum_staleness_days"]) for r in rows] == [("f", 61)]
