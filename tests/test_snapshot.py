from __future__ import annotations

import datetime as dt

import pytest
from conftest import by_id, catalog_rows, snapshot_rows, ts

from tablehealth import schemas
from tablehealth.operators import snapshot
from tablehealth.sources.readers import _fields

NOW = "2026-08-14 12:00:00"


def probes(spark, rows):
    names = [name for name, _ in _fields(schemas.PROBE)]
    return spark.createDataFrame([tuple(row.get(name) for name in names) for row in rows], schemas.PROBE)


def status_of(spark, probe, entry=None, old=None):
    catalog = catalog_rows(spark, [{"dataset_id": "a", "refresh_frequency": "daily", **(entry or {})}])
    previous = snapshot_rows(spark, [{"dataset_id": "a", **old}]) if old else None
    row = snapshot.build_snapshot(probes(spark, [{"dataset_id": "a", "http_status": 200, "status": "fresh", **probe}]), catalog, previous, checked_at=NOW)
    return row.first()


def day(days):
    return dt.date(2026, 8, 14) - dt.timedelta(days=days)


STATUS_CASES = [
    ({"content_freshness_date": day(1)}, {}, "fresh"),
    ({"content_freshness_date": day(3)}, {}, "aging"),
    ({"content_freshness_date": day(4)}, {}, "stale"),
    ({"content_freshness_date": day(135)}, {"refresh_frequency": "as-required"}, "fresh"),
    ({"content_freshness_date": day(270)}, {"refresh_frequency": "as-required"}, "aging"),
    ({"content_freshness_date": day(271)}, {"refresh_frequency": None}, "stale"),
    ({"content_freshness_date": day(-1)}, {}, "unknown-freshness"),
    ({}, {}, "unknown-freshness"),
    ({"http_status": 404}, {}, "discontinued"),
    ({"http_status": 410}, {"data_type": "reference"}, "unreachable"),
    ({"http_status": 404, "access_method": "Camofox"}, {"data_type": "reference"}, "browser-dependent"),
    ({"http_status": 503}, {}, "unreachable"),
    ({"http_status": None}, {}, "unreachable"),
    ({}, {"data_type": "reference", "discontinued": True}, "reference"),
    ({"content_freshness_date": day(1)}, {"discontinued": True}, "discontinued"),
    ({"content_freshness_date": day(1), "status": "degraded"}, {}, "degraded"),
    ({"content_freshness_date": day(1), "record_count": 49}, {"expected_record_count": 100}, "degraded"),
    ({"content_freshness_date": day(1), "record_count": 50}, {"expected_record_count": 100}, "fresh"),
    ({"record_count": 49}, {"expected_record_count": 100}, "unknown-freshness"),
]


def test_status_precedence(spark):
    ids = [f"d{i}" for i in range(len(STATUS_CASES))]
    rows = [{"dataset_id": i, "http_status": 200, "status": "fresh", **probe} for i, (probe, _, _) in zip(ids, STATUS_CASES)]
    catalog = catalog_rows(spark, [{"dataset_id": i, "refresh_frequency": "daily", **entry} for i, (_, entry, _) in zip(ids, STATUS_CASES)])
    got = by_id(snapshot.build_snapshot(probes(spark, rows), catalog, None, checked_at=NOW))
    assert {i: got[i]["status"] for i in ids} == {i: expected for i, (_, _, expected) in zip(ids, STATUS_CASES)}


def test_snapshot_uses_previous_row(spark):
    old = {"column_count": 3, "first_row_hash": "shape-v1:x", "content_freshness_date": day(2), "last_checked": ts("2026-08-01 00:00:00")}
    row = status_of(spark, {"content_freshness_date": day(1), "column_count": 4}, old=old)
    assert (row["content_shape_changed"], row["status"]) == (True, "degraded")
    row = status_of(spark, {"content_freshness_date": day(1), "first_row_hash": "raw:y"}, old=old)
    assert row["content_shape_changed"] is False
    row = status_of(spark, {"access_method": "Camofox"}, old=old)
    assert (row["content_freshness_date"], row["freshness_signal"], row["access_dependency"]) == (day(2), "content-date-parse", "browser")
    row = status_of(spark, {"http_status": None}, old=old)
    assert row["last_checked"].isoformat() == "2026-08-01T00:00:00"
    row = status_of(spark, {"last_modified": ts("2026-08-14 11:00:00"), "content_freshness_date": day(3)})
    assert (row["staleness_days"], row["freshness_signal_source"]) == (3, "last_modified_header")


POLICY = "dataset_id STRING, refresh_frequency STRING, data_type STRING, access_method STRING, probe_status STRING, http_status INT, last_checked STRING, unknown_since STRING, content_freshness_date STRING, last_modified STRING, policy_mode STRING, policy_fallback STRING, policy_date_field STRING"


POLICY_CASES = [
    ({"access_method": " CAMOFOX "}, ("browser-dependent", "browser-access-required")),
    ({"http_status": 500, "data_type": "reference"}, ("unreachable", "transport-failure")),
    ({"data_type": "reference"}, ("reference", "versioned-reference-data")),
    ({"probe_status": "Degraded"}, ("degraded", "probe-degraded")),
    ({"last_checked": None}, ("unknown", "never-probed")),
    ({"last_checked": None, "unknown_since": "2026-07-01"}, ("unknown", "unknown-review-required")),
    ({"last_checked": "bad"}, ("degraded", "invalid-last-checked")),
    ({"last_checked": "2026-08-15T00:00:00Z"}, ("degraded", "future-last-checked")),
    ({"refresh_frequency": "biennial to triennial (survey years)", "last_checked": "2026-06-30T12:00:00Z"}, ("aging", "survey-verification-aging")),
    ({"refresh_frequency": "biennial to triennial (survey years)", "last_checked": "2026-05-16T12:00:00Z"}, ("stale", "survey-verification-stale")),
    ({"refresh_frequency": "as-required", "content_freshness_date": "2020-01-01"}, ("unknown-freshness", "as-required-no-publisher-date")),
    ({"refresh_frequency": "as-required", "content_freshness_date": "2020-01-01", "policy_date_field": "date_x"}, ("fresh", "as-required-publisher-date")),
    ({"content_freshness_date": "2026-08-13"}, ("fresh", "freshness-within-window")),
    ({"content_freshness_date": "2026-08-12"}, ("aging", "freshness-aging")),
    ({"content_freshness_date": "2026-08-11"}, ("stale", "freshness-stale")),
    ({"content_freshness_date": "2026-08-20"}, ("unknown-freshness", "future-content-date")),
    ({"content_freshness_date": "soon"}, ("unknown-freshness", "invalid-freshness-signals")),
    ({"content_freshness_date": "soon", "last_modified": "2026-08-14T00:00:00Z"}, ("fresh", "freshness-within-window")),
    ({"last_modified": "2026-08-14T00:00:00Z", "policy_fallback": "none"}, ("unknown-freshness", "no-freshness-signal")),
    ({"content_freshness_date": "2026-08-13", "last_modified": "2026-08-01", "policy_mode": "structural-hash"}, ("stale", "freshness-stale")),
    ({"refresh_frequency": "Daily (weekdays, 0900 MYT)", "content_freshness_date": "2026-08-13"}, ("fresh", "freshness-within-window")),
]


def test_policy_cases(spark):
    base = {"refresh_frequency": "daily", "http_status": 200, "last_checked": "2026-08-14T10:00:00Z"}
    names = [part.split()[0] for part in POLICY.split(", ")]
    rows = [base | fields | {"dataset_id": f"d{i}"} for i, (fields, _) in enumerate(POLICY_CASES)]
    frame = spark.createDataFrame([tuple(row.get(name) for name in names) for row in rows], POLICY)
    got = by_id(snapshot.classify_policy(frame, as_of=NOW))
    for i, (fields, expected) in enumerate(POLICY_CASES):
        assert (got[f"d{i}"]["policy_status"], got[f"d{i}"]["policy_reason"]) == expected, fields


def test_select_due(spark):
    catalog = catalog_rows(spark, [
        {"dataset_id": "never", "refresh_frequency": "annual"}, {"dataset_id": "hourly", "refresh_frequency": "hourly"},
        {"dataset_id": "daily", "refresh_frequency": "daily"}, {"dataset_id": "failed", "refresh_frequency": "annual"},
        {"dataset_id": "weekday", "refresh_frequency": "daily (weekdays, 0900 myt)"}, {"dataset_id": "browser", "refresh_frequency": "weekly"},
    ])
    at = ts("2026-08-14 07:00:00")
    previous = snapshot_rows(spark, [
        {"dataset_id": "hourly", "last_checked": at, "status": "fresh"}, {"dataset_id": "daily", "last_checked": at, "status": "fresh"},
        {"dataset_id": "failed", "last_checked": at, "status": "unreachable"}, {"dataset_id": "weekday", "last_checked": at, "status": "fresh"},
        {"dataset_id": "browser", "last_checked": at, "status": "browser-dependent", "message": "Tab FAILED"},
    ])
    due = {r["dataset_id"] for r in snapshot.select_due(catalog, previous, as_of=NOW).collect()}
    assert due == {"never", "hourly", "failed", "weekday", "browser"}
    assert {r[0] for r in snapshot.select_due(catalog, previous, as_of=NOW, tier="slow").select("dataset_id").collect()} == {"never", "failed"}
    bad = catalog_rows(spark, [{"dataset_id": "x", "refresh_frequency": "sometimes"}])
    with pytest.raises(Exception, match="Unsupported refresh_frequency"):
        snapshot.select_due(bad, previous, as_of=NOW).collect()


def test_merge_due_is_strict(spark):
    catalog = catalog_rows(spark, [{"dataset_id": "a"}, {"dataset_id": "b"}])
    prior = spark.createDataFrame([("a", 1), ("b", 1)], "dataset_id STRING, v INT")
    update = spark.createDataFrame([("b", 2)], "dataset_id STRING, v INT")
    assert {tuple(r) for r in snapshot.merge_due(prior, update, catalog).collect()} == {("a", 1), ("b", 2)}
    for broken, message in ((update.union(update), "duplicate"), (spark.createDataFrame([("z", 2)], "dataset_id STRING, v INT"), "unknown dataset id")):
        with pytest.raises(Exception, match=message):
            snapshot.merge_due(prior, broken, catalog).collect()
    with pytest.raises(Exception, match="missing dataset id"):
        snapshot.merge_due(prior.limit(0), update, catalog).collect()


def test_compare_classifiers_counts_changes(spark):
    catalog = catalog_rows(spark, [{"dataset_id": "a", "refresh_frequency": "daily"}, {"dataset_id": "b", "refresh_frequency": "daily"}])
    snap = snapshot_rows(spark, [
        {"dataset_id": "a", "status": "fresh", "last_checked": ts("2026-08-14 10:00:00"), "content_freshness_date": day(1), "http_status": 200},
        {"dataset_id": "b", "status": "fresh", "last_checked": ts("2026-08-14 10:00:00"), "content_freshness_date": day(9), "http_status": 200},
    ])
    got = by_id(snapshot.compare_classifiers(snap, catalog, as_of=NOW))
    assert {k: v["status_changed"] for k, v in got.items()} == {"a": False, "b": True}
    with pytest.raises(Exception, match="snapshot is missing dataset"):
        snapshot.compare_classifiers(snap.limit(1), catalog, as_of=NOW).collect()
