from __future__ import annotations

import pytest
from conftest import by_id, catalog_rows, history_rows, snapshot_rows, ts
from pyspark.sql import functions as F

from tablehealth.operators import history


def row(dataset, observed, **extra):
    return {"dataset_id": dataset, "observed_at": ts(observed), **extra}


def test_upsert_is_last_write_wins_and_idempotent(spark):
    prior = history_rows(spark, [row("a", "2026-08-01 00:00:00", cycle="c1", record_count=1), row("a", "2026-08-01 01:00:00", cycle="c2", record_count=2)])
    current = history_rows(spark, [row("a", "2026-08-01 00:30:00", cycle="c1", record_count=7), row("b", "2026-08-01 00:30:00", cycle="c1", record_count=8)])
    for keyed in (False, True):
        once = history.upsert_history(prior, current, prior_is_keyed=keyed)
        twice = history.upsert_history(once, current, prior_is_keyed=keyed)
        expected = {("a", "c1", 7), ("a", "c2", 2), ("b", "c1", 8)}
        assert {tuple(r) for r in once.select("dataset_id", "cycle", "record_count").collect()} == expected
        assert {tuple(r) for r in twice.select("dataset_id", "cycle", "record_count").collect()} == expected


def test_first_of_equal_timestamps_wins(spark):
    at = ts("2026-08-01 10:00:00")
    rows = [{"dataset_id": "a", "observed_at": at, "last_modified": at, "cycle": f"c{i}", "status": s} for i, s in enumerate(("fresh", "aging"))]
    assert history.latest_per_day(history_rows(spark, rows)).first()["status"] == "fresh"


def test_future_evidence_is_not_evidence(spark):
    at = ts("2026-08-01 10:00:00")
    rows = [
        {"dataset_id": "a", "observed_at": at, "last_modified": ts("2026-08-02 00:00:00"), "content_date": at.date()},
        {"dataset_id": "b", "observed_at": at, "last_modified": ts("2026-08-02 00:00:00")},
        {"dataset_id": "c", "observed_at": at, "last_modified": ts("2026-07-31 10:00:00"), "content_date": ts("2026-07-30 00:00:00").date()},
    ]
    got = by_id(history.latest_per_day(history_rows(spark, rows)))
    assert set(got) == {"a", "c"}
    assert got["a"]["age_days"] == pytest.approx(10 / 24)
    assert got["c"]["age_days"] == pytest.approx(2 + 10 / 24)  # the oldest valid signal


def test_compaction_drops_late_rows_of_compacted_cycles(spark):
    rows = history_rows(spark, [
        row("a", "2026-08-01 00:00:00", cycle="2026-08-01T00:00", record_count=10, last_modified=ts("2026-07-31 00:00:00")),
        row("a", "2026-08-01 06:00:00", cycle="2026-08-01T06:00", record_count=20),
        row("a", "2026-08-13 06:00:00", cycle="2026-08-13T06:00", record_count=30),
    ])
    none = spark.createDataFrame([], "cycle STRING")
    first = history.compact_history(rows, None, none, now="2026-08-14 00:00:00")
    assert first.retained.count() == 1 and first.archived.count() == 2
    day = first.daily.first()
    assert (day["observations"], day["record_count"]["mean"], day["availability_percent"]) == (2, 15.0, 100.0)
    assert day["latest_successful_evaluable_observation"]["record_count"] == 10
    late = history_rows(spark, [
        row("a", "2026-08-01 06:30:00", cycle="2026-08-01T06:00", record_count=99),  # compacted cycle: dropped
        row("a", "2026-08-01 12:00:00", cycle="2026-08-01T12:00", record_count=40),  # new cycle: merged
    ])
    second = history.compact_history(late, first.daily, first.compacted_cycles, now="2026-08-14 00:00:00")
    day = second.daily.first()
    assert (day["observations"], day["record_count"]["max"], day["record_count"]["sum"]) == (3, 40, 70)
    assert [r["record_count"] for r in second.archived.collect()] == [40]


def test_to_observations_validates(spark):
    catalog = catalog_rows(spark, [{"dataset_id": "a", "name": "A", "url": "u"}])
    good = snapshot_rows(spark, [{"dataset_id": "a", "status": "fresh", "checked_at": ts("2026-08-01 00:00:00"), "message": "curl timed out"}])
    got = history.to_observations(good, catalog, cycle="2026-08-01T00:00").first()
    assert (got["probe_outcome"], got["name"], got["record_count_estimated"], got["anomaly_detected"]) == ("timeout", "A", False, None)
    for bad, message in (({"dataset_id": "a", "status": "great"}, "unsupported status"), ({"dataset_id": "", "status": "fresh"}, "non-empty dataset_id")):
        with pytest.raises(Exception, match=message):
            history.to_observations(snapshot_rows(spark, [bad]), catalog, cycle="c").collect()
    with pytest.raises(Exception, match="duplicate dataset id"):
        history.to_observations(good.union(good), catalog, cycle="c").collect()


def test_infer_probe_outcome(spark):
    frame = spark.createDataFrame(
        [("timeout", None, 200), (None, "Timed  out", 200), (None, None, 204), (None, None, 301), (None, None, None), ("odd", None, 200)],
        "o STRING, m STRING, h INT",
    )
    got = [r[0] for r in frame.select(history.infer_probe_outcome(F.col("o"), F.col("m"), F.col("h"))).collect()]
    assert got == ["timeout", "timeout", "success", "error", "error", "success"]


def test_snapshot_as_of_is_strict(spark):
    versions = spark.createDataFrame([("2026-08-01", "x"), ("2026-08-03", "y")], "version_date STRING, v STRING").withColumn(
        "version_date", F.col("version_date").cast("date"))
    assert [r["v"] for r in history.snapshot_as_of(versions, cutoff="2026-08-03").collect()] == ["x"]
    assert history.snapshot_as_of(versions, cutoff="2026-08-01").count() == 0
