from __future__ import annotations

import datetime as dt

import pytest
from conftest import by_id, catalog_rows, history_rows, snapshot_rows, ts
from pyspark.sql import functions as F

from tablehealth.functions import cadence, times
from tablehealth.functions.numbers import published
from tablehealth.operators import drift, history, signals


def age_row(dataset, observed, days, **extra):
    at = ts(observed)
    return {"dataset_id": dataset, "observed_at": at, "last_modified": at - dt.timedelta(days=days), **extra}


def test_published_rounds_like_python(spark):
    values = [62.15, 2.675, 1.0005, 0.125, 0.5, 1.5, 2.5, -0.05, 1234567.8915, 99.95, 0.045, 1e-9, 33.333333]
    rows = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    for digits in (0, 1, 3):
        got = [row[0] for row in rows.select(published("v", digits)).collect()]
        assert got == [round(v, digits) for v in values]


def test_cadence_mapping(spark):
    cases = {
        "Daily (weekdays, 0900 MYT)": 1.0, "weekly": 7.0, "annual": 365.0, "survey-year x": 730.0, "biennial": 730.0,
        "hourly": 1 / 24, "30 seconds": 30 / 86400, "as-required": None, None: None, "fortnightly": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "f STRING").select("f", cadence.cadence_days(F.col("f")).alias("d")).collect()
    assert {row["f"]: row["d"] for row in rows} == cases


def test_policy_frequency_is_a_closed_list(spark):
    frame = spark.createDataFrame([("Daily ",), ("fortnightly",)], "f STRING")
    loose = [row[0] for row in frame.select(cadence.policy_frequency(F.col("f"), strict=False)).collect()]
    assert loose == ["daily", None]
    with pytest.raises(Exception, match="unsupported refresh_frequency"):
        frame.select(cadence.policy_frequency(F.col("f"))).collect()


def test_parse_instant(spark):
    cases = ["2026-01-02T03:04:05Z", "2026-01-02T03:04:05+08:00", "2026-01-02T03:04:05", "2026-01-02", "nonsense", None, "2026-01-02T03:04:05.25+0800"]
    frame = spark.createDataFrame([(c,) for c in cases], "t STRING")
    got = [row[0] for row in frame.select(F.date_format(times.parse_instant(F.col("t")), "yyyy-MM-dd HH:mm:ss.SS")).collect()]
    assert got == ["2026-01-02 03:04:05.00", "2026-01-01 19:04:05.00", None, "2026-01-02 00:00:00.00", None, None, "2026-01-01 19:04:05.25"]
    naive = frame.select(times.parse_instant(F.col("t"), naive="utc").isNotNull()).collect()
    assert [row[0] for row in naive] == [True, True, True, True, False, False, True]


def test_http_date_week_and_local_time(spark):
    row = spark.range(1).select(
        F.date_format(times.parse_http_date(F.lit("Sun, 06 Nov 1994 08:49:37 GMT")), "yyyy-MM-dd HH:mm:ss").alias("http"),
        times.iso_week(F.lit("2027-01-01").cast("date")).alias("week"),
        times.display_local(F.lit("2026-08-05 13:07:00").cast("timestamp")).alias("local"),
        times.parse_http_date(F.lit("yesterday")).alias("bad"),
    ).first()
    assert row.asDict() == {"http": "1994-11-06 08:49:37", "week": "2026-W53", "local": "5 Aug 2026, 9:07 pm MYT", "bad": None}


NOW = "2026-08-14 12:00:00"


def trend_case(spark, ages, frequency="daily", step_days=1):
    start = dt.date(2026, 8, 14) - dt.timedelta(days=step_days * (len(ages) - 1))
    rows = [age_row("a", f"{start + dt.timedelta(days=i * step_days)} 10:00:00", age) for i, age in enumerate(ages)]
    catalog = catalog_rows(spark, [{"dataset_id": "a", "name": "A", "refresh_frequency": frequency}])
    return signals.trend(catalog, history_rows(spark, rows), as_of=NOW).first()


@pytest.mark.parametrize("ages, frequency, verdict, weekly", [
    ([2, 3, 4], "daily", "deteriorating", 7.0),
    ([4, 2, 0], "daily", "recovering", -14.0),
    ([1, 1, 1], "daily", "stable", 0.0),
    ([2, 3, 4], "monthly", "stable", 7.0),
    ([1, 2], "daily", "insufficient_data", None),
    ([2, 3, 4], "as-required", "insufficient_data", None),
])
def test_trend_classes(spark, ages, frequency, verdict, weekly):
    row = trend_case(spark, ages, frequency)
    assert (row["trend"], row["slope_days_per_week"]) == (verdict, weekly)


def test_trend_uses_latest_of_day_and_daily_evidence(spark):
    rows = [
        age_row("a", "2026-08-12 08:00:00", 9), age_row("a", "2026-08-12 09:00:00", 1),
        age_row("a", "2026-08-13 09:00:00", 1, probe_outcome="error"),
    ]
    stored = history.aggregate_daily(history_rows(spark, [
        age_row("a", "2026-08-10 09:00:00", 1), age_row("a", "2026-08-12 10:00:00", 99), age_row("a", "2026-08-14 09:00:00", 1),
    ]))
    catalog = catalog_rows(spark, [{"dataset_id": "a", "name": "A", "refresh_frequency": "daily"}])
    row = signals.trend(catalog, history_rows(spark, rows), stored, as_of=NOW).first()
    # the raw row of the 12th wins over the stored one; the failed 13th is not a sample
    assert (row["trend_sample_days"], row["trend"], row["publish_on_time_pct"], row["reliability_grade"]) == (3, "stable", 100.0, "A")
    only_daily = signals.trend(catalog, history_rows(spark, rows).limit(0), stored, as_of=NOW).first()
    assert only_daily["trend_sample_days"] == 3


def anomaly_case(spark, ages, latest, frequency="daily", status="fresh"):
    rows = [age_row("a", f"{dt.date(2026, 8, 14) - dt.timedelta(days=i + 1)} 10:00:00", age) for i, age in enumerate(ages)]
    rows.append(age_row("a", "2026-08-14 09:00:00", 500))  # today never enters the baseline
    catalog = catalog_rows(spark, [{"dataset_id": "a", "refresh_frequency": frequency}])
    snap = snapshot_rows(spark, [{"dataset_id": "a", "status": status}]).withColumn("staleness_days", F.lit(latest).cast("double"))
    row = signals.detect_anomalies(catalog, snap, history_rows(spark, rows), as_of=NOW).first()
    return row["anomaly_detected"], row["anomaly_detection"]


def test_anomaly_modes(spark):
    assert anomaly_case(spark, [1], 3.0)[0] is False  # strict comparison
    assert anomaly_case(spark, [1], 3.1)[0] is True
    flagged, detail = anomaly_case(spark, [1] * 12, 1.01)
    assert (flagged, detail["mode"], detail["mean_days"], detail["stdev_days"]) == (True, "rolling_14d", 1.0, 0.0)
    assert anomaly_case(spark, [1] * 11, 1.01)[1]["mode"] == "cadence_fallback"
    assert anomaly_case(spark, [1], 900.0, "as-required")[1]["mode"] == "not_evaluated"
    assert anomaly_case(spark, [1] * 12, 900.0, status="reference") [0] is False
    assert anomaly_case(spark, [1] * 12, None)[1]["mode"] == "not_evaluated"


def shape_row(dataset, observed, count=None, shape=None, columns=None, **extra):
    return {"dataset_id": dataset, "observed_at": ts(observed), "record_count": count, "shape_hash": shape, "column_count": columns, **extra}


def drift_case(spark, rows, latest=None, expected=None, daily=None):
    catalog = catalog_rows(spark, [{"dataset_id": "a", "name": "A", "expected_record_count": expected}])
    snap = snapshot_rows(spark, [{"dataset_id": "a", **(latest or {})}])
    return drift.drift(catalog, snap, history_rows(spark, rows), daily, as_of=NOW).first()


def test_drift_verdicts(spark):
    row = drift_case(spark, [
        shape_row("a", "2026-08-10 00:00:00", 100, "shape-v1:x"), shape_row("a", "2026-08-12 00:00:00", 110, "shape-v1:y"),
    ], {"record_count": 110})
    assert (row["verdict"], row["record_trend"], row["record_change_pct"], row["shape_change_count"]) == ("drift_detected", "growing", 10.0, 1)
    row = drift_case(spark, [
        shape_row("a", "2026-08-10 00:00:00", 100), shape_row("a", "2026-08-12 00:00:00", 40),
    ], {"record_count": 40}, 100)
    assert (row["verdict"], row["record_trend"], row["record_change_pct"]) == ("record_count_drift", "shrinking", -60.0)
    assert row["reason"] == "record count 40 is below 50% of expected count 100"
    row = drift_case(spark, [shape_row("a", "2026-08-10 00:00:00", 100), shape_row("a", "2026-08-12 00:00:00", 103)])
    assert (row["verdict"], row["record_trend"], row["record_count_within_tolerance"]) == ("stable", "stable", None)
    assert drift_case(spark, [shape_row("a", "2026-08-10 00:00:00", 100)])["verdict"] == "insufficient_data"
    assert drift_case(spark, [], {"content_shape_changed": True})["verdict"] == "drift_detected"


def test_drift_baseline_before_the_window(spark):
    rows = [
        shape_row("a", "2026-06-01 00:00:00", shape="shape-v1:old", columns=9), shape_row("a", "2026-07-01 00:00:00", shape="shape-v1:x", columns=3),
        shape_row("a", "2026-08-01 00:00:00", shape="other:z", columns=None), shape_row("a", "2026-08-02 00:00:00", shape="shape-v1:y", columns=3),
    ]
    row = drift_case(spark, rows)
    assert (row["shape_change_count"], row["shape_sample_count"], row["distinct_shape_count"]) == (1, 1, 2)
    assert (row["column_change_count"], row["column_sample_count"], row["column_count_changed"]) == (0, 1, None)
    # a compacted day is used only when raw has no row of that day
    stored = history.aggregate_daily(history_rows(spark, [
        shape_row("a", "2026-08-02 05:00:00", shape="shape-v1:w"), shape_row("a", "2026-08-05 05:00:00", shape="shape-v1:q"),
    ]))
    assert drift_case(spark, rows, daily=stored)["shape_change_count"] == 2


def test_record_trend_from_zero(spark):
    rows = [shape_row("a", "2026-08-10 00:00:00", 0), shape_row("a", "2026-08-12 00:00:00", 5), shape_row("b", "2026-08-10 00:00:00", 0),
            shape_row("b", "2026-08-12 00:00:00", 0), shape_row("c", "2026-08-12 00:00:00", 1), shape_row("c", "2026-08-12 23:00:00", 9)]
    got = by_id(drift.record_trend(history_rows(spark, rows), as_of=NOW))
    assert {k: (v["record_trend"], v["record_change_pct"]) for k, v in got.items()} == {
        "a": ("growing", None), "b": ("stable", None), "c": ("insufficient_data", None)}


def test_heartbeat(spark):
    rows = [{"dataset_id": "a", "observed_at": ts("2026-08-14 11:50:00")}, {"dataset_id": "b", "observed_at": ts("2026-08-14 11:30:00")},
            {"dataset_id": "b", "observed_at": ts("2026-08-14 11:59:00"), "probe_outcome": "error"}, {"dataset_id": "c", "observed_at": ts("2026-08-14 11:45:00")}]
    got = by_id(signals.heartbeat(history_rows(spark, rows), as_of=NOW, by=("dataset_id",)))
    assert {k: v["alert"] for k, v in got.items()} == {"a": False, "b": True, "c": False}
    assert signals.heartbeat(history_rows(spark, []), as_of=NOW).first()["alert"] is True
