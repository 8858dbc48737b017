from __future__ import annotations

import hashlib
import json

from conftest import catalog_rows, snapshot_rows, ts
import pytest
from pyspark.sql import functions as F

from tablehealth.functions import dates, shapes, text, times
from tablehealth.operators import profile, ranked, summary


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_deep_json_has_no_fingerprint():
    from tablehealth.functions.shapes import json_fingerprint

    assert json_fingerprint("[" * 100_000 + "]" * 100_000) is None


def test_canonical_url(spark):
    cases = {
        "HTTPS://Example.org/A/b/?z=1&a=%20x&a=#frag": "https://example.org/A/b?a=&a=+x&z=1", "http://example.org": "http://example.org/",
        "ftp://example.org/x": "", "//example.org/x": "", None: "", "https://h.example/~u?q=a*b~": "https://h.example/~u?q=a%2Ab~", "https://h/?flag": "https://h/?flag=",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "u STRING").select("u", text.canonical_url(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in rows} == cases


def test_text_keys(spark):
    row = one(
        spark, text.semantic_title(F.lit("data.gov.my – Births, 2020 (State)")).alias("title"), text.display_name(F.lit("my_set-a"), F.lit("")).alias("name"),
        F.array_join(text.granularity_signature(F.lit("daily_x"), F.lit("State births")), ",").alias("signature"),
        text.canonical_licence(F.lit(" cc BY 4.0 ")).alias("licence"), text.display_status(F.lit("unknown-freshness")).alias("status"),
        text.endpoint_channel(F.lit("https://A.Example:8080/x")).alias("channel"), text.estimated_parquet_rows(F.lit(137)).alias("rows"),
        text.estimated_parquet_rows(F.lit(16)).alias("none"),
    )
    assert row.asDict() == {
        "title": "births 2020 state", "name": "My Set A", "signature": "state,daily", "licence": "Creative Commons Attribution 4.0",
        "status": "Unknown freshness", "channel": "a.example:8080", "rows": 2, "none": None}


def test_sanitise_args(spark):
    args = F.create_map(F.lit("X_API_KEY"), F.lit("s"), F.lit("authTokens"), F.lit("t"), F.lit("q"), F.lit("y" * 300))
    assert one(spark, text.sanitise_args(args))[0] == {"X_API_KEY": "[REDACTED]", "authTokens": "[REDACTED]", "q": "y" * 200}


def _reference_shape(value):
    """Independent statement of the signature: nested lists of (key, type)."""
    if isinstance(value, dict):
        return {"type": "object", "fields": [[k, _reference_shape(v)] for k, v in sorted(value.items())]}
    if isinstance(value, list):
        texts = sorted({json.dumps(_reference_shape(v), sort_keys=True, separators=(",", ":")) for v in value})
        return {"type": "array", "items": [json.loads(t) for t in texts]}
    return {"type": {type(None): "null", bool: "boolean", int: "integer", float: "number", str: "string"}[type(value)]}


def test_shape_fingerprint(spark):
    documents = ['{"b": [1, 2.5, null, {"x": true}], "a": {"é": "v"}}', '{"a": {"é": "other"}, "b": [{"x": false}, 7, 1e3, null, 9]}', "[]", "3", "not json", None, '{"a":1}', '{"a":1.0}']
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "i INT, d STRING")
    got = [r["shape_hash"] for r in profile.shape_fingerprint(frame, json_col="d").orderBy("i").collect()]
    for found, document in zip(got, documents):
        if document in (None, "not json"):
            assert found is None
        else:
            signature = json.dumps(_reference_shape(json.loads(document)), sort_keys=True, separators=(",", ":"))
            assert found == "shape-v1:" + hashlib.sha256(signature.encode()).hexdigest()
    assert got[0] == got[1] and got[6] != got[7]
    header = json.dumps({"headers": ["a", "b c"], "type": "csv"}, sort_keys=True, separators=(",", ":"))
    assert shapes.header_fingerprint(["﻿a ", "b c"]) == "shape-v1:" + hashlib.sha256(header.encode()).hexdigest()


def test_infer_fields(spark):
    frame = spark.createDataFrame([("1", "1", "x", "", "2026-01-01T0:0", "true", 1.5), (" +2 ", "2.", "2", None, "2026-01-02", "FALSE", None)],
                                  "i STRING, n STRING, s STRING, e STRING, d STRING, b STRING, native DOUBLE")
    assert {r["name"]: r["type"] for r in profile.infer_fields(frame).collect()} == {
        "i": "integer", "n": "number", "s": "string", "e": "string", "d": "date", "b": "boolean", "native": "number"}


def test_text_dates(spark):
    body = "x2026-01-02y 12026-01-03 5 Mac 2025, ogos 17 2024; MAY 3, 2023 (émay 4, 2022) 31 February 2020 2026-13-01 9 foo 2021 120 mei 2021"
    row = one(spark, F.array_sort(dates.text_dates(F.lit(body))).cast("array<string>").alias("found"))
    assert row["found"] == ["2023-05-03", "2024-08-17", "2025-03-05", "2026-01-02"]
    found = F.array(*[F.lit(d).cast("date") for d in ("2026-01-02", "2025-03-05")])
    day = times.lit_day("2025-12-31")
    row = one(spark, dates.pick_date(found, day).cast("string"), dates.pick_date(found, day, mode="min").cast("string"), dates.pick_date(found, times.lit_day("2020-01-01")).cast("string"))
    assert tuple(row) == ("2025-03-05", "2025-03-05", "2026-01-02")


def test_detect_date_column(spark):
    frame = spark.createDataFrame([("2026-01-01", "2026-01-01", "2026-01-01", "x"), ("2026-01-02", "2026-01-02", None, "2026-01-01")], "date STRING, obs_date STRING, made_at STRING, year STRING")
    assert tuple(profile.detect_date_column(frame).first()) == ("date", 2, "2026-01-02")
    assert profile.detect_date_column(frame.select("year")).count() == 0


def test_robots(spark):
    agent = "ProbeBot/1.0 (+https://example.org)"
    cases = {
        "User-agent: *\nDisallow: /": True, "User-agent: other\nDisallow: /": False, "user-agent: PROBEBOT\r\nDisallow: / # all\r\n": True,
        "User-agent: probebot/1.0\nDisallow: /private": False, "User-agent: ProbeBot/1.0 (+https://example.org)\nDisallow:/": True,
        "User-agent: *\nUser-agent: other\nDisallow: /": False, "Disallow: /": False, "": False, None: False,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "b STRING").select("b", profile.robots_blocked(F.col("b"), agent).alias("x")).collect()
    assert {r["b"]: r["x"] for r in rows} == cases


def test_transit_profiles(spark):
    feeds = lambda *ids: spark.createDataFrame([(i,) for i in ids], "feed_id STRING")
    calendar = spark.createDataFrame([("a", "20260101", "20260301"), ("a", "20260105", "20260201"), ("b", "20260101", "20261399"), ("c", None, None)], "feed_id STRING, start_date STRING, end_date STRING")
    tables = {name: feeds("a", "b", "c", "d") for name in ("agency", "stops", "routes", "trips")} | {"stop_times": feeds("a", "a", "b", "c"), "calendar": calendar}
    got = {r["feed_id"]: r for r in profile.transit_static_profile(tables).collect()}
    assert (got["a"]["status"], got["a"]["record_count"], str(got["a"]["service_start"]), str(got["a"]["content_freshness_date"])) == ("fresh", 2, "2026-01-05", "2026-03-01")
    assert (got["b"]["message"], got["b"]["record_count"]) == ("invalid calendar date", None)
    assert (got["c"]["message"], got["c"]["record_count"]) == ("calendar.txt has no service dates", 1)
    assert got["d"]["message"] == "missing required files: stop_times.txt, calendar.txt"
    entities = spark.createDataFrame([("a", True, 100), ("a", True, 10**11), ("a", False, 500), ("a", True, 0)], "feed_id STRING, vehicle BOOLEAN, vehicle_ts BIGINT")
    headers = spark.createDataFrame([("a", 0), ("b", 86400)], "feed_id STRING, header_ts BIGINT")
    got = {r["feed_id"]: r for r in profile.transit_realtime_profile(entities, headers, now="2026-01-01").collect()}
    assert (got["a"]["vehicle_count"], got["a"]["newest_vehicle_timestamp"], str(got["a"]["content_freshness_date"])) == (3, 10**11, "1970-01-01")
    assert (got["b"]["vehicle_count"], got["b"]["header_timestamp"], str(got["b"]["content_freshness_date"])) == (0, 86400, "1970-01-02")


def test_search_and_pages(spark):
    catalog = catalog_rows(spark, [
        {"dataset_id": "x", "name": "CPI", "source": "OpenDOSM", "licence": "L"}, {"dataset_id": "gtfs_static_a", "name": "CPI inflation", "source": "s", "licence": "L"},
        {"dataset_id": "b", "name": "CPI inflation", "description": "inflation inflation", "source": "s", "licence": "L"}, {"dataset_id": "none", "name": "other"}])
    rows = ranked.search_datasets(catalog, snapshot_rows(spark, []), query=" CPI  inflation").collect()
    assert [(r["dataset_id"], r["score"]) for r in rows] == [("b", 112), ("gtfs_static_a", 110), ("x", 5)]
    assert [r["dataset_id"] for r in ranked.search_datasets(catalog, snapshot_rows(spark, []), query="cpi", source="dosm").collect()] == ["x"]
    page = ranked.paginate(catalog, order=["dataset_id"], limit=3, cursor=2).collect()
    for wrong in ({"limit": 0}, {"cursor": -1}):
        with pytest.raises(ValueError):
            ranked.paginate(catalog, order=["dataset_id"], **wrong)
    assert [(r["dataset_id"], r["total"], r["next_cursor"]) for r in page] == [("none", 4, None), ("x", 4, None)]


def test_compare_receipts(spark):
    ddl = "dataset_id STRING, source_url STRING, request_url STRING, http_status INT, last_modified TIMESTAMP, content_length BIGINT, access_dependency STRING, access_method STRING, source STRING"
    at = ts("2026-01-01 00:00:00")
    recorded = spark.createDataFrame([
        ("same", "u", "u", 200, at, None, "direct", "x", "s"), ("moved", "u", "v", 200, None, 5, "direct", "x", "s"), ("down", "u", "u", 200, at, 1, "direct", "x", "s"),
        ("gone", "u", "u", 200, at, 1, "direct", "x", "s"), ("browser", "u", "u", 200, at, 1, "direct", " Camofox", "s")], ddl)
    observed = spark.createDataFrame([("same", 200, at, 9), ("moved", 200, at, 5), ("down", 500, at, 1), ("browser", 200, at, 1)],
                                     "dataset_id STRING, http_status INT, last_modified TIMESTAMP, content_length BIGINT")
    got = {r["dataset_id"]: r for r in ranked.compare_receipts(recorded, observed).collect()}
    assert {k: v["verdict"] for k, v in got.items()} == {"same": "match", "moved": "mismatch", "down": "unreachable", "gone": "unreachable", "browser": "not_verifiable"}
    assert got["moved"]["mismatched_fields"] == "request_url_match, last_modified_match" and got["same"]["content_length_match"] is None


def test_usage_bands(spark):
    rows = spark.createDataFrame([(s,) for s in (90.0, 89.9, 50.0, 25.0, 0.0, None)], "s DOUBLE").select(summary.trust_band(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["90-100", "75-89", "50-74", "25-49", "0-24", None]
