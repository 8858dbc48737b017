from __future__ import annotations

import datetime as dt
import json
import random
import time

import pandas as pd
import pytest
from conftest import catalog_rows, history_rows, snapshot_rows, ts
from pyspark.sql import functions as F

from tablehealth.operators import drift, history, summary
from tablehealth.sources import readers, writers
from tablehealth.streaming import store, windows

HISTORY_LINES = [
    {"dataset_id": "a", "observed_at": "2026-08-01T00:00:00Z", "cycle": "2026-08-01T00:00", "status": "fresh", "record_count": 5, "content_date": "2026-07-31", "anomaly_detected": True},
    {"dataset_id": "b", "observed_at": "2026-08-01T08:00:00+08:00", "cycle": "2026-08-01T00:00", "status": "stale", "record_count": True, "latency_ms": 1.5},
]


def test_read_history_modes(spark, tmp_path):
    path = tmp_path / "history.jsonl"
    good = "\n".join(json.dumps(line) for line in HISTORY_LINES)
    path.write_text(good + "\n\n{broken\n[1]\n{\"cycle\": \"x\"}\n", encoding="utf-8")
    rows = {r["dataset_id"]: r for r in readers.read_history(spark, str(path)).collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"]["record_count"], rows["a"]["anomaly_detected"], str(rows["a"]["content_date"])) == (5, True, "2026-07-31")
    assert (rows["b"]["record_count"], rows["b"]["latency_ms"], rows["b"]["observed_at"].isoformat()) == (None, 1.5, "2026-08-01T00:00:00")
    with pytest.raises(Exception, match="invalid history line in history.jsonl"):
        readers.read_history(spark, str(path), mode="strict").collect()
    path.write_text(good, encoding="utf-8")
    assert readers.read_history(spark, str(path), mode="strict").count() == 2


def test_read_documents(spark, tmp_path):
    manifest = tmp_path / "catalog.json"
    manifest.write_text(json.dumps({"$schema": "v1", "datasets": [{"id": "a", "supersedes": "b"}, {"id": "b", "supersedes": ["c", "d"], "discontinued": True}, {"id": "c"}]}, indent=1))
    got = {r["dataset_id"]: r["supersedes"] for r in readers.read_catalog(spark, str(manifest)).collect()}
    assert got == {"a": ["b"], "b": ["c", "d"], "c": None}
    manifest.write_text("{}")
    with pytest.raises(Exception, match="datasets array"):
        readers.read_catalog(spark, str(manifest)).collect()
    health = tmp_path / "health.json"
    health.write_text(json.dumps({"checked_at": "2026-08-14T00:00:00Z", "datasets": [{"dataset_id": "a", "status": "fresh", "last_modified": "2026-08-01T00:00:00Z"}]}))
    assert readers.read_snapshot(spark, str(health)).first()["last_modified"].isoformat() == "2026-08-01T00:00:00"
    health.write_text(json.dumps({"checked_at": "2026-08-14T00:00:00", "datasets": []}))
    with pytest.raises(Exception, match="UTC offset"):
        readers.read_snapshot(spark, str(health)).collect()
    daily = tmp_path / "daily.json"
    daily.write_text(json.dumps({"schema": "x", "aggregates": [{"dataset_id": "a", "date": "2026-08-01", "observations": 2}]}))
    assert readers.read_daily(spark, str(daily), schema_name="y").count() == 0
    assert readers.read_daily(spark, str(daily), schema_name="x").first()["observations"] == 2
    with pytest.raises(Exception, match="unsupported schema"):
        readers.read_daily(spark, str(daily), schema_name="y", mode="strict").collect()


def test_read_payload_formats(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "a INT, b STRING").write.parquet(str(tmp_path / "p.bin"))
    (tmp_path / "t.csv").write_text("# SAMPLE: one line\na,b\n1,x\n2,y\n")
    (tmp_path / "list.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "wrapped.json").write_text('{"meta": 1, "results": [{"a": 1}, {"a": 2}, {"a": 3}]}')
    sizes = {name: readers.read_payload(spark, str(tmp_path / name)).count() for name in ("p.bin", "t.csv", "list.json", "wrapped.json")}
    assert sizes == {"p.bin": 1, "t.csv": 2, "list.json": 2, "wrapped.json": 3}
    assert readers.read_payload(spark, str(tmp_path / "t.csv")).columns == ["a", "b"]
    (tmp_path / "line.json").write_text("  [" + ",".join('{"a": %d}' % i for i in range(3000)) + "]")
    assert readers.read_payload(spark, str(tmp_path / "line.json")).count() == 3000
    (tmp_path / "damaged.parquet").write_bytes(b"PAR1" + b"rubbish, no footer")
    with pytest.raises(Exception):
        readers.read_payload(spark, str(tmp_path / "damaged.parquet")).count()


def test_writers(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1), ("b", 2)], "dataset_id STRING, v INT")
    base = str(tmp_path / "snap")
    writers.write_snapshot(frame, base, version="2026-08-01")
    writers.write_snapshot(frame.limit(1), base, version="2026-08-02")
    assert writers.read_latest(spark, base).count() == 1
    ledger = str(tmp_path / "ledger")
    assert writers.write_immutable(frame, ledger) is True
    assert writers.write_immutable(frame.orderBy(F.desc("v")), ledger) is False
    with pytest.raises(ValueError, match="different content"):
        writers.write_immutable(frame.withColumn("v", F.col("v") + 1), ledger)
    rows = history_rows(spark, [{"dataset_id": "a", "observed_at": ts("2026-07-31 00:00:00")}, {"dataset_id": "a", "observed_at": ts("2026-08-01 00:00:00")}])
    for _ in range(2):  # a retry replaces what the run wrote
        writers.archive_monthly(rows, str(tmp_path / "archive"), run="r1")
    assert spark.read.json(str(tmp_path / "archive")).count() == 2
    assert sorted(p.name for p in (tmp_path / "archive").glob("month=*")) == ["month=2026-07", "month=2026-08"]
    assert len(list((tmp_path / "archive").rglob("*.json.gz"))) >= 2
    table = str(tmp_path / "history")
    writers.write_history(rows, table)
    writers.write_history(rows.where(F.col("observed_at") >= "2026-08-01").withColumn("status", F.lit("stale")), table)
    assert {(str(r["date"]), r["status"]) for r in spark.read.parquet(table).collect()} == {("2026-07-31", "fresh"), ("2026-08-01", "stale")}


def test_usage_and_telemetry(spark, tmp_path):
    folder = tmp_path / "usage"
    folder.mkdir()
    call = {"ts": "2026-08-01T10:00:00.000Z", "tool": "trust_verdict", "buyer_id": "b", "args": {"dataset_id": "a"}, "result_summary": {"score": 91.0}}
    for day in ("2026-08-01", "2026-08-02", "2026-08-09"):
        (folder / f"{day}.jsonl").write_text(json.dumps(call | {"ts": f"{day}T10:00:00.000Z"}) + "\nbroken\n")
    (folder / "date=2026-08-02").mkdir()
    (folder / "date=2026-08-02" / "part.json").write_text(json.dumps(call | {"ts": "2026-08-02T11:00:00.000Z"}))
    assert readers.read_usage(spark, str(folder), since="2026-08-02", until="2026-08-02").count() == 2  # partitions and files
    (folder / "date=2026-08-02" / "part.json").unlink()
    (folder / "date=2026-08-02").rmdir()
    usage = readers.read_usage(spark, str(folder), since="2026-08-01", until="2026-08-03")
    lines = {(r["metric"], r["key"]): r["calls"] for r in summary.usage_summary(usage, buyer_id="b").collect()}
    assert lines == {("total_calls", "all"): 2, ("by_tool", "trust_verdict"): 2, ("by_dataset", "a"): 2, ("trust_distribution", "90-100"): 2}
    writers.write_usage(usage, str(tmp_path / "table"))
    assert readers.read_usage(spark, str(tmp_path / "table"), since="2026-08-02", until="2026-08-02").count() == 1
    assert readers.read_usage(spark, str(tmp_path / "nothing"), since="2026-08-02", until="2026-08-02").count() == 0
    events = spark.createDataFrame([(ts("2026-08-01 10:00:00"), "probe", 5, "ok", "c", {"lag_ms": "3"})], "ts TIMESTAMP, stage STRING, duration_ms BIGINT, status STRING, cycle STRING, extra MAP<STRING,STRING>")
    writers.write_telemetry(events, str(tmp_path / "telemetry"))
    assert readers.read_telemetry(spark, str(tmp_path / "telemetry")).first()["stage"] == "probe"


def _batches(spark, tmp_path, frames, name):
    folder = str(tmp_path / name)
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05 * (i >= 0))
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _stream_frames(spark):
    def at(text, **extra):
        return {"dataset_id": "a", "observed_at": ts(text), "last_modified": ts(text), **extra}
    first = [at("2026-08-01 00:00:00", shape_hash="shape-v1:x", record_count=1), at("2026-08-01 12:00:00", shape_hash="shape-v1:y", record_count=2), at("2026-08-12 00:00:00")]
    second = [at("2026-08-01 12:00:00", status="stale", record_count=99), at("2026-08-01 18:00:00", shape_hash="shape-v1:x", record_count=4), at("2026-08-13 00:00:00", status="aging")]
    return [history_rows(spark, first), history_rows(spark, second)]


def test_stream_upsert_and_compaction(spark, tmp_path):
    frames = _stream_frames(spark)
    sink = store.HistoryStore(spark, str(tmp_path / "store"))
    query = store.stream_upsert(_batches(spark, tmp_path, frames, "in"), sink, checkpoint=str(tmp_path / "cp"),
                                clock=lambda: "2026-08-14 00:00:00", trigger={"availableNow": True})
    query.awaitTermination(120)
    batch = history.upsert_history(frames[0], frames[1])
    keys = ["dataset_id", "cycle", "status", "record_count"]
    kept = batch.where(F.col("observed_at") >= "2026-08-07")
    assert {tuple(r) for r in sink.raw().select(*keys).collect()} == {tuple(r) for r in kept.select(*keys).collect()}
    assert sink.raw(now="2026-08-14 00:00:00").count() == 2
    day = sink.daily().collect()
    # the rewritten row of a compacted cycle is not aggregated again; the new cycle is
    assert [(str(r["date"]), r["observations"], r["record_count"]["sum"]) for r in day] == [("2026-08-01", 3, 7)]
    assert sorted(r["record_count"] for r in sink.archive.read().collect()) == [1, 2, 4]
    recent = lambda: {tuple(r) for r in sink.raw(now="2026-08-14 00:00:00").select(*keys).collect()}
    before = recent()
    sink.upsert(frames[1], 1)  # a replayed epoch changes nothing
    sink.compact(now="2026-08-14 00:00:00", epoch=1)
    assert recent() == before
    # partitions that expired before the run recorded first are gone
    assert sink.rows.read().agg(F.min("cycle_date")).first()[0] >= "2026-08-05"
    assert sink.daily().first()["observations"] == 3
    # the later run reads only the dates that expired since, and late arrivals
    sink.compact(now="2026-08-20 12:00:00", epoch=2)
    assert {(str(r["date"]), r["observations"]) for r in sink.daily().collect()} == {
        ("2026-08-01", 3), ("2026-08-12", 1), ("2026-08-13", 1)}
    far = history_rows(spark, [{"dataset_id": "a", "observed_at": ts("2026-08-01 00:00:00"), "cycle": "2026-08-20T00:00"}])
    sink.upsert(far, 3)  # observed far from its cycle, and still aggregated
    sink.compact(now="2026-08-20 12:00:00", epoch=3)
    assert {(str(r["date"]), r["observations"]) for r in sink.daily().collect()} == {("2026-08-01", 4), ("2026-08-12", 1), ("2026-08-13", 1)}


def test_stream_transitions_equal_batch(spark, tmp_path):
    frames = _stream_frames(spark)
    later = frames[1].where(F.col("observed_at") > "2026-08-01 12:00:00")
    sink = store.TransitionStore(spark, str(tmp_path / "changes"))
    sink.apply(frames[0].where(F.col("observed_at") < "2026-08-05"), 0)
    sink.apply(later, 1)
    sink.apply(later, 1)
    whole = frames[0].where(F.col("observed_at") < "2026-08-05").unionByName(later)
    want = {tuple(r) for r in drift.transition_events(whole).collect()}
    assert {tuple(r) for r in sink.events().collect()} == want and len(want) == 3


def test_stream_transitions_of_late_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        at = ts("2026-08-01 00:00:00") + dt.timedelta(hours=rng.randrange(24 * 6), seconds=i)
        rows.append({"dataset_id": rng.choice("ab"), "observed_at": at, "status": rng.choice(["fresh", "aging", "stale"]),
                     "shape_hash": rng.choice([None, "x", "y"]), "column_count": rng.choice([None, 1, 2])})
    whole = history_rows(spark, rows)
    sink = store.TransitionStore(spark, str(tmp_path / "changes"))
    for epoch in range(4):
        sink.apply(history_rows(spark, rows[epoch * 15:epoch * 15 + 15]), epoch)
    assert {tuple(r) for r in sink.events().collect()} == {tuple(r) for r in drift.transition_events(whole).collect()}


class _State:
    """The parts of a group state that the heartbeat uses."""

    def __init__(self):
        self.value, self.now, self.timeout, self.hasTimedOut = None, 0, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, value):
        self.value, self.timeout = value, None

    def setTimeoutDuration(self, wait):
        assert wait > 0
        self.timeout = self.now + wait


def test_heartbeat_of_endless_failures():
    track, state = windows.heartbeat_tracker(15 * 60_000), _State()
    alerts = []

    def send(minute, success):
        state.now, state.hasTimedOut = minute * 60_000, False
        frame = pd.DataFrame({"success_us": [float(minute) * 6e7 if success else None]})
        alerts.extend((minute, bool(a)) for out in track(("a",), iter([frame]), state) for a in out["alert"])
    send(0, True)
    for minute in range(5, 120, 5):
        send(minute, False)
    assert alerts == [(15, True)]
    send(120, True)
    assert alerts[1:] == [(120, False)]
    state.now, state.hasTimedOut = 135 * 60_000, True
    assert [bool(a) for out in track(("a",), iter([]), state) for a in out["alert"]] == [True]
    state, alerts[:] = _State(), []
    for minute in range(0, 40, 5):
        send(minute, False)
    assert alerts == [(15, True)]  # first seen failing


def test_stream_daily_and_usage(spark, tmp_path):
    frames = _stream_frames(spark)
    stream = windows.stream_daily(_batches(spark, tmp_path, [frames[0]], "daily"), watermark="1 day")
    query = stream.writeStream.format("memory").queryName("daily_out").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("daily_out").collect()
    want = history.aggregate_daily(frames[0].where(F.col("observed_at") < "2026-08-05")).collect()
    assert [r.asDict(True) for r in got] == [r.asDict(True) for r in want]
    usage = spark.createDataFrame([(ts("2026-08-01 10:00:00"), "t", "b", {"dataset_id": "a"}, (None,))] * 3,
                                  "ts TIMESTAMP, tool STRING, buyer_id STRING, args MAP<STRING,STRING>, result_summary STRUCT<score: DOUBLE>")
    counted = windows.stream_usage(_batches(spark, tmp_path, [usage], "usage"))
    query = counted.writeStream.format("memory").queryName("usage_out").outputMode("complete").option(
        "checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["metric"], r["calls"]) for r in spark.table("usage_out").collect()} == {("total_calls", 3), ("by_tool", 3), ("by_dataset", 3)}


def test_stream_heartbeat_alerts_after_silence(spark, tmp_path):
    rows = history_rows(spark, [{"dataset_id": "a", "observed_at": ts("2026-08-01 00:00:00")}, {"dataset_id": "a", "observed_at": ts("2026-08-01 01:00:00")}])
    source = _batches(spark, tmp_path, [rows], "beat")
    query = windows.stream_heartbeat(source, minutes=0.02).writeStream.format("memory").queryName("beat_out").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.table("beat_out").count() == 0:
            time.sleep(1)
        row = spark.table("beat_out").first()
        assert (row["dataset_id"], row["alert"], row["last_success_at"].isoformat()) == ("a", True, "2026-08-01T01:00:00")
    finally:
        query.stop()
