"""Folded stores and keyed stream state: the same results, and sizes that stay flat over many epochs."""

from __future__ import annotations

import datetime as dt
import random
import time
from pathlib import Path

from conftest import history_rows, ts
from pyspark.sql import functions as F

from tablehealth.operators import drift
from tablehealth.streaming import store, transitions


#: 200 epochs give the same picture and take six minutes.
EPOCHS = 60


def files(folder):
    return len(list(Path(folder).rglob("part-*.parquet")))


def everything(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_file_count_is_flat_and_replays_change_nothing(spark, tmp_path):
    table = store.EpochTable(spark, str(tmp_path), "k BIGINT, v BIGINT, d STRING", ("d",), reduce=store._newest(["k", "d"]))
    counts, latest = [], {}
    for epoch in range(EPOCHS):
        rows = [(epoch % 7, epoch, f"2026-08-0{1 + 2 * epoch // EPOCHS}"), (100 + epoch % 3, epoch, "2026-08-05")]
        latest.update({(k, d): v for k, v, d in rows})
        batch = spark.createDataFrame(rows, "k BIGINT, v BIGINT, d STRING").coalesce(1)
        table.write(batch, epoch)
        if epoch % 10 == 9:
            table.fold(epoch - 1)
            counts.append(files(tmp_path))
    current = lambda: {(r["k"], r["d"]): r["v"] for r in store._newest(["k", "d"])(table.read()).collect()}
    assert current() == latest and max(counts) - min(counts) <= 8 and max(counts) < 40
    before = everything(table.read())
    for epoch in (0, 27, EPOCHS - 2):
        table.write(spark.createDataFrame([(1, -1, "2026-08-01")], "k BIGINT, v BIGINT, d STRING"), epoch)
    table.fold(20)
    assert everything(table.read()) == before
    table.remove("d", lambda day: day < "2026-08-02")
    assert current() == {key: v for key, v in latest.items() if key[1] >= "2026-08-02"}


def test_a_fold_that_was_interrupted_is_not_seen(spark, tmp_path, monkeypatch):
    table = store.EpochTable(spark, str(tmp_path), "k BIGINT", ())
    for epoch in range(4):
        table.write(spark.createDataFrame([(epoch,)], "k BIGINT"), epoch)
    with monkeypatch.context() as broken:
        broken.setattr(table, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost driver")))
        try:
            table.fold(2)
        except RuntimeError:
            pass
    assert [r["k"] for r in table.read().orderBy("k").collect()] == [0, 1, 2, 3]
    table.fold(2)
    assert [r["k"] for r in table.read().orderBy("k").collect()] == [0, 1, 2, 3] and table._version()[1] == 2


def test_folded_history_and_transitions(spark, tmp_path):
    rng, rows = random.Random(5), []
    for i in range(32):
        at = ts("2026-08-01 00:00:00") + dt.timedelta(hours=rng.randrange(24 * 4), seconds=i)
        rows.append({"dataset_id": rng.choice("ab"), "observed_at": at, "status": rng.choice(["fresh", "stale"]), "shape_hash": rng.choice([None, "x", "y"]), "column_count": rng.choice([None, 1, 2])})
    plain, folded = store.HistoryStore(spark, str(tmp_path / "plain")), store.HistoryStore(spark, str(tmp_path / "folded"))
    changes = store.TransitionStore(spark, str(tmp_path / "changes"))
    for epoch in range(4):
        batch = history_rows(spark, rows[epoch * 8:epoch * 8 + 8])
        for sink in (plain, folded):
            sink.upsert(batch, epoch)
            sink.compact(now="2026-08-10 00:00:00" if epoch > 1 else "2026-08-09 00:00:00", epoch=epoch)
        changes.apply(batch, epoch)
        if epoch in (2, 3):
            folded.fold(epoch - 1)
            changes.fold(epoch - 1)
    assert everything(folded.raw()) == everything(plain.raw())
    assert [str(r) for r in folded.daily().orderBy("dataset_id", "date").collect()] == [str(r) for r in plain.daily().orderBy("dataset_id", "date").collect()]
    assert sorted(r["cycle"] for r in folded.cycles.read().collect()) == sorted(r["cycle"] for r in plain.cycles.read().collect())
    want = drift.transition_events(history_rows(spark, rows))
    assert everything(changes.events()) == everything(want)


def test_keyed_state_equals_batch_and_stays_flat(spark, tmp_path):
    rng, rows = random.Random(6), []
    for i in range(240):
        rows.append({"dataset_id": rng.choice(["a", "b", "c"]), "observed_at": ts("2026-08-01 00:00:00") + dt.timedelta(minutes=20 * i, seconds=rng.randrange(60)),
                     "status": rng.choice(["fresh", "stale", None]), "shape_hash": rng.choice([None, "x", "y"]), "column_count": rng.choice([None, 1, 2])})
    order = sorted(range(240), key=lambda i: i + rng.uniform(0, 5))  # out of order by less than two hours
    folder = str(tmp_path / "in")
    for start in range(0, 240, 20):
        history_rows(spark, [rows[i] for i in order[start:start + 20]]).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    for day in ("2026-09-01", "2026-09-02"):  # moves the watermark past all others
        history_rows(spark, [{"dataset_id": "z", "observed_at": ts(f"{day} 00:00:00"), "status": "fresh"}]).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    whole = history_rows(spark, rows)
    source = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    events = transitions.stateful_transitions(source, delay="2 hours")
    query = events.writeStream.format("memory").queryName("changes_out").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    want = drift.transition_events(whole)
    got = spark.table("changes_out").select(*want.columns)
    assert everything(got) == everything(want) and got.count() > 100
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(held) > 10 and max(held[6:]) <= max(held[:6]) + 10


def test_changes_of_one_instant_and_nulls():
    rows = [(5, "c", "fresh", None, 1), (3, None, "stale", "x", None), (5, "b", None, "y", 2), (5, "b", None, "y", 2)]
    events, known = transitions.changes_of(rows, ("aging", None, 2))
    assert events == [("status", "aging", "stale", 3), ("shape_hash", "x", "y", 5), ("status", "stale", "fresh", 5), ("column_count", "2", "1", 5)]
    assert known == ("fresh", "y", 1) and transitions.changes_of([], known) == ([], known)
