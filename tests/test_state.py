"""The last-known state against the operators on the whole history, with days in any order."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import history_rows
from pyspark.sql import functions as F

from tablehealth.operators import drift, history, state
from tablehealth.plans.bindings import AS_OF, Tables
from tablehealth.plans.cycle import run_cycle
from tablehealth.session import stored
from tablehealth.sources.writers import write_history

START = dt.datetime(2026, 8, 1, tzinfo=dt.timezone.utc)


def observations(seed, days=8):
    rng, rows = random.Random(seed), []
    for hour in range(0, days * 24, 5):
        cycle = START + dt.timedelta(hours=hour)
        for dataset in rng.sample("abcdefgh", 4):
            rows.append({
                "dataset_id": dataset, "cycle": cycle.strftime("%Y-%m-%dT%H:%M"), "observed_at": cycle + dt.timedelta(minutes=rng.choice([-90, 0, 3, 600])),
                "status": rng.choice(["fresh", "stale", None]), "probe_outcome": rng.choice(["success", "success", "error"]),
                "shape_hash": rng.choice(["shape-v1:x", "shape-v1:y", None]), "column_count": rng.choice([3, 4, None]), "record_count": rng.randint(0, 9),
            })
    return rows


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The history by date, and its state recorded in shuffled order, with a base in between, one day twice and one taken back."""
    base = str(tmp_path_factory.mktemp("state"))
    write_history(history_rows(spark, observations(1)), f"{base}/history")
    rows = spark.read.parquet(f"{base}/history")
    table = state.StateTable(spark, f"{base}/state")
    day = F.substring("cycle", 1, 10)
    groups = [["2026-08-05", "2026-08-02"], ["2026-08-01", "2026-08-07", "2026-08-08"], ["2026-08-04"], ["2026-08-03", "2026-08-06"]]
    for i, days in enumerate(groups):
        table.record(rows.where(day.isin(days)))
        if i == 1:
            table.fold("2026-08-05")
            assert table.bases() == ["2026-08-05"]
    assert table.bases() == [] and len(table.days()) == 8
    table.forget("2026-08-02")
    assert "2026-08-02" not in table.days()
    table.record(rows.where(day.isin("2026-08-02", "2026-08-05")))
    table.fold("2026-08-03")
    return table, rows


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("cycle", ["2026-08-06T10:00", "2026-08-04T00:00", "2026-08-02T07:00", "2026-07-01T00:00", "2026-09-01T00:00"])
def test_latest_before_cycle(kept, cycle):
    table, rows = kept
    columns = ["dataset_id", "cycle", "observed_at", "status", "record_count", "seq"]
    assert listed(state.latest_success(table.before(rows, cycle)), *columns) == listed(history.latest_before_cycle(rows, before_cycle=cycle), *columns)


def test_previous_cycle_is_in_the_digest(kept):
    table, rows = kept
    cycle = "2026-08-05T04:00"
    assert rows.where(F.col("cycle") == cycle).count()
    previous = rows.where(F.col("cycle") < cycle).agg(F.max("cycle")).first()[0]
    digest = table.ledger_digest(rows, cycle)
    for source in (rows, digest):
        assert source.where(F.col("cycle") < cycle).agg(F.max("cycle")).first()[0] == previous
    for at in (previous, cycle):
        assert listed(digest.where(F.col("cycle") == at), "dataset_id") == listed(rows.where(F.col("cycle") == at), "dataset_id")


@pytest.mark.parametrize("window", [2, 5])
def test_transitions(kept, window):
    table, rows = kept
    digest = table.window_digest(rows, as_of="2026-08-08 20:00:00", window_days=window)
    whole = drift.transitions(rows, as_of="2026-08-08 20:00:00", window_days=window)
    assert listed(drift.transitions(digest, as_of="2026-08-08 20:00:00", window_days=window), *whole.columns) == listed(whole, *whole.columns)


def test_events(kept):
    table, rows = kept
    since = F.lit("2026-08-05 00:00:00").cast("timestamp")
    later = [drift.transition_events(x).where(F.col("at") >= since) for x in (rows, table.events_digest(rows, since="2026-08-05 00:00:00"))]
    assert listed(later[0], *later[0].columns) == listed(later[1], *later[0].columns) != []


def test_reads_are_cut_to_partitions(kept):
    table, rows = kept
    plan = table.before(rows, "2026-08-07T10:00")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 3 and all("PartitionFilters: [" in line and "PartitionFilters: []" not in line for line in scans)


def test_kept_up_folds_every_so_often(spark, tmp_path):
    rows = stored(history_rows(spark, observations(2, days=5)))
    table = state.StateTable(spark, str(tmp_path))
    state.kept_up(table, rows.where(F.col("cycle") < "2026-08-03"), rows, every=2)
    assert table.bases() == []
    state.kept_up(table, rows.where(F.col("cycle") >= "2026-08-03"), rows, every=2)
    assert table.bases() == ["2026-08-04"] and len(table.days()) == 5
    assert listed(table._up_to("2026-08-05"), "dataset_id", "success.seq", "last.seq", "latest.seq") == listed(state.state_of(rows), "dataset_id", "success.seq", "last.seq", "latest.seq")


def test_empty(spark, tmp_path):
    none = history_rows(spark, [])
    table = state.StateTable(spark, str(tmp_path))
    table.record(none)
    assert table.days() == [] and table.before(none, "2026-08-01T00:00").collect() == []


def test_cycle_with_and_without_state(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001").stored
    write_history(history.keyed_history(t.history), f"{tmp_path}/history")
    prior = spark.read.parquet(f"{tmp_path}/history").select(*state.COLUMNS)
    table = state.StateTable(spark, f"{tmp_path}/state")
    table.record(prior)
    found = []
    for kept_state in (None, table):
        cycle = run_cycle(t.probes_at(AS_OF), t.catalog, t.previous, prior, as_of=AS_OF, cycle="2024-01-30T23:59", state=kept_state)
        found.append([listed(df, *sorted(df.columns)) for df in (cycle.drifts, cycle.deltas)])
    assert found[0] == found[1] and all(found[0])
