"""Queries answered from the last-known state instead of a scan of the history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehealth.operators import changes, drift, history, state
from tablehealth.plans import queries_changes
from tablehealth.plans.bindings import AS_OF, Tables
from tablehealth.plans.oracle import transitions_sql
from tablehealth.plans.registry import query
from tablehealth.session import scratch_path
from tablehealth.sources.writers import write_history

#: A base that lies a few days before what the queries ask for, so that base, days and history rows all take part.
_FOLDED = "2024-01-14"


def _kept(t: Tables, rows: DataFrame) -> tuple[state.StateTable, DataFrame]:
    """The history stored by date, and its state with one base."""
    base = scratch_path(t.spark, "state")
    write_history(rows, f"{base}/history")
    stored = t.spark.read.parquet(f"{base}/history")
    table = state.StateTable(t.spark, f"{base}/state")
    table.record(stored)
    table.fold(_FOLDED)
    return table, stored


@query("state_latest_before_cycle", """
SELECT dataset_id, cycle, observed_at, status, record_count, shape_hash, seq FROM (SELECT *, row_number() OVER
  (PARTITION BY dataset_id ORDER BY cycle DESC, observed_at DESC, seq) AS rn FROM obs
  WHERE cycle < '2024-01-20T13:00' AND probe_outcome = 'success') WHERE rn = 1""")
def _latest_before_cycle(t: Tables):
    table, stored = _kept(t, t.history)
    return state.latest_success(table.before(stored, "2024-01-20T13:00")).select(
        "dataset_id", "cycle", "observed_at", "status", "record_count", "shape_hash", "seq")


@query("state_dataset_deltas", queries_changes.DELTAS_SQL)
def _dataset_deltas(t: Tables):
    table, stored = _kept(t, queries_changes._history_with_cycle(t))
    digest = table.ledger_digest(stored, queries_changes._CYCLE)
    catalog = t.stored.catalog.where(~F.col("discontinued"))
    return changes.dataset_deltas(catalog, t.stored.snapshot, digest, cycle=queries_changes._CYCLE)


@query("state_transitions", transitions_sql(9))
def _transitions(t: Tables):
    table, stored = _kept(t, t.history)
    return drift.transitions(table.window_digest(stored, as_of=AS_OF, window_days=9), as_of=AS_OF, window_days=9)


_EVENTS = " UNION ALL ".join(f"""
SELECT dataset_id, '{name}' AS field, CAST(was AS VARCHAR) AS from_value, CAST({name} AS VARCHAR) AS to_value, observed_at AS at
FROM (SELECT dataset_id, {name}, observed_at, lag({name}) OVER (PARTITION BY dataset_id ORDER BY observed_at, cycle, seq) AS was FROM obs_once WHERE {name} IS NOT NULL)
WHERE was <> {name} AND observed_at >= TIMESTAMP '2024-01-21 06:30:00'""" for name in state.FIELDS)


@query("state_transition_events", "SELECT * FROM (" + _EVENTS.replace("obs_once", "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, cycle ORDER BY seq DESC) AS rn FROM obs) WHERE rn = 1)") + ")")
def _transition_events(t: Tables):
    table, stored = _kept(t, history.keyed_history(t.history))
    since = "2024-01-21 06:30:00"
    digest = table.events_digest(stored, since=since)
    return drift.transition_events(digest).where(F.col("at") >= F.lit(since).cast("timestamp"))
