"""The health cycle: one run from probes to every derived table."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehealth import params
from tablehealth.operators import changes, drift, graph, history, reconcile, signals, snapshot, summary, trust
from tablehealth.operators.state import COLUMNS, StateTable, kept_up
from tablehealth.session import configure, cut_lineage, stored


@dataclass(frozen=True)
class Cycle:
    """The outputs of one run; each is one write."""

    snapshot: DataFrame
    history: DataFrame
    observed: DataFrame
    trends: DataFrame
    drifts: DataFrame
    group_members: DataFrame
    groups: DataFrame
    scores: DataFrame
    deltas: DataFrame
    graph_groups: DataFrame
    trust_summary: DataFrame

    def write(self, base: str, *, version: str) -> None:
        """Store the history first, by date, then every other table as a version.

        Only the dates that this cycle observed are replaced in the history, from a stored copy, as the prior
        history may lie in the same folder. The last-known state under ``state`` is kept up with the history.
        """
        from tablehealth.sources.writers import write_history, write_snapshot

        dates = self.observed.select(F.to_date("observed_at").alias("_date")).distinct()
        touched = self.history.join(dates, F.to_date("observed_at") == F.col("_date"), "left_semi")
        write_history(stored(touched), f"{base}/history")
        spark = self.observed.sparkSession
        kept_up(StateTable(spark, f"{base}/state"), self.observed, spark.read.parquet(f"{base}/history"))
        for field in fields(self):
            if field.name not in ("history", "observed"):
                write_snapshot(getattr(self, field.name), f"{base}/{field.name}", version=version)


def run_cycle(
    probes: DataFrame,
    catalog: DataFrame,
    previous: DataFrame | None,
    prior_history: DataFrame,
    *,
    as_of: str,
    cycle: str,
    daily: DataFrame | None = None,
    seeds: DataFrame | None = None,
    prior_is_keyed: bool = True,
    state: StateTable | None = None,
) -> Cycle:
    """Derive everything of one cycle.

    The anomaly baseline excludes today, so it reads the history without the new
    rows' effect; the ledger needs the cycle's own rows, so it reads the history
    with them. Tables with one row per dataset are cut once and read by the later
    stages; the history is only scanned. With the ``state`` of the prior history, drift (unless there are stored days) and
    ledger read its digests, and of the history only the window and the cycle's day.
    """
    configure(probes.sparkSession)
    bare = cut_lineage(snapshot.build_snapshot(probes, catalog, previous, checked_at=as_of))
    anomalies = signals.detect_anomalies(catalog, bare, prior_history, as_of=as_of)
    current = cut_lineage(signals.annotate(bare, anomalies))
    observed = cut_lineage(history.to_observations(current, catalog, cycle=cycle))
    whole = history.upsert_history(prior_history, observed.select(*prior_history.columns), prior_is_keyed=prior_is_keyed)
    trends = cut_lineage(signals.trend(catalog, whole, daily, as_of=as_of))
    windowed, ledger = whole, whole
    if state is not None:
        rows = observed.select(*COLUMNS)
        ledger = state.ledger_digest(prior_history, cycle, own=rows)
        if daily is None:
            digest = state.window_digest(prior_history, as_of=as_of, window_days=params.DRIFT_WINDOW_DAYS)
            windowed = history.upsert_history(digest, rows, prior_is_keyed=prior_is_keyed)
    drifts = cut_lineage(drift.drift(catalog, current, windowed, daily, as_of=as_of))
    members = cut_lineage(reconcile.discover_groups(catalog, seeds))
    groups = cut_lineage(reconcile.reconcile(members, catalog, current))
    scores = trust.trust_score(catalog, current, trends, drifts, trust.verdict_by_dataset(members, groups))
    return Cycle(
        snapshot=current, history=whole, observed=observed, trends=trends, drifts=drifts, group_members=members, groups=groups,
        scores=scores, deltas=changes.dataset_deltas(catalog, current, ledger, cycle=cycle),
        graph_groups=graph.groups(catalog), trust_summary=summary.trust_summary(current),
    )
