"""Registered queries against their SQL on the smallest tables, and the whole cycle."""

from __future__ import annotations

import importlib.util
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tablehealth.operators import integrity
from tablehealth.plans import registry
from tablehealth.plans.bindings import AS_OF, Tables
from tablehealth.plans.cycle import run_cycle
from tablehealth.sources.writers import read_latest

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
spec = importlib.util.spec_from_file_location("check_oracle", ROOT / "tools" / "check_oracle.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

# one query per area; tools/check_oracle.py runs them all
NAMES = (
    "find_deteriorating", "latest_per_day", "merge_daily", "transitions", "build_snapshot", "detect_anomalies", "drift", "heartbeat_gap",
    "weekly_changes", "compare_snapshots", "graph_degrees", "status_distribution", "usage_summary", "standard_checks", "record_evidence",
    "attestation_links", "shape_fingerprint", "extract_text_dates", "transit_static_profile", "infer_fields",
)
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not present")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sql, name):
    df = registry.queries()[name](spark, SF)
    cursor = sql.execute(registry.oracle_sql()[name])
    want = check.rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert check.rows_of(df.columns, [tuple(row) for row in df.collect()]) == want


def test_entry_classes(spark):
    assert __spark_entry__.entry(spark).count() == 3
    trends = registry.queries()["trend"](spark, SF)
    assert {r["trend"]: r["count"] for r in trends.groupBy("trend").count().collect()} == {
        "deteriorating": 3, "recovering": 5, "stable": 6, "insufficient_data": 1}


def test_every_check_belongs_to_a_query():
    queries, oracle = registry.queries(), registry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert set(queries) - set(oracle) == {"output_invariants"}


def test_cycle(spark, tmp_path):
    t = Tables(spark, SF).stored
    prior = t.history.where(F.col("observed_at") < "2024-01-30")
    result = run_cycle(
        t.probes_at(AS_OF), t.catalog, t.previous, prior, as_of=AS_OF, cycle="2024-01-30T23:59", seeds=t.seeds, prior_is_keyed=True)
    result.write(str(tmp_path), version="1")
    history = spark.read.parquet(f"{tmp_path}/history")
    assert history.where(F.col("cycle") == "2024-01-30T23:59").count() == t.catalog.count()
    stored = {name: read_latest(spark, f"{tmp_path}/{name}") for name in ("snapshot", "trends", "drifts", "group_members", "groups", "scores", "deltas")}
    assert stored["snapshot"].count() == t.catalog.count()
    assert integrity.output_invariants(
        t.catalog, trends=stored["trends"], drifts=stored["drifts"], members=stored["group_members"], groups=stored["groups"], scores=stored["scores"],
    ).count() == 0
    assert stored["deltas"].where(F.col("change_type") == "status_changed").count() > 0
