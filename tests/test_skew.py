"""The parallel forms against brute force on small data, with a hot key."""

from __future__ import annotations

import datetime as dt
import hashlib
import itertools
import json
import random

from conftest import catalog_rows, history_rows, snapshot_rows, ts
from pyspark.sql import functions as F

from tablehealth.functions.text import canonical_json
from tablehealth.operators import chain, drift, graph, reconcile, signals
from tablehealth.operators.skew import change_runs, numbered


def test_numbered_matches_a_plain_window(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.6 else rng.choice("abc"), i) for i in rng.sample(range(5000), 600)]
    got = {(r["k"], r["i"]): r["occurrence"] for r in numbered(spark.createDataFrame(data, "k STRING, i BIGINT"), ["k"], "i", chunk=100).collect()}
    want = {}
    for key in {k for k, _ in data}:
        for n, i in enumerate(sorted(i for k, i in data if k == key), start=1):
            want[(key, i)] = n
    assert got == want


def _random_history(spark, seed):
    rng = random.Random(seed)
    rows, used = [], set()
    for i in range(500):
        dataset = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c"])
        at = ts("2026-07-01 00:00:00") + dt.timedelta(minutes=rng.randrange(45 * 24 * 60))
        if (dataset, at) in used:
            continue
        used.add((dataset, at))
        rows.append({
            "dataset_id": dataset, "observed_at": at, "shape_hash": rng.choice([None, "shape-v1:x", "shape-v1:y", "bad:z"]),
            "column_count": rng.choice([None, 3, 4]), "probe_outcome": rng.choice(["success", "error"]),
        })
    return rows, history_rows(spark, rows)


def test_transitions_match_a_row_loop(spark):
    rows, frame = _random_history(spark, 7)
    now = ts("2026-08-14 12:00:00")
    cutoff = now - dt.timedelta(days=30)
    got = {r["dataset_id"]: r for r in drift.transitions(frame, as_of="2026-08-14 12:00:00").collect()}
    for dataset in {row["dataset_id"] for row in rows}:
        mine = sorted((r for r in rows if r["dataset_id"] == dataset and r["observed_at"] <= now), key=lambda r: r["observed_at"])
        older = [r for r in mine if r["observed_at"] < cutoff]
        seen = older[-1:] + [r for r in mine if r["observed_at"] >= cutoff]
        for field, label in (("shape_hash", "shape"), ("column_count", "column")):
            previous, changes, last, samples = None, 0, None, 0
            for r in seen:
                value = r[field]
                if value is None or (field == "shape_hash" and not value.startswith("shape-v1:")):
                    continue
                inside = r["observed_at"] >= cutoff
                samples += inside
                if previous is not None and value != previous and inside:
                    changes, last = changes + 1, r["observed_at"]
                previous = value
            row = got[dataset]
            assert (row[f"{label}_change_count"], row[f"{label}_sample_count"]) == (changes, samples)
            stamp = row["last_shape_change_at" if label == "shape" else "last_column_change_at"]
            assert (stamp and stamp.replace(tzinfo=None)) == (last and last.replace(tzinfo=None))


def test_change_events_match_runs(spark):
    _, frame = _random_history(spark, 11)
    events = drift.transition_events(frame, fields=("column_count",)).groupBy("dataset_id").count()
    runs = change_runs(frame, "dataset_id", "observed_at", "cycle", ["column_count"], F.lit(True))
    assert {tuple(r) for r in events.collect()} == {
        (r["dataset_id"], r["column_count_changes"]) for r in runs.collect() if r["column_count_changes"]}


def test_heartbeat_gaps_match_a_row_loop(spark):
    rows, frame = _random_history(spark, 3)
    got = {(r["dataset_id"], r["gap_minutes"]) for r in signals.heartbeat_gaps(frame, minutes=300).collect()}
    want = set()
    for dataset in {r["dataset_id"] for r in rows}:
        times = sorted(r["observed_at"] for r in rows if r["dataset_id"] == dataset and r["probe_outcome"] == "success")
        want |= {(dataset, (b - a).total_seconds() / 60) for a, b in zip(times, times[1:]) if (b - a).total_seconds() > 300 * 60}
    assert got == want


def _random_catalog(spark, seed, size=60):
    rng = random.Random(seed)
    pick = lambda *values: rng.choice(values)
    entries = [{
        "dataset_id": f"d{i:03}", "name": pick("X series", "OpenDOSM: X series", "dosm - State Y"), "source": pick("p", "q", None),
        "steward": pick("s", "s", "s", "t", "", None), "geography": pick("g", None), "series_code": pick("1", "2", "3", None),
        "schema_id": pick("a", None, None), "supersedes": [f"d{i - 1:03}"] if i % 9 == 5 else None, "custodian": pick("C 1", "c-1", "other"),
        "refresh_frequency": pick("daily", "weekly"), "url": pick("https://A.example/x/?b=2&a=1#f", "https://a.example/x?a=1&b=2", f"https://h{i % 3}.example/{i}", "ftp://no", None),
    } for i in range(size)]
    return entries, catalog_rows(spark, entries)


def test_graph_matches_all_pairs(spark):
    entries, catalog = _random_catalog(spark, 5)
    edges = set()
    for a, b in itertools.combinations(entries, 2):
        ids = (a["dataset_id"], b["dataset_id"])
        same = lambda field: a[field] and a[field] == b[field]
        if same("steward") and same("source"):
            edges.add(("same_steward", *ids))
        if same("steward") and not same("source"):
            edges.add(("same_agency", *ids))
        edges |= {(kind, *ids) for kind, field in (("same_geography", "geography"), ("canonical_series", "series_code"), ("shared_schema", "schema_id")) if same(field)}
    edges |= {("successor_to", e["dataset_id"], target) for e in entries for target in e["supersedes"] or []}
    kinds = {r["kind"]: r["edges"] for r in graph.edge_kinds(catalog).collect()}
    assert kinds == {kind: sum(e[0] == kind for e in edges) for kind in kinds} and len(kinds) == 6
    degree = {}
    for kind, a, b in edges:
        for node in (a, b):
            degree[(node, kind)] = degree.get((node, kind), 0) + 1
    assert {(r["dataset_id"], r["kind"]): r["degree"] for r in graph.degrees(catalog).collect()} == degree
    connected = {node for node, _ in degree}
    assert {r[0] for r in graph.isolated(catalog).collect()} == {e["dataset_id"] for e in entries} - connected
    assert {(r["kind"], r["from_id"], r["to_id"]) for r in graph.edges_of(catalog, catalog).collect()} == edges


def test_edges_of_repeated_ids_in_blocks(spark):
    rng = random.Random(3)
    entries = [{
        "dataset_id": rng.choice([None] + [f"d{i % 60:02}"] * 12), "source": rng.choice(["x", "y", "", None]), "steward": rng.choice(["s", "s", "s", "t", None]),
        "geography": rng.choice(["g", "g", "h", None]), "schema_id": rng.choice(["a", None]),
    } for i in range(130)]
    ids = {e["dataset_id"] for e in entries} - {None}
    focus = {f"d{i:02}" for i in range(0, 60, 4)}
    edges = set()
    for a, b in itertools.permutations(entries, 2):
        if None in (a["dataset_id"], b["dataset_id"]) or a["dataset_id"] >= b["dataset_id"] or not focus & {a["dataset_id"], b["dataset_id"]}:
            continue
        same = lambda field: a[field] and a[field] == b[field]
        if same("steward"):
            if same("source"):
                edges.add(("same_steward", a["dataset_id"], b["dataset_id"]))
            else:
                edges.add(("same_agency", a["dataset_id"], b["dataset_id"]))
        edges |= {(kind, a["dataset_id"], b["dataset_id"]) for kind, field in (("same_geography", "geography"), ("shared_schema", "schema_id")) if same(field)}
    wanted = spark.createDataFrame([(i,) for i in [*focus & ids, *focus & ids, "unknown", None]], "dataset_id STRING")
    for block in (7, 1024):
        got = graph.edges_of(catalog_rows(spark, entries), wanted, block=block)
        rows = [(r["kind"], r["from_id"], r["to_id"]) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == edges


def test_edges_of_neither_collects_pairs_nor_keeps_a_clique_in_one_task(spark):
    _, catalog = _random_catalog(spark, 5)
    plan = graph.edges_of(catalog, catalog)._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union"  # not an aggregate of all edges
    joins = [line for line in plan.toString().splitlines() if "Join Inner" in line and "_block" in line]
    assert len(joins) == 3 and all("strategy=merge" in line for line in joins)


def test_group_verdicts_match_all_pairs(spark):
    rng = random.Random(9)
    entries, catalog = _random_catalog(spark, 8)
    health = [{
        "dataset_id": e["dataset_id"], "status": rng.choice(["fresh", "aging", "degraded", "unreachable"] + ["fresh"] * 8),
        "record_count": rng.choice([None, 100, 100, 101, 104, 160]), "record_count_estimated": rng.random() < 0.2,
        "content_freshness_date": rng.choice([None, dt.date(2026, 8, 1), dt.date(2026, 8, 2), dt.date(2026, 8, 5)]),
    } for e in entries if rng.random() < 0.9]
    snap = snapshot_rows(spark, health)
    members = reconcile.discover_groups(catalog)
    assert members.groupBy("dataset_id").count().where("count > 1").count() == 0
    rows = reconcile.member_rows(members, catalog, snap)
    pairs = reconcile.compare_for(rows, catalog).collect()  # every pair, on this small catalogue
    sizes = {r[0]: r[1] for r in members.groupBy("group_key").count().collect()}
    assert len(pairs) == sum(n * (n - 1) // 2 for n in sizes.values())
    names = ("record_count_within_tolerance", "content_date_within_tolerance", "availability_match")
    for group in reconcile.reconcile(members, catalog, snap).collect():
        mine = [p for p in pairs if p["group_key"] == group["group_key"]]
        failed = any(p[name] is False for p in mine for name in names)
        evidence = any(p[name] is not None for p in mine for name in names[:2])
        assert group["verdict"] == ("discrepancy" if failed else "agree" if evidence else "insufficient_data")
    anchored = reconcile.compare_with_anchor(rows).count()
    assert anchored == sum(n - 1 for n in sizes.values())


def test_tree_digest_by_hand(spark):
    items = [(f"d{i}", f"item{i}") for i in range(200)]
    frame = spark.createDataFrame([("day", *item) for item in items], "day STRING, id STRING, item STRING")
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    got = chain.ordered_digest(frame, ["day"], "id", "item", opening="[", separator=",", closing="]").first()
    level = {}
    for key, item in sorted(items):
        level.setdefault(sha(key)[:6], []).append(item)
    level = {place: sha("[" + ",".join(found) + "]") for place, found in level.items()}
    for digits in (3, 0):
        above = {}
        for place in sorted(level):
            above.setdefault(place[:digits], []).append(level[place])
        level = {place: sha("".join(found)) for place, found in above.items()}
    assert (got["rows"], got["digest"]) == (200, level[""])


def test_canonical_json_matches_python(spark):
    value = {"b": "é \"q\" /x", "a": None, "c": 3, "d": [], "e": True}
    got = spark.range(1).select(canonical_json({
        "b": F.lit(value["b"]), "a": F.lit(None).cast("string"), "c": F.lit(3), "d": F.array().cast("array<string>"), "e": F.lit(True),
    })).first()[0]
    assert got == json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
