"""One JSON document read in many small splits gives what a reader of the whole document gives."""

from __future__ import annotations

import json
import random

import pytest

from tablehealth.sources import documents, readers, writers


@pytest.fixture
def small_splits(spark):
    """Splits of some hundred bytes, so that every document is cut in strings, between records and inside them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "300")
    spark.conf.set(names[1], "1")
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


ODD = ["", "}", "{[", '"', '\\"}', "a\\", '"results": [', "]}", "é}", "日本{", "line\nbreak", '{"id": 1}', "\\\\"]


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 2 else 4)
    if kind == 0:
        return rng.choice([None, True, 1.5, rng.randrange(1000)])
    if kind < 4:
        return "".join(rng.choices(ODD + ["x", " "], k=rng.randrange(4)))
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {rng.choice(["a", "results", "}k", "items"]): value(rng, depth + 1) for _ in range(rng.randrange(3))}


def record(rng, i):
    return {"id": i, **{k: value(rng) for k in rng.sample(["v", "w", "results", "t{"], rng.randrange(4))}}


def test_random_documents_equal_a_parser(spark, tmp_path, small_splits):
    rng = random.Random(7)
    folder = tmp_path / "docs"
    folder.mkdir()
    want = {}
    for n in range(24):
        records = [record(rng, i) for i in range(rng.choice([0, 1, 3, 40]))]
        fields = [("meta", value(rng)), ("note", rng.choice(ODD)), ("items", rng.choice([7, "results", {"results": [{"id": -1}]}])), ("results", records)]
        rng.shuffle(fields)
        if n % 6 == 5:
            fields = [f for f in fields if f[0] != "results"]
        text = json.dumps(dict(fields), indent=rng.choice([None, 1]), ensure_ascii=n % 2 == 0) + rng.choice(["", "\n", "  \n"])
        (folder / f"{n:02}.json").write_text(text, encoding="utf-8")
        want[f"{n:02}.json"] = (dict(fields), records if n % 6 != 5 else None)
    records, rests = documents.split_documents(spark, str(folder), "records", "results")
    found = {}
    for row in records.collect():
        found.setdefault(row["file"].rsplit("/", 1)[1], {})[row["number"]] = json.loads(row["record"])
    seen = {row["file"].rsplit("/", 1)[1]: (row["key"], json.loads(row["rest"])) for row in rests.collect()}
    assert set(seen) == set(want)
    for name, (whole, listed) in want.items():
        assert [found.get(name, {})[i] for i in sorted(found.get(name, {}))] == (listed or [])
        assert sorted(found.get(name, {})) == list(range(len(listed or [])))
        rest = {**whole, "results": []} if listed is not None else whole
        assert seen[name] == ("results" if listed is not None else None, rest)
    assert documents.pieces(spark, str(folder)).select("file", "block").distinct().count() > 40


def test_plain_arrays_and_damaged_documents(spark, tmp_path, small_splits):
    rng = random.Random(3)
    listed = [record(rng, i) for i in range(60)]
    path = tmp_path / "list.json"
    path.write_text("﻿ " + json.dumps(listed) + "\n", encoding="utf-8")
    records, rests = documents.split_documents(spark, str(path))
    assert [json.loads(r["record"]) for r in records.orderBy("number").collect()] == listed
    assert [r["rest"].strip() for r in rests.collect()] == ["[]"]
    path.write_text('[{"a": 1}, 2, {"a": 3}]')
    with pytest.raises(Exception, match="objects only"):
        documents.split_documents(spark, str(path))[0].collect()
    path.write_text('{"results": [{"a": 1}, {"a": ')
    with pytest.raises(ValueError, match="complete JSON document"):
        documents.split_documents(spark, str(path), "results")


def test_readers_in_splits_equal_whole_documents(spark, tmp_path, small_splits):
    rng = random.Random(5)
    catalog = tmp_path / "catalog.json"
    entries = [{"id": f"d{i}", "name": rng.choice(ODD), "supersedes": rng.choice(["b", ["c", "}"], None])} for i in range(80)]
    catalog.write_text(json.dumps({"datasets": entries, "$schema": "v1"}, indent=1))
    health = tmp_path / "health.json"
    states = [{"dataset_id": f"d{i}", "status": "fresh", "message": rng.choice(ODD), "record_count": i, "last_modified": "2026-08-01T00:00:00Z"} for i in range(80)]
    health.write_text(json.dumps({"checked_at": "2026-08-14T00:00:00Z", "datasets": states}))
    daily = tmp_path / "daily.json"
    daily.write_text(json.dumps({"schema": "x", "aggregates": [{"dataset_id": f"d{i}", "date": "2026-08-01", "observations": i} for i in range(80)]}))
    for read in (lambda **k: readers.read_catalog(spark, str(catalog), **k), lambda **k: readers.read_snapshot(spark, str(health), **k),
                 lambda **k: readers.read_daily(spark, str(daily), schema_name="x", mode="strict", **k)):
        whole, split = read(), read(in_splits=True)
        assert split.dtypes == whole.dtypes
        assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect())) and split.count() == 80
    assert readers.read_daily(spark, str(daily), schema_name="y", in_splits=True).count() == 0
    with pytest.raises(Exception, match="unsupported schema"):
        readers.read_daily(spark, str(daily), schema_name="y", mode="strict", in_splits=True).collect()
    catalog.write_text("{}")
    with pytest.raises(Exception, match="datasets array"):
        readers.read_catalog(spark, str(catalog), in_splits=True).collect()
    health.write_text(json.dumps({"checked_at": "2026-08-14T00:00:00", "datasets": []}))
    with pytest.raises(Exception, match="UTC offset"):
        readers.read_snapshot(spark, str(health), in_splits=True).collect()


@pytest.mark.parametrize("wrap", [None, "rows"])
def test_payload_in_splits(spark, tmp_path, small_splits, wrap):
    rng = random.Random(9)
    rows = [{"a": i, "b": rng.choice(ODD), "c": {"d": rng.choice(ODD)}} for i in range(90)]
    path = tmp_path / "payload.json"
    path.write_text(json.dumps({"meta": {"rows": [1]}, wrap: rows} if wrap else rows, indent=2))
    whole, split = readers.read_payload(spark, str(path)), readers.read_payload(spark, str(path), in_splits=True)
    assert split.dtypes == whole.dtypes
    assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect())) and split.count() == 90


def test_written_documents_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, i, ODD[i % len(ODD)]) for i in range(200)], "part int, id int, t string")
    path = str(tmp_path / "out")
    writers.write_documents(rows, path, key="results", by="part")
    back, rests = documents.split_documents(spark, path, "results")
    got = {json.loads(r["record"])["id"]: json.loads(r["record"])["t"] for r in back.collect()}
    assert got == {i: ODD[i % len(ODD)] for i in range(200)} and rests.count() == 3
