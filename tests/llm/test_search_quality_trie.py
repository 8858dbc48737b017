"""Ranked search, line quality and the conversation trie against brute force, with edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablehealth.llm import bitsliced_search, conversation_trie, line_quality

CLASH = ("version", "term", "item", "kind", "key", "own", "path", "first", "rank", "score", "held_out", "good", "weight")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_clashes(df):
    return df.select("*", *[F.lit("extra").alias(c) for c in CLASH])


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["The", "über", "x1", "of", "Éa"]) if rng.random() < 0.5 else f"w{int(rng.expovariate(0.02))}" for _ in range(n))


# ranked search


def ranked_by_hand(docs, items, top=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = [(doc_id, Counter(pattern.findall((text or "").translate(LOWER)))) for doc_id, text in docs]
    n_docs, n_terms = sum(bool(c) for _, c in terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item_id, text in set(items):
        if item_id is None:
            continue
        scores = []
        for doc_id, c in terms:
            n = sum(c.values())
            score = 0
            for t in pattern.findall((text or "").translate(LOWER)):
                if c[t]:
                    m = 25 + (75 * n * n_docs) // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0 and doc_id is not None:
                scores.append((-score, doc_id))
        out += [(item_id, rank, doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


def searched(spark, docs, items, **settings):
    d = with_clashes(spark.createDataFrame(docs, "doc_id bigint, text string"))
    b = with_clashes(spark.createDataFrame(items, "item_id bigint, text string"))
    return sorted(tuple(r) for r in bitsliced_search.search(d, b, **settings).select("item_id", "rank", "doc_id", "score").collect())


def test_search_equals_brute_force(spark):
    docs = [(i, words(i, 5 + i * 7 % 200)) for i in range(150)]
    docs += [(200 + i, words(3, 40)) for i in range(25)]  # ties
    docs += [(300, None), (301, ""), (302, "!!! \n"), (None, words(5, 30)), (303, words(9, 30_000)), (304, "zz " * 900), (7, words(7, 54)), (7, words(7, 54)), (7, "w1 other text")]
    items = [(i, words(i, 12)) for i in range(20)] + [(20, None), (21, ""), (22, "zz ZZ zz"), (23, "nowhere"), (None, "w1"), (3, words(3, 40)), (0, words(0, 12))]
    assert searched(spark, docs, items) == ranked_by_hand(docs, items)


def test_search_in_groups_of_items(spark, monkeypatch):
    monkeypatch.setattr(bitsliced_search, "GROUP_TERMS", 40)
    docs, items = [(i, words(i, 30)) for i in range(60)], [(i, words(100 + i, 15)) for i in range(8)]
    assert searched(spark, docs, items, top=3) == ranked_by_hand(docs, items, 3)


def test_search_of_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == [] and searched(spark, [(1, "a b")], []) == [] and searched(spark, [(1, None)], [(1, "a")]) == []


def test_bounds_are_never_below_scores():
    docs = [(i, i, words(i, 10 + 13 * i)) for i in range(40)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"doc_id": a, "version": b, "text": c} for a, b, c in docs])
    rows = [row for out in bitsliced_search._index([batch]) for row in out.to_pylist()]
    total = [row for row in rows if row["kind"] == "all"]
    assert sum(r["docs"] for r in total) == 40
    n_terms = total[0]["terms"]
    query = [(5, t, 1000) for t in ("the", "x1", "w3", "w17", "nowhere")]
    search = bitsliced_search._Search(query, 40, n_terms)
    seen = 0
    for row in rows:
        if row["kind"] != "block":
            continue
        for _, total in search.bounds(row["width"], np.array(row["lengths"]), row["slices"]):
            for doc_id, bound in zip(row["ids"], total[0]):
                c = Counter(docs[doc_id][2].translate(LOWER).split())
                m = 25 + (75 * sum(c.values()) * 40) // n_terms
                assert bound >= sum(w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for _, t, w in query)
                seen += 1
    assert seen == 40


# line quality


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([3, 1, 5, 2])
    evidence, start, moves = rng.normal(size=11) * 2, rng.normal(size=2), rng.normal(size=(2, 2))
    bad, pairs = line_quality.marginals(evidence, counts, start, moves)
    expected, transitions, at = [], np.zeros((2, 2)), 0
    for n in counts:
        weights = {}
        for path in product((0, 1), repeat=int(n)):
            weights[path] = math.exp(start[path[0]] + sum(evidence[at + i] * s for i, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        z = sum(weights.values())
        expected += [sum(w for p, w in weights.items() if p[i]) / z for i in range(n)]
        for p, w in weights.items():
            for a, b in zip(p, p[1:]):
                transitions[a, b] += w / z
        at += n
    assert np.allclose(bad, expected) and np.allclose(pairs, transitions)


def good_text(rng):
    return "\n".join(" ".join(f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.randint(0, 999):x}n" for _ in range(rng.randint(4, 12))) + "." for _ in range(rng.randint(1, 6)))


def bad_text(rng):
    return good_text(rng).split("\n")[0] + "\n" + "\n".join("spam$$$ " * rng.randint(5, 20) for _ in range(rng.randint(2, 6)))


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(2)
    rows = [(i, bad_text(rng) if i % 3 == 0 else good_text(rng), int(i % 3 != 0)) for i in range(400)]
    return rows, spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id bigint, quality int, toxic int")


def test_held_out_documents_are_told_apart(spark, marked):
    rows, docs, labels = marked
    found = {r["doc_id"]: r for r in line_quality.quality(docs, labels).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(found) == 400 and sorted(i for i, r in found.items() if r["held_out"]) == held
    assert all(found[i]["predicted"] == y and 0 <= found[i]["score"] <= 1 for i, _, y in rows if i in set(held))
    texts = dict((i, t) for i, t, _ in rows)
    # the chain names the bad lines: all but the first one
    assert all(r["bad_lines"] == r["n_lines"] - 1 == texts[i].count("\n") for i, r in found.items() if i % 3 == 0)


def test_held_out_labels_are_not_learnt(spark, marked):
    _, docs, labels = marked
    turned = labels.withColumn("quality", F.when(line_quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in line_quality.quality(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_quality_edge_cases(spark, marked):
    _, docs, labels = marked
    rows = [(1, None), (2, ""), (None, "spam$$$ spam$$$ spam$$$ spam$$$"), (3, "\n\n"), (4, "w " * 50_000), (4, "w " * 50_000), (5, "a\n" * 20_000), (6, "x" * 5_000_000)]
    odd = with_clashes(docs.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string")))
    found = line_quality.quality(odd, with_clashes(labels.unionByName(spark.createDataFrame([(None, 1, 0), (9, None, 0), (11, 0, 1)], "doc_id bigint, quality int, toxic int")))).collect()
    assert len(found) == 408 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    assert [r["held_out"] for r in found if r["doc_id"] is None] == [False]
    none = labels.limit(0)
    assert {r["score"] for r in line_quality.quality(docs, none).collect()} == {0.5}
    assert {r["score"] for r in line_quality.quality(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert line_quality.quality(docs.limit(0), labels).collect() == []


# conversation trie


def trie_by_hand(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in turns.items()}
    nodes, ended = defaultdict(list), defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = own.get(c - c % 100, [])[:h] + mine[h:]
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
        ended[tuple(path)].append(c)
    children = defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]].append(path)

    def under(path):
        return [path] + [x for child in children[path] for x in under(child)]

    out = []
    for path, members in nodes.items():
        below = under(path)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        digest = hashlib.sha256(",".join(map(str, sorted(ended[path]))).encode()).hexdigest()
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else -1, len(members), len(children[path]), sum(not children[p] for p in below), saved, digest))
    return sorted(out)


def trie_rows(spark, rows, **settings):
    df = with_clashes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    found = conversation_trie.trie(df, **settings).select(
        "conv_id", "depth", F.coalesce("parent_conv_id", F.lit(-1)), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(r) for r in found.collect())


def conversations():
    rng, rows = random.Random(4), []
    for c in [*range(0, 130), *range(200, 230), *range(305, 340), 10_000, 20_000]:
        for t in range(rng.randint(0, 7)):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["hi", "", "äö", "long text " * 3])))
    rows += [(c, t, "user", "same") for c in range(8_100, 8_200) for t in range(3)]
    rows += [(1, None, None, None), (None, 0, "user", "x"), (50, 3, None, "hi"), (400, 0, "u", ""), (400, 1, None, None)]
    rows += [(500, t, "user", str(t % 3)) for t in range(60)] + [(501, t, "user", str(t % 3)) for t in range(61)]
    seen, unique = set(), []
    for row in rows:  # one row a place, as ties go by hash
        if row[:2] not in seen:
            seen.add(row[:2])
            unique.append(row)
    return unique


@pytest.mark.parametrize("shards", [1, 9])
def test_trie_equals_brute_force(spark, monkeypatch, shards):
    monkeypatch.setattr(conversation_trie, "CHUNK", 16)
    monkeypatch.setattr(conversation_trie, "SPLITTER_TURNS", 3)
    rows = conversations()
    assert trie_rows(spark, rows, shards=shards) == trie_by_hand(rows)


def test_trie_edge_cases(spark):
    assert trie_rows(spark, []) == [] and trie_rows(spark, [(None, 1, "a", "b")]) == []
    rows = [(777, 1, "a", "b")] * 3 + [(777, 1, "a", "c" * 100_000)]
    assert [r[1] for r in trie_rows(spark, rows)] == list(range(max(0, 4 - zlib.crc32(b"777") % 6) + 1))
