"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its evidence is the shape of the line itself (repeated words, symbols, capitals, digits, lengths)
and of the lines before and after it; transitions tie neighbours together. Forward-backward gives each line's marginal
probability of being good; their mean, weighted by the lines' lengths, is calibrated to the probability that a document has
label 1.

The model is fitted on a bounded sample (``FIT_DOCS`` labelled documents of at most ``FIT_LINES`` lines and ``FIT_CHARS``
characters, the first by hash), whose features, not texts, reach the driver: at most ``FIT_DOCS * FIT_LINES`` rows of under
100 bytes. Labels are those of documents, and a bad document may have good lines; so a model of single lines is fitted first, and a
line of a bad document counts as bad for the chain if that model finds it the more likely, or finds no line of it worse.

Scoring reads each whole text once where it lies, without a shuffle, a few megabytes of text at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the sample that the model is fitted on.
FIT_DOCS, FIT_LINES, FIT_CHARS = 8_000, 256, 65_536
#: Bytes of text that a task works on at once; a longer text is worked on alone.
BYTES_AT_ONCE = 4_000_000
#: Part of the documents that labels aren't learnt from: those whose crc32(id) has remainder 0. Fixed values of the contract.
FOLDS, LEAST = 5, 0.3

_STEPS = np.array([0.01, 0.03, 0.07, 0.15, 0.3, 0.5, 0.75])
_COUNTS = np.array([1, 2, 4, 8, 16, 32, 64, 128])
_LENGTHS = np.array([2, 3, 4, 5, 6, 8, 12])
_RUNS, _BARE = re.compile(rb"[#*$%&|<>~^=_]{2,}"), re.compile(rb"(?<!\S)[!-/:-@\[-`{-~]+(?!\S)")
_DIGITS, _SYMBOLS, _CAPITALS, _SMALL = b"0123456789", b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_SHARES, _FLAGS = 10, 4
#: Features of a line: steps of its shares, counts and lengths, and flags.
FEATURES = _SHARES * len(_STEPS) + len(_COUNTS) + len(_LENGTHS) + _FLAGS


def _measures(line: bytes, seen: set[bytes]) -> tuple[float, ...]:
    words = line.split()
    n, size = len(words), len(line)
    if not n:
        return (0.0,) * (_SHARES + 2) + (1.0, 0.0, 0.0, 0.0)
    again = line in seen
    seen.add(line)
    small = size - len(line.translate(None, _SMALL))
    capital = size - len(line.translate(None, _CAPITALS))
    windows = n - 2
    return (
        (size - len(line.translate(None, _SYMBOLS))) / size,
        len(_RUNS.findall(line)) / n,
        len(_BARE.findall(line)) / n,
        capital / max(1, small + capital),
        sum(map(bytes.isupper, words)) / n,
        sum(map(eq, words, words[1:])) / max(1, n - 1),
        1 - len(set(zip(words, words[1:], words[2:]))) / windows if windows > 0 else 0.0,
        (size - len(line.translate(None, _DIGITS))) / size,
        line.count(b"!") / n,
        1 - len(set(words)) / n,
        n, (size - n + 1) / n,
        0.0, float(again), float(words[-1][-1:] in b".!?"), float(line[:1].isupper()),
    )


def features(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features[line], weight of each line in bytes, lines of each text); an empty text has one empty line."""
    rows, weights, counts = [], [], []
    for text in texts:
        lines, seen = text.split(b"\n"), set()
        rows.extend(_measures(line, seen) for line in lines)
        weights.extend(map(len, lines))
        counts.append(len(lines))
    table = np.array(rows, dtype=float).reshape(-1, _SHARES + 2 + _FLAGS)
    parts = [table[:, :_SHARES, None] >= _STEPS, table[:, _SHARES, None] >= _COUNTS, table[:, _SHARES + 1, None] >= _LENGTHS, table[:, _SHARES + 2:] > 0]
    return np.concatenate([p.reshape(len(table), -1) for p in parts], axis=1).astype(np.uint8), np.array(weights, dtype=float), np.array(counts)


@dataclass
class Model:
    """Weights for the bad state of a line's own, previous and next features, transitions between states, and the calibration."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    start: np.ndarray  # of states good, bad
    moves: np.ndarray  # [from, to]
    slope: float
    shift: float

    def evidence(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Score of each line for being bad."""
        x = x.astype(np.float32)
        first, last = _ends(counts)
        before, after = np.roll(x @ self.before, 1), np.roll(x @ self.after, -1)
        before[first], after[last] = 0, 0
        return x @ self.own + before + after

    def raw(self, x, weights, counts) -> np.ndarray:
        """Share of each text, by length, that is good; NaN for texts of no length."""
        bad, _ = marginals(self.evidence(x, counts), counts, self.start, self.moves)
        first, _ = _ends(counts)
        total = np.add.reduceat(weights, first)
        with np.errstate(invalid="ignore"):
            return np.add.reduceat((1 - bad) * weights, first) / total

    def score(self, x, weights, counts, otherwise: float) -> np.ndarray:
        raw = self.raw(x, weights, counts)
        return np.where(np.isnan(raw), otherwise, _sigmoid(self.slope * _logit(np.nan_to_num(raw, nan=0.5)) + self.shift))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _ends(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    last = np.cumsum(counts) - 1
    return last - counts + 1, last


def marginals(evidence: np.ndarray, counts: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability that each line is bad, expected transitions [from, to] over all texts), by forward-backward.

    All texts advance a line at a time, the longest first, so those that have ended are at the end of the arrays.
    """
    order = np.argsort(-counts, kind="stable")
    first = _ends(counts)[0][order]
    lengths = counts[order]
    alive = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(int(lengths[0]) if len(lengths) else 0)]
    local = np.ones((len(evidence), 2))
    local[:, 1] = np.exp(np.clip(evidence, -30, 30))
    local /= local.sum(axis=1, keepdims=True)
    step, alpha, beta = np.exp(moves), np.empty((len(evidence), 2)), np.ones((len(evidence), 2))
    for t, n in enumerate(alive):
        at = first[:n] + t
        a = (np.exp(start) if t == 0 else alpha[at - 1] @ step) * local[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(len(alive) - 1, 0, -1):
        at = first[:alive[t]] + t
        ahead = local[at] * beta[at]
        both = alpha[at - 1][:, :, None] * step * ahead[:, None, :]
        pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = ahead @ step.T
        beta[at - 1] = b / b.sum(axis=1, keepdims=True)
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1), pairs


def _descend(gradient, size: int, rounds: int, rate: float) -> np.ndarray:
    """Adam over the whole sample."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for i in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return w


def fit(x: np.ndarray, weights: np.ndarray, counts: np.ndarray, labels: np.ndarray, *, rounds: int = 150, rate: float = 0.1, penalty: float = 1e-3) -> Model:
    """The chain fitted to documents' labels (1 good, 0 bad)."""
    k, n = x.shape[1], len(x)
    first, last = _ends(counts)
    bad = np.repeat(labels == 0, counts)
    xf = x.astype(np.float32)
    single = np.concatenate([xf, np.ones((n, 1), np.float32)], axis=1)
    alone = _descend(lambda w: single.T @ (_sigmoid(single @ w) - bad) / n + penalty * w, k + 1, rounds, rate)
    chance = _sigmoid(single @ alone)
    worst = np.maximum.reduceat(chance, first)
    y = bad & ((chance > 0.5) | (chance >= np.repeat(worst, counts)))
    prev, follow = np.roll(xf, 1, axis=0), np.roll(xf, -1, axis=0)
    prev[first], follow[last] = 0, 0
    inner = np.ones(n, dtype=bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    begun = np.array([np.mean(~y[first]), np.mean(y[first])])

    def model(w, slope=1.0, shift=0.0) -> Model:
        return Model(w[:k], w[k:2 * k], w[2 * k:3 * k], w[3 * k:3 * k + 2], w[3 * k + 2:].reshape(2, 2), slope, shift)

    def gradient(w):
        now = model(w)
        p, pairs = marginals(xf @ now.own + prev @ now.before + follow @ now.after, counts, now.start, now.moves)
        off = p - y
        starts = np.array([np.mean(1 - p[first]), np.mean(p[first])]) - begun
        return np.concatenate([xf.T @ off / n, prev.T @ off / n, follow.T @ off / n, starts * len(counts) / n, ((pairs - seen) / n).ravel()]) + penalty * w

    w = _descend(gradient, 3 * k + 6, rounds, rate)
    raw = model(w).raw(x, weights, counts)
    z, good = _logit(raw[~np.isnan(raw)]), labels[~np.isnan(raw)]
    design = np.stack([z, np.ones_like(z)], axis=1)
    slope, shift = _descend(lambda c: design.T @ (_sigmoid(design @ c) - good) / max(1, len(z)), 2, 400, 0.1)
    return model(w, float(max(slope, 1e-3)), float(shift))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _batches(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list[bytes], dict]]:
    """Runs of rows of bounded size: their texts as bytes, null's empty, and other columns."""
    for batch in batches:
        texts, start, size = batch.column("text").cast(pa.binary()), 0, 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
        for end, more in enumerate([*lengths, BYTES_AT_ONCE]):
            if size + more >= BYTES_AT_ONCE and end > start or end == len(lengths):
                if end > start:
                    yield [t or b"" for t in texts.slice(start, end - start).to_pylist()], {c: batch.column(c).slice(start, end - start) for c in columns}
                start, size = end, 0
            size += more


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(good, lines, x, weights) of the bounded sample of labelled documents outside the held-out fold.

    A document with several labels has their rounded mean; one without an id or a label is not learnt from.
    """
    mean = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    fitting = docs.where((F.length("text") <= FIT_CHARS) & (F.regexp_count("text", F.lit("\n")) < FIT_LINES)).select("doc_id", "text")
    chosen = fitting.select("doc_id").join(mean, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)

    def run(batches):
        for texts, kept in _batches(batches, ["good"]):
            for text, good in zip(texts, kept["good"].to_pylist()):
                x, weights, _ = features([text])
                yield pa.RecordBatch.from_pydict({"good": pa.array([good], pa.int32()), "x": [np.packbits(x, axis=1).tobytes()], "weights": [weights.tolist()]})

    # of rows that repeat an id, the text with the smallest hash
    texts = fitting.join(chosen, "doc_id").groupBy("doc_id", "good").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return texts.orderBy("doc_id").select("good", "text").mapInArrow(run, "good INT, x BINARY, weights ARRAY<DOUBLE>")


def trained(docs: DataFrame, labels: DataFrame) -> tuple[Model | None, float]:
    """The model, and the share of label 1 in its sample (one half without labels). None if there are not both labels."""
    rows = training_sample(docs, labels).collect()  # bounded by FIT_DOCS, FIT_LINES and FIT_CHARS
    good = np.array([r["good"] for r in rows])
    share = float(good.mean()) if len(good) else 0.5
    if len(set(good.tolist())) < 2:
        return None, share
    x = np.concatenate([np.unpackbits(np.frombuffer(r["x"], np.uint8).reshape(len(r["weights"]), -1), axis=1, count=FEATURES) for r in rows])
    weights = np.concatenate([np.array(r["weights"]) for r in rows])
    return fit(x, weights, np.array([len(r["weights"]) for r in rows]), good), share


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted, n_lines, bad_lines (lines more likely bad).

    Scores depend on the text alone; null and empty texts, and those of blank lines only of no length, get the sample's share
    of label 1. With no labels, or one kind only, every text gets that share. A null id is in no fold: held_out is false.
    Repeated rows are scored each; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    model, share = trained(docs, labels)
    held = spark.sparkContext.broadcast((model, share))  # a few hundred weights

    def run(batches):
        model, share = held.value
        for texts, kept in _batches(batches, ["doc_id", "held_out"]):
            x, weights, counts = features(texts)
            if model is None:
                score, bad = np.full(len(texts), share), np.zeros(len(texts), dtype=np.int64)
            else:
                score = model.score(x, weights, counts, share)
                p, _ = marginals(model.evidence(x, counts), counts, model.start, model.moves)
                bad = np.add.reduceat((p > 0.5).astype(np.int64), _ends(counts)[0])
            yield pa.RecordBatch.from_arrays(
                [kept["doc_id"], kept["held_out"], pa.array(score), pa.array((score >= LEAST).astype(np.int32)), pa.array(counts.astype(np.int64)), pa.array(bad)],
                names=["doc_id", "held_out", "score", "predicted", "n_lines", "bad_lines"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out BOOLEAN, score DOUBLE, predicted INT, n_lines BIGINT, bad_lines BIGINT")
