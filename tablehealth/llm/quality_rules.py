"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

A document passes the fixed base rules, or it is out. Of those that pass, each rate (symbols, repeated lines, repeated
words, word length) must lie within bounds that its own language and source set, read from a sketch: above its ninth decile
(and, for word length, below its first) by ``reach`` times the decile's distance from the median, which counts as ``width``
buckets at least. No cutoff is fixed: a group that is full of symbols tolerates them, one that has none doesn't.

The sketch of a group is its histogram over buckets of fixed relative width (``GROWTH``), so sketches merge by adding counts, are
exact in rank, off by at most one bucket in value, and do not depend on how rows are dealt out. Shares below ``RESOLUTION`` are
one bucket. A group smaller than ``min_group`` uses its language's merged sketch, and a language smaller than that the sketch of all.
As a share of few things is no evidence, a document breaks a bound only if its count is more than ``SIGMAS`` standard
deviations (of a Poisson count) above what the bound allows a document of its size.

Counting partly on each task keeps a source with a third of all rows from being special: a group's sketch has at most a
few hundred rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth.session import stored

# Fixed values of the contract.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Each bucket of a sketch ends at so many times the end of the one before.
GROWTH = 1.05
#: Parts per million up to which shares are one bucket, and standard deviations that a count must lie above its bound.
RESOLUTION, SIGMAS = 10_000, 3.0
#: Rates in parts per million: column, numerator, denominator, end of the first bucket, least spread in buckets, and whether it is a
#: share (of which only an excess counts) or a size with bounds on both sides.
RATES = (
    ("symbol_rate", "n_symbols", "word_chars", RESOLUTION, 10, True), ("dup_line_rate", "n_dup_lines", "n_lines", RESOLUTION, 10, True),
    ("repeat_rate", "n_repeat_words", "n_words", RESOLUTION, 10, True), ("word_length", "word_chars", "n_words", 1, 1, False),
)
_DECILES = {"low": 0.1, "middle": 0.5, "high": 0.9}


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of whole texts.

    A null text has no words. ``n_lines`` counts the lines that have a word.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        "doc_id", "lang", "source", F.filter(F.split(text, SPACE, -1), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(NOT_SPACE)).alias("lines"), F.regexp_count(text, F.lit(SYMBOLS)).alias("n_symbols"),
    )
    n = F.size("words")
    return split.select(
        "doc_id", "lang", "source", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def repeated_words(words: Column, window: int = 3) -> Column:
    """Number of words inside windows of ``window`` words that occur twice or more in the array, first ones included.

    Windows are compared by 64-bit hash. Names are bound through one-element arrays, so that each array is built once.
    """
    def let(value, body):
        return F.transform(F.array(value), body)[0]

    def windows(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    def positions(hashes):
        # equal hashes are neighbours once sorted
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(placed, lambda s: F.transform(
            F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))

    def covered(hashes):
        spans = F.transform(positions(hashes), lambda p: F.sequence(p, p + window - 1))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(F.size(F.array_distinct(F.flatten(spans))))

    return let(words, lambda w: F.when(F.size(w) <= window, 0).otherwise(let(windows(w), covered))).cast("long")


def sketch(rates: DataFrame, keys: list[str]) -> DataFrame:
    """The quantile sketches of every rate: (*keys, rate, bucket, n), to be merged by adding ``n``."""
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("rate"), bucket(F.col(name), first).alias("bucket")) for name, _, _, first, *_ in RATES]))
    return rates.select(*keys, named.alias("x")).groupBy(*keys, "x.rate", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def bucket(value: Column, first: int) -> Column:
    """Bucket 0 holds the values up to ``first``; bucket b those up to ``first`` * GROWTH ** b."""
    return F.when(value <= first, 0).otherwise(F.ceil(F.log(value.cast("double") / first) / math.log(GROWTH) - 1e-9)).cast("int")


def deciles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, rate, size, low, middle, high): the buckets in which the deciles of each sketch lie.

    A sketch is small, so it is read as one sorted list.
    """
    cells = sketches.groupBy(*keys, "rate").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("cells"), F.sum("n").alias("size"))

    def at(share):
        rank = F.ceil(F.col("size") * share)
        step = F.aggregate("cells", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at")), lambda acc, c: F.struct(
            (acc["seen"] + c["n"]).alias("seen"), F.coalesce(acc["at"], F.when(acc["seen"] + c["n"] >= rank, c["bucket"])).alias("at")))
        return step["at"]

    return cells.select(*keys, "rate", "size", *[at(share).alias(name) for name, share in _DECILES.items()])


def thresholds(rates: DataFrame, *, reach: float, min_group: int) -> DataFrame:
    """(lang, source, lower_<rate>, upper_<rate> ...): bounds in buckets of every language and source, nulls as keys of their own."""
    fine = stored(sketch(rates, ["lang", "source"]))
    by_lang = fine.groupBy("lang", "rate", "bucket").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("rate", "bucket").agg(F.sum("n").alias("n"))
    own, lang, all_ = (deciles(x, keys) for x, keys in ((fine, ["lang", "source"]), (by_lang, ["lang"]), (overall, [])))
    lang = lang.select(*[F.col(c).alias(f"l_{c}") for c in ("lang", "rate", "size", *_DECILES)])
    all_ = all_.select(*[F.col(c).alias(f"a_{c}") for c in ("rate", *_DECILES)])
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rate") == F.col("l_rate"))).join(all_, F.col("rate") == F.col("a_rate"))
    pick = {d: F.when(F.col("size") >= min_group, F.col(d)).when(F.col("l_size") >= min_group, F.col(f"l_{d}")).otherwise(F.col(f"a_{d}")) for d in _DECILES}
    width = F.element_at(F.create_map(*[F.lit(x) for name, _, _, _, width, _ in RATES for x in (name, width)]), F.col("rate"))
    bounds = joined.select(
        "lang", "source", "rate", (pick["low"] - reach * F.greatest(pick["middle"] - pick["low"], width)).alias("lower"),
        (pick["high"] + reach * F.greatest(pick["high"] - pick["middle"], width)).alias("upper"))
    return bounds.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("rate") == name, F.col(side))).alias(f"{side}_{name}") for name, *_ in RATES for side in ("lower", "upper")])


def quality(docs: DataFrame, *, reach: float = 3.0, min_group: int = 200) -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts, base_failed, kept and ``failed``, the names of the bounds it broke.

    Thresholds come from all documents that pass the base rules. Null and empty texts have no words and fail; null languages and sources are groups of their own;
    repeated rows are judged each; an empty table gives an empty result. Other columns are ignored.
    """
    n = F.col("n_words")
    counts = stored(base_counts(docs).withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)))
    rates = counts.select("*", *[F.floor(F.col(up) * 1_000_000 / F.greatest(F.col(down), F.lit(1))).alias(name) for name, up, down, *_ in RATES])
    bounds = stored(thresholds(rates.where(~F.col("base_failed")), reach=reach, min_group=min_group))
    bounds = bounds.withColumnsRenamed({"lang": "b_lang", "source": "b_source"})
    joined = rates.join(bounds, F.col("lang").eqNullSafe(F.col("b_lang")) & F.col("source").eqNullSafe(F.col("b_source")), "left")
    broken = []
    for name, up, down, first, _, share in RATES:
        lower, upper, value = F.col(f"lower_{name}"), F.col(f"upper_{name}"), bucket(F.col(name), first)
        if share:
            allowed = F.col(down) * (first / 1e6) * F.pow(F.lit(GROWTH), upper)
            broken.append(F.when(F.col(up) - allowed > SIGMAS * F.sqrt(allowed), f"high_{name}"))
        else:
            broken += [F.when(value < lower, f"low_{name}"), F.when(value > upper, f"high_{name}")]
    failed = F.filter(F.array(*broken), lambda x: x.isNotNull())
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"), F.when(F.col("base_failed"), "").otherwise(F.array_join(failed, ",")).alias("failed"),
    )


def keep_good(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without the documents that fail; rows without a doc_id stay. All columns as they were."""
    gone = quality(docs, **settings).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(stored(gone), "doc_id", "left_anti").select(*docs.columns)
