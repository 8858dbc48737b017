"""Benchmark decontamination by a distributed positional inverted index.

1. ``build_index`` writes one posting (document, position, term) for every training token whose term a test item uses, and
   one entry per document with its length. Documents are read and split once; nothing is shuffled.
2. ``phrase_candidates`` counts the postings of each term, takes the two rarest terms of every test phrase, and
   intersects their posting lists after adjusting positions by the terms' offsets in the phrase.
3. ``phrase_matches`` confirms the surviving alignments against the postings of all their terms and returns the phrase
   occurrences; ``proximity_matches`` finds the terms of a phrase close together in any order.

All of it is DataFrame operations. A document may have any length and a term any number of postings: no list is gathered
per term, joins are on (document, position, term), and tables taken from the test items are broadcast only when counted
and below ``BROADCAST_ROWS`` rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth.session import stored

# Fixed values of the contract: a word after lower-casing A-Z, and the words of a phrase.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASE = 13

# The same words before lower-casing.
_CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table counted at up to so many rows, of some 100 bytes each, may be broadcast.
BROADCAST_ROWS = 500_000


@dataclass
class Index:
    """``entries``: key, doc_id, n_words of every document. ``postings``: key, pos, term. ``items``: item, item_id, q, term."""

    entries: DataFrame
    postings: DataFrame
    items: DataFrame


def words_of(text: Column) -> Column:
    """The words as written; ``lowered`` gives their final form. Null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_CASED_WORD), F.lit(0))


def lowered(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(word.rlike("[A-Z]"), F.translate(word, _UPPER, _LOWER)).otherwise(word)


def small(df: DataFrame) -> DataFrame:
    """A hint to broadcast a stored table if it has at most ``BROADCAST_ROWS`` rows, else the table as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def build_index(docs: DataFrame, items: DataFrame) -> Index:
    """The positional index of ``docs`` (doc_id, text) for the terms of ``items`` (item_id, text).

    Each row is a document of its own, whatever its id. Null and empty texts have no words and keep their entry.
    """
    numbered = items.select(F.monotonically_increasing_id().alias("item"), "item_id", words_of(F.col("text")).alias("words"))
    tokens = stored(numbered.select("item", "item_id", F.posexplode("words").alias("q", "word")).select("item", "item_id", "q", lowered(F.col("word")).alias("word")))
    # the empty word stands before each document's first and carries its length
    entry = tokens.sparkSession.createDataFrame([("", -1)], "word string, term long")
    vocabulary = stored(tokens.select("word").distinct().withColumn("term", F.monotonically_increasing_id()).union(entry))
    split = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", words_of(F.col("text")).alias("words"))
    seen = split.select("key", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("pos", "word")).select(
        "key", "doc_id", "n_words", "pos", lowered(F.col("word")).alias("word"))
    index = stored(seen.join(small(vocabulary), "word").select("key", "doc_id", "n_words", F.col("pos").cast("long").alias("pos"), "term"))
    return Index(
        index.where(F.col("term") == -1).select("key", "doc_id", "n_words"), index.where(F.col("term") != -1).select("key", "pos", "term"),
        stored(tokens.join(vocabulary, "word").select("item", "item_id", F.col("q").cast("long").alias("q"), "term")),
    )


def phrases(index: Index, width: int = PHRASE) -> DataFrame:
    """(item, item_id, start, size, q, term): every word of every phrase.

    A phrase is ``width`` consecutive words of an item, or the whole of a shorter item.
    """
    sizes = index.items.groupBy("item").agg(F.count(F.lit(1)).alias("length"))
    words = index.items.join(sizes, "item").withColumn("size", F.least("length", F.lit(width)))
    first, last = F.greatest(F.lit(0), F.col("q") - F.col("size") + 1), F.least(F.col("q"), F.col("length") - F.col("size"))
    return words.select("item", "item_id", "size", "q", "term", F.explode(F.sequence(first, last)).alias("start"))


def phrase_candidates(index: Index, width: int = PHRASE) -> DataFrame:
    """(key, item, shift, start, size): alignments of a phrase on which its two rarest terms agree.

    ``shift`` is the document's position of the item's first word. A phrase with a term that no document has can't occur.
    """
    counts = stored(index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("postings")))
    ranked = phrases(index, width).join(small(counts), "term", "left").groupBy("item", "start", "size").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("postings", F.lit(0)).alias("postings"), "q", "term"))).alias("terms"))
    chosen = stored(ranked.where(F.col("terms")[0]["postings"] > 0).select(
        "item", "start", "size", F.col("terms")[0].alias("rarest"), F.get("terms", F.lit(1)).alias("next")))
    wanted = chosen.select(F.col("rarest.term").alias("term")).union(chosen.select("next.term")).where("term is not null").distinct()
    rare = stored(index.postings.join(small(stored(wanted)), "term", "left_semi"))
    found = rare.join(small(chosen.withColumn("term", F.col("rarest.term"))), "term").select(
        "key", "item", "start", "size", (F.col("pos") - F.col("rarest.q")).alias("shift"), F.col("next.term").alias("term"), F.col("next.q").alias("q"))
    alone = found.where(F.col("term").isNull())
    both = found.where(F.col("term").isNotNull()).withColumn("pos", F.col("shift") + F.col("q")).join(rare, ["key", "pos", "term"], "left_semi")
    columns = ["key", "item", "shift", "start", "size"]
    return alone.select(columns).union(both.select(columns))


def phrase_matches(index: Index, width: int = PHRASE) -> DataFrame:
    """(key, item, item_id, shift, starts, size): the exact phrase occurrences, ``starts`` counted in the item."""
    found = stored(phrase_candidates(index, width))
    rows = found.select("key").distinct()
    postings = index.postings.join(small(stored(rows)), "key", "left_semi")
    words = found.select("key", "item", "shift", "size", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("q")).distinct()
    expected = words.join(index.items, ["item", "q"]).withColumn("pos", F.col("shift") + F.col("q"))
    confirmed = expected.join(postings, ["key", "pos", "term"]).groupBy("key", "item", "item_id", "shift", "size").agg(F.sort_array(F.collect_list("q")).alias("agreed"))
    # in sorted, distinct positions a run of ``size`` ends exactly size - 1 places after it starts
    runs = F.filter("agreed", lambda q, i: F.get("agreed", i + F.col("size").cast("int") - 1) == q + F.col("size") - 1)
    return confirmed.select("key", "item", "item_id", "shift", "size", runs.alias("starts")).where(F.size("starts") > 0)


def proximity_matches(index: Index, width: int = PHRASE, slop: int = 10) -> DataFrame:
    """(doc_id, item_id, start, pos): phrases whose terms all occur within ``slop`` words around their rarest term.

    The order of the words is free; ``pos`` is the document's position of the rarest term. Exact phrases of up to
    ``slop`` words are among the matches.
    """
    counts = stored(index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("postings")))
    terms = stored(phrases(index, width).join(counts, "term", "left").groupBy("item", "item_id", "start", "term").agg(F.coalesce(F.max("postings"), F.lit(0)).alias("postings")))
    rarest = terms.groupBy("item", "item_id", "start").agg(F.min(F.struct("postings", "term")).alias("rarest"), F.count(F.lit(1)).alias("needed")).where("rarest.postings > 0")
    anchors = stored(rarest.select("item", "item_id", "start", "needed", F.col("rarest.term").alias("term")))
    placed = index.postings.join(small(anchors), "term").withColumnRenamed("pos", "at")
    expected = placed.drop("term").join(terms.select("item", "start", "term"), ["item", "start"])
    span = slop + 1
    # a posting within reach lies in the anchor's stretch of positions or in one beside it
    near = expected.select("*", F.explode(F.array(*[F.floor((F.col("at")) / span) + d for d in (-1, 0, 1)])).alias("stretch"))
    postings = index.postings.withColumn("stretch", F.floor(F.col("pos") / span))
    met = near.join(postings, ["key", "stretch", "term"]).where(F.abs(F.col("pos") - F.col("at")) <= slop)
    whole = met.groupBy("key", "item", "item_id", "start", "at", "needed").agg(F.count_distinct("term").alias("met")).where(F.col("met") == F.col("needed"))
    return whole.join(index.entries, "key").select("doc_id", "item_id", "start", F.col("at").alias("pos"))


def contamination(docs: DataFrame, items: DataFrame, *, width: int = PHRASE, share: int = 20) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a phrase is hit; a document is contaminated if one word in ``share`` or more is hit.
    Null and empty texts have no words and are clean; repeated rows are judged each; items without words match nothing,
    and an item without an id gives hits but is not counted or listed. Empty tables give empty or clean results. Columns
    other than doc_id, item_id and text are ignored.
    """
    index = build_index(docs, items)
    matches = stored(phrase_matches(index, width))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("size") - 1))))
    hits = matches.select("key", F.explode(F.transform(covered, lambda q: q + F.col("shift"))).alias("pos")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    named = matches.where(F.col("item_id").isNotNull()).select("key", F.col("item_id").cast("string").alias("item_id")).distinct().groupBy("key").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("names"))
    found = index.entries.join(hits, "key", "left").join(named, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """``docs`` without the contaminated documents; all columns and texts as they were.

    Rows without a doc_id stay, as a decision can't be traced to them. If an id repeats with different texts, a
    contaminated one takes the others with it.
    """
    gone = contamination(docs, items, **settings).where("contaminated").select("doc_id").distinct()
    return docs.join(stored(gone), "doc_id", "left_anti").select(*docs.columns)
