"""Language ID by Bayesian evidence fusion.

Posterior of a language = host prior x likelihood of the declared language x tempered likelihood of the text, normalised:

* text: a multinomial over hashed byte trigrams of letters, fitted on all texts by their declared language, each mixed with
  the same small share of the uniform distribution, so that a language with few texts is no better at unseen trigrams. Texts are
  dealt into two folds by their bytes and each is read by the model of the other one, so that none vouches for itself;
* declared markup language: how often texts that read as one language are declared as another, counted over all texts;
* host and address suffix: shares of languages among a host's texts, smoothed towards the shares of its address suffix,
  and those towards the shares of all, by grouped aggregation.

Every language of ``KNOWN`` that at least ``min_texts`` texts declare is a class, whatever its share. Other tags are no languages
but one further declared value, so junk tags, however many, cost nothing. One more class, ``UNKNOWN``, stands for none of these: foreign
languages and garbage. Its text model is the background, trigrams of independent bytes mixed with the
uniform distribution; its priors are counted as those of the others.

The trigram model and the table of declared languages have 2 x classes x ``BUCKETS`` and classes x (classes + 1) numbers, and classes
are at most those of ``KNOWN`` and one: under 105 MB if every language of the list is declared, so both may go to every task.
Host priors grow with the hosts and are joined, with texts left out; a host with a third of the rows is counted partly on
each task and its join left for adaptive execution to split.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth.session import stored

BUCKETS = 1 << 16
#: The language of texts that none of the declared languages explains, and tags that name no language.
UNKNOWN = "und"
# The two-letter codes of ISO 639-1, and three-letter codes (ISO 639-3) of languages that web texts often declare.
KNOWN = tuple("""
    aa ab ae af ak am an ar as av ay az ba be bg bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu
    fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn
    ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os
    pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw
    ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu
    arz ast ceb fil gsw haw hmn nds pnb sco war""".split())
_PIECE = 1 << 20  # bytes of a text that are looked at together
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32) for b in range(256))


def codes(text: str) -> Iterator[np.ndarray]:
    """The text's byte trigrams as numbers: A-Z as a-z, other ASCII as space, and no trigram with two spaces in a row."""
    data = b" " + text.encode("utf-8", "surrogatepass").translate(_FOLD) + b" "
    for at in range(0, len(data) - 2, _PIECE):
        b = np.frombuffer(data[at:at + _PIECE + 2], np.uint8)
        space = b == 32
        keep = ~((space[:-2] & space[1:-1]) | (space[1:-1] & space[2:]))
        wide = b.astype(np.uint32)
        yield (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:])[keep]


def fold_of(text: str) -> int:
    """0 or 1; equal texts have the same fold."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) & 1


def bucket_of(code: np.ndarray) -> np.ndarray:
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the text's byte trigrams."""
    return map(bucket_of, codes(text))


def primary(tag: Column) -> Column:
    """``en`` of ``en-GB`` or `` EN_us``; null of an empty one."""
    return F.nullif(F.lower(F.trim(F.split(tag, "[-_]")[0])), F.lit(""))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Evidence of raw pages (page_id, url, html): doc_id, text, declared, host, suffix."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    declared = F.regexp_extract("html", r"""(?is)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z]+)""", 1)
    return pages.select(F.col("page_id").alias("doc_id"), body.alias("text"), F.nullif(declared, F.lit("")).alias("declared"),
                        F.nullif(host, F.lit("")).alias("host"), F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit("")).alias("suffix"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """Evidence of documents (doc_id, text, lang, source): the source is the host, and there is no address."""
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))


def languages_of(evidence: DataFrame, min_texts: int = 2) -> list[str]:
    """The languages of ``KNOWN`` that at least ``min_texts`` texts declare."""
    named = evidence.select(primary(F.col("declared")).alias("declared")).where(F.col("declared").isin(*KNOWN))
    counts = named.groupBy("declared").agg(F.count(F.lit(1)).alias("n"))
    return sorted(row[0] for row in counts.where(F.col("n") >= min_texts).select("declared").collect())


def background(bytes_seen: np.ndarray) -> np.ndarray:
    """Probabilities of the buckets under independent bytes, with the shares seen, mixed evenly with the uniform distribution."""
    letters = np.array([32, *range(97, 123), *range(128, 256)], np.uint32)
    share = (bytes_seen[letters] + 1.0) / (bytes_seen[letters] + 1.0).sum()
    code = (letters[:, None, None] << 16 | letters[:, None] << 8 | letters).ravel()
    weight = share[:, None, None] * share[:, None] * share
    weight[0, 0, :] = weight[:, 0, 0] = 0  # two spaces in a row
    found = np.bincount(bucket_of(code), weight.ravel(), BUCKETS)
    return 0.5 * found / found.sum() + 0.5 / BUCKETS


def fit(evidence: DataFrame, languages: list[str], smoothing: float = 0.01) -> np.ndarray:
    """Log-probabilities, 2 x BUCKETS x (languages + 1), from all texts that declare one of the languages; the last is the background's.

    The first axis is the fold of the text to be read: its model has the texts of the other fold, or all where that has none.
    """
    place = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, first = {}, np.zeros(256, np.int64)
        for batch in batches:
            for text, name in zip(batch.column("text").to_pylist(), batch.column("declared").to_pylist()):
                key = fold_of(text), place[name]
                if key not in counts:
                    counts[key] = np.zeros(BUCKETS, np.int64)
                own = counts[key]
                for code in codes(text):
                    own += np.bincount(bucket_of(code), minlength=BUCKETS)
                    first += np.bincount(code >> np.uint32(16), minlength=256)
        for (fold, which), own in [*counts.items(), ((0, len(place)), first)]:
            bucket = np.nonzero(own)[0]
            keys = [pa.array(np.full(len(bucket), x), pa.int32()) for x in (fold, which)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(bucket, pa.int32()), pa.array(own[bucket])], names=["fold", "language", "bucket", "n"])

    texts = evidence.select("text", primary(F.col("declared")).alias("declared")).where(F.col("text").isNotNull() & F.col("declared").isin(languages))
    counted = texts.mapInArrow(count, "fold int, language int, bucket int, n bigint").groupBy("fold", "language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((2, BUCKETS, len(languages) + 1), np.float32)
    table[1 - counted["fold"], counted["bucket"], counted["language"]] = counted["n"]
    bytes_seen = table[:, :256, -1].sum(axis=0)
    for one in range(len(languages)):  # a language at a time: the wide numbers never exist for all of them together
        seen = table[:, :, one].astype(np.float64)
        size = seen.sum(axis=1, keepdims=True)
        share = np.where(size > 0, seen, seen[::-1]) / np.maximum(np.where(size > 0, size, size[::-1]), 1)
        table[:, :, one] = np.log((1 - smoothing) * share + smoothing / BUCKETS)
    table[:, :, -1] = np.log(background(bytes_seen))
    return table


def scored(evidence: DataFrame, model: np.ndarray, temper: float) -> DataFrame:
    """(doc_id, declared, host, suffix, n_grams, scores): tempered text log-likelihoods, less the best one's."""
    shared = evidence.sparkSession.sparkContext.broadcast(model)
    key = evidence.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            sizes, scores = [], []
            for text in batch.column("text").to_pylist():
                own, total, n = table[fold_of(text or "")], np.zeros(table.shape[2]), 0
                for buckets in trigrams(text or ""):
                    total += own[buckets].sum(axis=0, dtype=np.float64)
                    n += len(buckets)
                sizes.append(n)
                scores.append(((total - total.max()) * temper).tolist() if total.size else [])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "declared", "host", "suffix")], pa.array(sizes, pa.int64()), pa.array(scores, pa.list_(pa.float64()))],
                names=["doc_id", "declared", "host", "suffix", "n_grams", "scores"])

    plain = evidence.select("doc_id", "text", primary(F.col("declared")).alias("declared"), "host", "suffix")
    return plain.mapInArrow(score, f"doc_id {key}, declared string, host string, suffix string, n_grams bigint, scores array<double>")


def host_priors(read: DataFrame, n: int, weight: float) -> DataFrame:
    """(p_host, p_suffix, prior): log-shares of the ``n`` classes among the texts of each host and suffix, smoothed upwards.

    ``read`` has host, suffix and ``label``, the class that the text alone suggests. Counts are arrays by class.
    """
    def summed(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        # at most n counts for each key
        found = rows.groupBy(*keys, "label").agg(F.sum("n").alias("n")).groupBy(*keys).agg(
            F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "n")))).alias("m"))
        return found.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double")).alias(name))

    def smoothed(counts: Column, above: Column | None) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x)
        if above is None:
            return F.transform(counts, lambda x: (x + 1) / (total + n))
        return F.zip_with(counts, above, lambda x, y: (x + weight * y) / (total + weight))

    labels = stored(read.groupBy("host", "suffix", "label").agg(F.count(F.lit(1)).alias("n")))
    own = summed(labels, ["host", "suffix"], "own")
    above = summed(labels, ["suffix"], "above").withColumnRenamed("suffix", "s_suffix")
    every = summed(labels, [], "every")
    joined = own.join(above, F.col("suffix").eqNullSafe(F.col("s_suffix"))).join(F.broadcast(every))  # ``every`` is one row
    share = joined.select("host", "suffix", "own", smoothed(F.col("above"), smoothed(F.col("every"), None)).alias("above"))
    share = share.select("host", "suffix", smoothed(F.col("own"), F.col("above")).alias("share"))
    return share.select(F.col("host").alias("p_host"), F.col("suffix").alias("p_suffix"), F.transform("share", lambda x: F.log(x)).alias("prior"))


def declared_likelihood(read: DataFrame, languages: list[str]) -> DataFrame:
    """(d_value, told): log-likelihoods by class of each declared value, from the table of all texts; zeros where none is declared.

    Declarations outside the languages count as one further value, ``other``.
    """
    classes, values = range(len(languages) + 1), [*languages, "other"]
    counted = read.select("label", declared_value(languages).alias("value")).where("label is not null and value is not null").groupBy("label", "value").agg(F.count(F.lit(1)).alias("n")).collect()
    seen = {(row["label"], row["value"]): row["n"] for row in counted}
    total = [sum(seen.get((i, w), 0) for w in values) + len(values) for i in classes]
    rows = [(v, [math.log((seen.get((i, v), 0) + 1) / total[i]) for i in classes]) for v in values]
    return read.sparkSession.createDataFrame([*rows, (None, [0.0] * len(classes))], "d_value string, told array<double>")


def declared_value(languages: list[str]) -> Column:
    return F.when(F.col("declared").isin(languages), F.col("declared")).when(F.col("declared").isNotNull(), "other")


def identify(evidence: DataFrame, *, languages: list[str] | None = None, min_texts: int = 2, temper: float = 0.125,
             weight: float = 20.0, min_confidence: float = 0.5, min_grams: int = 3) -> DataFrame:
    """Per row of ``evidence``: doc_id, declared, language, confidence, kept.

    ``evidence`` has doc_id, text, declared, host and suffix; other columns are ignored. Null evidence says nothing: a null or
    empty text leaves the declared language and the host to decide, a null host or suffix is a group of its own.
    ``language`` is ``UNKNOWN`` where the background explains the text better than every language.
    ``kept`` is false for those, for texts of fewer than ``min_grams`` letter trigrams and for those whose best language has a
    posterior below ``min_confidence``. Ties take the language first in the alphabet, ``UNKNOWN`` last. Repeated rows are judged each. If no
    language is declared often enough there are none: ``language`` is null and nothing is kept. An empty table gives an
    empty result.
    """
    names = languages_of(evidence, min_texts) if languages is None else sorted(languages)
    if not names:
        return evidence.select("doc_id", primary(F.col("declared")).alias("declared"), F.lit(None).cast("string").alias("language"),
                               F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    classes = [*names, UNKNOWN]
    read = scored(evidence, fit(evidence, names), temper)
    best = F.array_position("scores", F.array_max("scores")).cast("int") - 1
    read = stored(read.withColumn("label", F.when(F.col("n_grams") >= min_grams, best)))
    priors = stored(host_priors(read, len(classes), weight))
    told = F.broadcast(declared_likelihood(read, names))  # a row for each language
    joined = read.join(priors, F.col("host").eqNullSafe(F.col("p_host")) & F.col("suffix").eqNullSafe(F.col("p_suffix")))
    joined = joined.join(told, declared_value(names).eqNullSafe(F.col("d_value")))
    three = F.zip_with(F.zip_with("scores", "prior", lambda a, b: a + b), "told", lambda a, b: a + b)
    summed = joined.select("doc_id", "declared", "n_grams", three.alias("weights"))
    top = F.array_max("weights")
    scale = F.aggregate("weights", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    confidence = F.round(1 / scale, 6)
    language = F.element_at(F.array(*[F.lit(x) for x in classes]), F.array_position("weights", top).cast("int"))
    return summed.select(
        "doc_id", "declared", language.alias("language"), confidence.alias("confidence"),
        ((F.col("n_grams") >= min_grams) & (language != UNKNOWN) & (confidence >= min_confidence)).alias("kept"))


def keep_identified(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without the documents whose language is not identified; rows without a doc_id stay."""
    gone = identify(document_evidence(docs), **settings).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(stored(gone), "doc_id", "left_anti").select(*docs.columns)
