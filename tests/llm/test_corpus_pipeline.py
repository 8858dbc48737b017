"""The pipeline over small tables: what each stage takes away, the written hand-over, odd rows and an empty table."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = {
    "en": "the of and to in is that for with was on are this from which one had their there been were when who will more".split(),
    "de": "der die und das von mit nicht ist auf eine auch sich dass werden aus bei nach wird noch nur wenn aber oder sehr".split(),
}


def prose(seed, n, lang="en"):
    """Words of the language between invented ones, in one line."""
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang]) if k % 2 else "".join(rng.choices("abdeilmnorstu", k=6)) for k in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    passage = prose(900, 40)
    rows = [(i, prose(i, 120, lang), lang, f"s{i % 3}") for i in range(40) for lang in [("en", "de")[i % 2]]]
    copied = rows[4][1]
    rows += [
        (100, copied, "en", "s1"),  # an exact copy of document 4
        (101, f"{prose(101, 60)}\n{passage}", "en", "s2"),  # holds a benchmark's passage
        (102, None, "en", "s1"), (103, "", None, None), (104, " \n\t ", "de", "s0"),
        (105, prose(105, 4000), "en", "s0"), (None, prose(106, 90), "en", "s0"), (107, prose(107, 90), "en", "s0"), (107, prose(107, 90), "en", "s0"),
    ]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(*row, len(row[1] or "")) for row in rows], SCHEMA)
    # a column that clashes with one that a stage works with
    docs.withColumn("words", F.lit("extra")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {row[0]: row[1] for row in rows}


def test_pipeline_keeps_clean_documents_and_drops_planted_ones(spark, tables):
    folder, texts = tables
    rows = corpus_pipeline.run(spark, folder).collect()
    kept = [r.doc_id for r in rows]
    assert len(set(kept)) == len(kept)
    assert set(range(40)) - {4} <= set(kept) and 105 in kept and kept.count(107) == 1
    assert len({4, 100} & set(kept)) == 1  # one of the copies
    assert 101 not in kept  # contaminated
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for row in rows:
        assert row["words"] == "extra"
        assert row["n_tokens"] == len(library.encode(row["text"] or ""))
        if row.doc_id in texts and row.doc_id is not None:
            # whole texts: nothing in these repeats between different documents
            assert row["text"] == texts[row.doc_id]


def test_stages_return_the_columns_of_documents(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_pipeline_of_an_empty_table(spark, tables, tmp_path):
    folder, _ = tables
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
