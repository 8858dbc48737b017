"""The training-data queries ``opN_<name>`` and ``pipeline``, each over its whole table, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehealth.llm import bitsliced_search, checks, conversation_trie, decontamination, language_id, license_scan, line_quality, line_templates, quality_rules, secret_scan, sentencepiece_bpe, simhash, token_counts, warc_revisits
from tablehealth.session import configure

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = lambda spark, directory: build(configure(spark), directory)
        if sql is not None:
            _SQL[name] = sql
        return build
    return register


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


MODEL = "piece_bpe_32k.model"


@_query("op1_language_id")
def op1(spark: SparkSession, directory: str) -> DataFrame:
    return language_id.identify(language_id.document_evidence(_table(spark, directory, "documents")))


@_query("op2_token_counts")
def op2(spark: SparkSession, directory: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, directory, "documents"), public_tokenizers.path(MODEL))


@_query("op3_benchmark_decontamination", checks.CONTAMINATION)
def op3(spark: SparkSession, directory: str) -> DataFrame:
    return decontamination.contamination(_table(spark, directory, "documents"), _table(spark, directory, "benchmark"))


@_query("op4_line_dedup")
def op4(spark: SparkSession, directory: str) -> DataFrame:
    cleaned = line_templates.without_repeated_lines(_table(spark, directory, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"), F.sha2("text", 256).alias("text_sha256"))


@_query("op5_sentencepiece")
def op5(spark: SparkSession, directory: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(_table(spark, directory, "documents"), public_tokenizers.path(MODEL), ("ids_sha256", "decoded_sha256"))


@_query("op6_simhash_near_duplicates")
def op6(spark: SparkSession, directory: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, directory, "documents"))


_WARC_SQL = r"""
WITH bare AS (SELECT page_id, html, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
parts AS (
  SELECT page_id, html,
    regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www[0-9]*\.|:(80|443)$', '', 'g') AS host,
    regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort([x for x in string_split(regexp_extract(u, '\?(.*)$', 1), '&') if x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid|sessionid)(=|$)')]) AS q
  FROM bare),
keyed AS (
  SELECT page_id, html, CASE WHEN host <> '' THEN host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS k,
    '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag FROM parts),
latest AS (
  SELECT a.page_id, max(b.page_id) AS found FROM keyed a JOIN keyed b ON a.k = b.k AND b.page_id < a.page_id + 1000 GROUP BY a.page_id),
judged AS (
  SELECT a.page_id, a.tag, l.found, b.html,
    CASE WHEN a.k IS NULL THEN 'no_url' WHEN l.found IS NULL THEN 'no_earlier_response' WHEN a.tag = b.tag THEN 'resolved' ELSE 'mismatch' END AS verdict
  FROM keyed a LEFT JOIN latest l ON a.page_id = l.page_id LEFT JOIN keyed b ON b.page_id = l.found)
SELECT -page_id - 1 AS record_id, found AS refers_to, verdict,
  CASE WHEN verdict = 'resolved' THEN 'cache-control=max-age=600;content-length=' || strlen(html) || ';content-type=text/html;etag=' || tag
    ELSE 'cache-control=max-age=600;content-length=0;etag=' || tag END AS headers,
  CASE WHEN verdict = 'resolved' THEN sha256(html) END AS payload_sha256
FROM judged
"""


@_query("op7_warc_revisits", _WARC_SQL)
def op7(spark: SparkSession, directory: str) -> DataFrame:
    found = warc_revisits.resolve(warc_revisits.crawl_of(_table(spark, directory, "pages")))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select("record_id", "refers_to", "verdict", listed.alias("headers"), F.sha2("payload", 256).alias("payload_sha256"))


@_query("op8_quality_rules", checks.quality())
def op8(spark: SparkSession, directory: str) -> DataFrame:
    return quality_rules.quality(_table(spark, directory, "documents"))


@_query("op9_license_scan", checks.licences())
def op9(spark: SparkSession, directory: str) -> DataFrame:
    return license_scan.licences(_table(spark, directory, "documents"))


@_query("op10_secret_scan")
def op10(spark: SparkSession, directory: str) -> DataFrame:
    return secret_scan.secrets(_table(spark, directory, "documents"))


@_query("op11_ranked_search", checks.RANKED)
def op11(spark: SparkSession, directory: str) -> DataFrame:
    return bitsliced_search.search(_table(spark, directory, "documents"), _table(spark, directory, "benchmark"))


@_query("op12_line_quality")
def op12(spark: SparkSession, directory: str) -> DataFrame:
    return line_quality.quality(_table(spark, directory, "documents"), _table(spark, directory, "labels"))


@_query("op13_conversation_trie", checks.TRIE)
def op13(spark: SparkSession, directory: str) -> DataFrame:
    return conversation_trie.trie(_table(spark, directory, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return _QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
