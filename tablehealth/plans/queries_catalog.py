"""Catalogue queries: text keys, reconciliation, graph, integrity, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablehealth import params
from tablehealth.functions import cadence, text
from tablehealth.operators import graph, integrity, ranked, reconcile, summary
from tablehealth.plans.bindings import Tables, dataset_id
from tablehealth.plans.oracle import canonical_url, case_of, in_list, pub, signature, title, words
from tablehealth.plans.registry import query


@query("canonical_url", f"SELECT page_id, {canonical_url('url')} AS canonical_url, lower(regexp_extract(url, '//([^/?#]*)', 1)) AS channel FROM pages")
def _canonical_url(t: Tables):
    return t.read("pages").select(
        "page_id", text.canonical_url(F.col("url")).alias("canonical_url"), text.endpoint_channel(F.col("url")).alias("channel")
    )


@query("semantic_title", f"""
SELECT dataset_id, {title('name')} AS title, {words('custodian')} AS custodian_words,
  array_to_string({signature('dataset_id', 'name')}, ' ') AS granularity FROM cat""")
def _semantic_title(t: Tables):
    return t.catalog.select(
        "dataset_id", text.semantic_title(F.col("name")).alias("title"),
        text.normalise_words(F.col("custodian")).alias("custodian_words"),
        F.array_join(text.granularity_signature(F.col("dataset_id"), F.col("name")), " ").alias("granularity"),
    )


@query("normalise_words", f"SELECT doc_id, {words('text')} AS words FROM documents")
def _normalise_words(t: Tables):
    return t.read("documents").select("doc_id", text.normalise_words(F.col("text")).alias("words"))


@query("cadence_tier", """
SELECT dataset_id, CASE WHEN refresh_frequency IN ('30 seconds', 'hourly') THEN 'realtime' WHEN refresh_frequency LIKE 'daily%' THEN 'daily'
    WHEN refresh_frequency IN ('weekly', 'monthly', 'quarterly') THEN 'weekly-monthly' ELSE 'slow' END AS tier,
  CASE WHEN refresh_frequency IN ('30 seconds', 'hourly') THEN 900 WHEN refresh_frequency LIKE 'daily (%' THEN 3600
    WHEN refresh_frequency = 'daily' THEN 86400 WHEN refresh_frequency IN ('weekly', 'monthly', 'quarterly') THEN 604800 ELSE 2592000 END AS due_seconds,
  CASE refresh_frequency WHEN '30 seconds' THEN 30 WHEN 'hourly' THEN 3600 WHEN 'weekly' THEN 604800 WHEN 'monthly' THEN 2592000
    WHEN 'quarterly' THEN 7776000 WHEN 'annual' THEN 31536000 ELSE CASE WHEN refresh_frequency LIKE 'daily%' THEN 86400 END END AS baseline_seconds,
  CASE refresh_frequency WHEN 'weekly' THEN 7.0 WHEN 'monthly' THEN 30.0 WHEN 'quarterly' THEN 90.0 WHEN 'annual' THEN 365.0
    ELSE CASE WHEN refresh_frequency LIKE 'daily%' THEN 1.0 WHEN refresh_frequency LIKE 'biennial%' THEN 730.0
      WHEN refresh_frequency = 'hourly' THEN CAST(1.0 AS DOUBLE) / 24 WHEN refresh_frequency = '30 seconds' THEN CAST(30.0 AS DOUBLE) / 86400 END END AS cadence_days
FROM cat""")
def _cadence_tier(t: Tables):
    frequency = cadence.policy_frequency(F.col("refresh_frequency"), F.col("dataset_id"))
    return t.catalog.select(
        "dataset_id", cadence.cadence_tier(frequency).alias("tier"), cadence.due_seconds(frequency).alias("due_seconds"),
        cadence.baseline_seconds(frequency).alias("baseline_seconds"), cadence.cadence_days(F.col("refresh_frequency")).alias("cadence_days"),
    )


@query("availability_class", """
SELECT dataset_id, CASE WHEN status IN ('fresh', 'aging', 'stale', 'unknown-freshness', 'reference') THEN 'available'
  WHEN status IN ('degraded', 'unavailable', 'discontinued') THEN 'failed' ELSE 'unknown' END AS availability_class FROM bare""")
def _availability_class(t: Tables):
    return t.bare_snapshot.select("dataset_id", text.availability_class(F.col("status")).alias("availability_class"))


@query("discover_groups", """
SELECT group_key, logical_name, grouping_method, relationship, confidence, dataset_id, record_count_policy,
  record_count_tolerance_pct, content_date_tolerance_days, rationale FROM members""")
def _discover_groups(t: Tables):
    return t.group_members


@query("reconcile", """
SELECT group_key, logical_name, grouping_method, relationship, record_count_policy, member_count, verdict,
  verdict = 'discrepancy' AS requires_human_review FROM groups""")
def _reconcile(t: Tables):
    return t.stored.groups.select(
        "group_key", "logical_name", "grouping_method", "relationship", "record_count_policy", "member_count", "verdict",
        "requires_human_review",
    )


@query("compare_with_anchor", """
SELECT group_key, left_id, right_id, record_count_delta, record_count_delta_pct, record_count_within_tolerance,
  content_date_delta_days, content_date_within_tolerance, availability_match FROM pairs p
WHERE left_id = (SELECT min(dataset_id) FROM members m WHERE m.group_key = p.group_key)""")
def _compare_with_anchor(t: Tables):
    return reconcile.compare_with_anchor(reconcile.member_rows(t.stored.group_members, t.stored.catalog, t.stored.bare_snapshot))


@query("compare_for", """
SELECT group_key, left_id, right_id, record_count_delta, record_count_delta_pct, record_count_within_tolerance,
  content_date_delta_days, content_date_within_tolerance, availability_match FROM pairs
WHERE left_id IN (SELECT dataset_id FROM bare WHERE status = 'stale') OR right_id IN (SELECT dataset_id FROM bare WHERE status = 'stale')""")
def _compare_for(t: Tables):
    rows = reconcile.member_rows(t.stored.group_members, t.stored.catalog, t.stored.bare_snapshot)
    return reconcile.compare_for(rows, t.stored.bare_snapshot.where(F.col("status") == "stale"))


@query("catalog_graph", """
SELECT kind, key, count(*) AS edges, any_value(weight) AS weight FROM edges WHERE kind <> 'successor_to' GROUP BY kind, key""")
def _catalog_graph(t: Tables):
    rows = graph.groups(t.catalog).where(F.col("edges") > 0)
    joined = F.array_join(F.from_json("key", "array<string>"), "|")
    return rows.select("kind", F.when(F.col("kind") == "same_steward", joined).otherwise(F.col("key")).alias("key"), "edges", "weight")


@query("graph_edge_kinds", f"""
SELECT k.kind, coalesce(e.n, 0) AS edges FROM (SELECT unnest([{', '.join(f"'{k}'" for k in params.EDGE_WEIGHTS)}]) AS kind) k
LEFT JOIN (SELECT kind, count(*) AS n FROM edges GROUP BY kind) e ON e.kind = k.kind""")
def _graph_edge_kinds(t: Tables):
    return graph.edge_kinds(t.catalog)


@query("graph_degrees", """
SELECT dataset_id, kind, count(*) AS degree FROM (SELECT from_id AS dataset_id, kind FROM edges UNION ALL SELECT to_id, kind FROM edges)
GROUP BY dataset_id, kind""")
def _graph_degrees(t: Tables):
    return graph.degrees(t.catalog)


@query("graph_isolated", """
SELECT dataset_id FROM cat WHERE dataset_id NOT IN (SELECT from_id FROM edges) AND dataset_id NOT IN (SELECT to_id FROM edges)""")
def _graph_isolated(t: Tables):
    return graph.isolated(t.catalog)


@query("graph_edges_of", """
SELECT kind, from_id, to_id, weight FROM edges
WHERE from_id IN (SELECT dataset_id FROM cat WHERE data_type = 'reference') OR to_id IN (SELECT dataset_id FROM cat WHERE data_type = 'reference')""")
def _graph_edges_of(t: Tables):
    return graph.edges_of(t.catalog, t.catalog.where(F.col("data_type") == "reference"))


@query("graph_nodes", "SELECT dataset_id, name AS title, steward, source AS agency FROM cat")
def _graph_nodes(t: Tables):
    return graph.nodes(t.catalog)


@query("id_set_findings", """
SELECT 'missing from health' AS rule, dataset_id AS subject, CAST(NULL AS VARCHAR) AS detail FROM cat WHERE dataset_id NOT IN (SELECT dataset_id FROM obs WHERE status = 'degraded' AND k % 3 = 0)
UNION ALL SELECT DISTINCT 'missing from catalogue', dataset_id, NULL FROM obs WHERE status = 'degraded' AND k % 3 = 0 AND dataset_id NOT IN (SELECT dataset_id FROM cat WHERE geography IS NOT NULL) AND false
UNION ALL SELECT 'duplicate in health', dataset_id, CAST(count(*) AS VARCHAR) FROM obs WHERE status = 'degraded' AND k % 3 = 0 GROUP BY dataset_id HAVING count(*) > 1""")
def _id_set_findings(t: Tables):
    health = t.observations.where((F.col("status") == "degraded") & (F.col("k") % 3 == 0))
    return integrity.id_set_findings(t.catalog, health)


@query("integrity_findings", """
SELECT 'missing from health' AS rule, dataset_id AS subject, CAST(NULL AS VARCHAR) AS detail FROM cat WHERE dataset_id NOT IN (SELECT dataset_id FROM bare WHERE status <> 'stale')
UNION ALL SELECT 'unresolved custodian', custodian, NULL FROM cat WHERE custodian = 'Custodian 3' GROUP BY custodian
UNION ALL SELECT 'unreferenced custodian', s, NULL FROM (SELECT DISTINCT steward AS s FROM cat WHERE steward IS NOT NULL)""")
def _integrity_findings(t: Tables):
    registered = t.catalog.where(F.col("custodian") != "Custodian 3").select("custodian").unionByName(
        t.catalog.where(F.col("steward").isNotNull()).select(F.col("steward").alias("custodian"))
    )
    health = t.bare_snapshot.where(F.col("status") != "stale")
    return integrity.integrity_findings(t.catalog, health, custodians=registered)


@query("output_invariants")
def _output_invariants(t: Tables):
    s = t.stored
    return integrity.output_invariants(
        s.catalog, trends=s.trends, drifts=s.drifts, members=s.group_members, groups=s.groups, scores=s.scores,
        edges=graph.successor_edges(s.catalog), memberships=graph.memberships(s.catalog),
    )


@query("catalog_with_health", """
SELECT c.dataset_id, c.name, coalesce(s.status, 'unknown') AS status, s.staleness_days FROM cat c
LEFT JOIN (SELECT * FROM bare WHERE status <> 'unreachable') s ON s.dataset_id = c.dataset_id""")
def _catalog_with_health(t: Tables):
    health = t.bare_snapshot.where(F.col("status") != "unreachable")
    return ranked.with_health(t.catalog, health, ["status", "staleness_days"]).select("dataset_id", "name", "status", "staleness_days")


@query("trust_summary", f"""
SELECT count(*) AS datasets_total, {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS status_{s.replace('-', '_')}" for s in params.STATUSES)},
  count(*) FILTER (WHERE freshness_signal_source = 'last_modified_header') AS signal_last_modified_header,
  count(*) FILTER (WHERE freshness_signal_source = 'content_date_parse') AS signal_content_date_parse,
  count(*) FILTER (WHERE freshness_signal_source = 'none') AS signal_neither,
  count(*) FILTER (WHERE last_modified IS NULL) AS without_last_modified, count(*) FILTER (WHERE record_count IS NULL) AS without_record_count,
  min(last_modified) AS oldest_last_modified, max(last_modified) AS newest_last_modified FROM bare""")
def _trust_summary(t: Tables):
    return summary.trust_summary(t.bare_snapshot)


@query("stale_datasets", "SELECT dataset_id, staleness_days AS days_since_modified FROM bare WHERE status = 'stale'")
def _stale_datasets(t: Tables):
    return summary.stale_datasets(t.bare_snapshot)


@query("count_by", f"""
SELECT k.key, coalesce(c.n, 0) AS count FROM (SELECT unnest([{', '.join(f"'{n}'" for n in params.NAMESPACES)}]) AS key) k
LEFT JOIN (SELECT namespace, count(*) AS n FROM cat GROUP BY 1) c ON c.namespace = k.key
UNION ALL SELECT 'all', count(*) FROM cat""")
def _count_by(t: Tables):
    return summary.count_by(t.catalog, "namespace", domain=params.NAMESPACES, with_total=True)


@query("licence_summary", "SELECT licence AS key, count(*) AS count FROM cat GROUP BY 1")
def _licence_summary(t: Tables):
    return summary.licence_summary(t.catalog)


@query("lifecycle_counts", "SELECT o_orderstatus AS key, count(*) AS count FROM orders GROUP BY 1")
def _lifecycle_counts(t: Tables):
    return summary.count_by(t.read("orders"), "o_orderstatus")


@query("reliability_summary", f"""
SELECT k.key, coalesce(c.n, 0) AS count FROM (SELECT unnest(['A', 'B', 'C', 'D', 'F', 'insufficient_data']) AS key) k
LEFT JOIN (SELECT reliability_grade, count(*) AS n FROM trends GROUP BY 1) c ON c.reliability_grade = k.key""")
def _reliability_summary(t: Tables):
    return summary.reliability_summary(t.trends)


_DOMAIN = "[" + ", ".join(f"'{s}'" for s in params.STATUSES) + "]"


@query("status_distribution", f"""
SELECT status, count, CASE WHEN first THEN {pub(f"percent + {pub('100.0 - sum(percent) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)', 1)}", 1)} ELSE percent END AS percent
FROM (SELECT *, {pub('count * 100 / CAST(total AS DOUBLE)', 1)} AS percent, row_number() OVER (ORDER BY count DESC, i) = 1 AS first
      FROM (SELECT d.status, d.i, (SELECT count(*) FROM bare b WHERE b.status = d.status) AS count, (SELECT count(*) FROM bare) AS total
            FROM (SELECT unnest({_DOMAIN}) AS status, unnest(range({len(params.STATUSES)})) AS i) d))""")
def _status_distribution(t: Tables):
    return summary.status_distribution(t.bare_snapshot)


@query("reliability_grade", """
SELECT dataset_id, publish_on_time_pct, CASE WHEN publish_on_time_pct IS NULL THEN 'insufficient_data' WHEN publish_on_time_pct >= 95 THEN 'A'
  WHEN publish_on_time_pct >= 85 THEN 'B' WHEN publish_on_time_pct >= 70 THEN 'C' WHEN publish_on_time_pct >= 50 THEN 'D' ELSE 'F' END AS grade FROM trends""")
def _reliability_grade(t: Tables):
    return t.trends.select("dataset_id", "publish_on_time_pct", cadence.reliability_grade(F.col("publish_on_time_pct")).alias("grade"))


_USAGE = f"""(SELECT ts, CASE event_type WHEN 'purchase' THEN 'trust_verdict' ELSE event_type END AS tool, 'buyer_' || (user_id % 10) AS buyer_id,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 <> 0 THEN 'ds_' || lpad(CAST(user_id AS VARCHAR), CAST(greatest(5, length(CAST(user_id AS VARCHAR))) AS INTEGER), '0') END AS dataset_id,
  CASE WHEN event_type = 'purchase' AND CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS score FROM events)"""


def usage_sql(extra: str = "", prefix: str = "") -> str:
    where = f"WHERE {extra}" if extra else ""
    band = ("CASE WHEN score >= 90 THEN '90-100' WHEN score >= 75 THEN '75-89' WHEN score >= 50 THEN '50-74' "
            "WHEN score >= 25 THEN '25-49' ELSE '0-24' END")
    return f"""
SELECT {prefix}buyer_id, metric, key, count(*) AS calls FROM (
  SELECT ts, buyer_id, 'total_calls' AS metric, 'all' AS key FROM {_USAGE} UNION ALL SELECT ts, buyer_id, 'by_tool', tool FROM {_USAGE}
  UNION ALL SELECT ts, buyer_id, 'by_dataset', dataset_id FROM {_USAGE} WHERE dataset_id IS NOT NULL
  UNION ALL SELECT ts, buyer_id, 'trust_distribution', {band} FROM {_USAGE} WHERE tool = 'trust_verdict' AND score IS NOT NULL) {where} GROUP BY ALL"""


@query("usage_summary", usage_sql("ts >= DATE '2024-01-05' AND ts < DATE '2024-01-21'"))
def _usage_summary(t: Tables):
    return summary.usage_summary(t.usage, since="2024-01-05", until="2024-01-20")


@query("usage_for_buyer", usage_sql("buyer_id = 'buyer_3'"))
def _usage_for_buyer(t: Tables):
    return summary.usage_summary(t.usage, buyer_id="buyer_3")


@query("source_staleness", """
SELECT family, any_value(steward) AS steward, count(*) AS dataset_count, 60 AS threshold_days, min(staleness_days) AS minimum_staleness_days,
  max(content_freshness_date) AS latest_data_as_of
FROM (SELECT c.series_code AS family, c.steward, s.staleness_days, s.content_freshness_date, s.dataset_id
      FROM (SELECT coalesce(series_code, 'none ' || dataset_id) AS series_code, steward, dataset_id FROM cat) c LEFT JOIN bare s ON s.dataset_id = c.dataset_id)
GROUP BY family HAVING count(dataset_id) = count(*) AND min(coalesce(steward, '')) = max(coalesce(steward, ''))
  AND count(*) FILTER (WHERE staleness_days > 10) = count(*)""".replace("60 AS threshold_days", "10 AS threshold_days"))
def _source_staleness(t: Tables):
    family = F.coalesce("series_code", F.concat(F.lit("none "), F.col("dataset_id")))
    families = t.catalog.select(family.alias("family"), "dataset_id")
    return summary.source_staleness(families, t.catalog, t.bare_snapshot, threshold_days=10)


@query("family_summary", """
SELECT c.steward AS family, count(*) AS datasets, count(*) FILTER (WHERE status = 'fresh') AS fresh, count(*) FILTER (WHERE status = 'stale') AS stale,
  max(checked_at) AS last_checked, max(last_modified) AS latest_source_update FROM cat c JOIN bare s ON s.dataset_id = c.dataset_id
WHERE c.steward IS NOT NULL GROUP BY 1""")
def _family_summary(t: Tables):
    families = t.catalog.where(F.col("steward").isNotNull()).select(F.col("steward").alias("family"), "dataset_id")
    return summary.family_summary(families, t.bare_snapshot)


_METRICS = """(SELECT dataset_id, CASE WHEN n % 11 = 0 THEN 'n/a' ELSE CAST(sum(k) AS VARCHAR) END AS views, CAST(count(*) AS BIGINT) AS csv,
  CAST(count(*) FILTER (WHERE k > 50) AS BIGINT) AS parquet FROM obs GROUP BY dataset_id, n)"""
_POPULAR = f"""(SELECT dataset_id, coalesce(TRY_CAST(views AS BIGINT), 0) + csv + parquet AS engagement FROM {_METRICS}
  ORDER BY engagement DESC, dataset_id LIMIT 12)"""


def _metrics(t: Tables):
    counted = t.observations.groupBy("dataset_id", "n").agg(
        F.sum("k").alias("_views"), F.count("*").alias("download_csv"), F.count_if(F.col("k") > 50).alias("download_parquet")
    )
    views = F.when(F.col("n") % 11 == 0, "n/a").otherwise(F.col("_views").cast("string"))
    return counted.select("dataset_id", views.alias("views"), "download_csv", "download_parquet")


@query("popular_topk", f"SELECT dataset_id, engagement FROM {_POPULAR}")
def _popular_topk(t: Tables):
    return summary.popular_topk(_metrics(t), t.catalog)


@query("assign_sections", f"""
SELECT dataset_id, 'top_visited' AS section FROM {_POPULAR}
UNION ALL SELECT dataset_id, 'reference' FROM cat WHERE data_type = 'reference'
UNION ALL SELECT dataset_id, CASE WHEN n % 5 = 1 THEN 'Source 1' WHEN n % 12 = 2 THEN 'Steward 2' ELSE 'other_government_open_data' END
  FROM cat WHERE data_type <> 'reference' AND dataset_id NOT IN (SELECT dataset_id FROM {_POPULAR})""")
def _assign_sections(t: Tables):
    by_source = t.catalog.where(F.col("n") % 5 == 1).select(F.lit("Source 1").alias("section"), F.lit(1).alias("priority"), "dataset_id")
    by_steward = t.catalog.where(F.col("n") % 12 == 2).select(F.lit("Steward 2").alias("section"), F.lit(2).alias("priority"), "dataset_id")
    return summary.assign_sections(t.catalog, by_source.unionByName(by_steward), summary.popular_topk(_metrics(t), t.catalog))


@query("with_lookups", """
SELECT l_orderkey, l_linenumber, l_quantity, p_name, p_brand, s_name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def _with_lookups(t: Tables):
    fact = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("premise"))
    item = t.read("part").select(F.col("p_partkey").alias("item"), "p_name", "p_brand")
    premise = t.read("supplier").select(F.col("s_suppkey").alias("premise"), "s_name")
    return summary.with_lookups(fact, item, premise, item_key="item", premise_key="premise").drop("item", "premise")


@query("sanitise_args", """
SELECT doc_id, 'text' AS key, substr(text, 1, 200) AS value FROM documents UNION ALL SELECT doc_id, 'api_key', '[REDACTED]' FROM documents
UNION ALL SELECT doc_id, 'lang', lang FROM documents""")
def _sanitise_args(t: Tables):
    args = F.create_map(F.lit("text"), F.col("text"), F.lit("api_key"), F.col("source"), F.lit("lang"), F.col("lang"))
    return t.read("documents").select("doc_id", F.explode(text.sanitise_args(args)))
