"""The ranked query surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablehealth import params
from tablehealth.operators import profile, ranked
from tablehealth.plans.bindings import AS_OF, Tables
from tablehealth.plans.oracle import NOW, in_list
from tablehealth.plans.registry import query
from tablehealth.sources import exports


def _occurrences(column: str, term: str) -> str:
    return f"((length({column}) - length(replace({column}, '{term}', ''))) // {len(term)})"


_TERMS = ("state", "series", "3")
_SCORE = " + ".join(f"5 * {_occurrences('lower(name)', t)} + {_occurrences('lower(description)', t)}" for t in _TERMS)


@query("search_datasets", f"""
SELECT c.dataset_id, name AS title, source, licence, coalesce(s.status, 'unknown') AS status, CAST(score AS BIGINT) AS score
FROM (SELECT *, {_SCORE} + CASE WHEN lower(name) = 'state series 3' THEN 100 WHEN contains(lower(name), 'state series 3') THEN 15 ELSE 0 END AS score
      FROM cat WHERE lower(licence) = lower('{params.CC_BY_4}') OR true) c LEFT JOIN bare s ON s.dataset_id = c.dataset_id
WHERE score <> 0 AND c.licence = '{params.OGL}' ORDER BY score DESC, title, c.dataset_id LIMIT 20""")
def _search_datasets(t: Tables):
    return ranked.search_datasets(t.catalog, t.bare_snapshot, query="State  series 3", licence="OGL", limit=20)


# the whole product table as a catalogue: p_name as the title
@query("search_parts", f"""
SELECT 'part_' || p_partkey AS dataset_id, p_name AS title, p_brand AS source, p_type AS licence, 'unknown' AS status,
  CAST(5 * {_occurrences('lower(p_name)', 'red')} + 5 * {_occurrences('lower(p_name)', 'ring')}
    + CASE WHEN lower(p_name) = 'red ring' THEN 100 WHEN contains(lower(p_name), 'red ring') THEN 15 ELSE 0 END AS BIGINT) AS score
FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'ring')
ORDER BY score DESC, title, dataset_id LIMIT 50""")
def _search_parts(t: Tables):
    parts = t.read("part").select(
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("dataset_id"), F.col("p_name").alias("name"),
        F.lit(None).cast("string").alias("description"), F.col("p_brand").alias("source"), F.col("p_type").alias("licence"),
    )
    return ranked.search_datasets(parts, t.bare_snapshot, query="red ring", limit=50)


@query("find_stale", f"""
SELECT c.dataset_id, coalesce(s.status, 'unknown') AS status, CASE WHEN s.dataset_id IS NULL THEN 'Missing from latest health snapshot' ELSE s.message END AS message,
  7200 AS age_seconds, s.staleness_days, coalesce(s.access_dependency, 'direct') AS access_dependency,
  coalesce(s.expected_record_count, c.expected_record_count) AS expected_record_count
FROM cat c LEFT JOIN (SELECT * FROM bare WHERE status <> 'unreachable') s ON s.dataset_id = c.dataset_id
WHERE s.dataset_id IS NULL OR s.status IN ('aging', 'stale', 'degraded')""")
def _find_stale(t: Tables):
    health = t.bare_snapshot.where(F.col("status") != "unreachable")
    return ranked.find_stale(t.catalog, health, as_of="2024-01-31 01:59:59")


@query("find_stale_old_snapshot", """
SELECT c.dataset_id, s.status, CASE WHEN s.status IN ('aging', 'stale', 'degraded') THEN s.message
    ELSE 'Latest health snapshot is older than the requested maximum age' END AS message,
  2 * 86400 AS age_seconds, s.staleness_days, s.access_dependency, s.expected_record_count
FROM cat c JOIN bare s ON s.dataset_id = c.dataset_id WHERE s.status <> 'reference'""")
def _find_stale_old_snapshot(t: Tables):
    return ranked.find_stale(t.catalog, t.bare_snapshot, as_of="2024-02-01 23:59:59", max_age_hours=24)


_ANOMALIES = """
SELECT c.dataset_id, c.name AS title, a.status, a.staleness_days, a.mode, a.latest_days, a.threshold_days,
  CASE WHEN a.threshold_days > 0 THEN a.latest_days / a.threshold_days ELSE 0.0 END AS severity_ratio,
  t.publish_on_time_pct, t.reliability_grade, t.reliability_sample_days
FROM cat c JOIN anom a ON a.dataset_id = c.dataset_id LEFT JOIN trends t ON t.dataset_id = c.dataset_id WHERE a.anomaly_detected"""
_ANOMALY_ORDER = "ORDER BY severity_ratio DESC, staleness_days DESC NULLS LAST, dataset_id LIMIT 50"


@query("find_anomalies", f"{_ANOMALIES} {_ANOMALY_ORDER}")
def _find_anomalies(t: Tables):
    return ranked.find_anomalies(t.catalog, t.snapshot, t.trends).drop("anomaly_detection")


@query("find_anomalies_reliable", f"{_ANOMALIES} AND a.mode = 'rolling_14d' AND t.reliability_grade IN ('A', 'B', 'C', 'D') {_ANOMALY_ORDER}")
def _find_anomalies_reliable(t: Tables):
    return ranked.find_anomalies(t.catalog, t.snapshot, t.trends, mode="rolling_14d", min_reliability="d").drop("anomaly_detection")


_TREND_SELECT = "SELECT dataset_id, name AS title, " + ", ".join(ranked._TREND_COLUMNS[2:]) + " FROM trends"


@query("find_deteriorating", f"""{_TREND_SELECT} WHERE trend = 'deteriorating'
ORDER BY slope_days_per_week DESC, coalesce(anomaly_rate_pct, -1) DESC, coalesce(publish_on_time_pct, 101), dataset_id LIMIT 50""")
def _find_deteriorating(t: Tables):
    return ranked.find_deteriorating(t.catalog, t.trends)


@query("find_deteriorating_anomalous", f"""{_TREND_SELECT} WHERE trend = 'deteriorating' AND anomaly_rate_pct >= 10
ORDER BY slope_days_per_week DESC, coalesce(anomaly_rate_pct, -1) DESC, coalesce(publish_on_time_pct, 101), dataset_id LIMIT 200""")
def _find_deteriorating_anomalous(t: Tables):
    return ranked.find_deteriorating(t.catalog, t.trends, min_anomaly_rate=10.0, limit=200)


@query("find_recovering", f"{_TREND_SELECT} WHERE trend = 'recovering' ORDER BY slope_days_per_week, dataset_id LIMIT 50")
def _find_recovering(t: Tables):
    return ranked.find_recovering(t.catalog, t.trends)


@query("find_unreliable", """
SELECT dataset_id, name AS title, reliability_grade, publish_on_time_pct, reliability_sample_days, latest_status, trend, reason FROM trends
WHERE reliability_grade IN ('D', 'F') ORDER BY reliability_grade DESC, publish_on_time_pct, dataset_id LIMIT 100""")
def _find_unreliable(t: Tables):
    return ranked.find_unreliable(t.catalog, t.trends, limit=100, at_or_below_grade="D")


@query("find_schema_drift", """
SELECT dataset_id, name AS title, verdict, shape_changed_recently, shape_change_count, last_shape_change_at, column_count_changed,
  column_change_count, record_trend, record_change_pct, record_count, column_count, expected_record_count, record_count_within_tolerance, reason
FROM drifts WHERE verdict IN ('drift_detected', 'record_count_drift')
ORDER BY verdict = 'drift_detected' DESC, greatest(shape_change_count, column_change_count) DESC, dataset_id LIMIT 200""")
def _find_schema_drift(t: Tables):
    return ranked.find_schema_drift(t.catalog, t.drifts, limit=200)


@query("check_reconciliation", """
SELECT q.query, c.dataset_id AS matched_dataset_id, c.name AS dataset_name, m.group_key, g.logical_name,
  coalesce(g.verdict, 'single_source') AS verdict, g.member_count
FROM (SELECT dataset_id AS query, dataset_id FROM cat WHERE data_type = 'reference'
      UNION ALL SELECT upper(name), dataset_id FROM cat WHERE discontinued) q
JOIN cat c ON c.dataset_id = q.dataset_id LEFT JOIN members m ON m.dataset_id = c.dataset_id LEFT JOIN groups g ON g.group_key = m.group_key""")
def _check_reconciliation(t: Tables):
    s = t.stored
    by_id = s.catalog.where(F.col("data_type") == "reference").select(F.col("dataset_id").alias("query"))
    by_name = s.catalog.where("discontinued").select(F.upper("name").alias("query"))
    return ranked.check_reconciliation(s.catalog, s.group_members, s.groups, names=by_id.unionByName(by_name)).drop("reason")


@query("paginate", """
SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, '150' AS next_cursor FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100""")
def _paginate(t: Tables):
    return ranked.paginate(t.read("orders").select("o_orderkey", "o_totalprice"), order=["o_orderkey"], limit=50, cursor=100)


@query("dataset_index", "SELECT c.dataset_id, s.status, c.name AS title, c.source, c.licence, c.namespace FROM cat c JOIN bare s ON s.dataset_id = c.dataset_id")
def _dataset_index(t: Tables):
    return ranked.dataset_index(t.catalog, t.bare_snapshot)


@query("find_by_licence", f"""
SELECT c.licence, c.dataset_id, c.name AS title, c.source, s.status FROM cat c JOIN bare s ON s.dataset_id = c.dataset_id WHERE c.licence = '{params.CC_BY_4}'""")
def _find_by_licence(t: Tables):
    return ranked.find_by_licence(t.catalog, t.bare_snapshot, licence="  CC by 4.0 ")


_RECEIPT = (
    "last_checked", "http_status", "request_url", "access_dependency", "access_method", "freshness_signal",
    "freshness_signal_source", "last_modified", "content_freshness_date", "record_count", "record_count_estimated",
    "first_row_hash", "content_shape_changed", "column_count", "expected_record_count", "record_count_within_tolerance",
    "staleness_days", "status", "anomaly_detected", "message",
)


@query("get_evidence", f"""
SELECT c.dataset_id, s.dataset_id IS NOT NULL AS evidence_available, {', '.join('s.' + c for c in _RECEIPT)}, s.mode AS anomaly_mode
FROM cat c LEFT JOIN (SELECT * FROM snap WHERE status <> 'stale') s ON s.dataset_id = c.dataset_id""")
def _get_evidence(t: Tables):
    rows = ranked.get_evidence(t.catalog, t.snapshot.where(F.col("status") != "stale"))
    return rows.withColumn("anomaly_mode", F.col("anomaly_detection.mode")).drop("anomaly_detection")


@query("project_evidence", f"SELECT dataset_id, {', '.join(params.COMPACT_EVIDENCE_FIELDS)} FROM snap")
def _project_evidence(t: Tables):
    return ranked.project_evidence(t.snapshot, compact=True)


@query("get_provenance", f"""
SELECT c.dataset_id, c.steward, c.source, c.licence, CASE c.licence WHEN '{params.CC_BY_4}' THEN '{params.LICENCE_URLS[params.CC_BY_4]}' ELSE '{params.LICENCE_URLS[params.OGL]}' END AS licence_url,
  c.url, s.access_method, s.last_checked AS last_verified, s.record_count, s.status, true AS evidence_available
FROM cat c JOIN snap s ON s.dataset_id = c.dataset_id WHERE c.data_type = 'reference'""")
def _get_provenance(t: Tables):
    ids = t.catalog.where(F.col("data_type") == "reference").select("dataset_id")
    rows = ranked.get_provenance(t.catalog, t.snapshot, ids=ids)
    return rows.withColumns({"record_count": F.col("evidence.record_count"), "status": F.col("evidence.status")}).drop("evidence")


@query("get_dataset", """
SELECT c.dataset_id, c.name, c.source, c.steward, c.licence, c.url, c.refresh_frequency, coalesce(s.status, 'unknown') AS status,
  CASE WHEN s.dataset_id IS NULL THEN 'Missing from latest health snapshot' ELSE s.message END AS message, s.staleness_days,
  coalesce(s.access_dependency, 'direct') AS access_dependency, c.expected_record_count, s.content_freshness_date,
  coalesce(s.freshness_signal_source, 'none') AS freshness_signal_source, s.record_count, s.column_count, s.last_checked, s.checked_at AS last_verified
FROM cat c LEFT JOIN (SELECT * FROM bare WHERE status <> 'stale') s ON s.dataset_id = c.dataset_id""".replace("s.last_checked, ", ""))
def _get_dataset(t: Tables):
    return ranked.get_dataset(t.catalog, t.bare_snapshot.where(F.col("status") != "stale"))


@query("usability_gate", f"""
SELECT dataset_id, status, last_checked, staleness_days, status IN {in_list(params.USABLE_STATUSES)} AS usable, status IN {in_list(params.BLOCKED_STATUSES)} AS blocked FROM bare""")
def _usability_gate(t: Tables):
    return ranked.usability_gate(t.bare_snapshot)


@query("latest_usable", """
SELECT dataset_id, status, last_checked, staleness_days, true AS usable, false AS blocked FROM bare WHERE status IN ('fresh', 'aging') ORDER BY last_checked DESC, dataset_id LIMIT 10""")
def _latest_usable(t: Tables):
    return ranked.latest_usable(t.bare_snapshot)


@query("oldest_stale", """
SELECT dataset_id, staleness_days, last_checked FROM bare WHERE status = 'stale' ORDER BY staleness_days DESC, dataset_id DESC LIMIT 1""")
def _oldest_stale(t: Tables):
    return ranked.oldest_stale(t.bare_snapshot)


_NOTE = "'The underlying probe has not produced this measurement.'"


@query("standard_checks", f"""
SELECT c.dataset_id, k.check, CASE k.check
    WHEN 'file_reachable' THEN CASE WHEN coalesce(s.http_status BETWEEN 200 AND 399, false) THEN 'pass' WHEN s.status = 'unreachable' THEN 'fail' ELSE 'warn' END
    WHEN 'row_count' THEN CASE WHEN s.record_count IS NOT NULL THEN 'pass' ELSE 'warn' END
    WHEN 'freshness' THEN CASE s.status WHEN 'fresh' THEN 'pass' WHEN 'stale' THEN 'fail' ELSE 'warn' END
    ELSE CASE WHEN s.content_shape_changed THEN 'fail' WHEN s.column_count IS NOT NULL THEN 'pass' ELSE 'warn' END END AS result,
  CASE k.check
    WHEN 'file_reachable' THEN CASE WHEN coalesce(s.http_status BETWEEN 200 AND 399, false) THEN 'Probe received HTTP ' || s.http_status || ' via ' || s.access_method ELSE coalesce(s.message, {_NOTE}) END
    WHEN 'row_count' THEN CASE WHEN s.record_count IS NOT NULL THEN 'Probe measured ' || s.record_count || ' record(s)' ELSE {_NOTE} END
    WHEN 'freshness' THEN 'Health snapshot classifies the dataset as ' || s.status
    ELSE CASE WHEN s.content_shape_changed THEN 'Probe detected a content-shape change' ELSE 'Probe observed ' || s.column_count || ' column(s) with no content-shape change' END END AS method
FROM cat c JOIN bare s ON s.dataset_id = c.dataset_id, (SELECT unnest(['file_reachable', 'row_count', 'freshness', 'schema_stable']) AS "check") k""")
def _standard_checks(t: Tables):
    return ranked.standard_checks(t.catalog, t.bare_snapshot)


@query("compare_receipts", """
SELECT dataset_id, CASE WHEN ok_live THEN su = request_url END AS request_url_match, CASE WHEN ok_live THEN lh = http_status END AS http_status_match,
  CASE WHEN ok_live AND (last_modified IS NOT NULL OR lm IS NOT NULL) THEN last_modified IS NOT DISTINCT FROM lm END AS last_modified_match,
  CASE WHEN ok_live THEN ll = content_length END AS content_length_match,
  CASE WHEN browser THEN 'not_verifiable' WHEN lh IS NULL OR lh NOT BETWEEN 200 AND 299 THEN 'unreachable'
    WHEN su <> request_url OR coalesce(lh <> http_status, false) OR last_modified IS DISTINCT FROM lm OR coalesce(ll <> content_length, false) THEN 'mismatch' ELSE 'match' END AS verdict
FROM (SELECT b.*, c.url AS su, c.source AS src, v.http_status AS lh, v.last_modified AS lm, v.content_length AS ll, b.access_method = 'Camofox' AS browser0,
        v.http_status IS NOT NULL AND b.access_method <> 'Camofox' AS ok_live
      FROM (SELECT * EXCLUDE (browser), access_method = 'Camofox' AS browser FROM prev) b JOIN cat c ON c.dataset_id = b.dataset_id LEFT JOIN probes_now v ON v.dataset_id = b.dataset_id)""")
def _compare_receipts(t: Tables):
    recorded = t.previous.select(
        "dataset_id", "request_url", "http_status", "last_modified", "content_length", "access_dependency", "access_method"
    ).join(t.catalog.select("dataset_id", F.col("url").alias("source_url"), "source"), "dataset_id")
    return ranked.compare_receipts(recorded, t.probes_at(AS_OF)).drop("mismatched_fields")


_HOSTS = "(SELECT DISTINCT regexp_extract(url, '^([A-Za-z]+://[^/]+)', 1) AS origin FROM pages)"


@query("robots_block_filter", f"""
SELECT page_id, url, coalesce(blocked, false) AS blocked FROM pages LEFT JOIN (
  SELECT origin, CASE length(origin) % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS blocked FROM {_HOSTS})
ON origin = regexp_extract(url, '^([A-Za-z]+://[^/]+)', 1)""")
def _robots_block_filter(t: Tables):
    origins = t.read("pages").select(profile.url_origin(F.col("url")).alias("origin")).distinct()
    bodies = {
        0: "User-agent: *\r\nDisallow: / # everything\n",
        1: "User-agent: *\nDisallow: /private\nUser-agent: other\nDisallow: /\n",
        2: "# note\nuser-AGENT : ProbeBot\nAllow: /x\ndisallow:/\n",
        3: "User-agent: ProbeBot\nUser-agent: other\nDisallow: /\n",
    }
    body = ranked.cadence.lookup(F.length("origin") % 5, bodies, F.lit(""))
    robots = origins.select("origin", body.alias("body"))
    return profile.robots_block_filter(t.read("pages").select("page_id", "url"), robots, user_agent="ProbeBot/1.0 (+https://example.org)")


_SITE = "https://health.example.org"


@query("to_jsonld", f"""
SELECT c.dataset_id, '{_SITE}/data/' || c.dataset_id || '.md' AS id, c.url AS same_as, coalesce(s.status, 'unknown') AS freshness,
  CAST(s.record_count AS VARCHAR) AS records, '2024-01-30' AS modified,
  'Malaysian public dataset: ' || c.name || '. Steward: ' || coalesce(c.steward, 'unknown') || '. Source: ' || coalesce(c.source, 'unknown') || '.' AS description
FROM cat c JOIN bare s ON s.dataset_id = c.dataset_id""")
def _to_jsonld(t: Tables):
    documents = exports.to_jsonld(t.catalog, t.bare_snapshot, base_url=_SITE, publisher="tablehealth")
    paths = {
        "id": "$['@id']", "same_as": "$.sameAs", "freshness": "$.variableMeasured[0].value", "records": "$.variableMeasured[1].value",
        "modified": "$.dateModified", "description": "$.description",
    }
    return documents.select("dataset_id", *[F.get_json_object("document", path).alias(name) for name, path in paths.items()])


@query("to_feed_rows", f"""
SELECT dataset_id, '[' || st || '] ' || name AS title, '{_SITE}/data/' || dataset_id || '.md' AS link,
  name || ': ' || st || '. ' || coalesce(message, 'No health data available') AS description, checked_at AS published_at
FROM (SELECT c.dataset_id, c.name, CASE WHEN s.status = 'discontinued' OR s.status IS NULL THEN 'unknown' ELSE s.status END AS st, s.message, s.checked_at
      FROM cat c LEFT JOIN (SELECT * FROM bare WHERE status <> 'stale') s ON s.dataset_id = c.dataset_id)""")
def _to_feed_rows(t: Tables):
    return exports.to_feed_rows(t.catalog, t.bare_snapshot.where(F.col("status") != "stale"), base_url=_SITE)
