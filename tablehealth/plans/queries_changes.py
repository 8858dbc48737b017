"""Change detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablehealth import params
from tablehealth.operators import changes, snapshot
from tablehealth.plans.bindings import AS_OF, Tables
from tablehealth.plans.oracle import NOW, TABLES, case_of
from tablehealth.plans.registry import query

# a cycle that exists in the history, with the catalogue of datasets that are still published
_CYCLE = "2024-01-25T12:00"

TABLES["lastcycle"] = f"SELECT max(cycle) AS c FROM obs WHERE cycle <= '{_CYCLE}'"
TABLES["hist"] = "SELECT o.* FROM obs o"
TABLES["base"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY cycle DESC, observed_at DESC, seq) AS rn FROM obs
  WHERE cycle < '{_CYCLE}' AND probe_outcome = 'success') WHERE rn = 1"""
TABLES["prevcycle"] = f"SELECT DISTINCT dataset_id FROM obs WHERE cycle = (SELECT max(cycle) FROM obs WHERE cycle < '{_CYCLE}')"
TABLES["shortcat"] = "SELECT * FROM cat WHERE NOT discontinued"
TABLES["compared"] = """
SELECT c.dataset_id, c.name, c.url AS new_url, b.cycle, b.status AS old_status, b.anomaly_detected AS old_flag, b.url AS old_url,
  b.shape_hash, b.record_count AS old_count, b.record_count_estimated AS old_estimated, s.status, a.anomaly_detected, s.first_row_hash,
  s.record_count, s.record_count_estimated, s.content_shape_changed, s.freshness_signal_source
FROM shortcat c JOIN base b ON b.dataset_id = c.dataset_id JOIN bare s ON s.dataset_id = c.dataset_id
JOIN anom a ON a.dataset_id = c.dataset_id"""

DELTAS_SQL = """
SELECT * FROM (
SELECT 'added' AS change_type, c.dataset_id, c.name, CAST(NULL AS VARCHAR) AS from_cycle, CAST(NULL AS VARCHAR) AS from_value,
  coalesce(s.status, 'unknown') AS to_value, c.url AS detail
FROM shortcat c LEFT JOIN bare s ON s.dataset_id = c.dataset_id WHERE c.dataset_id NOT IN (SELECT dataset_id FROM prevcycle)
UNION ALL SELECT 'removed', b.dataset_id, b.name, b.cycle, b.status, NULL, NULL FROM base b
  WHERE b.dataset_id IN (SELECT dataset_id FROM prevcycle) AND b.dataset_id NOT IN (SELECT dataset_id FROM shortcat)
UNION ALL SELECT 'status_changed', dataset_id, name, cycle, old_status, status,
  CASE WHEN content_shape_changed THEN 'content-shape-changed' ELSE freshness_signal_source END FROM compared WHERE old_status <> status
UNION ALL SELECT 'anomaly_changed', dataset_id, name, cycle, CAST(old_flag AS VARCHAR), CAST(anomaly_detected AS VARCHAR), 'freshness_delta_days'
  FROM compared WHERE old_flag IS NOT NULL AND old_flag <> anomaly_detected
UNION ALL SELECT 'url_changed', dataset_id, name, cycle, old_url, new_url, NULL FROM compared WHERE old_url <> new_url
UNION ALL SELECT 'schema_changed', dataset_id, name, cycle, shape_hash, first_row_hash, NULL FROM compared WHERE shape_hash <> first_row_hash
UNION ALL SELECT 'record_count_changed', dataset_id, name, cycle, CAST(old_count AS VARCHAR), CAST(record_count AS VARCHAR),
  CAST(record_count - old_count AS VARCHAR) FROM compared WHERE old_count <> record_count AND NOT old_estimated AND NOT record_count_estimated)"""


def _history_with_cycle(t: Tables):
    """The history, with one observation renamed to the ledger's cycle so that the cycle exists."""
    first = t.history.where(F.col("cycle") >= _CYCLE)
    marker = first.agg(F.min("seq").alias("_seq"))
    moved = first.join(F.broadcast(marker), F.col("seq") == F.col("_seq"), "left_semi").withColumn("cycle", F.lit(_CYCLE))
    return t.history.unionByName(moved)


def _ledger(t: Tables):
    catalog = t.stored.catalog.where(~F.col("discontinued"))
    return changes.dataset_deltas(catalog, t.stored.snapshot, _history_with_cycle(t), cycle=_CYCLE)


@query("dataset_deltas", DELTAS_SQL)
def _dataset_deltas(t: Tables):
    return _ledger(t)


@query("delta_summary", "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE change_type = '{k}') AS {k}" for k in (
        "added", "removed", "status_changed", "anomaly_changed", "url_changed", "schema_changed", "record_count_changed")
) + f" FROM ({DELTAS_SQL.strip()})")
def _delta_summary(t: Tables):
    return changes.delta_summary(_ledger(t))


@query("delta_range", "SELECT cycle, min(observed_at) AS observed_at FROM obs WHERE cycle BETWEEN '2024-01-10T00:00' AND '2024-01-20T12:00' GROUP BY cycle")
def _delta_range(t: Tables):
    return changes.delta_range(t.history.select("cycle", "observed_at"), since="2024-01-10T00:00", until="2024-01-20T12:00")


@query("weekly_changes", """
SELECT category, dataset_id, old_status, new_status, old_record_count, new_record_count, old_column_count, new_column_count, last_checked FROM (
  SELECT b.dataset_id, p.status AS old_status, b.status AS new_status, p.record_count AS old_record_count, b.record_count AS new_record_count,
    p.column_count AS old_column_count, b.column_count AS new_column_count, b.last_checked, p.dataset_id IS NOT NULL AS known,
    p.content_shape_changed AS old_shape, b.content_shape_changed AS new_shape,
    unnest(['new_break', 'recovered', 'schema_change', 'newly_probed']) AS category
  FROM bare b LEFT JOIN (SELECT * FROM prev WHERE access_dependency = 'direct') p ON p.dataset_id = b.dataset_id)
WHERE CASE category
  WHEN 'new_break' THEN known AND ((old_status = 'fresh' AND new_status = 'stale') OR (old_status = 'stale' AND new_status = 'unreachable'))
  WHEN 'recovered' THEN known AND old_status <> 'fresh' AND new_status = 'fresh'
  WHEN 'schema_change' THEN known AND (old_record_count IS DISTINCT FROM new_record_count OR old_column_count IS DISTINCT FROM new_column_count OR old_shape <> new_shape)
  ELSE NOT known END
UNION ALL SELECT 'added', c.dataset_id, NULL, s.status, NULL, s.record_count, NULL, s.column_count, s.last_checked FROM cat c
  LEFT JOIN bare s ON s.dataset_id = c.dataset_id WHERE c.n % 9 = 4""")
def _weekly_changes(t: Tables):
    before = t.previous.where(F.col("access_dependency") == "direct")
    return changes.weekly_changes(before, t.bare_snapshot, old_catalog=t.catalog.where(F.col("n") % 9 != 4), catalog=t.catalog)


_ADAPTERS = {0: "direct", 1: "gtfs-static", 2: "gtfs-realtime", 3: "weather", 4: "browser"}


TABLES["sides"] = f"""
SELECT p.dataset_id, c.real_status, p.status AS a, s.status AS b, p.last_checked AS checked_a, s.last_checked AS checked_b,
  p.staleness_days AS age_a, s.staleness_days AS age_b, p.content_freshness_date AS date_a, s.content_freshness_date AS date_b,
  p.record_count AS count_a, s.record_count AS count_b, p.column_count AS cols_a, s.column_count AS cols_b,
  {case_of('c.n % 5', _ADAPTERS)} AS adapter, {case_of('c.n % 5', {k: params.COUNT_THRESHOLDS[v] for k, v in _ADAPTERS.items()})} AS t
FROM prev p JOIN bare s ON s.dataset_id = p.dataset_id JOIN cat c ON c.dataset_id = p.dataset_id
WHERE p.status <> 'unknown-freshness' AND s.http_status IS NOT NULL"""


_RULE_ROWS = ", ".join("('{}', '{}', '{}')".format(code, kind, why.replace("'", "''")) for code, (kind, why) in changes.RULES.items())


@query("compare_snapshots", f"""
SELECT r.classification, CASE field WHEN 'dataset_id' THEN 'ID set' WHEN 'status' THEN 'Status flip' WHEN 'column_count' THEN 'Schema'
    WHEN 'record_count' THEN CASE f.code WHEN 'count-lively' THEN 'Volatile' WHEN 'count-lost' THEN 'Field' ELSE CASE WHEN adapter = 'gtfs-realtime' THEN 'Operational' ELSE 'Structural' END END
    ELSE 'Field' END AS category, f.dataset_id, f.field, f.before, f.after, r.reason FROM (
  SELECT 'id-missing' AS code, dataset_id, 'dataset_id' AS field, 'present' AS before, 'absent' AS after, NULL AS adapter FROM cat WHERE dataset_id NOT IN (SELECT dataset_id FROM bare WHERE http_status IS NOT NULL)
  UNION ALL SELECT 'id-new', dataset_id, 'dataset_id', 'absent', 'present', NULL FROM bare WHERE http_status IS NOT NULL
    AND dataset_id NOT IN (SELECT dataset_id FROM prev WHERE status <> 'unknown-freshness')
  UNION ALL SELECT CASE
      WHEN real_status = 'discontinued' AND b IN ('degraded', 'unreachable') THEN 'status-ended'
      WHEN (a = 'fresh' AND b = 'aging') OR (a = 'aging' AND b = 'fresh') THEN 'status-window'
      WHEN a IN ('stale', 'degraded', 'unreachable', 'unknown-freshness') AND b IN ('fresh', 'aging', 'stale') THEN 'status-revived'
      WHEN a = 'aging' AND b = 'stale' THEN 'status-aged'
      WHEN a = 'fresh' AND b = 'stale' AND checked_b > checked_a AND age_b > age_a THEN 'status-aged-at-once'
      WHEN a = 'fresh' AND b = 'stale' THEN 'status-unexplained' WHEN a = 'unknown' THEN 'status-first' ELSE 'status-other' END,
      dataset_id, 'status', a, b, adapter FROM sides WHERE a IS DISTINCT FROM b
  UNION ALL SELECT CASE WHEN checked_a IS NULL THEN 'check-first' WHEN checked_b IS NULL THEN 'check-lost' WHEN checked_b < checked_a THEN 'check-earlier' ELSE 'check-later' END,
      dataset_id, 'last_checked', '', '', adapter FROM sides WHERE checked_a IS DISTINCT FROM checked_b
  UNION ALL SELECT CASE WHEN age_a IS NULL THEN 'age-first' WHEN age_b IS NULL THEN 'age-lost' ELSE 'age-moved' END,
      dataset_id, 'freshness_days', '', '', adapter FROM sides WHERE age_a IS DISTINCT FROM age_b
  UNION ALL SELECT CASE WHEN date_a IS NULL THEN 'date-first' WHEN date_b IS NULL THEN 'date-lost' WHEN date_b < date_a THEN 'date-earlier' ELSE 'date-later' END,
      dataset_id, 'content_freshness_date', CAST(date_a AS VARCHAR), CAST(date_b AS VARCHAR), adapter FROM sides WHERE date_a IS DISTINCT FROM date_b
  UNION ALL SELECT CASE WHEN coalesce(count_b, 0) = 0 AND real_status = 'discontinued' THEN 'count-ended' WHEN count_a IS NULL THEN 'count-first' WHEN count_b IS NULL THEN 'count-lost'
      WHEN count_a = 0 OR abs(count_b - count_a) / CAST(abs(count_a) AS DOUBLE) >= CAST(t AS DOUBLE) THEN CASE WHEN adapter = 'gtfs-realtime' AND count_b = 0 THEN 'count-stalled' ELSE 'count-jumped' END
      WHEN adapter = 'gtfs-realtime' AND abs(count_b - count_a) / CAST(abs(count_a) AS DOUBLE) >= CAST(0.1 AS DOUBLE) THEN 'count-lively' ELSE 'count-within' END,
      dataset_id, 'record_count', CAST(count_a AS VARCHAR), CAST(count_b AS VARCHAR), adapter FROM sides WHERE count_a IS DISTINCT FROM count_b
  UNION ALL SELECT 'columns', dataset_id, 'column_count', CAST(cols_a AS VARCHAR), CAST(cols_b AS VARCHAR), adapter FROM sides WHERE cols_a IS DISTINCT FROM cols_b) f
JOIN (VALUES {_RULE_ROWS}) r(code, classification, reason) ON r.code = f.code""")
def _compare_snapshots(t: Tables):
    adapters = t.catalog.select("dataset_id", changes.lookup(F.col("n") % 5, _ADAPTERS).alias("adapter"))
    live = t.previous.where(F.col("status") != "unknown-freshness")
    candidate = t.bare_snapshot.where(F.col("http_status").isNotNull())
    found = changes.compare_snapshots(live, candidate, t.catalog, adapters=adapters)
    # the text forms of an instant and of a fractional age differ between Spark and SQL
    spelt = F.col("field").isin("last_checked", "freshness_days")
    return found.withColumns({name: F.when(spelt, "").otherwise(F.col(name)) for name in ("before", "after")})


@query("status_delta", """
SELECT status, CAST(sum(a) AS BIGINT) AS live, CAST(sum(b) AS BIGINT) AS candidate, CAST(sum(b) - sum(a) AS BIGINT) AS delta
FROM (SELECT status, 1 AS a, 0 AS b FROM prev UNION ALL SELECT status, 0, 1 FROM bare) GROUP BY status""")
def _status_delta(t: Tables):
    return changes.status_delta(t.previous, t.bare_snapshot)


_SOURCES = ["catalogue", "health", "export"]


@query("multi_source_consistency", """
SELECT dataset_id, finding, CASE finding WHEN 'missing' THEN concat_ws(', ', CASE WHEN a IS NULL THEN 'catalogue' END, CASE WHEN b IS NULL THEN 'health' END, CASE WHEN x IS NULL THEN 'export' END)
  ELSE concat_ws(', ', 'catalogue=' || a, 'health=' || b, 'export=' || x) END AS detail
FROM (SELECT *, unnest(['missing', 'mismatch']) AS finding FROM (SELECT c.dataset_id, c.url AS a, s.url AS b, CASE WHEN c.n % 6 = 1 THEN NULL ELSE c.url END AS x
      FROM cat c LEFT JOIN (SELECT * FROM bare WHERE status <> 'stale') s ON s.dataset_id = c.dataset_id))
WHERE CASE finding WHEN 'missing' THEN b IS NULL OR x IS NULL ELSE coalesce(b <> a, false) OR coalesce(b <> x, false) END""")
def _multi_source_consistency(t: Tables):
    values = (
        t.catalog.select("dataset_id", F.lit("catalogue").alias("source"), F.col("url").alias("value"))
        .unionByName(t.bare_snapshot.where(F.col("status") != "stale").select("dataset_id", F.lit("health").alias("source"), F.col("url").alias("value")))
        .unionByName(t.catalog.select("dataset_id", F.lit("export").alias("source"), F.when(F.col("n") % 6 == 1, "").otherwise(F.col("url")).alias("value")))
    )
    return changes.multi_source_consistency(values, _SOURCES)


@query("cadence_findings", """
SELECT c.dataset_id, c.refresh_frequency, CAST(s.staleness_days AS DOUBLE) AS staleness_days, f.finding
FROM cat c LEFT JOIN bare s ON s.dataset_id = c.dataset_id, (SELECT unnest(['unsupported_frequency', 'late']) AS finding) f
WHERE CASE f.finding WHEN 'late' THEN s.staleness_days > 2 * CASE c.refresh_frequency WHEN '30 seconds' THEN 0.001 WHEN 'hourly' THEN 1 / 24.0 WHEN 'daily' THEN 1
    WHEN 'weekly' THEN 7 WHEN 'monthly' THEN 30 WHEN 'quarterly' THEN 90 WHEN 'annual' THEN 365 END
  ELSE c.refresh_frequency LIKE 'daily (%' END""")
def _cadence_findings(t: Tables):
    return changes.cadence_findings(t.catalog, t.bare_snapshot)


_POLICY_SQL = f"""
SELECT dataset_id, old_status, new_status, old_status IS DISTINCT FROM new_status AS status_changed, new_reason FROM (
SELECT dataset_id, status AS old_status, CASE
    WHEN access_method = 'Camofox' THEN 'browser-dependent' WHEN status = 'unreachable' OR http_status NOT BETWEEN 200 AND 299 THEN 'unreachable'
    WHEN data_type = 'reference' THEN 'reference' WHEN status = 'degraded' THEN 'degraded' WHEN last_checked IS NULL THEN 'unknown'
    WHEN last_checked > {NOW} THEN 'degraded' WHEN f LIKE 'biennial%' THEN 'fresh' WHEN f = 'as-required' THEN 'unknown-freshness'
    WHEN sig IS NULL THEN 'unknown-freshness' WHEN age <= base * 1.5 THEN 'fresh' WHEN age <= base * 3 THEN 'aging' ELSE 'stale' END AS new_status,
  CASE
    WHEN access_method = 'Camofox' THEN 'browser-access-required' WHEN status = 'unreachable' OR http_status NOT BETWEEN 200 AND 299 THEN 'transport-failure'
    WHEN data_type = 'reference' THEN 'versioned-reference-data' WHEN status = 'degraded' THEN 'probe-degraded' WHEN last_checked IS NULL THEN 'never-probed'
    WHEN last_checked > {NOW} THEN 'future-last-checked' WHEN f LIKE 'biennial%' THEN 'survey-verification-current'
    WHEN f = 'as-required' THEN 'as-required-no-publisher-date'
    WHEN sig IS NULL THEN sig_reason WHEN age <= base * 1.5 THEN 'freshness-within-window' WHEN age <= base * 3 THEN 'freshness-aging' ELSE 'freshness-stale' END AS new_reason
FROM (SELECT *, (epoch_us({NOW}) - epoch_us(sig)) / 1e6 AS age FROM (
  SELECT s.*, c.data_type, c.refresh_frequency AS f, coalesce(CAST(s.content_freshness_date AS TIMESTAMP), s.last_modified) AS sig,
    'no-freshness-signal' AS sig_reason,
    CASE c.refresh_frequency WHEN '30 seconds' THEN 30 WHEN 'hourly' THEN 3600 WHEN 'weekly' THEN 604800 WHEN 'monthly' THEN 2592000
      WHEN 'quarterly' THEN 7776000 WHEN 'annual' THEN 31536000 ELSE 86400 END AS base
  FROM (SELECT * EXCLUDE (data_type) FROM bare) s JOIN cat c ON c.dataset_id = s.dataset_id)))"""


@query("compare_classifiers", _POLICY_SQL)
def _compare_classifiers(t: Tables):
    return snapshot.compare_classifiers(t.bare_snapshot, t.catalog, as_of=AS_OF).select(
        "dataset_id", "old_status", "new_status", "status_changed", "new_reason"
    )


@query("classify_policy", f"SELECT dataset_id, new_status AS policy_status, new_reason AS policy_reason FROM ({_POLICY_SQL})")
def _classify_policy(t: Tables):
    rows = t.bare_snapshot.join(t.catalog.select("dataset_id", "refresh_frequency", "data_type"), "dataset_id").withColumn(
        "probe_status", F.when(F.col("status").isin("degraded", "unreachable"), F.col("status"))
    )
    return snapshot.classify_policy(rows, as_of=AS_OF).select("dataset_id", "policy_status", "policy_reason")


@query("select_freshness_signal", """
SELECT seq, CASE WHEN content_ok THEN CAST(content_date AS TIMESTAMP) WHEN header_ok THEN last_modified END AS signal_at,
  CASE WHEN content_ok THEN 'content-date' WHEN header_ok AND (mode IS NOT NULL OR content_date IS NOT NULL) THEN 'last-modified-fallback'
    WHEN header_ok THEN 'last-modified' WHEN mode IS NULL AND content_date > CAST(observed_at AS DATE) THEN 'future-content-date'
    ELSE 'no-freshness-signal' END AS signal_reason
FROM (SELECT *, mode IS NULL AND CAST(content_date AS TIMESTAMP) <= observed_at AS content_ok, last_modified IS NOT NULL AS header_ok
      FROM (SELECT *, CASE WHEN k % 7 = 0 THEN 'structural-hash' END AS mode FROM obs))""")
def _select_freshness_signal(t: Tables):
    rows = t.observations.select(
        "seq", F.col("observed_at").alias("last_checked"), F.col("content_date").alias("content_freshness_date"), "last_modified",
        F.when(F.col("k") % 7 == 0, "structural-hash").alias("policy_mode"),
    )
    return snapshot.select_freshness_signal(rows).select("seq", "signal_at", "signal_reason")


@query("merge_due", """
SELECT dataset_id, status, last_checked, record_count FROM bare WHERE staleness_status = 'stale' OR http_status IS NULL
UNION ALL SELECT dataset_id, status, last_checked, record_count FROM prev
  WHERE dataset_id NOT IN (SELECT dataset_id FROM bare WHERE staleness_status = 'stale' OR http_status IS NULL)""")
def _merge_due(t: Tables):
    columns = ["dataset_id", "status", "last_checked", "record_count"]
    updates = t.bare_snapshot.where((F.col("staleness_status") == "stale") | F.col("http_status").isNull())
    # datasets seen for the first time have no prior row; the full current table stands in for them
    prior = t.previous.select(*columns)
    return snapshot.merge_due(prior, updates.select(*columns), t.catalog)
