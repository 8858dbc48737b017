"""SQL twins of the bindings and of the derived tables, for checking results in DuckDB.

Each entry of ``TABLES`` is one named subquery. ``with_tables`` prefixes a statement
with the subqueries it mentions, directly or through others.
"""

from __future__ import annotations

import re

from tablehealth import params
from tablehealth.plans.bindings import AS_OF, FREQUENCIES, PREVIOUS_AT

NOW = f"TIMESTAMP '{AS_OF}'"
TODAY = f"DATE '{AS_OF[:10]}'"


def pub(value: str, digits: int) -> str:
    """Rounded as published: from the exact binary value."""
    return f"CAST(printf('%.{digits}f', CAST({value} AS DOUBLE)) AS DOUBLE)"


def dataset_id(n: str) -> str:
    return f"'ds_' || lpad(CAST({n} AS VARCHAR), CAST(greatest(5, length(CAST({n} AS VARCHAR))) AS INTEGER), '0')"


def case_of(key: str, table: dict, default: str = "NULL") -> str:
    def lit(value):
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {key} {whens} ELSE {default} END"


def cadence(column: str, table: dict, survey: bool = True) -> str:
    prefix = f"OR lower({column}) LIKE 'survey-year%'" if survey else ""
    return f"""CASE WHEN lower({column}) LIKE 'daily%' THEN 1.0
        WHEN lower({column}) LIKE 'biennial%' {prefix} THEN 730.0
        ELSE CAST({case_of(f'lower({column})', table)} AS DOUBLE) END"""


def days(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 86400e6)"


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


TABLES: dict[str, str] = {}

TABLES["obs"] = f"""
SELECT {dataset_id('n')} AS dataset_id, ts AS observed_at, strftime(ts, '%Y-%m-%dT%H:00') AS cycle,
  CASE WHEN outcome <> 'success' THEN 'unreachable' WHEN k < 50 THEN 'fresh' WHEN k < 75 THEN 'aging'
       WHEN k < 90 THEN 'stale' ELSE 'degraded' END AS status,
  CASE WHEN n % 2 = 0 AND k < 95 THEN 'last-modified-header' ELSE 'content-date-parse' END AS freshness_signal,
  CASE WHEN n % 2 = 0 AND k < 95 THEN ts - to_seconds(k) END AS last_modified,
  CASE WHEN k >= 95 THEN CAST(ts AS DATE) + 1
       ELSE CAST(ts AS DATE) - CAST(k % 3 + CASE n % 3 WHEN 0 THEN di WHEN 1 THEN 30 - di ELSE 0 END AS INTEGER) END AS content_date,
  CAST(floor(value * 10) AS BIGINT) AS record_count, k % 11 = 0 AS record_count_estimated,
  CASE WHEN outcome = 'timeout' THEN NULL WHEN outcome = 'error' AND k % 10 = 1 THEN 404
       WHEN outcome = 'error' THEN 503 ELSE 200 END AS http_status,
  floor(value) AS latency_ms, outcome AS probe_outcome,
  CASE outcome WHEN 'timeout' THEN 'request timed out' WHEN 'error' THEN 'probe failed' END AS message,
  'Dataset ' || n AS name,
  'https://host' || (n % 7) || '.example.org/d/' || n || CASE WHEN n % 6 = 0 AND di >= 15 THEN '?v=2' ELSE '' END AS url,
  'shape-v1:' || sha256(CASE WHEN n % 5 = 0 AND di >= 20 THEN '1' ELSE '0' END) AS shape_hash,
  CASE WHEN n % 5 = 0 AND di >= 20 THEN 4 ELSE 3 END AS column_count,
  CASE WHEN k % 4 <> 0 THEN k >= 90 END AS anomaly_detected, event_id AS seq, n, k
FROM (SELECT *, CASE WHEN event_type = 'error' AND k < 20 THEN 'timeout' WHEN event_type = 'error' THEN 'error'
                ELSE 'success' END AS outcome
      FROM (SELECT event_id, ts, user_id AS n, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
              date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS di, event_type, value FROM events))"""

TABLES["cat"] = f"""
SELECT {dataset_id('n')} AS dataset_id,
  CASE WHEN (n // 20) % 2 = 1 THEN 'OpenDOSM: ' ELSE '' END || CASE WHEN (n % 20) % 3 = 0 THEN 'State ' ELSE '' END
    || 'Series ' || (n % 20) || ' block ' || (n // 40) AS name,
  'Counts of series ' || (n % 20) || ' for region ' || (n % 6) AS description,
  CASE WHEN n % 25 <> 24 THEN 'Source ' || (n % 5) END AS source,
  CASE WHEN n % 12 <> 11 THEN 'Steward ' || (n % 12) END AS steward,
  'Custodian ' || (n % 4) AS custodian,
  CASE WHEN n % 15 = 7 THEN 'HTTPS://Data.Example.org/shared/' || (n // 15) || '/?b=2&a=1'
       WHEN n % 15 = 8 THEN 'https://data.example.org/shared/' || (n // 15) || '?a=1&b=2#top'
       ELSE 'https://host' || (n % 7) || '.example.org/d/' || n END AS url,
  CASE WHEN n % 2 = 0 THEN '{params.CC_BY_4}' ELSE '{params.OGL}' END AS licence,
  {case_of('n % 7', dict(enumerate(params.NAMESPACES)))} AS namespace,
  CASE WHEN n % 6 <> 5 THEN 'Region ' || (n % 6) END AS geography,
  {case_of('n % 10', FREQUENCIES)} AS refresh_frequency,
  CASE WHEN n % 29 = 28 THEN 'reference' ELSE 'timeseries' END AS data_type,
  n % 31 = 30 AS discontinued,
  CASE WHEN n % 37 = 36 THEN 'discontinued' ELSE 'active' END AS real_status,
  CASE WHEN n % 4 <> 3 THEN CAST(400 * (1 + n % 3) AS BIGINT) END AS expected_record_count,
  CASE WHEN n % 5 <> 4 THEN 'SER-' || (n // 10) END AS series_code,
  CASE WHEN n % 3 = 0 THEN 'schema-' || (n % 9) END AS schema_id,
  CASE WHEN n % 16 = 15 THEN {dataset_id('(n - 1)')} END AS supersedes_id, n
FROM (SELECT DISTINCT user_id AS n FROM events)"""


def _probes(at: str) -> str:
    return f"""
SELECT dataset_id, CASE WHEN k % 17 = 0 THEN 'degraded' ELSE 'fresh' END AS status, message, url, url AS request_url,
  CASE WHEN n % 13 = 0 THEN 'Camofox' ELSE 'direct GET' END AS access_method, http_status,
  CAST(n * 1000 + k AS BIGINT) AS content_length, last_modified,
  CASE WHEN n % 8 <> 7 THEN content_date END AS content_freshness_date,
  CASE WHEN n % 9 <> 8 THEN record_count END AS record_count, record_count_estimated, column_count,
  shape_hash AS first_row_hash
FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY observed_at DESC, seq DESC) AS rn
      FROM obs WHERE observed_at <= TIMESTAMP '{at}') WHERE rn = 1"""


def _snapshot(probes: str, previous: str | None, at: str) -> str:
    now = f"TIMESTAMP '{at}'"
    if previous:
        join = f"LEFT JOIN {previous} o ON o.dataset_id = p.dataset_id"
        old = {name: f"o.{name}" for name in ("content_freshness_date", "column_count", "first_row_hash", "last_checked")}
    else:
        join = ""
        old = {"content_freshness_date": "CAST(NULL AS DATE)", "column_count": "CAST(NULL AS INTEGER)",
               "first_row_hash": "CAST(NULL AS VARCHAR)", "last_checked": "CAST(NULL AS TIMESTAMP)"}
    return f"""
SELECT *, CASE
    WHEN data_type <> 'reference' AND (discontinued OR coalesce(http_status IN (404, 410), false)) THEN 'discontinued'
    WHEN browser THEN 'browser-dependent'
    WHEN http_status IS NULL OR http_status < 200 OR http_status >= 300 THEN 'unreachable'
    WHEN data_type = 'reference' THEN 'reference'
    WHEN probe_status = 'degraded' THEN 'degraded'
    WHEN staleness_status = 'unknown-freshness' THEN 'unknown-freshness'
    WHEN content_shape_changed OR coalesce(record_count < expected_record_count * 0.5, false) THEN 'degraded'
    ELSE staleness_status END AS status
FROM (SELECT *, CASE WHEN staleness_days IS NULL THEN 'unknown-freshness'
        WHEN staleness_days <= coalesce(cad * 1.5, 135) THEN 'fresh'
        WHEN staleness_days <= coalesce(cad * 3, 270) THEN 'aging' ELSE 'stale' END AS staleness_status
      FROM (SELECT *, CAST(greatest(
                greatest(0, floor({days(now, 'last_modified')})),
                greatest(0, floor({days(now, 'CAST(content_freshness_date AS TIMESTAMP)')}))
              ) AS BIGINT) AS staleness_days0,
              CASE WHEN last_modified IS NULL AND content_freshness_date IS NULL THEN NULL ELSE
                CAST(greatest(CASE WHEN last_modified IS NOT NULL THEN greatest(0, floor({days(now, 'last_modified')})) END,
                  CASE WHEN content_freshness_date IS NOT NULL
                       THEN greatest(0, floor({days(now, 'CAST(content_freshness_date AS TIMESTAMP)')})) END) AS BIGINT) END AS staleness_days,
              CASE WHEN last_modified IS NOT NULL THEN 'last-modified-header' WHEN content_freshness_date IS NOT NULL
                THEN 'content-date-parse' WHEN browser THEN 'browser-only' ELSE 'no-header' END AS freshness_signal,
              CASE WHEN last_modified IS NOT NULL THEN 'last_modified_header' WHEN content_freshness_date IS NOT NULL
                THEN 'content_date_parse' ELSE 'none' END AS freshness_signal_source
            FROM (SELECT p.dataset_id, {now} AS checked_at,
                    CASE WHEN p.http_status IS NOT NULL OR p.last_modified IS NOT NULL OR p.content_freshness_date IS NOT NULL
                           OR p.record_count IS NOT NULL THEN {now} ELSE {old['last_checked']} END AS last_checked,
                    c.namespace, p.url, p.message, p.request_url, p.access_method, p.http_status, p.content_length,
                    p.last_modified,
                    CASE WHEN CAST(coalesce(p.content_freshness_date, CASE WHEN p.access_method = 'Camofox' THEN {old['content_freshness_date']} END) AS TIMESTAMP) <= {now}
                         THEN coalesce(p.content_freshness_date, CASE WHEN p.access_method = 'Camofox' THEN {old['content_freshness_date']} END) END AS content_freshness_date,
                    p.record_count, p.record_count_estimated,
                    coalesce(p.record_count < c.expected_record_count, false) AS incomplete,
                    p.column_count, p.first_row_hash,
                    coalesce({old['column_count']} <> p.column_count, false) OR coalesce({old['first_row_hash']} <> p.first_row_hash, false) AS content_shape_changed,
                    c.expected_record_count,
                    coalesce(p.record_count >= c.expected_record_count * 0.5, false) AS record_count_within_tolerance,
                    CASE WHEN p.access_method = 'Camofox' THEN 'browser' ELSE 'direct' END AS access_dependency,
                    p.access_method = 'Camofox' AS browser, p.status AS probe_status, c.data_type, c.discontinued,
                    {cadence('c.refresh_frequency', params.SNAPSHOT_CADENCE_DAYS, survey=False)} AS cad
                  FROM {probes} p JOIN cat c ON c.dataset_id = p.dataset_id {join})))"""


TABLES["probes_now"] = _probes(AS_OF)
TABLES["probes_before"] = _probes(PREVIOUS_AT)
TABLES["prev"] = _snapshot("probes_before", None, PREVIOUS_AT)
TABLES["bare"] = _snapshot("probes_now", "prev", AS_OF)
SNAPSHOT_COLUMNS = (
    "dataset_id", "checked_at", "last_checked", "namespace", "url", "status", "message", "request_url", "access_method",
    "http_status", "content_length", "last_modified", "content_freshness_date", "record_count", "record_count_estimated",
    "incomplete", "column_count", "first_row_hash", "content_shape_changed", "expected_record_count",
    "record_count_within_tolerance", "staleness_days", "staleness_status", "access_dependency", "freshness_signal",
    "freshness_signal_source",
)

TABLES["aged"] = f"""
SELECT *, CAST(observed_at AS DATE) AS day, CASE WHEN probe_outcome = 'success' THEN greatest(
    CASE WHEN last_modified <= observed_at THEN {days('observed_at', 'last_modified')} END,
    CASE WHEN CAST(content_date AS TIMESTAMP) <= observed_at THEN {days('observed_at', 'CAST(content_date AS TIMESTAMP)')} END) END AS age_days
FROM obs"""

TABLES["per_day"] = """
SELECT dataset_id, day, observed_at, cycle, status, anomaly_detected, age_days, seq
FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, day ORDER BY observed_at DESC, seq) AS rn
      FROM aged WHERE age_days IS NOT NULL) WHERE rn = 1"""

TABLES["anom"] = f"""
SELECT s.dataset_id, s.status, s.staleness_days, coalesce(latest > lim, false) AS anomaly_detected, mode, sample_days,
  CASE WHEN mode = 'rolling_14d' THEN {pub('m', 3)} END AS mean_days,
  CASE WHEN mode = 'rolling_14d' THEN {pub('sd', 3)} END AS stdev_days,
  CASE WHEN mode = 'rolling_14d' THEN {pub('lim', 3)} ELSE lim END AS threshold_days, latest AS latest_days
FROM (SELECT *, CASE mode WHEN 'rolling_14d' THEN m + 2 * sd WHEN 'cadence_fallback' THEN 3 * cad END AS lim
      FROM (SELECT *, CASE WHEN status IN ('reference', 'discontinued') OR latest IS NULL THEN 'not_evaluated'
                WHEN sample_days >= 12 THEN 'rolling_14d' WHEN cad IS NULL THEN 'not_evaluated'
                ELSE 'cadence_fallback' END AS mode
            FROM (SELECT b.dataset_id, b.status, b.staleness_days, CAST(b.staleness_days AS DOUBLE) AS latest,
                    coalesce(h.nd, 0) AS sample_days, h.m, h.sd,
                    {cadence('c.refresh_frequency', params.CADENCE_DAYS)} AS cad
                  FROM bare b JOIN cat c ON c.dataset_id = b.dataset_id
                  LEFT JOIN (SELECT dataset_id, count(*) AS nd, avg(age_days) AS m, stddev_pop(age_days) AS sd FROM per_day
                             WHERE day >= {TODAY} - 14 AND day < {TODAY} GROUP BY dataset_id) h
                    ON h.dataset_id = b.dataset_id))) s"""

TABLES["snap"] = """
SELECT b.*, a.anomaly_detected, a.mode, a.sample_days, a.mean_days, a.stdev_days, a.threshold_days, a.latest_days
FROM bare b LEFT JOIN anom a ON a.dataset_id = b.dataset_id"""

TABLES["trends"] = f"""
SELECT dataset_id, name, latest_status, {pub('cad', 6)} AS cadence_days,
  CASE WHEN NOT usable THEN 'insufficient_data' WHEN slope < -0.25 THEN 'recovering'
       WHEN slope > 0.25 AND latest_age > cad * 1.5 THEN 'deteriorating' ELSE 'stable' END AS trend,
  CASE WHEN coalesce(latest_status IN ('reference', 'discontinued'), false) THEN 'status ' || latest_status || ' is not freshness-evaluable'
       WHEN cad IS NULL THEN 'refresh cadence is not mapped'
       WHEN n < 3 OR span < 2 THEN 'requires 3 daily samples spanning at least 2 days'
       WHEN slope < -0.25 THEN 'staleness is decreasing faster than the recovery threshold'
       WHEN slope > 0.25 AND latest_age > cad * 1.5
         THEN 'staleness is increasing and latest freshness is beyond the on-time cadence boundary'
       ELSE 'slope is within the stable band or latest freshness remains on time' END AS reason,
  n AS trend_sample_days, {pub('span', 3)} AS history_span_days, {pub('latest_age', 3)} AS latest_staleness_days,
  CASE WHEN usable THEN {pub('slope', 3)} END AS slope_days_per_day,
  CASE WHEN usable THEN {pub('slope * 7', 3)} END AS slope_days_per_week,
  pct AS publish_on_time_pct,
  CASE WHEN pct IS NULL THEN 'insufficient_data' WHEN pct >= 95 THEN 'A' WHEN pct >= 85 THEN 'B' WHEN pct >= 70 THEN 'C'
       WHEN pct >= 50 THEN 'D' ELSE 'F' END AS reliability_grade,
  CASE WHEN usable THEN n ELSE 0 END AS reliability_sample_days,
  CASE WHEN flags > 0 THEN {pub('100.0 * flagged / flags', 1)} END AS anomaly_rate_pct, flags AS anomaly_sample_days
FROM (SELECT *, CASE WHEN usable THEN {pub('100.0 * on_time / n', 1)} END AS pct
      FROM (SELECT *, cad IS NOT NULL AND NOT coalesce(latest_status IN ('reference', 'discontinued'), false)
                AND n >= 3 AND span >= 2 AS usable
            FROM (SELECT c.dataset_id, c.name, c.cad, coalesce(d.n, 0) AS n,
                    CASE WHEN d.n >= 2 THEN d.span ELSE 0.0 END AS span, d.slope, d.latest_status, d.latest_age,
                    d.on_time, coalesce(d.flags, 0) AS flags, d.flagged
                  FROM (SELECT *, {cadence('refresh_frequency', params.CADENCE_DAYS)} AS cad FROM cat) c
                  LEFT JOIN (SELECT p.dataset_id, count(*) AS n,
                               (max(epoch_us(observed_at)) - min(epoch_us(observed_at))) / 86400e6 AS span,
                               regr_slope(age_days, {days('observed_at', f'CAST({TODAY} - 13 AS TIMESTAMP)')}) AS slope,
                               arg_max(status, observed_at) AS latest_status, arg_max(age_days, observed_at) AS latest_age,
                               count(*) FILTER (WHERE age_days <= k.cad * 1.5) AS on_time,
                               count(anomaly_detected) AS flags, count(*) FILTER (WHERE anomaly_detected) AS flagged
                             FROM per_day p JOIN (SELECT dataset_id,
                                 {cadence('refresh_frequency', params.CADENCE_DAYS)} AS cad FROM cat) k ON k.dataset_id = p.dataset_id
                             WHERE day BETWEEN {TODAY} - 13 AND {TODAY} GROUP BY p.dataset_id) d
                    ON d.dataset_id = c.dataset_id)))"""

_IN_WINDOW = f"observed_at >= {NOW} - INTERVAL {params.DRIFT_WINDOW_DAYS} DAY"


def transitions_sql(window_days: int) -> str:
    cutoff = f"{NOW} - INTERVAL {window_days} DAY"
    def part(field: str) -> str:
        return f"""
(SELECT dataset_id, count(*) FILTER (WHERE prev <> v AND w) AS changes, max(observed_at) FILTER (WHERE prev <> v AND w) AS last_at,
   count(*) FILTER (WHERE w) AS samples, count(DISTINCT v) AS kinds
 FROM (SELECT dataset_id, observed_at, w, {field} AS v, lag({field}) OVER (PARTITION BY dataset_id ORDER BY observed_at, cycle) AS prev
       FROM seen WHERE {field} IS NOT NULL) GROUP BY dataset_id)"""
    return f"""
SELECT d.dataset_id, coalesce(s.changes, 0) AS shape_change_count, s.last_at AS last_shape_change_at,
  coalesce(s.samples, 0) AS shape_sample_count, coalesce(s.kinds, 0) AS distinct_shape_count,
  coalesce(c.changes, 0) AS column_change_count, c.last_at AS last_column_change_at, coalesce(c.samples, 0) AS column_sample_count
FROM (SELECT DISTINCT dataset_id FROM obs WHERE observed_at <= {NOW}) d
LEFT JOIN (WITH seen AS (SELECT *, observed_at >= {cutoff} AS w FROM obs o WHERE observed_at <= {NOW}
    AND (observed_at >= {cutoff} OR observed_at = (SELECT max(observed_at) FROM obs b WHERE b.dataset_id = o.dataset_id AND b.observed_at < {cutoff})))
  SELECT * FROM {part('shape_hash')}) s ON s.dataset_id = d.dataset_id
LEFT JOIN (WITH seen AS (SELECT *, observed_at >= {cutoff} AS w FROM obs o WHERE observed_at <= {NOW}
    AND (observed_at >= {cutoff} OR observed_at = (SELECT max(observed_at) FROM obs b WHERE b.dataset_id = o.dataset_id AND b.observed_at < {cutoff})))
  SELECT * FROM {part('column_count')}) c ON c.dataset_id = d.dataset_id"""


TABLES["trans"] = transitions_sql(params.DRIFT_WINDOW_DAYS)


def record_trend_sql(window_days: int) -> str:
    return f"""
SELECT dataset_id,
  CASE WHEN n < 2 OR span < 1 THEN 'insufficient_data' WHEN first_count = 0 AND last_count > 0 THEN 'growing'
       WHEN pct > 5 THEN 'growing' WHEN pct < -5 THEN 'shrinking' ELSE 'stable' END AS record_trend,
  CASE WHEN n >= 2 AND span >= 1 THEN {pub('pct', 1)} END AS record_change_pct, n AS record_sample_days,
  {pub('span', 3)} AS record_history_span_days
FROM (SELECT *, CASE WHEN first_count <> 0 THEN 100.0 * (last_count - first_count) / abs(first_count) END AS pct
      FROM (SELECT dataset_id, count(*) AS n, (max(epoch_us(observed_at)) - min(epoch_us(observed_at))) / 86400e6 AS span,
              arg_min(record_count, observed_at) AS first_count, arg_max(record_count, observed_at) AS last_count
            FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, CAST(observed_at AS DATE) ORDER BY observed_at DESC, seq) AS rn
                  FROM obs WHERE probe_outcome = 'success' AND observed_at <= {NOW}
                    AND observed_at >= {NOW} - INTERVAL {window_days} DAY)
            WHERE rn = 1 GROUP BY dataset_id))"""


TABLES["rtrend"] = record_trend_sql(params.DRIFT_WINDOW_DAYS)

TABLES["drifts"] = f"""
SELECT dataset_id, name, CASE WHEN structural THEN 'drift_detected' WHEN tol = false THEN 'record_count_drift'
    WHEN evaluated THEN 'stable' ELSE 'insufficient_data' END AS verdict,
  shape_changed AS shape_changed_recently, shape_change_count, last_shape_change_at, shape_sample_count, distinct_shape_count,
  column_changed AS column_count_changed, column_change_count, last_column_change_at, column_sample_count, record_trend,
  record_change_pct, record_sample_days, record_history_span_days, record_count, column_count, expected_record_count,
  tol AS record_count_within_tolerance, flag AS content_shape_changed_latest,
  CASE WHEN structural AND shape_change_count > 0 THEN shape_change_count || ' structural fingerprint change(s) detected in the 30-day window'
       WHEN structural AND column_change_count > 0 THEN column_change_count || ' column-count change(s) detected in the 30-day window'
       WHEN structural THEN 'latest health snapshot reports a structural comparison change'
       WHEN tol = false THEN 'record count ' || record_count || ' is below 50% of expected count ' || expected_record_count
       WHEN evaluated THEN 'no structural transition or record-count tolerance failure was detected'
       ELSE 'requires two comparable structural or record-count observations, or an evaluable expected count' END AS reason
FROM (SELECT *, shape_changed OR coalesce(column_changed, false) AS structural,
        shape_sample_count >= 2 OR column_sample_count >= 2 OR tol IS NOT NULL OR record_trend <> 'insufficient_data' AS evaluated
      FROM (SELECT c.dataset_id, c.name, coalesce(t.shape_change_count, 0) AS shape_change_count, t.last_shape_change_at,
              coalesce(t.shape_sample_count, 0) AS shape_sample_count, coalesce(t.distinct_shape_count, 0) AS distinct_shape_count,
              coalesce(t.column_change_count, 0) AS column_change_count, t.last_column_change_at,
              coalesce(t.column_sample_count, 0) AS column_sample_count, coalesce(r.record_trend, 'insufficient_data') AS record_trend,
              r.record_change_pct, coalesce(r.record_sample_days, 0) AS record_sample_days,
              coalesce(r.record_history_span_days, 0.0) AS record_history_span_days, s.record_count, s.column_count,
              c.expected_record_count, s.record_count >= c.expected_record_count * 0.5 AS tol,
              coalesce(s.content_shape_changed, false) AS flag,
              coalesce(t.shape_change_count, 0) > 0 OR coalesce(s.content_shape_changed, false) AS shape_changed,
              CASE WHEN coalesce(t.column_change_count, 0) > 0 THEN true WHEN coalesce(t.column_sample_count, 0) >= 2 THEN false END AS column_changed
            FROM cat c LEFT JOIN bare s ON s.dataset_id = c.dataset_id LEFT JOIN trans t ON t.dataset_id = c.dataset_id
            LEFT JOIN rtrend r ON r.dataset_id = c.dataset_id))"""


# ---- reconciliation ----------------------------------------------------------


def words(value: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({value}, '')), '[^a-z0-9]+', ' ', 'g'))"


def title(value: str) -> str:
    stripped = f"regexp_replace({value}, '(?i)^(data\\.gov\\.my|opendosm|dosm)\\s*[:\\-–—]?\\s*', '')"
    return words(stripped)


def canonical_url(url: str) -> str:
    path = f"rtrim(regexp_extract({url}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/')"
    query = f"array_to_string(list_sort(string_split(regexp_extract({url}, '[?]([^#]*)', 1), '&')), '&')"
    return f"""(lower(regexp_extract({url}, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract({url}, '^[A-Za-z]+://([^/?#]*)', 1))
      || CASE {path} WHEN '' THEN '/' ELSE {path} END || CASE {query} WHEN '' THEN '' ELSE '?' || {query} END)"""


def signature(dataset_id: str, name: str) -> str:
    terms = "[" + ", ".join(f"'{t}'" for t in params.GRANULARITY_TERMS) + "]"
    return f"list_filter({terms}, lambda x: list_contains(string_split({words(f"{dataset_id} || ' ' || {name}")}, ' '), x))"


TABLES["m_seed"] = """
SELECT 'seed:pair-' || a.n AS group_key, a.name AS logical_name, 'seed' AS grouping_method,
  CASE WHEN (a.n // 30) % 3 = 2 THEN 'different_granularity' ELSE 'equivalent' END AS relationship, 'reviewed' AS confidence,
  unnest([a.dataset_id, b.dataset_id]) AS dataset_id,
  CASE WHEN (a.n // 30) % 2 = 0 THEN 'strict' ELSE 'context_only' END AS record_count_policy, CAST(5.0 AS DOUBLE) AS record_count_tolerance_pct,
  2 AS content_date_tolerance_days, 'reviewed pair' AS rationale
FROM cat a JOIN cat b ON b.n = a.n + 1 WHERE a.n % 30 = 1"""

TABLES["m_url"] = f"""
SELECT 'url:' || substr(sha256(u), 1, 16) AS group_key, arg_min(name, dataset_id) OVER (PARTITION BY u) AS logical_name,
  'exact_url' AS grouping_method, 'equivalent' AS relationship, 'high' AS confidence, dataset_id,
  'strict' AS record_count_policy, CAST(0.0 AS DOUBLE) AS record_count_tolerance_pct, 0 AS content_date_tolerance_days,
  'members publish the same canonical URL: ' || u AS rationale
FROM (SELECT *, count(*) OVER (PARTITION BY u) AS size FROM (SELECT *, {canonical_url('url')} AS u FROM cat)
      WHERE dataset_id NOT IN (SELECT dataset_id FROM m_seed)) WHERE size >= 2"""

TABLES["m_title"] = f"""
SELECT 'name:' || replace(cu, ' ', '-') || ':' || replace(ti, ' ', '-') || ':'
    || substr(sha256('["' || cu || '","' || ti || '","' || fr || '",' || CAST(to_json(sg) AS VARCHAR) || ']'), 1, 12) AS group_key,
  arg_min(name, dataset_id) OVER (PARTITION BY cu, ti, fr, sg) AS logical_name, 'semantic_title' AS grouping_method,
  'equivalent' AS relationship, 'moderate' AS confidence, dataset_id, 'context_only' AS record_count_policy,
  CAST(5.0 AS DOUBLE) AS record_count_tolerance_pct, 2 AS content_date_tolerance_days,
  'exact semantic title, custodian, cadence, and granularity match across endpoint channels' AS rationale
FROM (SELECT *, count(*) OVER (PARTITION BY cu, ti, fr, sg) AS size, min(ch) OVER (PARTITION BY cu, ti, fr, sg) AS low,
        max(ch) OVER (PARTITION BY cu, ti, fr, sg) AS high
      FROM (SELECT *, {words('custodian')} AS cu, {title('name')} AS ti, {words('refresh_frequency')} AS fr,
              {signature('dataset_id', 'name')} AS sg, lower(regexp_extract(url, '//([^/?#]*)', 1)) AS ch FROM cat
            WHERE dataset_id NOT IN (SELECT dataset_id FROM m_seed) AND dataset_id NOT IN (SELECT dataset_id FROM m_url)))
WHERE size >= 2 AND low <> high"""

TABLES["members"] = "SELECT * FROM m_seed UNION ALL SELECT * FROM m_url UNION ALL SELECT * FROM m_title"

TABLES["detail"] = """
SELECT m.*, coalesce(s.status, 'unknown') AS status,
  CASE WHEN s.status IN ('fresh', 'aging', 'stale', 'unknown-freshness', 'reference') THEN 'available'
       WHEN s.status IN ('degraded', 'unavailable', 'discontinued') THEN 'failed' ELSE 'unknown' END AS availability_class,
  s.record_count, coalesce(s.record_count_estimated, false) AS record_count_estimated, s.content_freshness_date AS content_date
FROM members m LEFT JOIN bare s ON s.dataset_id = m.dataset_id"""

# all pairs of a group, compared one by one
TABLES["pairs"] = f"""
SELECT *, CASE WHEN largest = 0 THEN 0.0 ELSE {pub('100.0 * abs(record_count_delta) / largest', 3)} END AS record_count_delta_pct
FROM (SELECT a.group_key, a.dataset_id AS left_id, b.dataset_id AS right_id, b.record_count - a.record_count AS record_count_delta,
        CASE WHEN a.record_count IS NOT NULL AND b.record_count IS NOT NULL THEN greatest(abs(a.record_count), abs(b.record_count)) END AS largest,
        CASE WHEN a.record_count_policy = 'strict' AND NOT a.record_count_estimated AND NOT b.record_count_estimated
             THEN abs(b.record_count - a.record_count) <= CASE WHEN a.record_count_tolerance_pct = 0 THEN 0
               ELSE greatest(1.0, greatest(a.record_count, b.record_count) * a.record_count_tolerance_pct / 100) END END AS record_count_within_tolerance,
        abs(b.content_date - a.content_date) AS content_date_delta_days,
        abs(b.content_date - a.content_date) <= a.content_date_tolerance_days AS content_date_within_tolerance,
        CASE WHEN a.availability_class <> 'unknown' AND b.availability_class <> 'unknown'
             THEN a.availability_class = b.availability_class END AS availability_match
      FROM detail a JOIN detail b ON a.group_key = b.group_key AND a.dataset_id < b.dataset_id)"""

TABLES["groups"] = """
SELECT m.group_key, any_value(m.logical_name) AS logical_name, any_value(m.grouping_method) AS grouping_method,
  any_value(m.relationship) AS relationship, any_value(m.record_count_policy) AS record_count_policy, count(*) AS member_count,
  CASE WHEN any_value(m.relationship) = 'different_granularity' THEN 'different_granularity'
       WHEN any_value(p.failed) THEN 'discrepancy' WHEN any_value(p.evidence) THEN 'agree' ELSE 'insufficient_data' END AS verdict
FROM members m LEFT JOIN (SELECT group_key,
    bool_or(coalesce(NOT record_count_within_tolerance, false) OR coalesce(NOT content_date_within_tolerance, false)
            OR coalesce(NOT availability_match, false)) AS failed,
    bool_or(record_count_within_tolerance IS NOT NULL OR content_date_within_tolerance IS NOT NULL) AS evidence
  FROM pairs GROUP BY group_key) p ON p.group_key = m.group_key
GROUP BY m.group_key"""

# ---- graph: all pairs of datasets that share a declared value ----
TABLES["cliques"] = """
SELECT 'same_steward' AS kind, source || '|' || steward AS key, CAST(NULL AS VARCHAR) AS publisher, dataset_id FROM cat
  WHERE source IS NOT NULL AND steward IS NOT NULL
UNION ALL SELECT 'same_agency', steward, source, dataset_id FROM cat WHERE steward IS NOT NULL
UNION ALL SELECT 'same_geography', geography, NULL, dataset_id FROM cat WHERE geography IS NOT NULL
UNION ALL SELECT 'canonical_series', series_code, NULL, dataset_id FROM cat WHERE series_code IS NOT NULL
UNION ALL SELECT 'shared_schema', schema_id, NULL, dataset_id FROM cat WHERE schema_id IS NOT NULL"""

TABLES["edges"] = f"""
SELECT a.kind, a.key, a.dataset_id AS from_id, b.dataset_id AS to_id, {case_of('a.kind', params.EDGE_WEIGHTS)} AS weight
FROM cliques a JOIN cliques b ON a.kind = b.kind AND a.key = b.key AND a.dataset_id < b.dataset_id
WHERE coalesce(a.publisher <> b.publisher, true)
UNION ALL SELECT 'successor_to', NULL, dataset_id, supersedes_id, 3 FROM cat WHERE supersedes_id IS NOT NULL"""

# ---- trust ----
_COMPONENTS = (("fresh", "0.3"), ("reliability", "0.3"), ("trend", "0.2"), ("drift", "0.1"), ("agree", "0.1"))
_WEIGHT = " + ".join(f"CASE WHEN p_{name} THEN CAST({w} AS DOUBLE) ELSE 0.0 END" for name, w in _COMPONENTS)
_SCORE = " + ".join(f"CASE WHEN p_{name} THEN CAST({w} AS DOUBLE) / w * c_{name} ELSE 0.0 END" for name, w in _COMPONENTS)

TABLES["scores"] = f"""
SELECT dataset_id, status, CASE WHEN status = 'stale' AND staleness_days >= 365 THEN least(floored, 30.0) ELSE floored END AS score,
  c_fresh, c_reliability, c_trend, c_drift, c_agree, p_fresh, p_reliability, p_trend, p_drift, p_agree, observed_at
FROM (SELECT *, greatest(CASE WHEN w > 0 THEN {pub(_SCORE, 1)} ELSE 50.0 END, 25.0) AS floored
  FROM (SELECT *, {_WEIGHT} AS w
    FROM (SELECT c.dataset_id, s.status, s.staleness_days, s.last_checked AS observed_at,
        CAST({case_of('s.status', params.STATUS_SCORE, '50')} AS DOUBLE) AS c_fresh, coalesce(t.publish_on_time_pct, 50.0) AS c_reliability,
        CAST({case_of('t.trend', params.TREND_SCORE, '50')} AS DOUBLE) AS c_trend, CAST({case_of('d.verdict', params.DRIFT_SCORE, '50')} AS DOUBLE) AS c_drift,
        CAST({case_of('g.verdict', params.RECON_SCORE, '50')} AS DOUBLE) AS c_agree,
        s.dataset_id IS NOT NULL AS p_fresh, t.publish_on_time_pct IS NOT NULL AS p_reliability,
        coalesce(t.trend <> 'insufficient_data', false) AS p_trend, coalesce(d.verdict <> 'insufficient_data', false) AS p_drift,
        coalesce(g.verdict <> 'insufficient_data', false) AS p_agree
      FROM cat c LEFT JOIN bare s ON s.dataset_id = c.dataset_id LEFT JOIN trends t ON t.dataset_id = c.dataset_id
      LEFT JOIN drifts d ON d.dataset_id = c.dataset_id
      LEFT JOIN (SELECT m.dataset_id, g.verdict FROM members m JOIN groups g ON g.group_key = m.group_key) g ON g.dataset_id = c.dataset_id)))"""


def with_tables(sql: str) -> str:
    """The statement with the derived tables it needs in front, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                visit(TABLES[name])

    visit(sql)
    if not needed:
        return sql
    parts = ",\n".join(f"{name} AS ({body})" for name, body in TABLES.items() if name in needed)
    return f"WITH {parts}\n{sql.strip()}"
