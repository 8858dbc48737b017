"""Trust scores, attestations and record evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablehealth import params
from tablehealth.operators import chain, evidence, history, membership, signals, trust
from tablehealth.plans.bindings import AS_OF, Tables
from tablehealth.plans.oracle import NOW, TABLES
from tablehealth.plans.registry import query
from tablehealth.session import cut_lineage

_DAY = AS_OF[:10]
_KEY = "key-1"


def _parts(score: str = "c", present: str = "p"):
    return ", ".join(f"{score}_{n}, {present}_{n}" for n in ("fresh", "reliability", "trend", "drift", "agree"))


@query("trust_score", f"SELECT dataset_id, score, {_parts()}, observed_at FROM scores")
def _trust_score(t: Tables):
    names = {"fresh": "freshness", "reliability": "reliability", "trend": "trend", "drift": "drift", "agree": "cross_source_agreement"}
    columns = []
    for short, name in names.items():
        columns += [F.col(f"components.{name}").alias(f"c_{short}"), F.col(f"component_availability.{name}.available").alias(f"p_{short}")]
    return t.stored.scores.select("dataset_id", "score", *columns, "observed_at")


def _link_sql(day: str, previous: str) -> str:
    """Payload and link of every dataset for one day, from the current snapshot."""
    return f"""
SELECT DATE '{day}' AS date, dataset_id, observed_at, previous_chain_head, payload,
  sha256(unhex(previous_chain_head) || encode(payload)) AS chain_link
FROM (SELECT c.dataset_id, s.last_checked AS observed_at, {previous} AS previous_chain_head, CAST(json_object(
    'access_dependency', s.access_dependency,
    'browser_receipt', json_object('available', false, 'reason', CASE WHEN s.access_dependency = 'browser' THEN 'probe runner emitted no signed receipt' END),
    'content_fingerprint', json_object('scheme', 'shape-v1:sha256', 'scope', 'first-row-or-headers', 'value', s.first_row_hash),
    'dataset_id', c.dataset_id, 'date', '{day}', 'key_id', '{_KEY}', 'last_staleness_days', s.staleness_days, 'last_status', s.status,
    'observed_at', strftime(s.last_checked, '%Y-%m-%dT%H:%M:%SZ'), 'observed_request_url', s.request_url,
    'previous_chain_head', {previous}, 'probe_count_14d', coalesce(p.n14, 0), 'probe_count_24h', coalesce(p.n1, 0),
    'schema', 'probe-attestation/v1', 'signer_pubkey_base64', '', 'source_url', c.url) AS VARCHAR) AS payload
  FROM cat c JOIN bare s ON s.dataset_id = c.dataset_id
  LEFT JOIN (SELECT dataset_id, count(*) AS n14, count(*) FILTER (WHERE observed_at >= {NOW} - INTERVAL 1 DAY) AS n1
             FROM obs WHERE observed_at >= {NOW} - INTERVAL 14 DAY GROUP BY dataset_id) p ON p.dataset_id = c.dataset_id)"""


def _tree_sql(key: str, leaf: str, rows: str) -> str:
    """(key, rows, digest): leaves by six hex digits of the hash of dataset_id, nodes by three, one root."""
    return f"""(
  SELECT {key}, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(d, '' ORDER BY p)) AS digest FROM (
    SELECT {key}, substr(p, 1, 3) AS p, sum(n) AS n, sha256(string_agg(d, '' ORDER BY p)) AS d FROM (
      SELECT {key}, substr(sha256(dataset_id), 1, 6) AS p, count(*) AS n, sha256({leaf}) AS d FROM {rows} GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1)"""


def _head_sql(links: str) -> str:
    return f"""
SELECT date, previous_chain_head, dataset_count, dataset_links_sha256, payload, sha256(unhex(previous_chain_head) || encode(payload)) AS chain_head
FROM (SELECT date, previous_chain_head, dataset_count, dataset_links_sha256, CAST(json_object('dataset_count', dataset_count,
        'dataset_links_sha256', dataset_links_sha256, 'date', strftime(date, '%Y-%m-%d'), 'key_id', '{_KEY}',
        'previous_chain_head', previous_chain_head, 'schema', 'daily-chain-head/v1') AS VARCHAR) AS payload
      FROM (SELECT date, any_value(previous_chain_head) AS previous_chain_head, count(*) AS dataset_count,
              any_value(digest) AS dataset_links_sha256
            FROM {links} JOIN {_tree_sql("date", """'[' || string_agg('{"chain_link":"' || chain_link || '","dataset_id":"' || dataset_id || '"}', ',' ORDER BY dataset_id) || ']'""", links)} USING (date)
            GROUP BY date))"""


TABLES["links1"] = _link_sql("2024-01-29", f"'{params.GENESIS}'")
TABLES["head1"] = _head_sql("links1")
TABLES["links2"] = _link_sql(_DAY, "(SELECT chain_head FROM head1)")
TABLES["head2"] = _head_sql("links2")


def _links(t: Tables, day: str, previous=None):
    counts = signals.probe_counts(t.history, as_of=AS_OF)
    return chain.attestation_links(t.stored.catalog, t.stored.bare_snapshot, counts, day=day, previous_heads=previous, key_id=_KEY)


def _two_days(t: Tables):
    first = t.stored._shared(_links(t, "2024-01-29"))
    head = t.stored._shared(chain.daily_chain_head(first, key_id=_KEY))
    second = t.stored._shared(_links(t, _DAY, head))
    return first, head, second


@query("attestation_links", "SELECT date, dataset_id, observed_at, previous_chain_head, payload, chain_link FROM links1")
def _attestation_links(t: Tables):
    return _links(t, "2024-01-29")


@query("daily_chain_head", """
SELECT date, previous_chain_head, dataset_count, dataset_links_sha256, payload, chain_head FROM (SELECT * FROM head1 UNION ALL SELECT * FROM head2)""")
def _daily_chain_head(t: Tables):
    _, head, second = _two_days(t)
    return head.unionByName(chain.daily_chain_head(second, key_id=_KEY))


@query("verify_chain", f"""
SELECT date, chain_head, previous, links_valid, digest_valid, head_valid, replayed,
  CASE WHEN NOT links_valid THEN 'a link or its previous head is invalid' ELSE 'daily heads replay to an anchor' END AS reason FROM (
  SELECT date, chain_head, 'genesis' AS previous, true AS links_valid, true AS digest_valid, true AS head_valid, true AS replayed FROM head1
  UNION ALL SELECT date, chain_head, 'linked', NOT EXISTS (SELECT 1 FROM bare WHERE status = 'stale'), NOT EXISTS (SELECT 1 FROM bare WHERE status = 'stale'), true,
    NOT EXISTS (SELECT 1 FROM bare WHERE status = 'stale') FROM head2)""")
def _verify_chain(t: Tables):
    first, head, second = _two_days(t)
    heads = head.unionByName(chain.daily_chain_head(second, key_id=_KEY))
    # the links of stale datasets are altered after the second head was made
    stale = t.stored.bare_snapshot.where(F.col("status") == "stale").select("dataset_id", F.lit(True).alias("_stale"))
    altered = second.join(stale, "dataset_id", "left").withColumn(
        "chain_link", F.when(F.col("_stale"), F.reverse("chain_link")).otherwise(F.col("chain_link"))
    ).drop("_stale")
    return chain.verify_chain(first.unionByName(altered), heads)


@query("trust_verdict", """
SELECT c.dataset_id, b.status, t.trend, d.verdict AS drift_verdict, g.verdict AS reconciliation_verdict, s.score, l.chain_link,
  c.name || ' — ' || c.source || '; observed ' || strftime(l.observed_at, '%Y-%m-%dT%H:%M:%SZ') || '; attestation ' || l.chain_link || '.' AS citation_text
FROM cat c JOIN bare b ON b.dataset_id = c.dataset_id JOIN trends t ON t.dataset_id = c.dataset_id JOIN drifts d ON d.dataset_id = c.dataset_id
LEFT JOIN members m ON m.dataset_id = c.dataset_id LEFT JOIN groups g ON g.group_key = m.group_key
JOIN scores s ON s.dataset_id = c.dataset_id JOIN links1 l ON l.dataset_id = c.dataset_id""")
def _trust_verdict(t: Tables):
    s = t.stored
    verdicts = trust.verdict_by_dataset(s.group_members, s.groups)
    rows = trust.trust_verdict(s.catalog, s.bare_snapshot, s.trends, s.drifts, verdicts, s.scores, _links(t, "2024-01-29"))
    return rows.select(
        "dataset_id", "health.status", "trend.trend", F.col("drift.verdict").alias("drift_verdict"),
        "reconciliation.reconciliation_verdict", "score.score", "attestation.chain_link", "citation_text",
    )


_CYCLE_COLUMNS = ["dataset_id", "cycle", "status", "record_count", "probe_outcome", "shape_hash"]


@query("cycle_digest", """
SELECT cycle, rows, digest FROM """ + _tree_sql("cycle", """string_agg(CAST(json_object('dataset_id', dataset_id, 'cycle', cycle, 'status', status,
  'record_count', record_count, 'probe_outcome', probe_outcome, 'shape_hash', shape_hash) AS VARCHAR) || chr(10), '' ORDER BY dataset_id)""",
  "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, cycle ORDER BY seq DESC) AS rn FROM obs) WHERE rn = 1)"))
def _cycle_digest(t: Tables):
    return chain.cycle_digest(history.keyed_history(t.history), columns=_CYCLE_COLUMNS)


@query("key_validity", """
SELECT seq, key_id = 'key-0' OR public_key = 'pk-' || substr(key_id, 5) AS key_registry_match, t AS key_time_valid,
  (key_id = 'key-0' OR public_key = 'pk-' || substr(key_id, 5)) AND t AND key_id <> 'key-2' AS key_valid
FROM (SELECT seq, 'key-' || (n % 3) AS key_id, CASE WHEN n % 3 <> 0 AND n % 17 = 0 THEN 'pk-x' ELSE 'pk-' || (n % 3) END AS public_key,
  observed_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-05' + to_days(CAST(10 + 5 * (n % 3) AS INTEGER)) AS t FROM obs)""")
def _key_validity(t: Tables):
    n = F.col("n")
    signed = t.observations.select(
        "seq", F.concat(F.lit("key-"), (n % 3).cast("string")).alias("key_id"),
        F.when((n % 3 != 0) & (n % 17 == 0), "pk-x").otherwise(F.concat(F.lit("pk-"), (n % 3).cast("string"))).alias("public_key"),
        "observed_at",
    )
    start = F.lit("2024-01-05").cast("timestamp")
    registry = t.catalog.select((n % 3).alias("i")).distinct().select(
        F.concat(F.lit("key-"), F.col("i").cast("string")).alias("key_id"), F.concat(F.lit("pk-"), F.col("i").cast("string")).alias("public_key"),
        start.alias("not_before"), F.timestamp_micros(F.unix_micros(start) + (10 + 5 * F.col("i")) * 86_400_000_000).alias("not_after"),
        F.lit("Ed25519").alias("algorithm"), F.when(F.col("i") == 2, "compromised").otherwise("active").alias("status"),
        F.lit(None).cast("timestamp").alias("compromised_at"),
    )
    return chain.key_validity(signed, registry).select("seq", "key_registry_match", "key_time_valid", "key_valid")


_KEYS_SQL = """(SELECT DISTINCT 'key-' || (n % 3) AS key_id, 'pk-' || (n % 3) || '-' || (n % 2) AS public_key,
  TIMESTAMP '2024-01-03' + to_days(CAST(n % 10 AS INTEGER)) AS not_before, TIMESTAMP '2024-01-03' + to_days(CAST(n % 10 + 4 + 3 * (n % 4) AS INTEGER)) AS not_after,
  CASE WHEN n % 11 = 0 THEN 'compromised' ELSE 'active' END AS status FROM cat)"""


@query("key_validity_as_of", f"""
SELECT seq, pk = public_key AS key_registry_match, coalesce(seen BETWEEN not_before AND not_after, false) AS key_time_valid,
  pk = public_key AND coalesce(seen BETWEEN not_before AND not_after, false) AND status <> 'compromised' AS key_valid
FROM (SELECT seq, observed_at AS seen, 'pk-' || (n % 3) || '-' || (seq % 2) AS pk, k.*,
    row_number() OVER (PARTITION BY seq ORDER BY k.not_before <= observed_at DESC,
      CASE WHEN k.not_before <= observed_at THEN -epoch_us(k.not_before) ELSE epoch_us(k.not_before) END,
      CASE WHEN k.not_before <= observed_at THEN -epoch_us(k.not_after) ELSE epoch_us(k.not_after) END,
      CASE WHEN k.not_before <= observed_at THEN -CAST(right(k.public_key, 1) AS INTEGER) ELSE CAST(right(k.public_key, 1) AS INTEGER) END,
      CASE WHEN (k.not_before <= observed_at) = (k.status = 'compromised') THEN 0 ELSE 1 END) AS rn
  FROM obs JOIN {_KEYS_SQL} k ON k.key_id = 'key-' || (n % 3)) WHERE rn = 1""")
def _key_validity_as_of(t: Tables):
    """Keys listed many times, with intervals that overlap and repeat."""
    n, start = F.col("n"), F.lit("2024-01-03").cast("timestamp")
    days = lambda count: F.timestamp_micros(F.unix_micros(start) + count * 86_400_000_000)
    registry = t.catalog.select(
        F.concat(F.lit("key-"), (n % 3).cast("string")).alias("key_id"), F.concat(F.lit("pk-"), (n % 3).cast("string"), F.lit("-"), (n % 2).cast("string")).alias("public_key"),
        days(n % 10).alias("not_before"), days(n % 10 + 4 + 3 * (n % 4)).alias("not_after"),
        F.lit("Ed25519").alias("algorithm"), F.when(n % 11 == 0, "compromised").otherwise("active").alias("status"), F.lit(None).cast("timestamp").alias("compromised_at"),
    )
    signed = t.observations.select(
        "seq", F.concat(F.lit("key-"), (n % 3).cast("string")).alias("key_id"),
        F.concat(F.lit("pk-"), (n % 3).cast("string"), F.lit("-"), (F.col("seq") % 2).cast("string")).alias("public_key"), "observed_at")
    return chain.key_validity(signed, registry).select("seq", "key_registry_match", "key_time_valid", "key_valid")


@query("verify_membership", """
SELECT l.date, l.dataset_id, CASE WHEN left(sha256(l.dataset_id), 6) = (SELECT left(sha256(min(b.dataset_id)), 6) FROM bare b JOIN cat k ON k.dataset_id = b.dataset_id
    WHERE b.status = 'aging' AND k.n % 23 <> 5) THEN 'invalid_path'
  WHEN c.n % 23 = 5 THEN 'omitted' WHEN s.status = 'stale' THEN 'other_link' ELSE 'member' END AS membership
FROM links1 l JOIN cat c ON c.dataset_id = l.dataset_id JOIN bare s ON s.dataset_id = l.dataset_id""")
def _verify_membership(t: Tables):
    """A tree without some datasets, links altered after the head, and one listed link altered in the tree."""
    links = cut_lineage(_links(t, "2024-01-29"))
    status = t.stored.bare_snapshot.select("dataset_id", F.col("status").alias("_status"))
    numbers = t.stored.catalog.select("dataset_id", F.col("n").alias("_n"))
    marked = cut_lineage(links.join(status, "dataset_id").join(numbers, "dataset_id"))
    kept = marked.where(F.col("_n") % 23 != 5).select(*links.columns)
    tree = cut_lineage(membership.head_tree(kept))
    chosen = marked.where((F.col("_status") == "aging") & (F.col("_n") % 23 != 5)).agg(F.min("dataset_id")).scalar()
    forged = tree.withColumn("chain_link", F.when(F.col("dataset_id") == chosen, F.reverse("chain_link")).otherwise(F.col("chain_link")))
    shown = marked.withColumn("chain_link", F.when(F.col("_status") == "stale", F.reverse("chain_link")).otherwise(F.col("chain_link"))).select(*links.columns)
    return membership.verify_membership(shown, forged, chain.daily_chain_head(kept, key_id=_KEY)).select("date", "dataset_id", "membership")


# ---- record evidence: customers as the records of a product register ----


def _register(t: Tables):
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    number = F.lpad((F.floor(key / 2) % 100_000_000).cast("string"), 8, "0")
    return t.read("customer").select(
        (key + 1).alias("row_no"),
        F.when(key % 23 == 22, "").when(key % 19 == 18, F.concat(F.lit("BAD"), number))
        .otherwise(F.concat(F.when(key % 4 == 0, "mal").otherwise("MAL"), number, F.lit("AZ"))).alias("reg_no"),
        F.col("c_name").alias("product"),
        F.when(key % 3 != 0, F.col("c_mktsegment")).alias("holder"),
        F.when(key % 5 != 0, F.concat(F.lit("H"), F.col("c_nationkey").cast("string"))).otherwise(" ").alias("holder_osa"),
        F.when(balance > 0, F.concat(F.lit("Maker \"é\" "), F.col("c_nationkey").cast("string"))).otherwise("").alias("manufacturer"),
        F.lit("").alias("manufacturer_osa"),
    )


_MODIFIED, _AGE = "2024-01-29T06:30:00Z", 1
TABLES["register"] = """
SELECT c_custkey + 1 AS row_no, CASE WHEN c_custkey % 23 = 22 THEN '' WHEN c_custkey % 19 = 18 THEN 'BAD' || num
    ELSE CASE WHEN c_custkey % 4 = 0 THEN 'mal' ELSE 'MAL' END || num || 'AZ' END AS reg_no,
  CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE '' END AS holder, CASE WHEN c_custkey % 5 <> 0 THEN 'H' || c_nationkey ELSE '' END AS holder_osa,
  CASE WHEN c_acctbal > 0 THEN 'Maker "é" ' || c_nationkey ELSE '' END AS manufacturer
FROM (SELECT *, lpad(CAST((c_custkey // 2) % 100000000 AS VARCHAR), 8, '0') AS num FROM customer)"""
TABLES["evid"] = f"""
SELECT row_no, CASE WHEN nth = 1 THEN base ELSE base || '#' || nth END AS record_id, CASE WHEN missing = '[]' THEN 'fresh' ELSE 'degraded' END AS status,
  missing = '[]' AS schema_ok, '{{"alternatives":[],"freshness":{{"age_days":{_AGE},"source_last_modified":"{_MODIFIED}"}},"linkage":{{"linked_to":[' || links || '],"unmatched":['
    || unmatched || ']}},"structural":{{"missing_required_fields":' || missing || ',"schema_ok":' || CASE WHEN missing = '[]' THEN 'true' ELSE 'false' END || '}}}}' AS explanation
FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY row_no) AS nth FROM (SELECT *,
    CASE WHEN reg_no = '' THEN 'row:' || row_no ELSE 'reg_no:' || upper(reg_no) END AS base,
    CASE WHEN reg_no = '' THEN '["reg_no"]' WHEN NOT regexp_full_match(upper(reg_no), 'MAL[0-9]{{8}}[A-Z]+') THEN '["reg_no:pattern"]' ELSE '[]' END AS missing,
    CASE WHEN holder_osa <> '' THEN '{{"kind":"held_by","to":"osa_code:' || holder_osa || '"}}' ELSE '' END AS links,
    concat_ws(',', CASE WHEN holder_osa = '' AND holder <> '' THEN '"holder:' || holder || '"' END,
      CASE WHEN manufacturer <> '' THEN '"manufacturer:' || replace(manufacturer, '"', chr(92) || '"') || '"' END) AS unmatched FROM register))"""


def _evidence(t: Tables):
    return evidence.record_evidence(
        _register(t), dataset_id=params.REGISTRY_DATASET, freshness_status="fresh", source_last_modified=_MODIFIED, age_days=_AGE
    )


@query("record_evidence", "SELECT row_no, record_id, status, schema_ok, explanation, 'sha256:' || sha256(explanation) AS evidence_digest FROM evid")
def _record_evidence(t: Tables):
    return _evidence(t).drop("missing_required_fields", "linked_to", "unmatched")


@query("evidence_envelope", f"""
SELECT '{params.REGISTRY_DATASET}' AS dataset_id, DATE '2024-01-30' AS run_date, count(*) AS record_count, count(*) FILTER (WHERE schema_ok) AS schema_valid_count,
  {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS status_{s.replace('-', '_')}" for s in params.STATUSES)} FROM evid""")
def _evidence_envelope(t: Tables):
    return evidence.evidence_envelope(_evidence(t), dataset_id=params.REGISTRY_DATASET, run_date="2024-01-30")


@query("validate_evidence", """
SELECT 'evidence_digest does not match explanation' AS rule, record_id AS subject FROM evid WHERE NOT schema_ok AND row_no % 2 = 0
UNION ALL SELECT 'status_distribution does not match records', unnest(['stale', 'fresh']) WHERE EXISTS (SELECT 1 FROM evid WHERE status = 'fresh')""")
def _validate_evidence(t: Tables):
    rows = t.stored._shared(_evidence(t))
    envelope = evidence.evidence_envelope(rows, dataset_id=params.REGISTRY_DATASET, run_date="2024-01-30")
    tampered = rows.withColumn(
        "evidence_digest", F.when(~F.col("schema_ok") & (F.col("row_no") % 2 == 0), "sha256:0").otherwise(F.col("evidence_digest"))
    ).withColumn("status", F.when(F.col("status") == "fresh", "stale").otherwise(F.col("status")))
    return evidence.validate_evidence(tampered, envelope, age_days=_AGE, source_last_modified=_MODIFIED)


@query("representative_excerpt", """
SELECT row_no, record_id, status FROM evid WHERE row_no IN (SELECT min(row_no) FROM evid GROUP BY status) OR row_no IN (
  SELECT row_no FROM evid WHERE row_no NOT IN (SELECT min(row_no) FROM evid GROUP BY status) ORDER BY row_no LIMIT 18)""")
def _representative_excerpt(t: Tables):
    return evidence.representative_excerpt(_evidence(t), n=20).select("row_no", "record_id", "status")


@query("dataset_freshness_status", """
SELECT dataset_id, age_days, CASE WHEN discontinued OR real_status = 'discontinued' THEN 'discontinued' WHEN data_type = 'reference' THEN 'reference'
  WHEN age_days IS NULL OR w IS NULL THEN 'unknown-freshness' WHEN age_days <= w THEN 'fresh' WHEN age_days <= 3 * w THEN 'aging' ELSE 'stale' END AS freshness_status
FROM (SELECT c.*, date_diff('day', CAST(s.last_modified AS DATE), DATE '2024-01-30') AS age_days, CASE c.refresh_frequency WHEN '30 seconds' THEN 0 WHEN 'hourly' THEN 0
    WHEN 'daily' THEN 1 WHEN 'weekly' THEN 7 WHEN 'monthly' THEN 30 WHEN 'quarterly' THEN 90 WHEN 'annual' THEN 365 END AS w
  FROM cat c JOIN bare s ON s.dataset_id = c.dataset_id)""")
def _dataset_freshness_status(t: Tables):
    entries = t.catalog.join(t.bare_snapshot.select("dataset_id", F.col("last_modified").alias("source_last_modified")), "dataset_id")
    return evidence.dataset_freshness_status(entries, run_date="2024-01-30").select("dataset_id", "age_days", "freshness_status")
