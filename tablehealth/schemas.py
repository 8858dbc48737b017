"""Input schemas as DDL text. Null means absent: no operator fills a missing observation."""

from __future__ import annotations

CATALOG = (
    """dataset_id STRING, name STRING, description STRING, source STRING, steward STRING, custodian STRING,
    url STRING, licence STRING, namespace STRING, geography STRING, refresh_frequency STRING,
    data_type STRING, discontinued BOOLEAN, real_status STRING, expected_record_count BIGINT,
    series_code STRING, schema_id STRING, supersedes ARRAY<STRING>"""
)

PROBE = (
    """dataset_id STRING, status STRING, message STRING, url STRING, request_url STRING,
    access_method STRING, http_status INT, content_length BIGINT, last_modified TIMESTAMP,
    content_freshness_date DATE, first_record_timestamp STRING, record_count BIGINT,
    estimated_record_count BIGINT, record_count_estimated BOOLEAN, incomplete BOOLEAN,
    column_count INT, first_row_hash STRING, snapshot_chars BIGINT, probe_timestamp STRING,
    header_timestamp BIGINT, newest_vehicle_timestamp BIGINT"""
)

HISTORY = (
    """dataset_id STRING, observed_at TIMESTAMP, cycle STRING, status STRING, freshness_signal STRING,
    last_modified TIMESTAMP, content_date DATE, record_count BIGINT, record_count_estimated BOOLEAN,
    http_status INT, latency_ms DOUBLE, probe_outcome STRING, message STRING, name STRING, url STRING,
    shape_hash STRING, column_count INT, anomaly_detected BOOLEAN, seq BIGINT"""
)

EVIDENCE = (
    "observed_at", "cycle", "status", "freshness_signal", "last_modified", "content_date",
    "record_count", "latency_ms", "probe_outcome", "message", "shape_hash", "column_count",
    "anomaly_detected",
)

_EVIDENCE_DDL = """STRUCT<observed_at: TIMESTAMP, cycle: STRING, status: STRING, freshness_signal: STRING,
    last_modified: TIMESTAMP, content_date: DATE, record_count: BIGINT, latency_ms: DOUBLE,
    probe_outcome: STRING, message: STRING, shape_hash: STRING, column_count: INT, anomaly_detected: BOOLEAN>"""

DAILY = (
    f"""dataset_id STRING, date DATE, first_observed_at TIMESTAMP, last_observed_at TIMESTAMP,
    observations BIGINT, status_distribution MAP<STRING, BIGINT>,
    probe_outcome_distribution MAP<STRING, BIGINT>, availability_percent DOUBLE,
    record_count STRUCT<min: BIGINT, mean: DOUBLE, max: BIGINT, samples: BIGINT, sum: BIGINT>,
    latency_ms STRUCT<mean: DOUBLE, samples: BIGINT, sum: DOUBLE>,
    latest_observation {_EVIDENCE_DDL}, latest_successful_observation {_EVIDENCE_DDL},
    latest_successful_evaluable_observation {_EVIDENCE_DDL}"""
)

USAGE = (
    """ts TIMESTAMP, tool STRING, buyer_id STRING, args MAP<STRING, STRING>,
    result_summary STRUCT<count: BIGINT, dataset_id: STRING, status: STRING, score: DOUBLE,
    methodology_version: INT>, latency_ms BIGINT, request_id STRING, client_ip STRING"""
)

TELEMETRY = (
    "ts TIMESTAMP, stage STRING, duration_ms BIGINT, status STRING, cycle STRING, extra MAP<STRING, STRING>"
)

SEEDS = (
    """key STRING, logical_name STRING, members ARRAY<STRING>, relationship STRING, rationale STRING,
    record_count_policy STRING, record_count_tolerance_pct DOUBLE, content_date_tolerance_days INT"""
)
