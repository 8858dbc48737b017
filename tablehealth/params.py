"""Thresholds, lookups and status domains.

Everything here is a default; operators take the value as a keyword argument.
"""

from __future__ import annotations

# ---- fixed values: status and outcome domains, in publication order ----
STATUSES = (
    "fresh", "aging", "stale", "discontinued", "degraded", "browser-dependent",
    "unreachable", "unknown", "unknown-freshness", "reference",
)
PROBE_OUTCOMES = ("success", "error", "timeout")
INELIGIBLE_STATUSES = ("reference", "discontinued")
CLASSIFIED_STATUSES = ("browser-dependent", "unknown", "unknown-freshness", "reference", "discontinued")
SIGNAL_SOURCES = ("last_modified_header", "content_date_parse", "none")

# ---- fixed values: access methods that need a browser ----
BROWSER_ACCESS_METHOD = "camofox"
BROWSER_SOURCE_MARK = "camofox-rendered"

# ---- fixed values: anomaly ----
ANOMALY_WINDOW_DAYS = 14
ANOMALY_MIN_SAMPLE_DAYS = 12
ANOMALY_SIGMAS = 2.0
ANOMALY_CADENCE_MULTIPLIER = 3.0
ANOMALY_METRIC = "freshness_delta_days"

# ---- fixed values: trend and reliability ----
TREND_WINDOW_DAYS = 14
TREND_MIN_SAMPLE_DAYS = 3
TREND_MIN_SPAN_DAYS = 2.0
TREND_SLOPE_THRESHOLD = 0.25
ON_TIME_MULTIPLIER = 1.5
GRADE_FLOORS = (("A", 95.0), ("B", 85.0), ("C", 70.0), ("D", 50.0))
GRADES = ("A", "B", "C", "D", "F")

# ---- fixed values: drift ----
DRIFT_WINDOW_DAYS = 30
RECORD_MIN_SAMPLE_DAYS = 2
RECORD_MIN_SPAN_DAYS = 1.0
RECORD_TREND_PCT = 5.0
RECORD_TOLERANCE_RATIO = 0.5
SHAPE_PREFIX = "shape-v1:"

# ---- fixed values: snapshot freshness multipliers and defaults ----
FRESH_MULTIPLIER = 1.5
AGING_MULTIPLIER = 3.0
NULL_CADENCE_FRESH_DAYS = 135.0
NULL_CADENCE_AGING_DAYS = 270.0

# ---- fixed values: cadence in days (anomaly and trend) ----
CADENCE_DAYS = {
    "weekly": 7.0, "monthly": 30.0, "quarterly": 90.0, "annual": 365.0,
    "hourly": 1 / 24, "30 seconds": 30 / 86400,
}
# ---- fixed values: the snapshot uses rounded sub-daily constants ----
SNAPSHOT_CADENCE_DAYS = CADENCE_DAYS | {"hourly": 0.04, "30 seconds": 0.0003}
# ---- fixed values: record evidence counts whole days ----
EVIDENCE_CADENCE_DAYS = {
    "30 seconds": 0, "hourly": 0, "daily": 1, "weekly": 7, "monthly": 30,
    "quarterly": 90, "annual": 365,
}

# ---- fixed values: scheduling policy ----
WEEKDAY_DAILY = (
    "daily (weekdays, 0900 myt)", "daily (weekdays, 1130 myt)",
    "daily (weekdays, 1200 myt)", "daily (weekdays, 1700 myt)",
)
SURVEY_FREQUENCY = "biennial to triennial (survey years)"
AS_REQUIRED = "as-required"
TIER_MEMBERS = {
    "realtime": ("30 seconds", "hourly"),
    "daily": ("daily", *WEEKDAY_DAILY),
    "weekly-monthly": ("weekly", "monthly", "quarterly"),
    "slow": ("annual", AS_REQUIRED, SURVEY_FREQUENCY),
}
TIER_DUE_SECONDS = {"realtime": 900, "daily": 86400, "weekly-monthly": 604800, "slow": 2592000}
WEEKDAY_DAILY_DUE_SECONDS = 3600
BASELINE_SECONDS = {
    "30 seconds": 30, "hourly": 3600, "daily": 86400, "weekly": 604800,
    "monthly": 2592000, "quarterly": 7776000, "annual": 31536000,
}
RETRY_MINUTES = 240
SURVEY_AGING_DAYS, SURVEY_STALE_DAYS = 45, 90
UNKNOWN_REVIEW_DAYS = 30

# ---- fixed values: history ----
RETENTION_DAYS = 7
HEARTBEAT_MINUTES = 15

# ---- fixed values: snapshot comparison ----
COUNT_THRESHOLDS = {
    "direct": 0.10, "gtfs-static": 0.10, "gtfs-realtime": 0.50, "weather": 0.15, "browser": 0.25,
}
REALTIME_VOLATILE_THRESHOLD = 0.10

# ---- fixed values: reconciliation ----
NAME_TOLERANCE_PCT, NAME_TOLERANCE_DAYS = 5.0, 2
GRANULARITY_TERMS = (
    "national", "malaysia", "state", "district", "dun", "parlimen", "parliament",
    "constituency", "division", "class", "subclass", "sector", "age", "sex",
    "ethnic", "strata", "monthly", "quarterly", "annual", "daily", "hourly",
)
PUBLISHER_PREFIX = r"(?i)^(?:data\.gov\.my|opendosm|dosm)\s*[:\-–—]?\s*"

# ---- fixed values: graph ----
EDGE_WEIGHTS = {
    "same_steward": 2, "same_agency": 1, "same_geography": 1,
    "canonical_series": 2, "successor_to": 3, "shared_schema": 1,
}

# ---- fixed values: trust score ----
STATUS_SCORE = {
    "fresh": 100, "reference": 90, "aging": 65, "stale": 20, "degraded": 10, "unreachable": 0,
    "discontinued": 0, "browser-dependent": 50, "unknown": 50, "unknown-freshness": 50,
}
TREND_SCORE = {"recovering": 100, "stable": 75, "deteriorating": 25, "insufficient_data": 50}
DRIFT_SCORE = {"stable": 100, "record_count_drift": 40, "drift_detected": 0, "insufficient_data": 50}
RECON_SCORE = {
    "agree": 100, "different_granularity": 50, "discrepancy": 0,
    "insufficient_data": 50, "single_source": 50,
}
SCORE_WEIGHTS = {
    "freshness": 0.30, "reliability": 0.30, "trend": 0.20, "drift": 0.10,
    "cross_source_agreement": 0.10,
}
SCORE_DEFAULT, SCORE_FLOOR, SCORE_STALE_CAP, SCORE_STALE_CAP_DAYS = 50.0, 25.0, 30.0, 365

# ---- fixed values: licences ----
CC_BY_4 = "Creative Commons Attribution 4.0"
OGL = "Open Government Licence (Malaysia)"
LICENCE_ALIASES = {
    "cc by 4.0": CC_BY_4,
    "creative commons attribution 4.0": CC_BY_4,
    "ogl": OGL,
    "open government licence (malaysia)": OGL,
}
LICENCE_URLS = {
    CC_BY_4: "https://creativecommons.org/licenses/by/4.0/",
    OGL: "https://www.data.gov.my/pages/terms-of-use",
}

# ---- fixed values: evidence projections ----
EVIDENCE_FIELDS = (
    "last_checked", "http_status", "request_url", "access_dependency", "access_method",
    "freshness_signal", "freshness_signal_source", "last_modified", "content_freshness_date",
    "record_count", "record_count_estimated", "first_row_hash", "content_shape_changed",
    "column_count", "expected_record_count", "record_count_within_tolerance",
    "staleness_days", "status", "anomaly_detected", "anomaly_detection", "message",
)
COMPACT_EVIDENCE_FIELDS = (
    "last_checked", "http_status", "request_url", "access_dependency",
    "freshness_signal_source", "content_freshness_date", "record_count",
    "first_row_hash", "anomaly_detected", "status",
)

# ---- fixed values: record evidence ----
IDENTIFIER_CANDIDATES = ("record_id", "id", "reg_no", "license_no")
REGISTRATION_PATTERN = r"(?i)^MAL[0-9]{8}[A-Z]+$"
REGISTRATION_TRANSITION_PATTERN = r"(?i)^MAL\s*(\+\s*)?[0-9]{8}\s*(\+\s*)?[A-Z]+$"
REGISTRY_DATASET = "pharmaceutical_products"
REGISTRY_WINDOW_DAYS = 1
LINK_FIELDS = (
    ("holder", "holder_osa", "held_by"),
    ("manufacturer", "manufacturer_osa", "manufactured_by"),
    ("importer", "importer_osa", "imported_by"),
)
EXCERPT_SIZE = 50

# ---- fixed values: month names in the two languages of the sources ----
MONTHS = {
    "jan": 1, "january": 1, "januari": 1, "feb": 2, "february": 2, "februari": 2, "mar": 3, "march": 3, "mac": 3,
    "apr": 4, "april": 4, "may": 5, "mei": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "julai": 7,
    "aug": 8, "august": 8, "ogos": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "oktober": 10,
    "nov": 11, "november": 11, "dec": 12, "december": 12, "disember": 12,
}

# ---- fixed values: misc ----
GENESIS = "0" * 64
NAMESPACES = (
    "economy", "environment", "government_open_data", "healthcare", "other", "transport", "weather",
)
DATE_COLUMN_PATTERN = r"^date$|^date_|^_date$|.*_date$|.*_at$|^year$|^month$|^quarter$|^period$"
APPENDIX_MINIMUM = 12
PARQUET_OVERHEAD_BYTES, PARQUET_BYTES_PER_ROW = 16, 120
TRANSIT_TABLES = ("agency", "stops", "routes", "trips", "stop_times", "calendar")
SOURCE_STALENESS_DAYS = 60
POPULAR_LIMIT = 12
USABLE_STATUSES = ("fresh", "aging")
BLOCKED_STATUSES = ("stale", "degraded", "unreachable", "unknown", "unknown-freshness")
# ---- fixed values: the cadence audit has its own vocabulary and its own 30-second constant ----
AUDIT_FREQUENCIES = (
    "30 seconds", "hourly", "daily", "weekly", "monthly", "quarterly", "annual", "as-required",
    "biennial to triennial (survey years)", "daily (weekdays)", "daily (weekdays, 0900 MYT)",
    "daily (weekdays, 1130 MYT)", "daily (weekdays, 1200 MYT)", "daily (weekdays, 1700 MYT)",
)
AUDIT_CADENCE_DAYS = {
    "30 seconds": 0.001, "hourly": 1 / 24, "daily": 1.0, "weekly": 7.0, "monthly": 30.0,
    "quarterly": 90.0, "annual": 365.0,
}

#: Days of state that are read beside a base before they are folded into the next one.
STATE_FOLD_DAYS = 7

#: Epochs of a stream's store after which the closed ones are folded.
FOLD_EPOCHS = 50
