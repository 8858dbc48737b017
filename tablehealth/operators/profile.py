"""Profiles, inferred types and dates of observed payload tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth import params
from tablehealth.functions import shapes, times
from tablehealth.functions.dates import pick_date, text_dates


def format_metrics(payload: DataFrame, *, column: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """How many ids follow the legacy, the transition, or no known registration format; blanks are ignored."""
    value = F.regexp_replace(F.regexp_replace(F.col(column).cast("string"), '^"|"$', ""), "\r$", "")
    rows = payload.withColumn("_value", value).where(F.col("_value") != "")
    legacy = F.col("_value").rlike(params.REGISTRATION_PATTERN)
    transition = ~legacy & F.col("_value").rlike(params.REGISTRATION_TRANSITION_PATTERN)
    counted = rows.groupBy(*group_cols).agg(
        F.count_if(legacy).alias("legacy_count"),
        F.count_if(transition).alias("transition_count"),
        F.count_if(~legacy & ~transition).alias("invalid_count"),
        F.count("*").alias("_total"),
    )
    return counted.withColumn("compatible", (F.col("_total") > 0) & (F.col("invalid_count") == 0)).drop("_total")


def appendix_count(pages: DataFrame, *, column: str, minimum: int = params.APPENDIX_MINIMUM) -> DataFrame:
    """Distinct appendix labels per page."""
    found = F.regexp_extract_all(F.col(column), F.lit(r">Appendix[^\S\n]+([0-9]+[A-Z]?)<"), F.lit(1))
    return pages.withColumn("appendix_resource_count", F.size(F.array_distinct(found))).withColumn(
        "guidance_structure_compatible", F.col("appendix_resource_count") >= minimum
    )


def payload_profile(
    payload: DataFrame,
    *,
    row_no: str,
    group_cols: Sequence[str] = (),
    timestamp_cols: Sequence[str] = ("timestamp", "date", "publish_date"),
    location_col: str | None = None,
    date_col: str | None = None,
) -> DataFrame:
    """Counts, first record timestamp, distinct locations and date range, per payload."""
    columns = [name for name in payload.columns if name not in (row_no, *group_cols)]
    stamps = [F.col(name).cast("string") for name in timestamp_cols if name in payload.columns]
    first = F.coalesce(*stamps) if stamps else F.lit(None).cast("string")
    aggs = [
        F.count("*").alias("record_count"),
        F.lit(len(columns)).alias("column_count"),
        F.min_by(first, F.col(row_no)).alias("first_record_timestamp"),
    ]
    if location_col is not None:
        aggs.append(F.count_distinct(location_col).alias("locations"))
    if date_col is not None:
        aggs += [F.min(date_col).alias("date_start"), F.max(date_col).alias("date_end")]
    return payload.groupBy(*group_cols).agg(*aggs)


def transit_static_profile(tables: Mapping[str, DataFrame], *, feed: str = "feed_id", files: DataFrame | None = None) -> DataFrame:
    """One row per transit feed from its six tables; ``calendar`` has YYYYMMDD text dates.

    ``files`` (feed, ``table``) lists the tables a feed delivered; without it a table
    without rows counts as missing.
    """
    counts = reduce(DataFrame.unionByName, [
        tables[name].groupBy(feed).agg(F.count("*").alias("_n")).select(feed, F.lit(name).alias("_table"), "_n")
        for name in params.TRANSIT_TABLES
    ])
    if files is not None:
        counts = counts.unionByName(files.select(feed, F.col("table").alias("_table"), F.lit(0).cast("bigint").alias("_n")))
    wide = counts.groupBy(feed).agg(*[
        F.sum(F.when(F.col("_table") == name, F.col("_n"))).alias(name) for name in params.TRANSIT_TABLES
    ])
    dated = tables["calendar"].where(
        (F.coalesce("start_date", F.lit("")) != "") & (F.coalesce("end_date", F.lit("")) != "")
    )
    service = dated.groupBy(feed).agg(F.max("start_date").alias("_start"), F.max("end_date").alias("_end"))
    rows = wide.join(service, feed, "left")

    def day(name: str) -> Column:
        return F.when(F.col(name).rlike(r"^\d{8}$"), F.try_to_date(F.col(name), "yyyyMMdd"))

    missing = F.concat_ws(", ", *[F.when(F.col(name).isNull(), F.lit(f"{name}.txt")) for name in params.TRANSIT_TABLES])
    rows = rows.withColumns({"missing_files": missing, "service_start": day("_start"), "service_end": day("_end")})
    undated = F.col("_end").isNull()
    bad_date = ~undated & (F.col("service_start").isNull() | F.col("service_end").isNull())
    incomplete = F.col("missing_files") != ""
    message = (
        F.when(incomplete, F.concat(F.lit("missing required files: "), F.col("missing_files")))
        .when(undated, "calendar.txt has no service dates")
        .when(bad_date, "invalid calendar date")
        .otherwise("valid static feed")
    )
    usable = ~incomplete & ~bad_date
    return rows.select(
        feed, *params.TRANSIT_TABLES,
        F.when(usable & undated, F.greatest(*params.TRANSIT_TABLES))
        .when(usable, F.greatest("stops", "trips", "stop_times")).alias("record_count"),
        F.when(usable, F.col("service_start")).alias("service_start"),
        F.when(usable, F.col("service_end")).alias("content_freshness_date"),
        F.when(usable & ~undated, "fresh").otherwise("degraded").alias("status"),
        message.alias("message"),
    )


def transit_realtime_profile(entities: DataFrame, headers: DataFrame, *, now, feed: str = "feed_id") -> DataFrame:
    """Vehicles and feed time per feed.

    ``entities``: feed, ``vehicle`` (boolean), ``vehicle_ts`` (epoch seconds).
    ``headers``: feed, ``header_ts``; zero or null falls back to the newest vehicle
    that is not in the future.
    """
    current = F.floor(F.unix_micros(times.lit_instant(now)) / 1_000_000)
    vehicles = entities.where("vehicle").groupBy(feed).agg(
        F.count("*").alias("vehicle_count"),
        F.max(F.when(F.col("vehicle_ts") > 0, F.col("vehicle_ts"))).alias("newest_vehicle_timestamp"),
        F.max(F.when((F.col("vehicle_ts") > 0) & (F.col("vehicle_ts") <= current), F.col("vehicle_ts"))).alias("_past"),
    )
    rows = headers.join(vehicles, feed, "left")
    header = F.nullif(F.col("header_ts"), F.lit(0))
    count = F.coalesce("vehicle_count", F.lit(0))
    return rows.select(
        feed, count.alias("vehicle_count"), header.alias("header_timestamp"), "newest_vehicle_timestamp",
        F.to_date(F.timestamp_seconds(F.coalesce(header, "_past"))).alias("content_freshness_date"),
    )


# ---- structure and types -----------------------------------------------------


def shape_fingerprint(df: DataFrame, *, json_col: str, out: str = "shape_hash") -> DataFrame:
    return df.withColumn(out, shapes.json_shape(F.col(json_col)))


def distinct_shapes(df: DataFrame, *, json_col: str, group_cols: Sequence[str]) -> DataFrame:
    """Rows per distinct fingerprint of each group."""
    return shape_fingerprint(df, json_col=json_col).groupBy(*group_cols, "shape_hash").agg(F.count("*").alias("rows"))


def table_fingerprint(df: DataFrame) -> str:
    """Fingerprint of a table's header."""
    return shapes.header_fingerprint(df.columns)


_TYPE_PATTERNS = (
    ("date", r"^\d{4}-\d{2}-\d{2}(?:[T ][^\s]+)?$"),
    ("boolean", r"(?i)^(?:true|false)$"),
    ("integer", r"^[+-]?\d+$"),
    ("number", r"^[+-]?(?:\d+\.\d*|\d*\.\d+)(?:[Ee][+-]?\d+)?$"),
)
_NATIVE_TYPES = {
    "boolean": "boolean", "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer",
    "float": "number", "double": "number", "date": "date", "timestamp": "date", "timestamp_ntz": "date",
}


def infer_fields(df: DataFrame) -> DataFrame:
    """(position, name, type) per column from all rows.

    Blanks are ignored; integers mixed with numbers are numbers, any other mixture
    is string, no value at all is string. All columns are classified in one pass.
    """
    rows = df
    aggs, plain = [], {}
    for i, (name, kind) in enumerate(df.dtypes):
        if kind in _NATIVE_TYPES:
            plain[i] = _NATIVE_TYPES[kind]
            aggs.append(F.max(F.when(F.col(f"`{name}`").isNotNull(), F.lit(1))).alias(f"_c{i}_native"))
            continue
        if kind.startswith("decimal"):
            plain[i] = "number"
            aggs.append(F.max(F.when(F.col(f"`{name}`").isNotNull(), F.lit(1))).alias(f"_c{i}_native"))
            continue
        raw = F.col(f"`{name}`").cast("string")
        value = F.when(raw != "", F.trim(raw))
        found = F.when(value.isNull(), F.lit(None).cast("string"))
        for label, pattern in _TYPE_PATTERNS:
            found = found.when(value.rlike(pattern), label)
        found = found.otherwise("string")
        for label in ("date", "boolean", "integer", "number", "string"):
            aggs.append(F.max(F.when(found == label, F.lit(1))).alias(f"_c{i}_{label}"))
    flags = rows.agg(*aggs)
    items = []
    for i, (name, _) in enumerate(df.dtypes):
        if i in plain:
            verdict = F.when(F.col(f"_c{i}_native").isNotNull(), plain[i]).otherwise("string")
        else:
            seen = {label: F.col(f"_c{i}_{label}").isNotNull() for label in ("date", "boolean", "integer", "number", "string")}
            kinds = reduce(lambda a, b: a + b, [flag.cast("int") for flag in seen.values()])
            numeric = seen["number"] & ((kinds == 1) | ((kinds == 2) & seen["integer"]))
            verdict = (
                F.when(numeric, "number").when((kinds == 1) & seen["integer"], "integer")
                .when((kinds == 1) & seen["date"], "date").when((kinds == 1) & seen["boolean"], "boolean")
                .otherwise("string")
            )
        items.append(F.struct(F.lit(i).alias("position"), F.lit(name).alias("name"), verdict.alias("type")))
    return flags.select(F.inline(F.array(*items)))


# ---- dates -------------------------------------------------------------------


def min_max_date(
    df: DataFrame, *, value: Column, mode: str, today, group_cols: Sequence[str] = (), iso_only: bool = False
) -> DataFrame:
    """Smallest or largest date text (first 10 characters); the largest ignores future dates.

    ``iso_only`` is the rule for delimited files: only values that begin with an ISO
    date take part, whole, and future dates are kept.
    """
    if mode not in ("min", "max"):
        raise ValueError("mode must be 'min' or 'max'")
    text = value.cast("string")
    if iso_only:
        text = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text)
    else:
        text = F.substring(text, 1, 10)
        if mode == "max":
            text = F.when(text <= F.date_format(times.lit_day(today), "yyyy-MM-dd"), text)
    picked = F.min(text) if mode == "min" else F.max(text)
    return df.groupBy(*group_cols).agg(picked.alias("content_date"))


def extract_text_dates(df: DataFrame, *, column: str, today, mode: str = "max") -> DataFrame:
    """The content date written in each row's text."""
    found = df.withColumn("_found", text_dates(F.col(column)))  # its own column, so the text is searched once
    return found.withColumn("content_date", pick_date(F.col("_found"), times.lit_day(today), mode=mode)).drop("_found")


def date_of_documents(df: DataFrame, *, column: str, today, mode: str = "max", group_cols: Sequence[str] = ()) -> DataFrame:
    """One content date per group of texts, by combining row-level extremes."""
    day = times.lit_day(today)
    found = df.select(*group_cols, F.explode(text_dates(F.col(column))).alias("_d"))
    past = F.max(F.when(F.col("_d") <= day, F.col("_d")))
    picked = F.min("_d") if mode == "min" else F.coalesce(past, F.max("_d"))
    return found.groupBy(*group_cols).agg(picked.alias("content_date"))


def detect_date_column(df: DataFrame) -> DataFrame:
    """The date-named column whose values are all ISO dates and most varied, with its maximum.

    The first column wins a tie; no row when none qualifies. All candidates are
    measured in one pass.
    """
    pattern = re.compile(params.DATE_COLUMN_PATTERN)
    names = [name for name, kind in df.dtypes if kind in ("string", "date") and pattern.search(name)]
    schema = "column string, distinct_values bigint, max_date string"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    aggs = []
    for i, name in enumerate(names):
        text = F.col(f"`{name}`").cast("string")
        aggs += [
            F.bool_and(F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))).alias(f"_ok{i}"),
            F.count_distinct(text).alias(f"_n{i}"),
            F.max(text).alias(f"_max{i}"),
        ]
    items = F.array(*[
        F.struct(
            F.when(F.col(f"_ok{i}"), F.col(f"_n{i}")).alias("distinct_values"), F.lit(-i).alias("_rank"),
            F.lit(name).alias("column"), F.col(f"_max{i}").alias("max_date"),
        )
        for i, name in enumerate(names)
    ])
    usable = F.filter(items, lambda item: item["distinct_values"].isNotNull())
    best = df.agg(*aggs).select(F.array_max(usable).alias("_best")).where(F.col("_best").isNotNull())
    return best.select("_best.column", "_best.distinct_values", "_best.max_date")


# ---- robots ------------------------------------------------------------------


def robots_blocked(body: Column, user_agent: str) -> Column:
    """Whether a robots body disallows ``/`` for the agent, read top to bottom.

    The latest user-agent line decides whether the following rules apply. The lines
    of one body are folded inside the row, so no shuffle is needed.
    """
    token = user_agent.lower().split()[0]
    accepted = ["*", token.split("/")[0], token, user_agent.lower()]

    def value_of(line: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(line, r"^[^:]*:\s*", ""), r"\s*$", "")

    def step(state: Column, raw: Column) -> Column:
        line = F.regexp_replace(F.regexp_replace(raw, r"\r$", ""), r"\s*#.*", "")
        agent_line = line.rlike(r"(?i)^\s*user-agent\s*:")
        rule_line = line.rlike(r"(?i)^\s*disallow\s*:") & (value_of(line) == "/")
        return F.struct(
            F.when(agent_line, F.lower(value_of(line)).isin(accepted)).otherwise(state["matching"]).alias("matching"),
            (state["blocked"] | (~agent_line & rule_line & state["matching"])).alias("blocked"),
        )

    start = F.struct(F.lit(False).alias("matching"), F.lit(False).alias("blocked"))
    folded = F.aggregate(F.split(F.coalesce(body, F.lit("")), "\n"), start, step, lambda state: state["blocked"])
    return F.coalesce(folded, F.lit(False))


def url_origin(url: Column) -> Column:
    """``scheme://authority`` as written, null when malformed."""
    origin = F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]+)", 1)
    return F.nullif(origin, F.lit(""))


def robots_block_filter(urls: DataFrame, robots: DataFrame, *, user_agent: str, url_col: str = "url") -> DataFrame:
    """URLs with ``blocked``; an origin without a robots body, and a malformed URL, are allowed.

    ``robots`` is (``origin``, ``body``), one row per origin.
    """
    rules = robots.select(F.col("origin").alias("_origin"), robots_blocked(F.col("body"), user_agent).alias("blocked"))
    keyed = urls.withColumn("_url_origin", url_origin(F.col(url_col)))
    return keyed.join(rules, F.col("_url_origin") == F.col("_origin"), "left").withColumn(
        "blocked", F.coalesce("blocked", F.lit(False))
    ).drop("_origin", "_url_origin")
