"""Payload profiles, fingerprints, inferred types and dates in text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehealth import params
from tablehealth.functions import dates, text, times
from tablehealth.operators import profile
from tablehealth.plans.bindings import AS_OF, Tables
from tablehealth.plans.oracle import TODAY
from tablehealth.plans.registry import query

_TODAY = AS_OF[:10]


@query("format_metrics", """
SELECT nation, count(*) FILTER (WHERE kind = 'legacy') AS legacy_count, count(*) FILTER (WHERE kind = 'transition') AS transition_count,
  count(*) FILTER (WHERE kind = 'invalid') AS invalid_count, count(*) FILTER (WHERE kind = 'invalid') = 0 AS compatible
FROM (SELECT c_nationkey AS nation, CASE c_custkey % 5 WHEN 0 THEN 'blank' WHEN 1 THEN 'legacy' WHEN 2 THEN 'legacy' WHEN 3 THEN 'transition'
    ELSE CASE WHEN c_nationkey % 3 = 0 THEN 'legacy' ELSE 'invalid' END END AS kind FROM customer) WHERE kind <> 'blank' GROUP BY nation""")
def _format_metrics(t: Tables):
    key = F.col("c_custkey")
    number = F.lpad((key % 100_000_000).cast("string"), 8, "0")
    value = (
        F.when(key % 5 == 0, "").when(key % 5 == 1, F.concat(F.lit('"MAL'), number, F.lit('A"')))
        .when(key % 5 == 2, F.concat(F.lit("mal"), number, F.lit("xz")))
        .when(key % 5 == 3, F.concat(F.lit("MAL + "), number, F.lit(" A")))
        .otherwise(F.concat(F.when(F.col("c_nationkey") % 3 == 0, "MAL").otherwise("NOT"), number, F.lit("T")))
    )
    rows = t.read("customer").select(F.col("c_nationkey").alias("nation"), value.alias("reg_no"))
    return profile.format_metrics(rows, column="reg_no", group_cols=["nation"])


@query("appendix_count", "SELECT page_id, 1 + page_id % 14 AS appendix_resource_count, 1 + page_id % 14 >= 12 AS guidance_structure_compatible FROM pages")
def _appendix_count(t: Tables):
    # an appendix list of 1 + page_id % 14 distinct labels, each linked twice
    labels = F.transform(
        F.sequence(F.lit(0), F.col("page_id") % 14), lambda i: F.concat(F.lit("<a>Appendix "), (i + 1).cast("string"), F.lit("B</a>"))
    )
    block = F.array_join(labels, " ")
    pages = t.read("pages").select("page_id", F.concat(F.col("html"), block, block).alias("html"))
    return profile.appendix_count(pages, column="html").drop("html")


@query("payload_profile", """
SELECT l_suppkey AS supplier, count(*) AS record_count, 3 AS column_count, arg_min(CAST(CAST(l_shipdate AS DATE) AS VARCHAR), l_orderkey * 10 + l_linenumber) AS first_record_timestamp,
  count(DISTINCT l_partkey) AS locations, min(CAST(l_shipdate AS DATE)) AS date_start, max(CAST(l_shipdate AS DATE)) AS date_end
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1)
GROUP BY l_suppkey""")
def _payload_profile(t: Tables):
    # one payload per supplier; rows of equal order and line number count once
    first = t.read("lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(
        F.min(F.struct("l_shipdate", "l_partkey", "l_quantity")).alias("r")
    )
    rows = first.select(
        F.col("l_suppkey").alias("supplier"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"),
        F.col("r.l_shipdate").cast("date").alias("date"), F.col("r.l_partkey").alias("part"), F.col("r.l_quantity").alias("quantity"),
    )
    return profile.payload_profile(rows, row_no="row_no", group_cols=["supplier"], location_col="part", date_col="date")


_FEED_TABLES = {
    "agency": "(SELECT s_nationkey AS f FROM supplier)", "stops": "(SELECT c_nationkey AS f FROM customer)",
    "routes": "(SELECT p_partkey % 25 AS f FROM part)", "trips": "(SELECT o_orderkey % 25 AS f FROM orders WHERE o_orderkey % 25 <> 7)",
    "stop_times": "(SELECT l_orderkey % 25 AS f FROM lineitem)",
    "calendar": """(SELECT o_custkey % 25 AS f, CASE WHEN o_custkey % 25 = 3 THEN NULL ELSE strftime(o_orderdate, '%Y%m%d') END AS s,
      CASE WHEN o_custkey % 25 = 5 THEN '99999999' ELSE strftime(o_orderdate + INTERVAL 30 DAY, '%Y%m%d') END AS e FROM orders)""",
}
_FEED_COUNTS = " ".join(
    f"LEFT JOIN (SELECT f, count(*) AS n FROM {body} GROUP BY f) {name} ON {name}.f = k.f" for name, body in _FEED_TABLES.items()
)
_MISSING = "concat_ws(', ', " + ", ".join(f"CASE WHEN {name}.n IS NULL THEN '{name}.txt' END" for name in _FEED_TABLES) + ")"


@query("transit_static_profile", f"""
SELECT feed_id, agency, stops, routes, trips, stop_times, calendar,
  CASE WHEN missing = '' AND s IS NULL THEN greatest(agency, stops, routes, trips, stop_times, calendar)
       WHEN missing = '' AND feed_id <> 5 THEN greatest(stops, trips, stop_times) END AS record_count,
  CASE WHEN missing = '' AND feed_id <> 5 THEN CAST(strptime(s, '%Y%m%d') AS DATE) END AS service_start,
  CASE WHEN missing = '' AND feed_id <> 5 THEN CAST(strptime(e, '%Y%m%d') AS DATE) END AS content_freshness_date,
  CASE WHEN missing = '' AND s IS NOT NULL AND feed_id <> 5 THEN 'fresh' ELSE 'degraded' END AS status,
  CASE WHEN missing <> '' THEN 'missing required files: ' || missing WHEN s IS NULL THEN 'calendar.txt has no service dates'
       WHEN feed_id = 5 THEN 'invalid calendar date' ELSE 'valid static feed' END AS message
FROM (SELECT k.f AS feed_id, {', '.join(f'{name}.n AS {name}' for name in _FEED_TABLES)}, {_MISSING} AS missing, d.s, CASE WHEN k.f = 5 THEN NULL ELSE d.e END AS e
      FROM (SELECT unnest(range(25)) AS f) k {_FEED_COUNTS}
      LEFT JOIN (SELECT f, max(s) AS s, max(e) AS e FROM {_FEED_TABLES['calendar']} WHERE s IS NOT NULL GROUP BY f) d ON d.f = k.f)""")
def _transit_static_profile(t: Tables):
    orders = t.read("orders")
    feed, date = F.col("o_custkey") % 25, F.col("o_orderdate")
    tables = {
        "agency": t.read("supplier").select(F.col("s_nationkey").cast("bigint").alias("feed_id")),
        "stops": t.read("customer").select(F.col("c_nationkey").cast("bigint").alias("feed_id")),
        "routes": t.read("part").select((F.col("p_partkey") % 25).alias("feed_id")),
        "trips": orders.where(F.col("o_orderkey") % 25 != 7).select((F.col("o_orderkey") % 25).alias("feed_id")),
        "stop_times": t.read("lineitem").select((F.col("l_orderkey") % 25).alias("feed_id")),
        "calendar": orders.select(
            feed.alias("feed_id"), F.when(feed != 3, F.date_format(date, "yyyyMMdd")).alias("start_date"),
            F.when(feed == 5, "99999999").otherwise(F.date_format(F.date_add(date.cast("date"), 30), "yyyyMMdd")).alias("end_date"),
        ),
    }
    return profile.transit_static_profile(tables)


@query("transit_realtime_profile", f"""
SELECT h.feed_id, coalesce(v.n, 0) AS vehicle_count, CASE WHEN h.header <> 0 THEN h.header END AS header_timestamp, v.newest AS newest_vehicle_timestamp,
  CAST(make_timestamp(coalesce(nullif(h.header, 0), v.past) * 1000000) AS DATE) AS content_freshness_date
FROM (SELECT user_id AS feed_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE max(epoch_us(ts) // 1000000) END AS header FROM events GROUP BY user_id) h
LEFT JOIN (SELECT user_id AS feed_id, count(*) AS n, max(t) FILTER (WHERE t > 0) AS newest, max(t) FILTER (WHERE t > 0 AND t <= epoch(TIMESTAMP '2024-01-20')) AS past
  FROM (SELECT user_id, CASE WHEN event_type = 'signup' THEN 0 ELSE epoch_us(ts) // 1000000 END AS t FROM events WHERE event_type <> 'error') GROUP BY user_id) v ON v.feed_id = h.feed_id""")
def _transit_realtime_profile(t: Tables):
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    events = t.read("events").select(F.col("user_id").alias("feed_id"), "event_type", seconds.alias("t"))
    entities = events.select(
        "feed_id", (F.col("event_type") != "error").alias("vehicle"), F.when(F.col("event_type") == "signup", 0).otherwise(F.col("t")).alias("vehicle_ts")
    )
    headers = events.groupBy("feed_id").agg(F.max("t").alias("t")).select(
        "feed_id", F.when(F.col("feed_id") % 3 == 0, 0).otherwise(F.col("t")).alias("header_ts")
    )
    return profile.transit_realtime_profile(entities, headers, now="2024-01-20 00:00:00")


@query("record_count_estimate", "SELECT doc_id, CASE WHEN n_chars > 16 THEN CAST(ceil((n_chars - 16) / CAST(120 AS DOUBLE)) AS BIGINT) END AS estimated_rows FROM documents")
def _record_count_estimate(t: Tables):
    return t.read("documents").select("doc_id", text.estimated_parquet_rows(F.col("n_chars")).alias("estimated_rows"))


def _signature(kind: str) -> str:
    return f"'shape-v1:' || sha256('{{\"fields\":[[\"k\",{{\"type\":\"{kind}\"}}]],\"type\":\"object\"}}')"


@query("shape_fingerprint", f"""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN {_signature('string')} ELSE {_signature('integer')} END AS shape_hash FROM events""")
def _shape_fingerprint(t: Tables):
    return profile.shape_fingerprint(_varied_props(t), json_col="props").select("event_id", "shape_hash")


def _varied_props(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    as_text = F.concat(F.lit('{"k": "'), k, F.lit('"}'))
    return t.read("events").select(
        "event_id", "event_type", F.when(F.col("event_id") % 7 == 0, as_text).otherwise(F.col("props")).alias("props")
    )


@query("distinct_shapes", f"""
SELECT event_type, CASE WHEN event_id % 7 = 0 THEN {_signature('string')} ELSE {_signature('integer')} END AS shape_hash, count(*) AS rows FROM events GROUP BY 1, 2""")
def _distinct_shapes(t: Tables):
    return profile.distinct_shapes(_varied_props(t), json_col="props", group_cols=["event_type"])


def _kind_sql(value: str) -> str:
    """Type of one text value, and the merged type of all of them."""
    kind = f"""CASE WHEN {value} IS NULL OR {value} = '' THEN NULL WHEN regexp_full_match({value}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ][^ ]+)?') THEN 'date'
      WHEN lower({value}) IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match({value}, '[+-]?[0-9]+') THEN 'integer'
      WHEN regexp_full_match({value}, '[+-]?([0-9]+[.][0-9]*|[0-9]*[.][0-9]+)([Ee][+-]?[0-9]+)?') THEN 'number' ELSE 'string' END"""
    return f"""(SELECT CASE WHEN count(k) = 0 THEN 'string' WHEN bool_and(k IN ('integer', 'number')) THEN max(k) WHEN count(DISTINCT k) = 1 THEN max(k) ELSE 'string' END
      FROM (SELECT {kind} AS k FROM orders) WHERE k IS NOT NULL)"""


_DAY_SQL = "strftime(o_orderdate, '%Y-%m-%d')"
_FIELD_SQL = {
    "o_orderkey": "CAST(o_orderkey AS VARCHAR)", "total": "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)", "day": _DAY_SQL,
    "stamp": f"({_DAY_SQL} || 'T00:00:00Z')", "flag": "CASE WHEN o_orderkey % 2 = 0 THEN 'TRUE' ELSE 'false' END", "blank": "''",
    "o_orderpriority": "o_orderpriority", "mixed": "CASE WHEN o_orderkey % 2 = 0 THEN '12' ELSE '-1.5e3' END",
    "mixture": f"CASE WHEN o_orderkey % 2 = 0 THEN {_DAY_SQL} ELSE '7' END", "native": "CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS VARCHAR)",
}


@query("infer_fields", " UNION ALL ".join(
    f"SELECT {i} AS position, '{name}' AS name, {_kind_sql(value)} AS type" for i, (name, value) in enumerate(_FIELD_SQL.items())))
def _infer_fields(t: Tables):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    even = F.col("o_orderkey") % 2 == 0
    rows = t.read("orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("total"), day.alias("day"),
        F.concat(day, F.lit("T00:00:00Z")).alias("stamp"), F.when(even, "TRUE").otherwise("false").alias("flag"),
        F.lit("").alias("blank"), "o_orderpriority", F.when(even, "12").otherwise("-1.5e3").alias("mixed"),
        F.when(even, day).otherwise("7").alias("mixture"), F.col("o_totalprice").alias("native"),
    )
    return profile.infer_fields(rows)


@query("min_max_date", f"""
SELECT o_orderstatus, 'max' AS mode, max(strftime(o_orderdate, '%Y-%m-%d')) FILTER (WHERE o_orderdate <= DATE '1999-06-30') AS content_date FROM orders GROUP BY 1
UNION ALL SELECT o_orderstatus, 'min', min(strftime(o_orderdate, '%Y-%m-%d')) FROM orders GROUP BY 1""")
def _min_max_date(t: Tables):
    rows = t.read("orders").select(
        "o_orderstatus", F.to_json(F.struct(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("date")).alias("meta"))).alias("row")
    )
    value = F.get_json_object("row", "$.meta.date")
    parts = [
        profile.min_max_date(rows, value=value, mode=mode, today="1999-06-30", group_cols=["o_orderstatus"]).withColumn("mode", F.lit(mode))
        for mode in ("max", "min")
    ]
    return reduce(DataFrame.unionByName, parts)


_DAYS = "(DATE '2023-06-01' + CAST(doc_id % 500 AS INTEGER))"
_MONTH_NAMES = list({number: name for name, number in params.MONTHS.items()}.values())  # the last name of each


def _dated_documents(t: Tables) -> DataFrame:
    """Documents with an ISO date, a written earlier date and an impossible date added to the whole text."""
    day = F.date_add(F.lit("2023-06-01").cast("date"), (F.col("doc_id") % 500).cast("int"))
    before = F.date_sub(day, 40)
    names = F.array(*[F.lit(name) for name in _MONTH_NAMES])
    month = F.element_at(names, F.month(before))
    written = F.when(
        F.col("doc_id") % 2 == 0, F.concat_ws(" ", F.dayofmonth(before), month, F.year(before))
    ).otherwise(F.concat(F.initcap(month), F.lit(" "), F.dayofmonth(before), F.lit(", "), F.year(before)))
    return t.read("documents").select(
        "doc_id", "source",
        F.concat(F.col("text"), F.lit(" issued "), F.date_format(day, "yyyy-MM-dd"), F.lit("; revised "), written, F.lit("; 2023-02-30 void")).alias("text"),
    )


@query("extract_text_dates", f"""
SELECT doc_id, CASE WHEN {_DAYS} <= {TODAY} THEN {_DAYS} WHEN {_DAYS} - 40 <= {TODAY} THEN {_DAYS} - 40 ELSE {_DAYS} END AS content_date, {_DAYS} - 40 AS earliest FROM documents""")
def _extract_text_dates(t: Tables):
    rows = _dated_documents(t).select("doc_id", dates.text_dates(F.col("text")).alias("found"))
    today = times.lit_day(_TODAY)
    return rows.select(
        "doc_id", dates.pick_date(F.col("found"), today).alias("content_date"),
        dates.pick_date(F.col("found"), today, mode="min").alias("earliest"),
    )


@query("date_of_documents", f"""
SELECT source, coalesce(max(d) FILTER (WHERE d <= {TODAY}), max(d)) AS content_date FROM (SELECT source, unnest([{_DAYS}, {_DAYS} - 40]) AS d FROM documents) GROUP BY source""")
def _date_of_documents(t: Tables):
    return profile.date_of_documents(_dated_documents(t), column="text", today=_TODAY, group_cols=["source"])


_PAGE_PATTERN = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"
_PAGE_DAY = "(DATE '2023-12-01' + CAST(page_id % 120 AS INTEGER))"


@query("extract_page_dates", f"""
SELECT page_id, CASE WHEN {_PAGE_DAY} <= {TODAY} THEN {_PAGE_DAY} ELSE CASE WHEN {_PAGE_DAY} - 75 <= {TODAY} THEN {_PAGE_DAY} - 75 END END AS content_date, 1 + page_id % 4 AS station_rows FROM pages""")
def _extract_page_dates(t: Tables):
    day = F.date_add(F.lit("2023-12-01").cast("date"), (F.col("page_id") % 120).cast("int"))
    lines = F.array_join(F.array_repeat(F.lit('row "12 Kuala'), (1 + F.col("page_id") % 4).cast("int")), "\n")
    body = F.concat(F.col("html"), F.lit("\n"), lines, F.lit("\n"), F.date_format(day, "yyyy-MM-dd"), F.lit(" 31/02/2024 "), F.date_format(F.date_sub(day, 75), "d/M/yyyy"))
    return t.read("pages").select("page_id", body.alias("body")).select(
        "page_id", dates.page_date(F.col("body"), _PAGE_PATTERN, times.lit_day(_TODAY)).alias("content_date"),
        dates.matching_lines(F.col("body"), r'row "[0-9]+ [A-Z]').alias("station_rows"),
    )


@query("extract_embedded_json", """
SELECT page_id, CASE WHEN page_id % 4 < 2 THEN DATE '2023-12-01' + CAST(page_id % 300 AS INTEGER) END AS data_as_of FROM pages""")
def _extract_embedded_json(t: Tables):
    day = F.date_format(F.date_add(F.lit("2023-12-01").cast("date"), (F.col("page_id") % 300).cast("int")), "yyyy-MM-dd")
    stamp = F.when(F.col("page_id") % 4 == 2, day).otherwise(F.concat(day, F.lit(" 08:30")))
    payload = F.concat(F.lit('{"props":{"pageProps":{"data_as_of":"'), stamp, F.lit('"}}}'))
    opening = F.when(F.col("page_id") % 4 == 0, "<script id=\"__NEXT_DATA__\" type=\"application/json\">").when(
        F.col("page_id") % 4 == 3, "<script id=\"other\">").otherwise("<SCRIPT defer id='__NEXT_DATA__'>")
    html = F.concat(F.col("html"), opening, payload, F.lit("</script >"))
    return t.read("pages").select("page_id", dates.embedded_page_date(html).alias("data_as_of"))


@query("detect_date_column", """
SELECT 'ship_date' AS "column", count(DISTINCT strftime(l_shipdate, '%Y-%m-%d')) AS distinct_values, max(strftime(l_shipdate, '%Y-%m-%d')) AS max_date FROM lineitem""")
def _detect_date_column(t: Tables):
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    rows = t.read("lineitem").select(
        F.date_format(F.trunc("l_shipdate", "year"), "yyyy-MM-dd").alias("year"), day.alias("ship_date"), day.alias("date_again"),
        F.concat(day, F.lit("Z")).alias("updated_at"), F.when(F.col("l_linenumber") > 1, day).alias("date_gap"), day.alias("plain"),
    )
    return profile.detect_date_column(rows)


@query("render_dated_path", """
SELECT o_orderkey, 'lake/prices_' || strftime(o_orderdate, '%Y-%m') || '.parquet' AS monthly, 'lake/rail_' || strftime(o_orderdate, '%Y') || '_daily.csv' AS yearly FROM orders""")
def _render_dated_path(t: Tables):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.read("orders").select(
        "o_orderkey", times.render_dated_path("lake/prices_{YYYY-MM}.parquet", day).alias("monthly"),
        times.render_dated_path("lake/rail_{YYYY}_daily.csv", day).alias("yearly"),
    )
