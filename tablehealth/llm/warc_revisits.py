"""Not-modified revisits of a web archive, resolved by an as-of join on the canonical URL.

A ``revisit`` record (status 304) stands for the latest earlier full response of its canonical URL. If its validators
agree with that response's, it is resolved: it gets the response's payload and headers, with those headers that a
304 response may change taken from the revisit.

The as-of join has two levels, so that one URL with a third of all records is no single task. Records without payloads are
dealt out by ranges of (URL, time); inside a range the latest response is a running maximum; the best of each
range and URL is then carried to the ranges after it. A URL has at most one such row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablehealth.session import stored

# The header fields that a 304 response carries to update a stored response, and query parameters that
# only track visitors.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid|sessionid)(=|$)"

RECORDS = "record_id bigint, record_type string, url string, at timestamp, status int, headers map<string,string>, payload string"


def canonical(url: Column) -> Column:
    """Host in lower case without www. and default port, path without trailing slashes, sorted query without tracking; no scheme or fragment."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), r"^www\d*\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    joined = F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))
    return F.when(host != "", joined)


def header_map(headers: Column) -> Column:
    """Names in lower case; of names that differ only in case, the last one's value. Null is empty."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def latest_responses(records: DataFrame) -> DataFrame:
    """(record_id, key, at, etag, modified, found): each dated revisit with the latest earlier full response, or null.

    Earlier is strictly earlier; of responses at the same time the one with the largest record_id counts.
    """
    headers = header_map(F.col("headers"))
    light = records.select("record_id", canonical(F.col("url")).alias("key"), F.unix_micros("at").alias("at"), (F.col("record_type") == "revisit").alias("revisit"),
                           ((F.col("record_type") == "response") & (F.col("status") == 200)).alias("full"),
                           headers["etag"].alias("etag"), headers["last-modified"].alias("modified"))
    usable = light.where(F.col("key").isNotNull() & F.col("at").isNotNull() & (F.col("revisit") | F.col("full")))
    ranged = stored(usable.repartitionByRange("key", "at").withColumn("range", F.spark_partition_id()))
    response = F.when(F.col("full"), F.struct("at", "record_id", "etag", "modified"))
    before = Window.partitionBy("range", "key").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    inside = ranged.select("record_id", "key", "at", "revisit", "etag", "modified", "range", F.max(response).over(before).alias("own")).where("revisit")
    best = ranged.where("full").groupBy("key", "range").agg(F.max(response).alias("best"))
    # (range, key) pairs with a record, and the best response of the key in the ranges before
    pairs = ranged.select("key", "range").distinct().join(best, ["key", "range"], "left")
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = pairs.select("key", "range", F.max("best").over(earlier).alias("carried")).where("carried is not null")
    return inside.join(carried, ["key", "range"], "left").select("record_id", "key", "at", "etag", "modified", F.coalesce("own", "carried").alias("found"))


def resolve(records: DataFrame) -> DataFrame:
    """Every revisit record: record_id, url, at, refers_to, verdict, headers, payload.

    ``records`` has the columns of ``RECORDS``; others are ignored. Verdicts: ``resolved`` (an entity tag, else a
    modification time, is on both sides and equal), ``mismatch``, ``unverified`` (no validator on both sides),
    ``no_earlier_response``, ``no_url``, ``no_date``. Unresolved records keep their own headers and a null payload.
    Of responses that repeat an id, the one with the smallest payload serves; revisits are resolved each. An empty table gives
    an empty result.
    """
    own = records.where(F.col("record_type") == "revisit").select("record_id", "url", "at", header_map(F.col("headers")).alias("own"))
    own = own.withColumn("key", canonical(F.col("url"))).withColumn("micros", F.unix_micros("at"))
    found = latest_responses(records).withColumnRenamed("at", "micros").dropDuplicates(["record_id", "key", "micros"])
    joined = own.join(found, ["record_id", "key", "micros"], "left")
    tags, times = (F.col("etag"), F.col("found.etag")), (F.col("modified"), F.col("found.modified"))
    verdict = (
        F.when(F.col("key").isNull(), "no_url").when(F.col("at").isNull(), "no_date").when(F.col("found").isNull(), "no_earlier_response")
        .when(tags[0].isNotNull() & tags[1].isNotNull(), F.when(_weak(tags[0]) == _weak(tags[1]), "resolved").otherwise("mismatch"))
        .when(times[0].isNotNull() & times[1].isNotNull(), F.when(times[0] == times[1], "resolved").otherwise("mismatch")).otherwise("unverified"))
    judged = joined.select("record_id", "url", "at", "own", verdict.alias("verdict"), F.col("found.record_id").alias("refers_to"))
    full = records.where((F.col("record_type") == "response") & (F.col("status") == 200)).select(
        F.col("record_id").alias("refers_to"), header_map(F.col("headers")).alias("stored"), "payload")
    # a map can't be compared, so repeated ids are told apart by the payload alone
    # written first, so that the join below can be split where many revisits refer to one response
    full = stored(full.groupBy("refers_to").agg(F.min_by(F.struct("stored", "payload"), F.coalesce("payload", F.lit(""))).alias("full")))
    merged = judged.join(full, "refers_to", "left")
    good = F.col("verdict") == "resolved"
    update = F.map_filter("own", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter("full.stored", lambda k, v: ~F.array_contains(F.map_keys(update), k))
    return merged.select(
        "record_id", "url", "at", "refers_to", "verdict", F.when(good, F.map_concat(kept, update)).otherwise(F.col("own")).alias("headers"),
        F.when(good, F.col("full.payload")).alias("payload"))


def crawl_of(pages: DataFrame) -> DataFrame:
    """The records of a crawl of ``pages`` (page_id, url, html) and of its repetition, one response and one revisit a page.

    Page n is fetched at minute n, and again, with the validators of the first time, at minute n + 1000, when another
    page of the same URL may have come between.
    """
    start = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60)
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    first = pages.select(
        F.col("page_id").alias("record_id"), F.lit("response").alias("record_type"), "url", start.alias("at"), F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length("html").cast("string"),
                     F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"), F.col("html").alias("payload"))
    again = pages.select(
        (-F.col("page_id") - 1).alias("record_id"), F.lit("revisit").alias("record_type"), "url", F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("page_id") + 1000) * 60).alias("at"),
        F.lit(304).alias("status"), F.create_map(F.lit("etag"), tag, F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=600")).alias("headers"),
        F.lit(None).cast("string").alias("payload"))
    return first.union(again)
