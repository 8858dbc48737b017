"""Hash-linked daily attestations (digests only; signing is out of scope)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablehealth import params
from tablehealth.functions import times
from tablehealth.functions.text import canonical_json, chain_digest, sha256_text

#: Hex digits of a row's place in the digest tree, by level: 16.7 million leaves, then 4096 and one.
LEVELS = (6, 3, 0)


def ordered_digest(
    rows: DataFrame, keys: list[str], order: str, item: str, *, opening: str = "", separator: str = "", closing: str = "",
) -> DataFrame:
    """(keys, rows, digest): one sha256 per group over all its item texts, by the same tree for every number of rows.

    A row's place is the start of the hash of its order value. A leaf's digest covers opening + its items in order, joined
    by the separator, + closing; a node's covers its children's digests in the order of their places, of which there are
    at most 4096. So no task gathers a group: a leaf holds a 16.7-millionth of it.
    """
    def gathered(value: str, by: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.struct(F.col(by).alias("o"), F.col(value).alias("i"))))
        return F.transform(pairs, lambda pair: pair["i"])

    place = sha256_text(F.col(order).cast("string"))
    placed = rows.select(*keys, F.col(order).alias("_order"), F.col(item).alias("_item"), F.substring(place, 1, LEVELS[0]).alias("_place"))
    level = placed.groupBy(*keys, "_place").agg(
        F.count("*").alias("rows"),
        sha256_text(F.concat(F.lit(opening), F.array_join(gathered("_item", "_order"), separator), F.lit(closing))).alias("digest"),
    )
    for digits in LEVELS[1:]:
        above = level.withColumn("_above", F.substring("_place", 1, digits))
        level = above.groupBy(*keys, F.col("_above")).agg(
            F.sum("rows").alias("rows"), sha256_text(F.array_join(gathered("digest", "_place"), "")).alias("digest")
        ).withColumnRenamed("_above", "_place")
    return level.drop("_place")


def _zulu(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def attestation_links(
    catalog: DataFrame,
    snapshot: DataFrame,
    counts: DataFrame,
    *,
    day,
    previous_head: str | None = None,
    previous_heads: DataFrame | None = None,
    key_id: str = "",
    public_key: str = "",
) -> DataFrame:
    """One payload and link per dataset; every dataset of a day hangs off the same previous head.

    The previous head is a value, or a table (``date``, ``chain_head``) whose row of
    the preceding day is used, which keeps a backfill lazy. Genesis otherwise.
    """
    run_day = times.lit_day(day)
    health = snapshot.select(
        "dataset_id", "last_checked", "checked_at", "request_url", "access_dependency", "status",
        F.col("staleness_days").cast("bigint").alias("staleness_days"), "first_row_hash",
    )
    rows = (
        catalog.select("dataset_id", F.col("url").alias("source_url"))
        .join(health, "dataset_id", "left")
        .join(counts, "dataset_id", "left")
        .withColumn("date", run_day)
    )
    if previous_heads is not None:
        prior = previous_heads.select(F.date_add("date", 1).alias("date"), F.col("chain_head").alias("previous_chain_head"))
        rows = rows.join(prior, "date", "left").withColumn(
            "previous_chain_head", F.coalesce("previous_chain_head", F.lit(params.GENESIS))
        )
    else:
        rows = rows.withColumn("previous_chain_head", F.lit(previous_head or params.GENESIS))
    observed = F.coalesce("last_checked", "checked_at")
    browser = F.coalesce(F.col("access_dependency") == "browser", F.lit(False))
    fingerprint = F.when(
        F.col("first_row_hash") != "",
        F.struct(
            F.lit("shape-v1:sha256").alias("scheme"), F.lit("first-row-or-headers").alias("scope"),
            F.col("first_row_hash").alias("value"),
        ),
    )
    payload = canonical_json({
        "access_dependency": F.coalesce("access_dependency", F.lit("direct")),
        "browser_receipt": F.struct(
            F.lit(False).alias("available"),
            F.when(browser, "probe runner emitted no signed receipt").alias("reason"),
        ),
        "content_fingerprint": fingerprint,
        "dataset_id": F.col("dataset_id"),
        "date": F.date_format("date", "yyyy-MM-dd"),
        "key_id": F.lit(key_id),
        "last_staleness_days": F.col("staleness_days"),
        "last_status": F.col("status"),
        "observed_at": _zulu(observed),
        "observed_request_url": F.col("request_url"),
        "previous_chain_head": F.col("previous_chain_head"),
        "probe_count_14d": F.coalesce("probe_count_14d", F.lit(0)),
        "probe_count_24h": F.coalesce("probe_count_24h", F.lit(0)),
        "schema": F.lit("probe-attestation/v1"),
        "signer_pubkey_base64": F.lit(public_key),
        "source_url": F.col("source_url"),
    })
    return rows.withColumn("payload", payload).select(
        "date", "dataset_id", observed.alias("observed_at"), "previous_chain_head", "payload",
        chain_digest(F.col("previous_chain_head"), F.col("payload")).alias("chain_link"),
    )


def _link_digests(links: DataFrame) -> DataFrame:
    item = canonical_json({"chain_link": F.col("chain_link"), "dataset_id": F.col("dataset_id")})
    return ordered_digest(
        links.withColumn("_item", item), ["date"], "dataset_id", "_item",
        opening="[", separator=",", closing="]",
    )


def _head_payload(key_id: Column) -> Column:
    return canonical_json({
        "dataset_count": F.col("rows"),
        "dataset_links_sha256": F.col("digest"),
        "date": F.date_format("date", "yyyy-MM-dd"),
        "key_id": key_id,
        "previous_chain_head": F.col("previous_chain_head"),
        "schema": F.lit("daily-chain-head/v1"),
    })


def daily_chain_head(links: DataFrame, *, key_id: str = "") -> DataFrame:
    """The head of each day present in ``links``."""
    previous = links.groupBy("date").agg(F.any_value("previous_chain_head").alias("previous_chain_head"))
    rows = _link_digests(links).join(previous, "date").withColumn("payload", _head_payload(F.lit(key_id)))
    return rows.select(
        "date", "previous_chain_head", F.col("rows").alias("dataset_count"),
        F.col("digest").alias("dataset_links_sha256"), "payload",
        chain_digest(F.col("previous_chain_head"), F.col("payload")).alias("chain_head"),
    )


def verify_chain(links: DataFrame, heads: DataFrame, *, anchors: DataFrame | None = None) -> DataFrame:
    """Recompute every link, link digest and head, and follow the heads back.

    One row per day: whether its links, its digest and its own head hold, how its
    previous head is found (genesis, the head of an earlier day, or missing), and
    whether the unbroken run of valid days reaches an anchor. Days are few, so
    following the heads is a window over days; everything per dataset is parallel.
    """
    per_day = links.groupBy("date").agg(
        F.count_if(
            ~F.col("chain_link").eqNullSafe(chain_digest(F.col("previous_chain_head"), F.col("payload")))
        ).alias("bad_links"),
        F.min("previous_chain_head").alias("_low"),
        F.max("previous_chain_head").alias("_high"),
    )
    digests = _link_digests(links).select("date", F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
    known = heads.select(F.col("chain_head").alias("_known"), F.col("date").alias("_known_date"))
    rows = (
        heads.join(per_day, "date", "left").join(digests, "date", "left")
        .join(known, (F.col("previous_chain_head") == F.col("_known")) & (F.col("_known_date") < F.col("date")), "left")
    )
    if anchors is None:
        rows = rows.withColumn("_anchored", F.col("previous_chain_head") == params.GENESIS)
    else:
        marks = anchors.select(F.col("chain_head").alias("_anchor"))
        rows = rows.join(marks, F.col("chain_head") == F.col("_anchor"), "left").withColumn(
            "_anchored", F.col("_anchor").isNotNull()
        )
    links_valid = (
        (F.col("bad_links") == 0) & (F.col("_low") == F.col("_high")) & (F.col("_low") == F.col("previous_chain_head"))
    )
    digest_valid = F.col("dataset_links_sha256").eqNullSafe(F.col("_digest")) & (F.col("dataset_count") == F.col("_rows"))
    head_valid = F.col("chain_head").eqNullSafe(chain_digest(F.col("previous_chain_head"), F.col("payload"))) & (
        F.get_json_object("payload", "$.dataset_links_sha256") == F.col("dataset_links_sha256")
    )
    genesis = F.col("previous_chain_head") == params.GENESIS
    rows = rows.select(
        "date", "chain_head", "previous_chain_head",
        F.coalesce(links_valid, F.lit(False)).alias("links_valid"),
        F.coalesce(digest_valid, F.lit(False)).alias("digest_valid"),
        F.coalesce(head_valid, F.lit(False)).alias("head_valid"),
        F.when(genesis, "genesis").when(F.col("_known").isNotNull(), "linked").otherwise("missing").alias("previous"),
        "_anchored",
    ).withColumn("_ok", F.col("links_valid") & F.col("digest_valid") & F.col("head_valid"))
    by_day = Window.orderBy("date")  # one row per day
    follows = F.lag("chain_head").over(by_day) == F.col("previous_chain_head")
    breaks = F.when(F.col("_ok") & F.coalesce(follows, F.lit(True)), 0).otherwise(1)
    rows = rows.withColumn("_break", breaks).withColumn("_breaks", F.sum("_break").over(by_day))
    anchor_breaks = F.last(F.when(F.col("_anchored") & F.col("_ok"), F.col("_breaks")), ignorenulls=True).over(by_day)
    replayed = F.coalesce(anchor_breaks == F.col("_breaks"), F.lit(False)) & F.col("_ok")
    reason = (
        F.when(~F.col("links_valid"), "a link or its previous head is invalid")
        .when(~F.col("digest_valid"), "the digest of the day's links differs")
        .when(~F.col("head_valid"), "the daily head is invalid")
        .when(F.col("previous") == "missing", "the previous daily head is not known")
        .when(~F.col("replayed"), "the chain is broken before an anchor")
        .otherwise("daily heads replay to an anchor")
    )
    return rows.withColumn("replayed", replayed).select(
        "date", "chain_head", "links_valid", "digest_valid", "head_valid", "previous", "replayed", reason.alias("reason")
    )


def cycle_digest(history: DataFrame, *, columns: list[str]) -> DataFrame:
    """Digest per cycle over its rows as JSON lines in dataset order."""
    line = F.concat(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), F.lit("\n"))
    return ordered_digest(
        history.withColumn("_line", line), ["cycle"], "dataset_id", "_line"
    )


#: Order of a registry's entries for one key: the last of those that have begun holds.
_ENTRY = ("not_before", "not_after", "public_key", "algorithm", "status", "compromised_at")


def key_validity(attestations: DataFrame, registry: DataFrame) -> DataFrame:
    """Attestations with the registry entry of their key that holds at ``observed_at``; one row each.

    Input columns: ``key_id, public_key, observed_at`` against ``key_id, public_key, not_before, not_after, algorithm,
    status, compromised_at``. A key id may be listed many times, with intervals that repeat or overlap. The entry with the
    latest start at or before the instant holds; of equal starts the one that ends last, then the greatest in the order of
    the other columns (nulls least). If none has begun, or the instant is null, the first entry stands for the key, so that its
    public key is still compared; its interval doesn't hold.

    The entries of a key become one sorted list, so a key that signs most attestations multiplies no rows.
    """
    entries = registry.groupBy(F.col("key_id").alias("_key_id")).agg(F.array_sort(F.collect_set(F.struct(*_ENTRY))).alias("_entries"))
    begun = F.filter("_entries", lambda e: e["not_before"] <= F.col("observed_at"))
    joined = attestations.join(entries, F.col("key_id") == F.col("_key_id"), "left").withColumn("_begun", begun)
    held = F.coalesce(F.try_element_at("_begun", F.lit(-1)), F.try_element_at("_entries", F.lit(1)))
    joined = joined.withColumn("_entry", held)
    entry = F.col("_entry")
    in_time = F.coalesce(F.col("observed_at").between(entry["not_before"], entry["not_after"]), F.lit(False))
    match = F.coalesce(F.col("public_key") == entry["public_key"], F.lit(False))
    sound = (
        (F.coalesce(entry["algorithm"], F.lit("Ed25519")) == "Ed25519")
        & (F.coalesce(entry["status"], F.lit("")) != "compromised")
        & entry["compromised_at"].isNull()
    )
    return joined.select(
        *attestations.columns,
        match.alias("key_registry_match"), in_time.alias("key_time_valid"),
        (match & in_time & sound & F.col("_key_id").isNotNull()).alias("key_valid"),
    )
