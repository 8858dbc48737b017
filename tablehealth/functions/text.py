"""Text keys, licences, names and canonical JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablehealth import params
from tablehealth.functions.cadence import lookup


def occurrences(text: Column, term: str | Column) -> Column:
    """Non-overlapping occurrences of a literal term."""
    needle = term if isinstance(term, Column) else F.lit(term)
    removed = F.replace(text, needle, F.lit(""))
    return F.floor((F.length(text) - F.length(removed)) / F.length(needle))


def squash(text: Column) -> Column:
    """Lower case, single spaces, no outer spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def normalise_words(text: Column) -> Column:
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " ")
    return F.trim(words)


def semantic_title(text: Column) -> Column:
    return normalise_words(F.regexp_replace(F.coalesce(text, F.lit("")), params.PUBLISHER_PREFIX, ""))


# scheme, authority, path, query and fragment of a URL, the generic RFC 3986 split
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def endpoint_channel(url: Column) -> Column:
    """Lower-case network location (host and port); empty when there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def _form_encode(text: Column) -> Column:
    """Decode then re-encode one query part, so equal parts get equal bytes."""
    decoded = F.coalesce(F.try_url_decode(text), text)
    return F.replace(F.replace(F.url_encode(decoded), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Equality key of an http(s) URL; empty for anything else.

    Lower-case scheme and host, no trailing slash, query parts sorted by
    (name, value) with blanks kept, no fragment.
    """
    text = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(text, _URL, 1))
    host = F.lower(F.regexp_extract(text, _URL, 2))
    path = F.rtrim(F.regexp_extract(text, _URL, 3), F.lit("/"))
    raw_query = F.regexp_extract(text, _URL, 4)
    parts = F.filter(F.split(raw_query, "&"), lambda part: part != "")
    pairs = F.array_sort(
        F.transform(
            parts,
            lambda part: F.struct(
                _form_encode(F.substring_index(part, "=", 1)).alias("name"),
                _form_encode(
                    F.when(F.contains(part, F.lit("=")), F.substr(part, F.instr(part, "=") + 1)).otherwise("")
                ).alias("value"),
            ),
        )
    )
    query = F.array_join(F.transform(pairs, lambda pair: F.concat(pair["name"], F.lit("="), pair["value"])), "&")
    whole = F.concat(
        scheme, F.lit("://"), host,
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(scheme.isin("http", "https") & (host != ""), whole).otherwise("")


def granularity_signature(dataset_id: Column, name: Column) -> Column:
    """Ordered granularity terms found among the words of id and name."""
    words = F.split(
        normalise_words(F.concat_ws(" ", F.coalesce(dataset_id, F.lit("")), F.coalesce(name, F.lit("")))), " "
    )
    terms = F.array(*[F.lit(term) for term in params.GRANULARITY_TERMS])
    return F.array_intersect(terms, words)


def availability_class(status: Column) -> Column:
    value = F.lower(F.coalesce(status, F.lit("")))
    return (
        F.when(value.isin("fresh", "aging", "stale", "unknown-freshness", "reference"), "available")
        .when(value.isin("degraded", "unavailable", "discontinued"), "failed")
        .otherwise("unknown")
    )


def canonical_licence(licence: Column) -> Column:
    trimmed = F.trim(licence)
    return F.coalesce(lookup(F.lower(trimmed), params.LICENCE_ALIASES), trimmed)


def licence_url(licence: Column) -> Column:
    return lookup(licence, params.LICENCE_URLS)


def display_name(dataset_id: Column, *names: Column) -> Column:
    """First non-empty name; otherwise the id in title case."""
    fallback = F.initcap(F.regexp_replace(dataset_id, "[_-]", " "))
    return F.coalesce(*[F.when(name != "", name) for name in names], fallback)


def display_status(status: Column) -> Column:
    text = F.replace(status, F.lit("-"), F.lit(" "))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def canonical_json(fields: Mapping[str, Column] | Sequence[tuple[str, Column]]) -> Column:
    """Compact JSON with sorted keys and nulls kept; nested structs must be sorted too."""
    items = sorted(dict(fields).items())
    return F.to_json(
        F.struct(*[value.alias(name) for name, value in items]), {"ignoreNullFields": "false"}
    )


def sha256_text(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def chain_digest(previous_hex: Column, payload: Column) -> Column:
    """sha256 over the previous head's 32 bytes followed by the payload text."""
    return F.sha2(F.concat(F.unhex(previous_hex), F.encode(payload, "UTF-8")), 256)


def sanitise_args(args: Column, *, limit: int = 200) -> Column:
    """Mask credential-shaped keys and bound the length of every value of a string map."""
    secret = r"(?i)api_key|token"
    return F.transform_values(
        args,
        lambda key, value: F.when(key.rlike(secret), F.lit("[REDACTED]")).otherwise(F.substring(value, 1, limit)),
    )


def estimated_parquet_rows(size_bytes: Column) -> Column:
    """Row estimate from a file size, null when the file cannot hold a row."""
    overhead, per_row = params.PARQUET_OVERHEAD_BYTES, params.PARQUET_BYTES_PER_ROW
    return F.when(size_bytes > overhead, F.ceil((size_bytes - overhead) / per_row).cast("bigint"))
