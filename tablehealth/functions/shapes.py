"""Value-insensitive structure fingerprints."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tablehealth import params

_LEAVES = {bool: "boolean", int: "integer", float: "number", str: "string", type(None): "null"}


def _signature(value: object) -> str:
    """Canonical JSON text of a value's type, written directly."""
    leaf = _LEAVES.get(type(value))
    if leaf is not None:
        return f'{{"type":"{leaf}"}}'
    if isinstance(value, dict):
        fields = ",".join(f"[{json.dumps(key)},{_signature(value[key])}]" for key in sorted(value))
        return f'{{"fields":[{fields}],"type":"object"}}'
    items = ",".join(sorted({_signature(item) for item in value}))
    return f'{{"items":[{items}],"type":"array"}}'


def _digest(signature: str) -> str:
    return params.SHAPE_PREFIX + hashlib.sha256(signature.encode()).hexdigest()


def json_fingerprint(text: str | None) -> str | None:
    """Fingerprint of one JSON text; null for null or unusable text."""
    if text is None:
        return None
    try:
        return _digest(_signature(json.loads(text)))
    except (ValueError, RecursionError):  # the latter: nested too deeply to be read
        return None


@F.pandas_udf(StringType())
def json_shape(texts: pd.Series) -> pd.Series:
    """Exact nested fingerprint per row: Spark's schema functions merge array item types."""
    distinct = texts.drop_duplicates()
    return texts.map(dict(zip(distinct, distinct.map(json_fingerprint))))


def header_fingerprint(names: list[str]) -> str:
    """Fingerprint of a table's column names in their order."""
    trimmed = [name.strip() for name in names]
    if trimmed:
        trimmed[0] = trimmed[0].lstrip("﻿")
    headers = ",".join(json.dumps(name) for name in trimmed)
    return _digest(f'{{"headers":[{headers}],"type":"csv"}}')
