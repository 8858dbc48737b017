"""Named queries over the shared test tables, each with its SQL check where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehealth.plans.bindings import Tables
from tablehealth.plans.oracle import with_tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may refer to the derived tables of ``oracle.py``."""
    def register(build: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query registered twice: {name}")
        _QUERIES[name] = build
        if sql is not None:
            _SQL[name] = with_tables(sql)
        return build
    return register


def present(df: DataFrame) -> DataFrame:
    """Timestamps without zone, so that results read the same under any client time zone."""
    return df.select(*[
        F.col(f"`{name}`").cast("timestamp_ntz").alias(name) if kind == "timestamp" else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ])


def _load() -> None:
    from tablehealth.plans import (  # noqa: F401
        queries_catalog, queries_changes, queries_history, queries_payload, queries_ranked, queries_state, queries_trust,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def runner(build):
        return lambda spark, directory: present(build(Tables(spark, directory)))

    return {name: runner(build) for name, build in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
