"""Refresh-frequency text to scheduling and freshness numbers.

Four readings of the same text exist on purpose: anomaly and trend accept
prefixes, the snapshot rounds the sub-daily values, record evidence counts whole
days, and the scheduling policy accepts a closed list only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablehealth import params


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """Equality lookup in a small fixed table, as one CASE expression."""
    result = None
    for value, mapped in table.items():
        literal = F.lit(mapped)
        result = F.when(key == value, literal) if result is None else result.when(key == value, literal)
    return result if default is None else result.otherwise(default)


def cadence_days(frequency: Column) -> Column:
    """Expected days between updates (anomaly, trend); null when not mapped."""
    text = F.lower(frequency)
    return (
        F.when(text.startswith("daily"), F.lit(1.0))
        .when(text.startswith("survey-year") | text.startswith("biennial"), F.lit(730.0))
        .otherwise(lookup(text, params.CADENCE_DAYS))
    )


def snapshot_cadence_days(frequency: Column) -> Column:
    text = F.lower(frequency)
    return (
        F.when(text.startswith("daily"), F.lit(1.0))
        .when(text.startswith("biennial"), F.lit(730.0))
        .otherwise(lookup(text, params.SNAPSHOT_CADENCE_DAYS))
    )


def evidence_window_days(dataset_id: Column, frequency: Column) -> Column:
    return F.when(
        dataset_id == params.REGISTRY_DATASET, F.lit(params.REGISTRY_WINDOW_DAYS)
    ).otherwise(lookup(frequency, params.EVIDENCE_CADENCE_DAYS))


def policy_frequency(frequency: Column, dataset_id: Column | None = None, *, strict: bool = True) -> Column:
    """Trimmed lower-case frequency from the closed list; otherwise an error, or null if not strict."""
    text = F.lower(F.trim(frequency))
    allowed = [name for names in params.TIER_MEMBERS.values() for name in names]
    known = F.when(text.isin(allowed), text)
    if not strict:
        return known
    label = F.lit("<unknown>") if dataset_id is None else F.coalesce(dataset_id, F.lit("<unknown>"))
    message = F.concat(
        F.lit("dataset "), label, F.lit(" has unsupported refresh_frequency "),
        F.coalesce(frequency, F.lit("null")),
    )
    return F.coalesce(known, F.raise_error(message).cast("string"))


def cadence_tier(frequency: Column) -> Column:
    tier = None
    for name, members in params.TIER_MEMBERS.items():
        match = frequency.isin(list(members))
        tier = F.when(match, F.lit(name)) if tier is None else tier.when(match, F.lit(name))
    return tier


def due_seconds(frequency: Column) -> Column:
    return F.when(
        frequency.isin(list(params.WEEKDAY_DAILY)), F.lit(params.WEEKDAY_DAILY_DUE_SECONDS)
    ).otherwise(lookup(cadence_tier(frequency), params.TIER_DUE_SECONDS))


def baseline_seconds(frequency: Column) -> Column:
    daily = F.when(frequency.isin(list(params.WEEKDAY_DAILY)), F.lit("daily")).otherwise(frequency)
    return lookup(daily, params.BASELINE_SECONDS)


def reliability_grade(on_time_pct: Column) -> Column:
    grade = F.when(on_time_pct.isNull(), F.lit("insufficient_data"))
    for name, floor in params.GRADE_FLOORS:
        grade = grade.when(on_time_pct >= floor, F.lit(name))
    return grade.otherwise(F.lit("F"))


def grade_rank(grade: Column) -> Column:
    """0 for A up to 4 for F; null for an unevaluated grade."""
    return lookup(grade, {name: rank for rank, name in enumerate(params.GRADES)})
