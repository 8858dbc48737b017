"""Instants, UTC days and ages."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def lit_instant(value: datetime | str | Column) -> Column:
    """A UTC instant literal; naive Python values are read as UTC."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            return F.timestamp_micros(F.lit(int(value.timestamp() * 1_000_000)))
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp")


def lit_day(value: date | str | Column) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("date")


def parse_instant(text: Column, *, naive: str = "reject") -> Column:
    """ISO-8601 text to a timestamp, null when unusable.

    Date-only text is midnight UTC. A date-time without an offset is null when
    ``naive="reject"`` and UTC when ``naive="utc"``; both rules exist in the
    operators, so the caller chooses.
    """
    value = F.regexp_replace(F.trim(text), r"([+-]\d{2})(\d{2})$", "$1:$2")
    date_only = value.rlike(r"^\d{4}-\d{2}-\d{2}$")
    zoned = value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}){0,2}(\.\d+)?(Z|[+-]\d{2}(:\d{2})?)$")
    plain = value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}){0,2}(\.\d+)?$")
    accepted = date_only | zoned if naive == "reject" else date_only | zoned | plain
    return F.when(accepted, F.try_to_timestamp(value))


def parse_http_date(text: Column) -> Column:
    """RFC 7231 ``Sun, 06 Nov 1994 08:49:37 GMT``; the weekday name is not checked."""
    trimmed = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    return F.try_to_timestamp(trimmed, F.lit("dd MMM yyyy HH:mm:ss z"))


def utc_day(instant: Column) -> Column:
    return F.to_date(instant)


def midnight(day: Column) -> Column:
    return day.cast("timestamp")


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days, from microseconds (``timestampdiff`` truncates)."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(DAY_MICROS))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def floored_age_days(now: Column, earlier: Column) -> Column:
    """Whole days, never negative."""
    return F.greatest(F.lit(0), F.floor(days_between(now, earlier)))


def historical_age(
    observed_at: Column, probe_outcome: Column, last_modified: Column, content_date: Column
) -> Column:
    """Age in days of the oldest signal that is not in the future; null unless the probe succeeded."""
    content_at = midnight(content_date)
    signals = (
        F.when(last_modified <= observed_at, days_between(observed_at, last_modified)),
        F.when(content_at <= observed_at, days_between(observed_at, content_at)),
    )
    return F.when(probe_outcome == "success", F.greatest(*signals))


def freshness_evaluable(row) -> Column:
    """``row`` is a DataFrame or a struct column with the history fields."""
    observed = row["observed_at"]
    return F.coalesce(
        (row["probe_outcome"] == "success")
        & (
            F.coalesce(row["last_modified"] <= observed, F.lit(False))
            | F.coalesce(midnight(row["content_date"]) <= observed, F.lit(False))
        ),
        F.lit(False),
    )


def display_local(instant: Column, *, offset_hours: int = 8, label: str = "MYT") -> Column:
    """``5 Aug 2026, 9:07 pm MYT`` at a fixed offset."""
    local = F.timestamp_micros(F.unix_micros(instant) + offset_hours * 3_600_000_000)
    return F.concat(
        F.date_format(local, "d MMM yyyy, h:mm "), F.lower(F.date_format(local, "a")), F.lit(f" {label}")
    )


def iso_week(day: Column) -> Column:
    """``2026-W33``; the week-numbering year is the year of the week's Thursday."""
    thursday = F.date_add(day, 3 - F.weekday(day))
    return F.concat(F.year(thursday), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def render_dated_path(template: str | Column, day: date | str | Column) -> Column:
    """Expand ``{YYYY-MM}`` and ``{YYYY}`` for a run date; any other date text is an error."""
    text = template if isinstance(template, Column) else F.lit(template)
    run_day = day if isinstance(day, Column) else F.lit(str(day))
    checked = F.when(
        run_day.cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(run_day.cast("string"), "yyyy-MM-dd").isNotNull(),
        F.try_to_date(run_day.cast("string"), "yyyy-MM-dd"),
    ).otherwise(F.raise_error(F.concat(F.lit("invalid run date: "), run_day.cast("string"))).cast("date"))
    monthly = F.replace(text, F.lit("{YYYY-MM}"), F.date_format(checked, "yyyy-MM"))
    return F.replace(monthly, F.lit("{YYYY}"), F.date_format(checked, "yyyy"))
