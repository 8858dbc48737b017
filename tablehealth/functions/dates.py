"""Dates found in text, pages and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablehealth import params

_ISO = r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"
# any word of month length: looking the word up afterwards is far cheaper than an
# alternation of all month names at every position of a long text
_DAY_FIRST = r"(?<!\d)\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}(?!\d)"
_MONTH_FIRST = r"(?<![\p{L}\p{N}_])[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}(?!\d)"


def _valid_date(year: Column, month: Column, day: Column) -> Column:
    """A date from text parts, null when it does not exist."""
    iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(year != "0000", F.try_to_date(iso, "yyyy-MM-dd"))


def _month_number(word: Column) -> Column:
    table = F.create_map(*[F.lit(item) for name, number in params.MONTHS.items() for item in (name, str(number))])
    return F.try_element_at(table, F.lower(word))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _part(match: Column, pattern: str) -> Column:
    return F.regexp_extract(match, pattern, 1)


def text_dates(text: Column) -> Column:
    """All calendar dates written in the text: ISO, ``5 March 2023`` and ``March 5, 2023``."""
    iso = F.transform(
        _all(text, _ISO), lambda m: _valid_date(F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2))
    )

    def worded(match: Column) -> Column:
        return _valid_date(
            _part(match, r"(\d{4})$"), _month_number(_part(match, r"([A-Za-z]+)")), _part(match, r"(?<!\d)(\d{1,2})(?!\d)")
        )

    day_first = F.transform(_all(text, _DAY_FIRST), worded)
    month_first = F.transform(_all(text, _MONTH_FIRST), worded)
    return F.array_distinct(F.filter(F.concat(iso, day_first, month_first), lambda found: found.isNotNull()))


def pick_date(found: Column, today: Column, *, mode: str = "max") -> Column:
    """The earliest date, or the latest that is not after today (the latest of all if every one is)."""
    if mode == "min":
        return F.array_min(found)
    if mode != "max":
        raise ValueError("mode must be 'min' or 'max'")
    return F.coalesce(F.array_max(F.filter(found, lambda item: item <= today)), F.array_max(found))


def page_date(text: Column, pattern: str, today: Column) -> Column:
    """Latest ISO or D/M/YYYY date matched by the pattern, future dates dropped."""
    def parsed(match: Column) -> Column:
        iso = match.rlike(r"^\d{4}-\d{2}-\d{2}$")
        day_first = match.rlike(r"^\d{1,2}[/\-]\d{1,2}[/\-]\d{4}$")
        return F.when(
            iso, _valid_date(F.substring(match, 1, 4), F.substring(match, 6, 2), F.substring(match, 9, 2))
        ).when(
            day_first,
            _valid_date(
                F.regexp_extract(match, r"(\d{4})$", 1), F.regexp_extract(match, r"^\d{1,2}[/\-](\d{1,2})", 1),
                F.regexp_extract(match, r"^(\d{1,2})", 1),
            ),
        )

    found = F.transform(_all(text, pattern), parsed)
    return F.array_max(F.filter(found, lambda item: item <= today))


def matching_lines(text: Column, pattern: str) -> Column:
    """Number of lines of a page that match the pattern."""
    return F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(pattern)))


def embedded_page_date(html: Column) -> Column:
    """``props.pageProps.data_as_of`` of the page's ``__NEXT_DATA__`` script, as a date."""
    pattern = r"(?is)<script\b[^>]*\bid=(?:\"__NEXT_DATA__\"|'__NEXT_DATA__')[^>]*>(.*?)</script\s*>"
    stamp = F.get_json_object(F.regexp_extract(html, pattern, 1), "$.props.pageProps.data_as_of")
    shaped = stamp.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}$")
    instant = F.when(shaped, F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm")))
    return F.to_date(instant)
