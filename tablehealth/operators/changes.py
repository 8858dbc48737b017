"""Change ledgers and snapshot comparisons."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth import params
from tablehealth.functions import text, times
from tablehealth.functions.cadence import lookup
from tablehealth.operators import history as hist

DELTA_COLUMNS = ("change_type", "dataset_id", "name", "from_cycle", "from_value", "to_value", "detail")
CYCLE_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$"


def delta_baseline(history: DataFrame, *, cycle: str) -> DataFrame:
    """One row: previous cycle and the reason why no ledger can be built, if any."""
    if not re.match(CYCLE_PATTERN, cycle):
        raise ValueError("cycle must use YYYY-MM-DDTHH:MM")
    facts = history.agg(
        F.max(F.when(F.col("cycle") < cycle, F.col("cycle"))).alias("_previous"),
        F.count_if(F.col("cycle") == cycle).alias("_current"),
    )
    return facts.select(
        F.lit(cycle).alias("cycle"),
        F.when(F.col("_current") > 0, F.col("_previous")).alias("previous_cycle"),
        F.when(F.col("_current") == 0, f"no_history_line_for_cycle_{cycle}")
        .when(F.col("_previous").isNull(), "no_history_baseline_yet").alias("previous_cycle_skipped_reason"),
    )


def dataset_deltas(catalog: DataFrame, snapshot: DataFrame, history: DataFrame, *, cycle: str) -> DataFrame:
    """The ledger of one cycle as a long table of seven change types.

    ``added`` and ``removed`` compare the catalogue with the previous cycle's ids;
    the other types compare the snapshot with each dataset's latest successful
    observation of an earlier cycle. A null in the baseline is absent evidence and
    never a change, except for ``status``. Empty when the baseline has a skip reason.
    """
    previous = delta_baseline(history, cycle=cycle).select("previous_cycle").scalar()
    previous_ids = history.where(F.col("cycle") == previous).select("dataset_id").distinct()
    old = hist.latest_before_cycle(history, before_cycle=cycle)
    entries = catalog.select("dataset_id", F.col("name").alias("_name"), F.col("url").alias("_url"))
    health = snapshot.select(
        "dataset_id", "status", "anomaly_detected", "first_row_hash", "record_count", "record_count_estimated",
        "content_shape_changed", "freshness_signal", "freshness_signal_source", F.lit(True).alias("_in_health"),
    )

    def row(kind: str, name: Column, from_cycle: Column, before: Column, after: Column, detail: Column) -> list[Column]:
        values = (F.lit(kind), F.col("dataset_id"), name, from_cycle, before, after, detail)
        return [value.cast("string").alias(label) for value, label in zip(values, DELTA_COLUMNS)]

    none = F.lit(None).cast("string")
    added = (
        entries.join(previous_ids, "dataset_id", "left_anti").join(health, "dataset_id", "left")
        .select(*row("added", text.display_name(F.col("dataset_id"), F.col("_name")), none, none,
                     F.coalesce("status", F.lit("unknown")), F.col("_url")))
    )
    removed = (
        previous_ids.join(entries.select("dataset_id"), "dataset_id", "left_anti").join(old, "dataset_id", "inner")
        .select(*row("removed", text.display_name(F.col("dataset_id"), F.col("name")), F.col("cycle"),
                     F.coalesce("status", F.lit("unknown")), none, none))
    )
    joined = entries.join(
        old.select("dataset_id", F.struct(*[c for c in old.columns if c != "dataset_id"]).alias("old")), "dataset_id"
    ).join(health, "dataset_id")
    was = F.col("old")
    signal = F.when(F.coalesce("content_shape_changed", F.lit(False)), "content-shape-changed").otherwise(
        F.coalesce(
            F.when(F.col("freshness_signal_source") != "", F.col("freshness_signal_source")),
            F.when(F.col("freshness_signal") != "", F.col("freshness_signal")), F.lit("health-probe"),
        )
    )
    estimated = F.coalesce(was["record_count_estimated"], F.lit(False)) | F.coalesce("record_count_estimated", F.lit(False))
    count_delta = F.when(~estimated & (was["record_count"] != F.col("record_count")), F.col("record_count") - was["record_count"])

    def change(kind: str, condition: Column, before: Column, after: Column, detail: Column) -> Column:
        item = F.struct(
            F.lit(kind).alias("change_type"), before.cast("string").alias("from_value"),
            after.cast("string").alias("to_value"), detail.cast("string").alias("detail"),
        )
        return F.when(F.coalesce(condition, F.lit(False)), item)

    changes = F.array(
        change("status_changed", ~was["status"].eqNullSafe(F.col("status")), was["status"], F.col("status"), signal),
        change(
            "anomaly_changed",
            was["anomaly_detected"].isNotNull() & ~was["anomaly_detected"].eqNullSafe(F.col("anomaly_detected")),
            was["anomaly_detected"], F.col("anomaly_detected"), F.lit(params.ANOMALY_METRIC),
        ),
        change("url_changed", was["url"] != F.col("_url"), was["url"], F.col("_url"), none),
        change("schema_changed", was["shape_hash"] != F.col("first_row_hash"), was["shape_hash"], F.col("first_row_hash"), none),
        change("record_count_changed", count_delta.isNotNull(), was["record_count"], F.col("record_count"), count_delta),
    )
    changed = (
        joined.withColumn("_change", F.explode(F.filter(changes, lambda item: item.isNotNull())))
        .select(
            F.col("_change.change_type"), "dataset_id",
            text.display_name(F.col("dataset_id"), F.col("_name"), was["name"]).alias("name"),
            was["cycle"].alias("from_cycle"), "_change.from_value", "_change.to_value", "_change.detail",
        )
    )
    ledger = added.unionByName(removed).unionByName(changed)
    return ledger.where(previous.isNotNull())


def delta_summary(ledger: DataFrame) -> DataFrame:
    """Number of changes per type, as one row."""
    kinds = (
        "added", "removed", "status_changed", "anomaly_changed", "url_changed", "schema_changed", "record_count_changed",
    )
    return ledger.agg(*[F.count_if(F.col("change_type") == kind).alias(kind) for kind in kinds])


def delta_range(ledgers: DataFrame, *, since: str | None = None, until: str | None = None) -> DataFrame:
    """Ledger cycles between two cycles, both inclusive, compared as text."""
    rows = ledgers
    if since:
        rows = rows.where(F.col("cycle") >= since)
    if until:
        rows = rows.where(F.col("cycle") <= until)
    return rows.groupBy("cycle").agg(F.min("observed_at").alias("observed_at")).orderBy("cycle")


def weekly_changes(
    before: DataFrame, after: DataFrame, *, old_catalog: DataFrame | None = None, catalog: DataFrame | None = None
) -> DataFrame:
    """Transitions between two snapshots: breaks, recoveries, structure changes, new datasets.

    A dataset may appear in more than one category. ``added`` needs both catalogues.
    """
    fields = ("status", "record_count", "column_count", "content_shape_changed")
    old = before.select("dataset_id", *[F.col(name).alias(f"_old_{name}") for name in fields], F.lit(True).alias("_in_old"))
    both = after.select("dataset_id", *fields, "last_checked").join(old, "dataset_id", "left")
    was, now = F.col("_old_status"), F.col("status")
    known = F.coalesce("_in_old", F.lit(False))
    broke = ((was == "fresh") & (now == "stale")) | ((was == "stale") & (now == "unreachable"))
    recovered = ~was.eqNullSafe(F.lit("fresh")) & (now == "fresh")

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    structure = (
        ~F.col("_old_record_count").eqNullSafe(F.col("record_count"))
        | ~F.col("_old_column_count").eqNullSafe(F.col("column_count"))
        | (flag("_old_content_shape_changed") != flag("content_shape_changed"))
    )
    categories = F.filter(
        F.array(
            F.when(known & broke, "new_break"),
            F.when(known & recovered & ~F.coalesce(broke, F.lit(False)), "recovered"),
            F.when(known & structure, "schema_change"),
            F.when(~known, "newly_probed"),
        ),
        lambda item: item.isNotNull(),
    )
    columns = [
        "category", "dataset_id", F.col("_old_status").alias("old_status"), F.col("status").alias("new_status"),
        F.col("_old_record_count").alias("old_record_count"), F.col("record_count").alias("new_record_count"),
        F.col("_old_column_count").alias("old_column_count"), F.col("column_count").alias("new_column_count"),
        "last_checked",
    ]
    result = both.withColumn("category", F.explode(categories)).select(*columns)
    if catalog is not None and old_catalog is not None:
        new_ids = catalog.select("dataset_id").join(old_catalog.select("dataset_id"), "dataset_id", "left_anti")
        nothing = {
            name: F.lit(None).cast(kind) for name, kind in (
                ("_old_status", "string"), ("_old_record_count", "bigint"), ("_old_column_count", "int"),
            )
        }
        entered = new_ids.join(after.select("dataset_id", *fields, "last_checked"), "dataset_id", "left").withColumns(nothing)
        result = result.unionByName(entered.withColumn("category", F.lit("added")).select(*columns))
    return result


# ---- live against candidate --------------------------------------------------


#: Every rule of the comparison by its own code: what follows from it, and why in words. ``compare_snapshots`` finds codes only.
RULES = {
    "id-unlisted": ("Blocker", "the candidate holds a dataset that the catalogue doesn't list"),
    "id-missing": ("Blocker", "the catalogue lists a dataset that the candidate lacks"),
    "id-dropped": ("Blocker", "a live dataset is neither listed nor in the candidate"),
    "id-new": ("Blocker", "the candidate holds a dataset that isn't live"),
    "status-ended": ("Approved", "the source has ended, so failing probes are no surprise"),
    "status-window": ("Approved", "moved between fresh and aging"),
    "status-revived": ("Approved", "a probe dated the data again"),
    "status-aged": ("Approved", "an aging dataset went stale"),
    "status-aged-at-once": ("Approved", "went stale at once, and both its age and its last check moved on"),
    "status-unexplained": ("Blocker", "went stale at once, and neither age nor last check accounts for it"),
    "status-first": ("Approved", "unknown so far, now probed"),
    "status-other": ("Pending", "no rule covers this change of status"),
    "check-first": ("Approved", "checked for the first time"),
    "check-later": ("Approved", "checked again, later"),
    "check-lost": ("Blocker", "the time of the last check is gone"),
    "check-earlier": ("Blocker", "the last check lies before the live one"),
    "age-first": ("Approved", "an age is known for the first time"),
    "age-moved": ("Approved", "ages count up to the probe, which is another one"),
    "age-lost": ("Pending", "the age is no longer known"),
    "date-first": ("Approved", "a publisher's date is known for the first time"),
    "date-later": ("Approved", "the publisher's date is later"),
    "date-earlier": ("Blocker", "the publisher's date lies before the live one"),
    "date-lost": ("Pending", "the publisher's date is no longer known"),
    "count-ended": ("Approved", "the source has ended, so it has no rows"),
    "count-first": ("Approved", "rows counted for the first time"),
    "count-lost": ("Pending", "the rows are no longer counted"),
    "count-within": ("Approved", "the count moved by less than its adapter allows"),
    "count-lively": ("Volatile", "the count of a live feed moves this much by itself"),
    "count-stalled": ("Blocker", "a live feed has no rows any more"),
    "count-jumped": ("Blocker", "the count moved by as much as its adapter allows, or more"),
    "columns": ("Blocker", "the number of columns differs"),
    "sum-status": ("Blocker", "the summary's count of a status isn't that of the rows"),
    "sum-total": ("Blocker", "the summary's total isn't the catalogue's"),
}
# pairs of statuses (before, after) that are judged without further evidence
_STATUS_PAIRS = {
    **{f"{old}>{new}": "status-revived" for old in ("stale", "degraded", "unreachable", "unknown-freshness") for new in ("fresh", "aging", "stale")},
    "fresh>aging": "status-window", "aging>fresh": "status-window", "aging>stale": "status-aged",
}


def _rule(code: Column) -> list[Column]:
    return [lookup(code, {name: rule[i] for name, rule in RULES.items()}).alias(label) for i, label in enumerate(("classification", "reason"))]


def _count_code(before: Column, after: Column, adapter: Column) -> Column:
    limit = lookup(adapter, params.COUNT_THRESHOLDS, F.lit(params.COUNT_THRESHOLDS["direct"]))
    share = F.when(before != 0, F.abs(after - before) / F.abs(before)).otherwise(F.lit(float("inf")))
    live = F.coalesce(adapter == "gtfs-realtime", F.lit(False))
    return (
        F.when((share >= limit) & live & (after == 0), "count-stalled").when(share >= limit, "count-jumped")
        .when(live & (share >= params.REALTIME_VOLATILE_THRESHOLD), "count-lively").otherwise("count-within")
    )


def _count_category(code: Column, adapter: Column) -> Column:
    side = F.when(adapter == "gtfs-realtime", "Operational").otherwise("Structural")
    return F.when(code == "count-lively", "Volatile").when(code == "count-lost", "Field").otherwise(side)


def classify_record_count(before: Column, after: Column, adapter: Column) -> Column:
    """``struct(classification, category, reason)`` of a change between two known record counts."""
    code = _count_code(before, after, adapter)
    return F.struct(*_rule(code), _count_category(code, adapter).alias("category"))


def _appearing(was: Column, now: Column, name: str, both: Column) -> Column:
    """The code of a value that may be missing on a side; ``both`` where it is on neither."""
    return F.when(was.isNull(), f"{name}-first").when(now.isNull(), f"{name}-lost").otherwise(both)


def _codes(old: str, new: str) -> dict[str, Column]:
    """The code of a difference, by field."""
    def sides(field: str) -> tuple[Column, Column]:
        return F.col(f"{old}.{field}"), F.col(f"{new}.{field}")

    ended = F.coalesce(F.col("_real_status") == "discontinued", F.lit(False))
    checked, age, date, count = sides("last_checked"), sides("freshness_days"), sides("content_freshness_date"), sides("record_count")
    was, now = sides("status")
    grown = F.coalesce((checked[1] > checked[0]) & (age[1] > age[0]), F.lit(False))
    at_once = F.when((was == "fresh") & (now == "stale"), F.when(grown, "status-aged-at-once").otherwise("status-unexplained"))
    first = F.when((was == "unknown") & ~now.eqNullSafe(F.lit("unknown")), "status-first")
    return {
        "status": F.coalesce(
            F.when(ended & now.isin("degraded", "unreachable"), "status-ended"), lookup(F.concat(was, F.lit(">"), now), _STATUS_PAIRS), at_once, first, F.lit("status-other")),
        "last_checked": _appearing(*checked, "check", F.when(checked[1] < checked[0], "check-earlier").otherwise("check-later")),
        "freshness_days": _appearing(*age, "age", F.lit("age-moved")),
        "content_freshness_date": _appearing(*date, "date", F.when(date[1] < date[0], "date-earlier").otherwise("date-later")),
        "record_count": F.when(ended & F.coalesce(count[1] == 0, F.lit(True)), "count-ended").otherwise(
            _appearing(*count, "count", _count_code(*count, F.col("_adapter")))),
        "column_count": F.lit("columns"),
    }


def compare_snapshots(
    live: DataFrame,
    candidate: DataFrame,
    catalog: DataFrame,
    *,
    adapters: DataFrame | None = None,
    candidate_summary: Mapping[str, int] | None = None,
) -> DataFrame:
    """Findings of a candidate snapshot against the live one.

    Six fields are compared per dataset; id-set differences and a candidate summary
    that disagrees with its own rows are blockers. ``adapters`` maps dataset_id to an
    adapter; without it every dataset is ``direct``.
    """
    fields = ("status", "last_checked", "freshness_days", "content_freshness_date", "record_count", "column_count")

    def prepared(df: DataFrame, label: str) -> DataFrame:
        age = F.col("freshness_days") if "freshness_days" in df.columns else F.col("staleness_days")
        picked = df.select("dataset_id", *[age.cast("double").alias(name) if name == "freshness_days" else F.col(name) for name in fields])
        return picked.select("dataset_id", F.struct(*fields).alias(label))

    live_rows, new_rows = prepared(live, "o"), prepared(candidate, "n")
    entries = catalog.select("dataset_id", F.col("real_status").alias("_real_status"), F.lit(True).alias("_listed"))
    both = live_rows.join(new_rows, "dataset_id", "full").join(entries, "dataset_id", "full")
    if adapters is not None:
        both = both.join(adapters.select("dataset_id", F.col("adapter").alias("_adapter")), "dataset_id", "left")
    else:
        both = both.withColumn("_adapter", F.lit("direct"))
    in_live, in_new, listed = F.col("o").isNotNull(), F.col("n").isNotNull(), F.col("_listed").isNotNull()

    def item(code, field, before, after) -> Column:
        return F.struct(code.alias("code"), F.lit(field).alias("field"), before.cast("string").alias("before"), after.cast("string").alias("after"))

    def ids(code: str) -> Column:
        place = [F.when(found, "present").otherwise("absent") for found in (listed if code in ("id-unlisted", "id-missing") else in_live, in_new)]
        return item(F.lit(code), "dataset_id", *place)

    items = [
        F.when(listed & ~in_new, ids("id-missing")), F.when(in_new & ~listed, ids("id-unlisted")),
        F.when(in_live & ~in_new & ~listed, ids("id-dropped")), F.when(in_new & ~in_live, ids("id-new")),
    ]
    for field, code in _codes("o", "n").items():
        was, now = F.col(f"o.{field}"), F.col(f"n.{field}")
        items.append(F.when(in_live & in_new & ~was.eqNullSafe(now), item(code, field, was, now)))
    code = F.col("code")
    kinds = {"dataset_id": F.lit("ID set"), "status": F.lit("Status flip"), "record_count": _count_category(code, F.col("_adapter")), "column_count": F.lit("Schema")}
    category = F.coalesce(*[F.when(F.col("field") == field, kind) for field, kind in kinds.items()], F.lit("Field"))
    found = both.select("dataset_id", "_adapter", F.inline(F.filter(F.array(*items), lambda entry: entry.isNotNull())))
    classification, reason = _rule(code)
    findings = found.select(classification, category.alias("category"), "dataset_id", "field", "before", "after", reason)
    if candidate_summary is None:
        return findings
    return findings.unionByName(_summary_findings(candidate, catalog, candidate_summary))


def _summary_findings(candidate: DataFrame, catalog: DataFrame, summary: Mapping[str, int]) -> DataFrame:
    """``summary`` holds ``datasets_total`` and one count per status (underscored names); null statuses count as unknown."""
    name = F.translate(F.coalesce("status", F.lit("unknown")), "-", "_")
    counted = candidate.groupBy(F.concat(F.lit("by_status."), name).alias("field")).agg(F.count("*").alias("n"))
    total = catalog.agg(F.count("*").alias("n")).select(F.lit("datasets_total").alias("field"), "n")
    claims = [(key if key == "datasets_total" else f"by_status.{key}", value) for key, value in ({"datasets_total": None} | dict(summary)).items()]
    claimed = candidate.sparkSession.createDataFrame(claims, "field string, claim bigint")
    whole = F.col("field") == "datasets_total"
    # a status that one side doesn't name has no datasets there; a total that isn't given agrees with none
    both = counted.unionByName(total).join(claimed, "field", "full").select(
        "field", F.coalesce("n", F.lit(0)).alias("n"), F.when(whole, F.col("claim")).otherwise(F.coalesce("claim", F.lit(0))).alias("claim"))
    classification, reason = _rule(F.when(whole, "sum-total").otherwise("sum-status"))
    return both.where(~F.col("n").eqNullSafe(F.col("claim"))).select(
        classification, F.when(whole, "Shape").otherwise("Distribution").alias("category"), F.lit("(summary)").alias("dataset_id"), "field",
        F.col("n").cast("string").alias("before"), F.col("claim").cast("string").alias("after"), reason)


def status_delta(live: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per-status counts of two snapshots and their difference."""
    both = live.select("status", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        candidate.select("status", F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    return both.groupBy("status").agg(
        F.sum("a").alias("live"), F.sum("b").alias("candidate"), (F.sum("b") - F.sum("a")).alias("delta")
    )


# ---- the same attribute in several sources -----------------------------------


def multi_source_consistency(values: DataFrame, sources: list[str]) -> DataFrame:
    """Datasets whose attribute is missing from a source or differs between sources.

    ``values`` is long: ``dataset_id, source, value``; a null or empty value is
    missing. A listed (dataset, source) pair without a row is missing as well. The
    number of sources is fixed and small, so it becomes columns.
    """
    present = F.when(F.col("value") != "", F.col("value"))
    wide = values.groupBy("dataset_id").agg(
        *[F.max(F.when(F.col("source") == name, present)).alias(f"_v{i}") for i, name in enumerate(sources)]
    )
    cells = [F.col(f"_v{i}") for i in range(len(sources))]
    missing = F.concat_ws(", ", *[F.when(cell.isNull(), F.lit(name)) for cell, name in zip(cells, sources)])
    details = F.concat_ws(", ", *[F.when(cell.isNotNull(), F.concat(F.lit(f"{name}="), cell)) for cell, name in zip(cells, sources)])
    distinct = F.size(F.array_distinct(F.filter(F.array(*cells), lambda cell: cell.isNotNull())))
    findings = F.filter(
        F.array(
            F.when(missing != "", F.struct(F.lit("missing").alias("finding"), missing.alias("detail"))),
            F.when(distinct > 1, F.struct(F.lit("mismatch").alias("finding"), details.alias("detail"))),
        ),
        lambda entry: entry.isNotNull(),
    )
    return wide.select("dataset_id", F.inline(findings))


def cadence_findings(catalog: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Unsupported refresh frequencies, and staleness beyond twice the expected cadence."""
    rows = catalog.select("dataset_id", "refresh_frequency").join(
        snapshot.select("dataset_id", F.col("staleness_days").cast("double").alias("staleness_days")), "dataset_id", "left"
    )
    frequency = F.col("refresh_frequency")
    unsupported = ~F.coalesce(frequency.isin(*params.AUDIT_FREQUENCIES), F.lit(False))
    late = F.col("staleness_days") > 2 * lookup(frequency, params.AUDIT_CADENCE_DAYS)
    findings = F.filter(
        F.array(F.when(unsupported, "unsupported_frequency"), F.when(late, "late")), lambda entry: entry.isNotNull()
    )
    return rows.select("dataset_id", "refresh_frequency", "staleness_days", F.explode(findings).alias("finding"))
