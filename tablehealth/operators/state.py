"""Last-known state per dataset, kept by day, so that no lookup scans the history.

The state of a set of rows has one row per dataset: its latest successful row and its latest row by cycle, its latest row by
time, and the last non-null value of every watched field. States of disjoint sets of rows merge by taking maxima, so the
state of all days before a cycle is a base, the states of the days after it, and the rows of the cycle's own day:

* ``partial/day=<d>`` holds the state of the rows whose cycle lies on day d;
* ``base/day=<d>`` holds the merged state of all days up to d, written by ``fold`` every so often;
* ``facts/day=<d>`` holds the span of dates of those rows, by which reads of the history are cut to its date partitions.

Recording a day again replaces its partition and drops the bases that contain it, so days may arrive in any order, twice, or
be taken back. Each lookup returns a small history (``DIGEST``): the rows that decide, in place of all rows. The operators
read it as they read a history, and their results are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehealth import params, schemas
from tablehealth.functions import times

FIELDS = ("status", "shape_hash", "column_count")
COLUMNS = [part.strip().split(" ")[0] for part in schemas.HISTORY.replace("\n", " ").split(",")]
_KEPT = [name for name in COLUMNS if name != "dataset_id"]
_ROW = "STRUCT<" + ", ".join(": ".join(part.split(None, 1)) for part in " ".join(schemas.HISTORY.split()).split(", ")[1:]) + ">"
_KINDS = dict(part.split(None, 1) for part in " ".join(schemas.HISTORY.split()).split(", "))
STATE = f"dataset_id STRING, success {_ROW}, last {_ROW}, latest {_ROW}, " + ", ".join(
    f"known_{name} STRUCT<observed_at: TIMESTAMP, cycle: STRING, value: {_KINDS[name]}>" for name in FIELDS)
_FACTS = "first_date DATE, last_date DATE, last_us BIGINT, rows BIGINT"


def _first_loaded(row: Column | None = None) -> Column:
    """Of rows alike in all else, the one loaded first counts as the later."""
    return -F.coalesce(F.col("seq") if row is None else row["seq"], F.lit(0))


def _orders(name: str) -> Column:
    row = F.col(name)
    if name == "latest":
        return F.when(row.isNotNull(), F.struct(row["observed_at"], _first_loaded(row)))
    return F.when(row.isNotNull(), F.struct(row["cycle"], row["observed_at"], _first_loaded(row)))


def _merged(states: DataFrame) -> DataFrame:
    """One row per dataset: the greatest of each part. The maxima combine before the shuffle."""
    known = [F.max(f"known_{name}").alias(f"known_{name}") for name in FIELDS]
    return states.groupBy("dataset_id").agg(*[F.max_by(name, _orders(name)).alias(name) for name in ("success", "last", "latest")], *known)


def _each_row(history: DataFrame) -> list[Column]:
    row = F.struct(*_KEPT)
    known = [
        F.when(F.col(name).isNotNull(), F.struct(F.col("observed_at"), F.col("cycle"), F.col(name).alias("value"))).alias(f"known_{name}") for name in FIELDS
    ]
    return [F.when(F.col("probe_outcome") == "success", row).alias("success"), row.alias("last"), row.alias("latest"), *known]


def state_of(history: DataFrame) -> DataFrame:
    """The state (``STATE``) of the rows of a history."""
    return _merged(history.select("dataset_id", *_each_row(history)))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all rows together; the order doesn't matter, nor whether a state is given twice."""
    whole = states[0]
    for state in states[1:]:
        whole = whole.unionByName(state)
    return _merged(whole)


def _rows(state: DataFrame, *parts: str) -> DataFrame:
    """The rows that a state keeps, as history rows, each once."""
    listed = F.array_distinct(F.filter(F.array(*[F.col(part) for part in parts]), lambda row: row.isNotNull()))
    return state.select("dataset_id", F.inline(listed)).select(*COLUMNS)


def latest_success(state: DataFrame) -> DataFrame:
    """Each dataset's latest successful row by cycle."""
    return _rows(state, "success")


class StateTable:
    """States by cycle day under one folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, day STRING").parquet(f"{self.base}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], f"{schema}, day STRING")

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.base}/{name}")

    def _folders(self, name: str) -> dict[str, object]:
        """day -> path of the partitions of a table, from a listing."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return {}
        found = {}
        for entry in files.listStatus(folder):
            label, _, day = entry.getPath().getName().partition("=")
            if label == "day":
                found[day] = entry.getPath()
        return found

    def _remove(self, name: str, days: Sequence[str]) -> None:
        folders = self._folders(name)
        for day in days:
            if day in folders:
                folders[day].getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folders[day], True)

    def days(self) -> list[str]:
        return sorted(self._folders("partial"))

    def bases(self) -> list[str]:
        return sorted(self._folders("base"))

    def record(self, rows: DataFrame) -> None:
        """Store the states of the cycle days of ``rows``, which are all of the history's rows of those days.

        Bases that contain such a day go first, so an interrupted run leaves nothing stale that is read.
        """
        placed = rows.withColumn("day", F.substring("cycle", 1, 10))
        at = F.col("observed_at")
        spans = placed.groupBy("day").agg(
            F.min(F.to_date(at)).alias("first_date"), F.max(F.to_date(at)).alias("last_date"), F.max(F.unix_micros(at)).alias("last_us"), F.count(F.lit(1)).alias("rows"))
        earliest = spans.agg(F.min("day")).first()[0]  # one value
        if earliest is None:
            return
        self._remove("base", [day for day in self.bases() if day >= earliest])
        by_day = placed.select("dataset_id", "day", *_each_row(placed)).groupBy("day", "dataset_id").agg(
            *[F.max_by(name, _orders(name)).alias(name) for name in ("success", "last", "latest")], *[F.max(f"known_{name}").alias(f"known_{name}") for name in FIELDS])
        self._write(by_day.repartition("day", F.pmod(F.xxhash64("dataset_id"), F.lit(8))), "partial")
        self._write(spans, "facts")

    def forget(self, day: str) -> None:
        """Take a day back, as if its cycles had never run."""
        self._remove("base", [b for b in self.bases() if b >= day])
        self._remove("partial", [day])
        self._remove("facts", [day])

    def fold(self, day: str) -> None:
        """Write the merged state of all days up to ``day``; older bases stay for lookups before it."""
        whole = self._up_to(day)
        self._write(whole.withColumn("day", F.lit(day)), "base")

    def _up_to(self, day: str) -> DataFrame:
        """The state of all days up to ``day``: the newest base, and the days after it."""
        base = max((b for b in self.bases() if b <= day), default="")
        later = self._read("partial", STATE).where((F.col("day") > base) & (F.col("day") <= day)).drop("day")
        if not base:
            return _merged(later)
        return merge_states(self._read("base", STATE).where(F.col("day") == base).drop("day"), later)

    def _day_before(self, day: str) -> str:
        return max((d for d in self.days() if d < day), default="")

    def facts(self) -> DataFrame:
        return self._read("facts", _FACTS)

    def _own_day(self, history: DataFrame, day: str) -> DataFrame:
        """The history's rows of one cycle day, read from the date partitions that hold them."""
        rows = history.where(F.substring("cycle", 1, 10) == day)
        span = self.facts().where(F.col("day") == day).first()  # one row
        if span is None:
            return rows.where(F.lit(False))
        if dict(history.dtypes).get("date") == "date":
            rows = rows.where(F.col("date").between(F.lit(span["first_date"]), F.lit(span["last_date"])))
        return rows

    def before(self, history: DataFrame, cycle: str) -> DataFrame:
        """The state of all rows of earlier cycles; of the history, only the cycle's own day is read."""
        day = cycle[:10]
        own = self._own_day(history, day).where(F.col("cycle") < cycle)
        return merge_states(self._up_to(self._day_before(day)), state_of(own))

    def ledger_digest(self, history: DataFrame, cycle: str, *, own: DataFrame | None = None) -> DataFrame:
        """For ``latest_before_cycle`` and ``dataset_deltas`` of a cycle: each dataset's rows that decide, and the cycle's own.

        The cycle's rows are ``own`` where they aren't stored yet.
        """
        now = (self._own_day(history, cycle[:10]).where(F.col("cycle") == cycle) if own is None else own).select(*COLUMNS)
        return _rows(self.before(history, cycle), "success", "last").unionByName(now)

    def _since(self, history: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
        """(state of the days that lie wholly before the cutoff and follow no other, the rows of all other days)."""
        at = self.spark.range(1).select(F.unix_micros(times.lit_instant(cutoff)).alias("at")).first()["at"]  # one value
        spans = self.facts().orderBy("day").collect()  # one row a day
        whole = ""
        for span in spans:
            if span["last_us"] >= at:
                break
            whole = span["day"]
        rest = history.where(F.substring("cycle", 1, 10) > whole)
        first = min((s["first_date"] for s in spans if s["day"] > whole), default=None)
        if first is not None and dict(history.dtypes).get("date") == "date":
            rest = rest.where(F.col("date") >= F.lit(first))
        return self._up_to(whole), rest

    def window_digest(self, history: DataFrame, *, as_of, window_days: int) -> DataFrame:
        """For ``transitions`` and ``drift``: the rows of the window, and in place of all earlier days each dataset's latest row."""
        state, rest = self._since(history, times.lit_instant(as_of) - F.make_dt_interval(F.lit(window_days)))
        return _rows(state, "latest").unionByName(rest.select(*COLUMNS))

    def events_digest(self, history: DataFrame, *, since) -> DataFrame:
        """For ``transition_events`` from ``since`` on: the rows of its days, and the last known values before them.

        Earlier events aren't complete in the result of the operator; keep those at ``since`` or later.
        """
        state, rest = self._since(history, times.lit_instant(since))
        known = None
        for name in FIELDS:
            kept = F.col(f"known_{name}")
            values = state.where(kept.isNotNull()).select(
                "dataset_id", kept["observed_at"].alias("observed_at"), kept["cycle"].alias("cycle"),
                *[(kept["value"] if other == name else F.lit(None)).cast(_KINDS[other]).alias(other) for other in FIELDS])
            known = values if known is None else known.unionByName(values)
        return rest.select("dataset_id", "observed_at", "cycle", *FIELDS).unionByName(known)


def kept_up(table: StateTable, observed: DataFrame, history: DataFrame, *, every: int = params.STATE_FOLD_DAYS) -> None:
    """After a cycle: record the days that ``observed`` touched from the stored history, and fold when the last base is ``every`` days old."""
    days = [row[0] for row in observed.select(F.substring("cycle", 1, 10).alias("day")).distinct().collect()]  # the cycle's days
    rows = history.where(F.substring("cycle", 1, 10).isin(days))
    table.record(rows)
    closed = table.days()[:-1]
    newest = max(table.bases(), default="")
    if closed and len([day for day in closed if day > newest]) >= every:
        table.fold(closed[-1])

