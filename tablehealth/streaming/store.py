"""Append-only stores written from ``foreachBatch``.

Every micro-batch writes only its own ``epoch=<n>`` partitions, so a replay after a
lost driver or executor overwrites exactly what it wrote before and nothing else.
Readers combine the epochs: last write wins for keyed rows, algebraic merge for
aggregates. Closed epochs are folded into date partitions that a version list names,
so the number of files depends on the dates kept, not on the epochs.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablehealth import params, schemas
from tablehealth.functions import times
from tablehealth.operators import drift
from tablehealth.operators import history as hist
from tablehealth.operators.skew import latest_by


class EpochTable:
    """A Parquet table of epochs' rows, partitioned by one column or by none, whose closed epochs can be folded.

    * ``delta`` holds what each epoch wrote, by partition and epoch.
    * ``base`` holds the rows of the folded epochs, by version and partition; a fold writes only the partitions that the epochs
      touched, each reduced to the rows that still count.
    * ``versions`` lists, for each version, the last folded epoch and the version in which each partition lies. It is written
      last, and readers follow its newest entry, so a fold happens as a whole or not at all.

    An epoch that has been folded is closed: writing it again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, partition_by: tuple[str, ...] = (), *, reduce: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.schema, self.partition_by = spark, path, schema, partition_by
        self.reduce = reduce or (lambda rows: rows)
        self._column = partition_by[0] if partition_by else "_all"

    def _folder(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _version(self) -> tuple[int, int, dict[str, int]]:
        """(version, last folded epoch, partition -> the version that holds it) of the newest entry; (0, -1, {}) without one."""
        folder, files = self._folder("versions")
        numbers = [int(e.getPath().getName().split("=")[1]) for e in files.listStatus(folder) if e.getPath().getName().startswith("version=")
                   and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(e.getPath(), "_SUCCESS"))] if files.exists(folder) else []
        if not numbers:
            return 0, -1, {}
        rows = self.spark.read.schema("upto BIGINT, name STRING, held BIGINT").parquet(f"{self.path}/versions/version={max(numbers)}").collect()  # one row a partition
        return max(numbers), rows[0]["upto"], {r["name"]: r["held"] for r in rows if r["name"] is not None}

    def _publish(self, version: int, upto: int, held: dict[str, int]) -> None:
        rows = [(upto, name, number) for name, number in sorted(held.items())] or [(upto, None, None)]
        self.spark.createDataFrame(rows, "upto BIGINT, name STRING, held BIGINT").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/version={version}")

    def write(self, df: DataFrame, epoch: int) -> None:
        if epoch <= self._version()[1]:
            return
        (
            df.withColumn("epoch", F.lit(epoch).cast("bigint"))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(*self.partition_by, "epoch").parquet(f"{self.path}/delta")
        )

    def _delta(self) -> DataFrame:
        schema = f"{self.schema}, epoch BIGINT"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/delta")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def _base(self, held: dict[str, int]) -> DataFrame | None:
        if not held:
            return None
        paths = [f"{self.path}/base/version={number}/{self._column}={name}" for name, number in held.items()]
        rows = self.spark.read.schema(f"{self.schema}, epoch BIGINT").option("basePath", f"{self.path}/base").parquet(*paths)
        return rows.select(*[part.split()[0] for part in _flat(self.schema)], "epoch")

    def read(self, *, before: int | None = None) -> DataFrame:
        """All rows with their epoch; only earlier epochs when ``before`` is given, which must not be folded yet."""
        _, upto, held = self._version()
        if before is not None and before <= upto:
            raise ValueError(f"epoch {before} has been folded")
        rows, base = self._delta().where(F.col("epoch") > upto), self._base(held)
        rows = rows if base is None else base.unionByName(rows)
        return rows if before is None else rows.where(F.col("epoch") < before)

    def fold(self, upto: int) -> None:
        """Fold the epochs up to ``upto`` into the base. Only the partitions that they touched are read and written."""
        version, last, held = self._version()
        if upto <= last:
            return
        due = self._delta().where((F.col("epoch") > last) & (F.col("epoch") <= upto))
        name = F.col(self._column).cast("string") if self.partition_by else F.lit("all")
        touched = [r[0] for r in due.select(name).distinct().collect()]  # partitions of the closed epochs
        old = self._base({n: held[n] for n in touched if n in held})
        number = version + 1
        if touched:
            rows = self.reduce(due if old is None else old.unionByName(due))
            placed = rows if self.partition_by else rows.withColumn(self._column, F.lit("all"))
            placed.repartition(self._column).write.mode("overwrite").partitionBy(self._column).parquet(f"{self.path}/base/version={number}")
        folder, files = self._folder("base", f"version={number}")
        written = {e.getPath().getName().partition("=")[2] for e in files.listStatus(folder) if e.isDirectory()} if files.exists(folder) else set()
        # a touched partition of which nothing is left has no folder
        self._publish(number, upto, {n: held_in for n, held_in in held.items() if n not in touched} | {n: number for n in touched if n in written})
        self._clear(number, upto)

    def _clear(self, number: int, upto: int) -> None:
        """Delete folded epochs, and what neither this version nor the one before it names (a reader may still follow that)."""
        delta, files = self._folder("delta")
        if files.exists(delta):
            for entry in files.listStatus(delta):
                inner = [entry] if entry.getPath().getName().startswith("epoch=") else files.listStatus(entry.getPath()) if entry.isDirectory() else []
                left = 0
                for epoch in inner:
                    label, _, value = epoch.getPath().getName().partition("=")
                    if label == "epoch" and int(value) <= upto:
                        files.delete(epoch.getPath(), True)
                    else:
                        left += 1
                if entry.isDirectory() and not left and files.exists(entry.getPath()):
                    files.delete(entry.getPath(), True)
        named = set()
        for version in (number, number - 1):
            folder, _ = self._folder("versions", f"version={version}")
            if files.exists(folder):
                rows = self.spark.read.schema("upto BIGINT, name STRING, held BIGINT").parquet(f"{self.path}/versions/version={version}").collect()
                named |= {(r["held"], r["name"]) for r in rows}
        for top in ("versions", "base"):
            folder, _ = self._folder(top)
            for entry in files.listStatus(folder) if files.exists(folder) else []:
                label, _, value = entry.getPath().getName().partition("=")
                if label != "version":
                    continue
                if top == "versions" and int(value) < number - 1:
                    files.delete(entry.getPath(), True)
                if top == "base":
                    parts = [p for p in files.listStatus(entry.getPath()) if p.isDirectory()]
                    gone = [p for p in parts if (int(value), p.getPath().getName().partition("=")[2]) not in named]
                    for part in gone:
                        files.delete(part.getPath(), True)
                    if len(gone) == len(parts):
                        files.delete(entry.getPath(), True)

    def remove(self, column: str, gone) -> None:
        """Delete the partitions of the first partition column whose value ``gone`` accepts."""
        folder, files = self._folder("delta")
        if files.exists(folder):
            for entry in files.listStatus(folder):
                name, _, value = entry.getPath().getName().partition("=")
                if name == column and gone(value):
                    files.delete(entry.getPath(), True)
        version, upto, held = self._version()
        left = {name: number for name, number in held.items() if not gone(name)}
        if left != held:
            self._publish(version + 1, upto, left)
            self._clear(version + 1, upto)


def _flat(schema: str) -> list[str]:
    """The columns of a DDL schema whose types may hold commas."""
    parts, depth, start = [], 0, 0
    for i, char in enumerate(schema + ","):
        depth += (char in "<(") - (char in ">)")
        if char == "," and depth == 0:
            parts.append(schema[start:i].strip())
            start = i + 1
    return parts


def _newest(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Of rows that share the keys, those of the last epoch that wrote one."""
    def reduce(rows: DataFrame) -> DataFrame:
        return latest_by(rows, keys, F.col("epoch")).select(*rows.columns)
    return reduce


def _combined(partials: DataFrame) -> DataFrame:
    """Partial aggregates of epochs merged into one a day, which counts as the last of them."""
    epochs = partials.groupBy("dataset_id", "date").agg(F.max("epoch").alias("epoch"))
    return hist.combine_daily(partials.withColumn("_rank", -F.col("epoch"))).join(epochs, ["dataset_id", "date"]).select(*partials.columns)


#: Partition of rows whose cycle says nothing about when they were observed; sorts after all dates.
_APART = "apart"


class HistoryStore:
    """Raw observations, daily aggregates, archive and compacted cycles under one folder.

    ``upsert`` keys rows by (dataset_id, cycle); the raw table is partitioned by the
    cycle's date, which is part of the key, so versions of a row share a partition.
    Rows observed more than ``slack_days`` away from their cycle, or whose cycle is no
    date, share the partition ``apart``, which every read and compaction includes, so
    that all other partitions can be skipped by date.
    """

    def __init__(self, spark: SparkSession, base: str, *, retention_days: int = params.RETENTION_DAYS, slack_days: int = 2):
        self.spark, self.retention_days, self.slack = spark, retention_days, timedelta(days=slack_days)
        self.rows = EpochTable(spark, f"{base}/raw", f"{schemas.HISTORY}, cycle_date STRING", ("cycle_date",), reduce=_newest(["dataset_id", "cycle", "cycle_date"]))
        self.aggregates = EpochTable(spark, f"{base}/daily", schemas.DAILY, reduce=_combined)
        self.cycles = EpochTable(spark, f"{base}/compacted_cycles", "cycle STRING", reduce=lambda rows: rows.groupBy("cycle").agg(F.min("epoch").alias("epoch")))
        self.archive = EpochTable(spark, f"{base}/archive", f"{schemas.HISTORY}, month STRING", ("month",))
        self.runs = EpochTable(spark, f"{base}/compactions", "cutoff STRING", reduce=lambda rows: rows.orderBy(F.desc("epoch")).limit(1))
        self.columns = [part.strip().split(" ")[0] for part in schemas.HISTORY.replace("\n", " ").split(",")]

    def upsert(self, batch: DataFrame, epoch: int) -> None:
        day = F.substring("cycle", 1, 10)
        apart = F.abs(F.datediff(F.to_date("observed_at"), F.try_to_date(day, "yyyy-MM-dd")))
        placed = F.when(apart <= self.slack.days, day).otherwise(F.lit(_APART))
        self.rows.write(hist.keyed_history(batch.select(*self.columns)).withColumn("cycle_date", placed), epoch)

    def _current(self, rows: DataFrame) -> DataFrame:
        return latest_by(rows.drop("cycle_date"), ["dataset_id", "cycle"], F.col("epoch")).select(*self.columns)

    def _cutoff(self, now: str | datetime) -> datetime:
        instant = now if isinstance(now, datetime) else datetime.fromisoformat(now.replace("Z", "+00:00"))
        return instant.replace(tzinfo=instant.tzinfo or timezone.utc).astimezone(timezone.utc) - timedelta(days=self.retention_days)

    def raw(self, *, now: str | datetime | None = None) -> DataFrame:
        """Current rows, without the expired ones when ``now`` is given."""
        rows = self.rows.read()
        if now is None:
            return self._current(rows)
        cutoff = self._cutoff(now)
        recent = rows.where((F.col("cycle_date") >= (cutoff - self.slack).date().isoformat()) | (F.col("cycle_date") == _APART))
        return self._current(recent).where(F.col("observed_at") >= times.lit_instant(cutoff))

    def compact(self, *, now: str | datetime, epoch: int) -> None:
        """Aggregate and archive newly expired rows; rows of compacted cycles are left out.

        Reads only what can have changed since the last run: partitions around the
        dates that expired in between, and late arrivals of newer epochs. The run is
        recorded last, so an interrupted one is repeated as a whole.
        """
        cutoff = self._cutoff(now)
        due = F.col("cycle_date") <= (cutoff + self.slack).date().isoformat()
        rows = self.rows.read(before=epoch + 1).where(due | (F.col("cycle_date") == _APART))
        last = self.runs.read(before=epoch).agg(F.max(F.struct("epoch", "cutoff")).alias("r")).first()["r"]  # one row
        if last is not None:
            since = (datetime.fromisoformat(last["cutoff"]) - self.slack).date().isoformat()
            rows = rows.where((F.col("epoch") > last["epoch"]) | (F.col("cycle_date") >= since) | (F.col("cycle_date") == _APART))
        done = self.cycles.read(before=epoch).select("cycle").distinct()
        result = hist.compact_history(
            self._current(rows), None, done, now=times.lit_instant(cutoff), retention_days=0
        )
        self.aggregates.write(result.daily, epoch)
        self.archive.write(result.archived.withColumn("month", F.date_format("observed_at", "yyyy-MM")), epoch)
        self.cycles.write(result.compacted_cycles.join(done, "cycle", "left_anti"), epoch)
        self.runs.write(self.spark.createDataFrame([(cutoff.isoformat(),)], "cutoff STRING"), epoch)
        if last is not None:
            # all of their rows expired before the run that is recorded already, so a replay of this one doesn't need them
            expired = datetime.fromisoformat(last["cutoff"]) - self.slack
            self.rows.remove("cycle_date", lambda day: day != _APART and day < expired.date().isoformat())

    def fold(self, upto: int) -> None:
        """Fold the closed epochs up to ``upto`` in every table, so that files don't grow in number with epochs.

        ``upto`` must lie before the epoch that may still be replayed.
        """
        for table in (self.rows, self.aggregates, self.cycles, self.archive, self.runs):
            table.fold(upto)

    def daily(self) -> DataFrame:
        """One aggregate per (dataset, day): the epochs' partial results merged."""
        return hist.combine_daily(self.aggregates.read().withColumn("_rank", -F.col("epoch")))


def stream_upsert(stream: DataFrame, store: HistoryStore, *, checkpoint: str, clock=None, fold_every: int = params.FOLD_EPOCHS, **options):
    """Start a query that keeps ``store`` current; with a clock it also compacts after every batch.

    Every ``fold_every`` epochs those before the current one are folded: it alone may be replayed.
    """
    def apply(batch: DataFrame, epoch: int) -> None:
        store.upsert(batch, epoch)
        if clock is not None:
            store.compact(now=clock(), epoch=epoch)
        if epoch and epoch % fold_every == 0:
            store.fold(epoch - 1)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return _start(writer, options)


def _start(writer, options: dict):
    trigger = options.pop("trigger", None)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.options(**options).start()


class TransitionStore:
    """Change events of a stream, equal to those of its rows in event-time order, however they arrive.

    Rows are stored by day. A batch recomputes the events of its datasets from the earliest day that it touches, from
    stored rows and the values carried into that day, and the newest epoch of a (dataset, day) slice holds. An
    in-order stream recomputes the current day only; a late row costs the days since it was due.
    """

    fields = ("status", "shape_hash", "column_count")
    _values = "dataset_id STRING, observed_at TIMESTAMP, cycle STRING, status STRING, shape_hash STRING, column_count INT, day STRING"

    def __init__(self, spark: SparkSession, base: str):
        self.rows = EpochTable(spark, f"{base}/rows", self._values, ("day",))
        self.slices = EpochTable(spark, f"{base}/slices", self._values, ("day",), reduce=_newest(["dataset_id", "day"]))
        self.changes = EpochTable(
            spark, f"{base}/events", "dataset_id STRING, field STRING, from_value STRING, to_value STRING, at TIMESTAMP, day STRING", ("day",))

    def fold(self, upto: int) -> None:
        """Fold the closed epochs up to ``upto``: of slices and their events, only the newest of each (dataset, day) stay.

        Events go first: they are judged by the slices that are still there.
        """
        newest = self._newest()
        self.changes.reduce = lambda rows: rows.join(newest, ["dataset_id", "day", "epoch"], "left_semi").select(*rows.columns)
        for table in (self.changes, self.slices, self.rows):
            table.fold(upto)

    def _newest(self) -> DataFrame:
        return self.slices.read().groupBy("dataset_id", "day").agg(F.max("epoch").alias("epoch"))

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """Store one micro-batch and the events and carried values of the slices that it changes."""
        columns = ["dataset_id", "observed_at", "cycle", *self.fields]
        day = F.date_format("observed_at", "yyyy-MM-dd").alias("day")
        self.rows.write(batch.select(*columns, day), epoch)
        since = batch.select("dataset_id", day).groupBy("dataset_id").agg(F.min("day").alias("since"))
        earliest = since.agg(F.min("since")).first()[0]  # one value
        if earliest is None:
            return
        stored_rows = self.rows.read(before=epoch + 1).where(F.col("day") >= earliest).join(since, "dataset_id").where(F.col("day") >= F.col("since"))
        before = self.slices.read(before=epoch).join(since, "dataset_id").where(F.col("day") < F.col("since"))
        carried = latest_by(before.drop("since"), ["dataset_id"], F.struct("day", "epoch")).select(*columns, "day")
        known = stored_rows.select(*columns, "day").unionByName(carried)
        self.changes.write(drift.transition_events(known.select(*columns), fields=self.fields).withColumn("day", F.date_format("at", "yyyy-MM-dd")), epoch)
        order = F.struct("observed_at", "cycle")
        daily = known.groupBy("dataset_id", "day").agg(
            F.max("observed_at").alias("observed_at"), F.max_by("cycle", order).alias("cycle"),
            *[F.max_by(name, F.when(F.col(name).isNotNull(), order)).alias(name) for name in self.fields])
        by_day = Window.partitionBy("dataset_id").orderBy("day")  # one row per day
        ends = daily.select("dataset_id", "observed_at", "cycle", *[F.last(name, ignorenulls=True).over(by_day).alias(name) for name in self.fields], "day")
        self.slices.write(ends.join(since, "dataset_id").where(F.col("day") >= F.col("since")).drop("since"), epoch)

    def events(self) -> DataFrame:
        return self.changes.read().join(self._newest(), ["dataset_id", "day", "epoch"], "left_semi").drop("day", "epoch")


def stream_transitions(stream: DataFrame, store: TransitionStore, *, checkpoint: str, fold_every: int = params.FOLD_EPOCHS, **options):
    """Start a query that keeps ``store`` current and folds it every ``fold_every`` epochs."""
    def apply(batch: DataFrame, epoch: int) -> None:
        store.apply(batch, epoch)
        if epoch and epoch % fold_every == 0:
            store.fold(epoch - 1)

    return _start(stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint), options)
