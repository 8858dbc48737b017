"""Change events of a stream from keyed state, without reading anything that is stored.

Per dataset the state holds the last known value of each field and the rows that the watermark hasn't passed yet. A timer at
the earliest such row fires when the watermark reaches it; rows up to the watermark are then final, as later ones of their
time no longer get in, and are compared in order of (observed_at, cycle). So micro-batches in any order, within the delay, give
the events of ``drift.transition_events``, and the state is one row and the rows of one delay for each dataset, however long
the stream runs. Rows later than the delay are left out by Spark; ``store.TransitionStore`` takes them at the price of reading
stored days again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FIELDS = ("status", "shape_hash", "column_count")
EVENTS = "dataset_id STRING, field STRING, from_value STRING, to_value STRING, at TIMESTAMP"
_VALUES = "status STRING, shape_hash STRING, column_count INT"
#: transformWithState keeps its timers and lists in this provider.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def changes_of(rows: list[tuple], known: tuple) -> tuple[list[tuple], tuple]:
    """((field, from, to, micros) of the changes, the values known after them) of (micros, cycle, *values), sorted here.

    Nulls are no values. Rows of one instant and cycle go by their values.
    """
    out, values = [], list(known)
    for at, _, *now in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", *[(v is not None, v if v is not None else 0) for v in r[2:]])):
        for i, (name, value) in enumerate(zip(FIELDS, now)):
            if value is None:
                continue
            if values[i] is not None and values[i] != value:
                out.append((name, str(values[i]), str(value), at))
            values[i] = value
    return out, tuple(values)


class _Transitions(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", _VALUES)
        self.waiting = handle.getListState("waiting", f"at BIGINT, cycle STRING, {_VALUES}")
        self.due = handle.getValueState("due", "due BIGINT")

    def _wait_for(self, rows: list[tuple]) -> None:
        """One timer, at the earliest of the rows that wait."""
        due = min(-(-row[0] // 1000) for row in rows)
        if self.due.exists():
            if self.due.get()[0] <= due:
                return
            self.handle.deleteTimer(self.due.get()[0])
        self.due.update((due,))
        self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            columns = [frame[name].astype(object).where(frame[name].notna(), None) for name in ("at", "cycle", *FIELDS)]
            new += [(int(at), cycle, status, shape, None if count is None else int(count)) for at, cycle, status, shape, count in zip(*columns)]
        if new:
            self.waiting.appendList(new)
            self._wait_for(new)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(row) for row in self.waiting.get()]
        later = [row for row in rows if row[0] > passed]
        events, known = changes_of([row for row in rows if row[0] <= passed], self.known.get() if self.known.exists() else (None,) * len(FIELDS))
        self.known.update(known)
        self.due.clear()
        if later:
            self.waiting.put(later)
            self._wait_for(later)
        else:
            self.waiting.clear()
        if events:
            frame = pd.DataFrame(events, columns=["field", "from_value", "to_value", "at"])
            frame.insert(0, "dataset_id", key[0])
            frame["at"] = pd.to_datetime(frame["at"], unit="us")
            yield frame

    def close(self) -> None:
        pass


def stateful_transitions(stream: DataFrame, *, delay: str = "2 hours") -> DataFrame:
    """The change events (dataset_id, field, from_value, to_value, at) of a stream of observations.

    ``delay`` is how far rows may come out of order; an event comes out once the watermark has passed it. Rows without a dataset
    or an instant are left out. Repeated rows change nothing. Sets the session's state store provider to ``PROVIDER``.
    """
    stream.sparkSession.conf.set(*PROVIDER)
    rows = (
        stream.where(F.col("dataset_id").isNotNull() & F.col("observed_at").isNotNull())
        .withWatermark("observed_at", delay)
        .select("dataset_id", "observed_at", F.unix_micros("observed_at").alias("at"), "cycle", *FIELDS)
    )
    return rows.groupBy("dataset_id").transformWithStateInPandas(_Transitions(), EVENTS, "append", "EventTime")
