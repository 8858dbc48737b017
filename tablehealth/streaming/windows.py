"""Windowed and stateful stream operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tablehealth import params
from tablehealth.operators import history as hist
from tablehealth.operators.summary import _usage_items


def stream_daily(stream: DataFrame, *, watermark: str = f"{params.RETENTION_DAYS} days") -> DataFrame:
    """Daily aggregates of a stream; a day is emitted once the watermark has passed it.

    Rows later than the watermark are dropped by Spark. The stricter rule for late
    rows of compacted cycles is ``HistoryStore.compact``.
    """
    return hist.aggregate_daily(stream.withWatermark("observed_at", watermark))


def stream_usage(usage: DataFrame, *, watermark: str = "1 day") -> DataFrame:
    """Calls per UTC day, buyer, metric and key."""
    items = usage.withWatermark("ts", watermark).select(
        "ts", "buyer_id", F.explode(_usage_items(F.coalesce("tool", F.lit("unknown")))).alias("_item")
    )
    return (
        items.groupBy(F.window("ts", "1 day").alias("_day"), "buyer_id", F.col("_item.metric").alias("metric"), F.col("_item.key").alias("key"))
        .agg(F.count("*").alias("calls"))
        .select(F.to_date("_day.start").alias("date"), "buyer_id", "metric", "key", "calls")
    )


_ALERT = "dataset_id STRING, last_success_at TIMESTAMP, alert BOOLEAN"


def heartbeat_tracker(wait_ms: int):
    """The state function of ``stream_heartbeat``.

    The state is the latest success, whether its dataset is alerting, and the processing time from which the wait runs: that
    of the last batch with a success, or of the first sight. Batches of failures never move it.
    """
    stamp = lambda value: pd.to_datetime(value, unit="us") if value is not None else pd.NaT

    def track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        last, alerting, since = state.get if state.exists else (None, False, now)
        row = lambda alert: pd.DataFrame({"dataset_id": [key[0]], "last_success_at": [stamp(last)], "alert": [alert]})
        if state.hasTimedOut:
            state.update((last, True, since))
            if not alerting:
                yield row(True)
            return
        for batch in batches:
            seen = batch["success_us"].dropna()
            if len(seen):
                last, since, back = max(int(seen.max()), last or 0), now, alerting
                if back:
                    yield row(False)
                alerting = False
        left = since + wait_ms - now
        if not alerting and left <= 0:
            alerting = True
            yield row(True)
        state.update((last, alerting, since))
        if not alerting:
            state.setTimeoutDuration(left)

    return track


def stream_heartbeat(stream: DataFrame, *, minutes: int = params.HEARTBEAT_MINUTES) -> DataFrame:
    """An alert row when a dataset had no success for ``minutes`` of processing time, and one when it is back.

    A dataset that keeps failing alerts like a silent one, and a dataset first seen failing has its deadline from then.
    """
    success = F.when(F.col("probe_outcome") == "success", F.unix_micros("observed_at"))
    return (
        stream.select("dataset_id", success.alias("success_us"))
        .groupBy("dataset_id")
        .applyInPandasWithState(
            heartbeat_tracker(int(minutes * 60_000)), _ALERT, "last_success_us BIGINT, alerting BOOLEAN, since_ms BIGINT", "append",
            GroupStateTimeout.ProcessingTimeTimeout,
        )
    )
