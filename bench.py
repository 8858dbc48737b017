"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tablehealth import local_session
from tablehealth.plans import registry

HEADLINE = (
    "find_deteriorating", "latest_per_day", "aggregate_daily", "upsert_history", "transitions", "record_trend", "drift",
    "build_snapshot", "detect_anomalies", "heartbeat_gap", "dataset_deltas", "discover_groups", "reconcile", "graph_degrees",
    "trust_score", "attestation_links", "record_evidence", "shape_fingerprint", "extract_text_dates", "usage_summary",
    "payload_profile", "with_lookups",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="bench", **{"spark.ui.showConsoleProgress": "false"})
    queries = registry.queries()
    queries["heartbeat"](spark, directory).write.format("noop").mode("overwrite").save()  # start the workers
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(directory.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
