from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tablehealth import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("checkpoints"))
    return local_session(8, app="tests", **{
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": folder, "spark.sql.shuffle.partitions": "2", "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1",
    })


def ts(text: str) -> dt.datetime:
    """A UTC instant for ``createDataFrame``."""
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)


def history_rows(spark, rows):
    """History rows from dicts; omitted fields are null."""
    from tablehealth import schemas
    from tablehealth.sources.readers import _fields

    names = [name for name, _ in _fields(schemas.HISTORY)]
    filled = []
    for i, row in enumerate(rows):
        row = {"probe_outcome": "success", "status": "fresh", "cycle": row["observed_at"].strftime("%Y-%m-%dT%H:%M"), "seq": i, **row}
        filled.append(tuple(row.get(name) for name in names))
    return spark.createDataFrame(filled, schemas.HISTORY)


def catalog_rows(spark, rows):
    from tablehealth import schemas
    from tablehealth.sources.readers import _fields

    names = [name for name, _ in _fields(schemas.CATALOG)]
    return spark.createDataFrame([tuple(row.get(name) for name in names) for row in rows], schemas.CATALOG)


def snapshot_rows(spark, rows):
    ddl = """dataset_id STRING, checked_at TIMESTAMP, last_checked TIMESTAMP, status STRING, message STRING, staleness_days BIGINT,
        content_freshness_date DATE, last_modified TIMESTAMP, record_count BIGINT, record_count_estimated BOOLEAN, column_count INT,
        first_row_hash STRING, content_shape_changed BOOLEAN, expected_record_count BIGINT, access_dependency STRING, access_method STRING,
        http_status INT, freshness_signal STRING, freshness_signal_source STRING, anomaly_detected BOOLEAN, request_url STRING, url STRING"""
    names = [part.strip().split()[0] for part in ddl.split(",")]
    return spark.createDataFrame([tuple(row.get(name) for name in names) for row in rows], ddl)


def by_id(df, key="dataset_id"):
    return {row[key]: row.asDict(recursive=True) for row in df.collect()}
