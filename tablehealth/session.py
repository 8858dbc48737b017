"""Session settings shared by every entry point."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that may be changed on a running session. All day arithmetic in the
# package is UTC calendar arithmetic, so the time zone is not negotiable.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Python workers get batches by size too: rows may hold very long texts
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on; safe to repeat."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", app: str = "tablehealth", **conf: str) -> SparkSession:
    """A single-machine session for tests and for ``bench.py``."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one named in ``spark.checkpoint.dir``, else one below the warehouse.

    On a cluster one of the two must be set to a folder that all executors share: the warehouse's own default is a folder of
    the driver's machine and serves local sessions only.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch_path(spark: SparkSession, label: str = "tablehealth") -> str:
    """A new path in the scratch folder, deleted with all below it when the session's JVM ends."""
    path = f"{scratch_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write the frame once as Parquet to the shared scratch folder and continue from there.

    Later reads prune columns and push filters down, and a lost executor costs one file read again.
    The files are deleted when the session's JVM ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


cut_lineage = stored
