"""Session settings the jobs rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split hot join keys even where the next step groups by the same key.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # JSON objects with a repeated key keep the last value, as Python's and
    # JavaScript's parsers do.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # A batch row carries up to 64 texts; small Arrow batches keep the Python
    # workers' memory flat whatever the text length.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings. Cluster sizing (executors, memory, shuffle
    partitions) stays with whoever submits the job."""
    for key, value in _RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def size_shuffles(spark: SparkSession, data_bytes: int, partition_bytes: int = 256 * 1024 * 1024) -> int:
    """Set the number of shuffle partitions for a shuffle of ``data_bytes``.

    Spark merges partitions that turn out small but cannot split those of an
    aggregation, so the number has to fit the data from the start: the default
    of 200 would mean 500 GB each at 100 TB. Never lowers the current setting.
    """
    wanted = -(-data_bytes // partition_bytes)
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(wanted, 1_000_000))
    spark.conf.set("spark.sql.shuffle.partitions", str(count))
    return count


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the cluster's shared folder.

    ``spark.checkpoint.dir`` names that folder. Only where it is unset, as in a
    local test, a temporary folder is used and recorded in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="glosswork-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/glosswork/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared scratch folder: computed once, however often
    it is read, and with its lineage cut. The tables of a run lie side by side below
    ``spark.checkpoint.dir``; whoever set that folder removes them when the run is over."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
