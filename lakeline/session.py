"""Session construction and shared settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every Lakeline job relies on: UTC wall clock (the test tables carry
# zone-less timestamps), AQE for runtime re-planning (coalescing, skew joins,
# size-checked broadcast from runtime statistics), no web UI.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpointed scans and frontiers are deleted once no longer referenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Streaming state (windows, dedup keys, latest state, liveness) off-heap in
    # RocksDB, so large state does not pressure executor JVM heaps.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
}

TARGET_PARTITION_BYTES = 128 * 1024 * 1024


def sizing(input_bytes: int, total_cores: int, partition_bytes: int = TARGET_PARTITION_BYTES) -> dict:
    """Settings for a job reading ``input_bytes`` on ``total_cores`` cores.

    Shuffle partitions are sized so a partition holds ~``partition_bytes`` of
    (pre-aggregation) data, at least 3 waves of the cluster's cores; AQE then
    coalesces small ones and splits skewed join partitions.  E.g. 100 TB on
    1000 executors x 8 cores -> ~800k partitions, scan splits of 128 MB.
    """
    waves = 3 * max(1, total_cores)
    parts = max(waves, -(-int(input_bytes) // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * partition_bytes),
    }


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "lakeline", extra: dict | None = None) -> SparkSession:
    """Return the active session or build one with Lakeline defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared (distributed) folder and is only
    read here.  Only when it is unset (local tests) do we pick a scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared (distributed) folder")
        d = tempfile.mkdtemp(prefix="lakeline-ckpt-")  # local mode only (tests)
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for derived tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name) if "://" not in base else base.rstrip("/") + "/" + name
