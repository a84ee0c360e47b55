"""Snapshot registry: register, latest, list, as-of version/time.

The registry is a DataFrame (table_name, snapshot_id, uri, format,
created_at[, schema, status]) kept as an append-only Parquet folder.  All
lookups are aggregates (``max_by``) -- partial per task, so a table with very
many snapshots never lands in one task; versions are skew-safe positions.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lakeline.operators.scan import with_position
from lakeline.sources.commits import claim

REGISTRY_SCHEMA = ("table_name string, snapshot_id bigint, uri string, format string, created_at timestamp_ntz, "
                   "schema map<string,string>, status string, error string, version bigint")


def _ord():
    return F.struct(F.col("created_at"), F.col("snapshot_id"))


def snap_latest(snapshots: DataFrame) -> DataFrame:
    """Latest snapshot per table by (created_at desc, snapshot_id desc)."""
    cols = [c for c in snapshots.columns if c != "table_name"]
    g = snapshots.groupBy("table_name").agg(F.max_by(F.struct(*cols), _ord()).alias("__s"))
    return g.select("table_name", *[F.col("__s." + c).alias(c) for c in cols])


def snap_list_tables(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("table_name").agg(
        F.max_by("snapshot_id", _ord()).alias("latest_snapshot_id"),
        F.count(F.lit(1)).alias("snapshots"), F.max("created_at").alias("last_created_at"))


def with_versions(snapshots: DataFrame) -> DataFrame:
    """The stored version, which stays when older snapshots go; a registry without
    one gets the 1-based position in its table by (created_at, snapshot_id)."""
    if "version" in snapshots.columns:
        return snapshots
    return with_position(snapshots, ["table_name"], ["created_at", "snapshot_id"], "version")


def snap_as_of(snapshots: DataFrame, version: int | None = None, ts=None, table: str | None = None) -> DataFrame:
    """Snapshot per table at a version, or the newest one created at or
    before ``ts``; exactly one of the two must be given."""
    if (version is None) == (ts is None):
        raise ValueError("give exactly one of version or ts")
    s = snapshots if table is None else snapshots.filter(F.col("table_name") == table)
    if version is not None:
        return with_versions(s).filter(F.col("version") == version)
    t = F.lit(ts).cast("timestamp_ntz") if isinstance(ts, str) else ts
    return snap_latest(s.filter(F.col("created_at") <= t))


def read_registry(spark: SparkSession, registry: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).parquet(registry).drop("commit")


def next_version(spark: SparkSession, registry: str, table: str) -> int:
    """A version above all stored for the table, claimed so that no other writer gets it."""
    try:
        known = read_registry(spark, registry)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return claim(spark, _claims(registry, table))
    stored = known.filter(F.col("table_name") == table).agg(F.max("version")).first()[0] or 0
    return claim(spark, _claims(registry, table), stored)


def _claims(registry: str, table: str) -> str:
    """Folder of the table's claimed numbers, beside the registry; any name is safe in a path."""
    return f"{registry.rstrip('/')}_claims/{hashlib.sha256(table.encode()).hexdigest()}"


def snap_register(spark: SparkSession, registry: str, table: str, snapshot_id: int, uri: str,
                  fmt: str = "parquet", schema: dict | None = None) -> DataFrame:
    """Validate the URI by resolving its schema (inferred when not given),
    then append one row marked completed, or failed with the error."""
    status, error = "completed", None
    try:
        found = spark.read.format(fmt).load(uri).schema
        if schema is None:
            schema = {f.name: f.dataType.simpleString() for f in found.fields}
    except Exception as e:  # noqa: BLE001
        status, error = "failed", f"{type(e).__name__}: {e}"
    version = next_version(spark, registry, table)
    row = spark.createDataFrame([(table, snapshot_id, uri, fmt, None, schema, status, error, version)], REGISTRY_SCHEMA)
    row = row.withColumn("created_at", F.localtimestamp())
    # A folder a write: writers into one folder would delete each other's temporary files.
    row.write.parquet(f"{registry.rstrip('/')}/commit={uuid.uuid4().hex}")
    return read_registry(spark, registry)


def snap_read(spark: SparkSession, snapshots: DataFrame, table: str) -> DataFrame:
    """Resolve a table name to its latest completed snapshot and read it
    (records an INPUT in the active lineage context, if any)."""
    s = snapshots
    if "status" in s.columns:
        s = s.filter(F.col("status") == "completed")
    row = snap_latest(s.filter(F.col("table_name") == table)).select("uri", "format").first()
    if row is None:
        raise KeyError(f"no snapshot for table {table}")
    from lakeline.operators.tracking import record_input

    record_input(table, row["uri"])
    return spark.read.format(row["format"]).load(row["uri"])
