"""Helpers shared by the corpus operators: saved tables and skew-safe per-key answers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeline.session import scratch_path

# Fixed pattern: the white space of the contracts (space and \x09-\x0D).
WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RECORDS: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder of ``spark.checkpoint.dir``."""
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    for record in RECORDS:
        record.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that ``new_path`` gives meanwhile."""
    RECORDS.append(paths := [])
    try:
        yield paths
    finally:
        RECORDS.remove(paths)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders, on whatever file system they are."""
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once in the shared folder and return the written table.

    Cuts lineage: whatever is nondeterministic above (partition numbers, range
    bounds) is fixed, and a lost executor costs one task, not the whole plan.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salt_of(spark: SparkSession, *cols: Column) -> Column:
    """A salt that deals the rows of one hot key over all shuffle partitions."""
    n = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def hand_down(whole: DataFrame, keys: list[str], salted: DataFrame) -> DataFrame:
    """Rows (salt, keys) -> (salt, keys, what ``whole`` says of the keys).

    ``salted`` holds each (salt, key) once, so a key meets at most as many rows
    as there are salts; joining data rows back on (salt, key) afterwards is even
    however many rows one key has.
    """
    return salted.select("salt", *keys).join(whole, keys)
