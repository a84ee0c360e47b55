"""Sources and sinks: Parquet, Arrow IPC, JSON rows, CSV,
hive-partitioned scans, object listings, and format-negotiated writes.

Readers are lazy ``spark.read`` calls, so filters and projections reach the
scan (``PushedFilters`` / ``ReadSchema``); writers are executor-side
``df.write`` calls -- results never pass through the driver.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBJECT_PIECE = 4 << 20  # bytes of a body in a row
ARROW_BATCH_ROWS = 10_000
ARROW_FILE_STREAMS = 32  # streams of a file
ARROW_END = "LAKEARRW"  # follows each stream of a file
MAX_RECORDS_PER_FILE = 10_000_000
TARGET_FILE_BYTES = 128 * 1024 * 1024


# ------------------------------------------------------------------ readers

def src_parquet(spark: SparkSession, path, columns: list[str] | None = None, where=None) -> DataFrame:
    """Parquet scan; ``columns`` and ``where`` are pushed to the reader."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if where is not None:
        df = df.filter(where)
    if columns:
        df = df.select(*columns)
    return df


def src_json_rows(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines; with no schema Spark infers one as the union of all rows
    (missing fields become null).  Pass a schema in production: inference is
    a full extra pass."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def src_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True,
            casts: dict[str, str] | None = None) -> DataFrame:
    """CSV with a declared schema (no inference pass) and optional casts."""
    df = spark.read.option("header", header).schema(schema).csv(path)
    for c, t in (casts or {}).items():
        df = df.withColumn(c, F.col(c).cast(t))
    return df


def src_hive_partitioned(spark: SparkSession, path: str, filename: bool = True) -> DataFrame:
    """Hive-partitioned Parquet: partition columns are discovered from
    ``key=value`` folders (filters on them prune folders); optionally the
    source file of each row from the ``_metadata`` column."""
    df = spark.read.option("basePath", path).parquet(path)
    if filename:
        df = df.select("*", F.col("_metadata.file_path").alias("filename"))
    return df


def src_object_list(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Object listing (path, length, modificationTime): ``binaryFile`` with the
    content column pruned, so file bodies are never read."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def src_object_get(spark: SparkSession, path: str, glob: str | None = None, piece: int | None = None) -> DataFrame:
    """Object bodies, one row per object (path, length, content).

    With ``piece``: (path, length, offset, content), a row per ``piece`` bytes, those of an
    object one after another in one task.  Files of the local
    or a mounted file system are then read piece by piece, so a task's memory does not grow
    with the object; from other stores Spark reads a body whole before it is cut."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    objects = r.option("recursiveFileLookup", "true").load(path)
    if piece is None:
        return objects.select("path", "length", "content")
    names, schema = ["path", "length", "offset", "content"], "path string, length long, offset long, content binary"

    def row(name: str, length: int, offset: int, body) -> pa.RecordBatch:
        body = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(struct.pack("<ii", 0, len(body))), pa.py_buffer(body)])  # not copied
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([length], pa.int64()), pa.array([offset], pa.int64()), body], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, length, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                body = memoryview(body.as_buffer())
                for at in range(0, length, piece):
                    yield row(name, length, at, body[at : at + piece])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with open("/" + name.removeprefix("file:").lstrip("/"), "rb") as file:
                    for at in range(0, length, piece):
                        body = file.read(min(piece, length - at))
                        if len(body) != min(piece, length - at):
                            raise OSError(f"{name} ended before its {length} bytes")
                        yield row(name, length, at, body)

    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
        return objects.select("path", "length").mapInArrow(fetch, schema)
    return objects.select("path", "length", "content").mapInArrow(cut, schema)


def src_arrow_ipc(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None) -> DataFrame:
    """Arrow IPC stream files: one task decodes each file (``mapInArrow``),
    yielding its record batches; the files are the unit of parallelism."""
    files = src_object_get(spark, path, glob).select("content")
    names, end = [f.name for f in schema.fields], ARROW_END.encode()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa  # noqa: F811  (executor side)

        for b in batches:
            for body in b.column(0):
                blob = body.as_buffer()  # not copied
                src = pa.BufferReader(blob)
                # Complete streams back to back, each with or without the end mark.
                while src.tell() < blob.size:
                    for rb in pa.ipc.open_stream(src):
                        yield rb.select(names)
                    if blob[src.tell() : src.tell() + len(end)].to_pybytes() == end:
                        src.seek(src.tell() + len(end))

    return files.mapInArrow(decode, schema)


def register_sources(spark: SparkSession, sources: dict[str, str], fmt: str = "parquet") -> list[str]:
    """Name -> path views for federated SQL (``spark.sql`` over them)."""
    for name, path in sources.items():
        spark.read.format(fmt).load(path).createOrReplaceTempView(name)
    return list(sources)


def src_fallback(spark: SparkSession, paths: list[str], fmt: str = "parquet",
                 refresh_cache: str | None = None) -> DataFrame:
    """Primary, else fallback(s), else cached copy; the first path whose scan
    resolves wins (schema resolution is eager, so a missing path fails here).
    With ``refresh_cache`` the winning source is copied to that path."""
    errors = []
    for p in paths:
        try:
            df = spark.read.format(fmt).load(p)
            df.schema  # noqa: B018
        except Exception as e:  # noqa: BLE001
            errors.append(f"{p}: {type(e).__name__}")
            continue
        if refresh_cache and p != refresh_cache:
            df.write.mode("overwrite").format(fmt).save(refresh_cache)
        return df
    raise RuntimeError("no source available: " + "; ".join(errors))


# ------------------------------------------------------------------ sinks

def sink_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "overwrite") -> str:
    df.write.mode(mode).option("compression", compression).parquet(path)
    return path


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with header; nulls written as ''."""
    df.write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
    return path


def sink_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).json(path)
    return path


def arrow_ipc_batches(df: DataFrame, max_rows: int = ARROW_BATCH_ROWS) -> DataFrame:
    """Arrow IPC streams built on executors: one row per batch of at most
    ``max_rows`` rows (partition, seq, ipc bytes).  Each value is a complete,
    independently readable IPC stream."""
    schema = df.schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa  # noqa: F811
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seq = 0
        for b in batches:
            for off in range(0, b.num_rows, max_rows):
                chunk = b.slice(off, max_rows)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, chunk.schema) as w:
                    w.write_batch(chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([chunk.num_rows], pa.int64()),
                     pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "seq", "rows", "ipc"])
                seq += 1

    out = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()),
                        T.StructField("rows", T.LongType()), T.StructField("ipc", T.BinaryType())])
    return df.select(*[F.col(f.name) for f in schema.fields]).mapInArrow(encode, out)


def sink_arrow(df: DataFrame, path: str, max_rows: int = ARROW_BATCH_ROWS) -> str:
    """Arrow IPC files on any file system Spark writes.

    A file is a chain of up to ``ARROW_FILE_STREAMS`` complete IPC streams of at most ``max_rows`` rows, each
    followed by ``ARROW_END``; it is written by Spark's text writer, whose commit
    protocol covers lost tasks.  ``src_arrow_ipc`` reads the chain; an ordinary
    stream reader reads the streams one after another.
    """
    streams = arrow_ipc_batches(df, max_rows).select(F.col("ipc").cast("string"))
    streams.write.mode("overwrite").option("maxRecordsPerFile", ARROW_FILE_STREAMS).option("lineSep", ARROW_END).text(path)
    return path


def sink_partitioned(df: DataFrame, path: str, cols: list[str], max_records: int = MAX_RECORDS_PER_FILE,
                     mode: str = "overwrite") -> str:
    """Hive-partitioned Parquet, at most ``max_records`` rows per file.  Rows
    are clustered by the partition columns first so each task writes few folders;
    the rebalance splits a value that holds more than a task's share."""
    (df.hint("rebalance", *[F.col(c) for c in cols]).write.mode(mode).partitionBy(*cols)
     .option("maxRecordsPerFile", max_records).parquet(path))
    return path


def sink_parquet_tuned(df: DataFrame, path: str, bloom_cols: list[str] = (), sort_cols: list[str] = (),
                       level: int = 3, mode: str = "overwrite") -> str:
    """zstd, dictionary encoding, bloom filters on point-lookup columns, and
    rows sorted within each file so min/max statistics prune well."""
    w = df.sortWithinPartitions(*sort_cols) if sort_cols else df
    wr = (w.write.mode(mode).option("compression", "zstd").option("parquet.compression.codec.zstd.level", level)
          .option("parquet.enable.dictionary", "true"))
    for c in bloom_cols:
        wr = wr.option(f"parquet.bloom.filter.enabled#{c}", "true")
    wr.parquet(path)
    return path


# What an Accept header must contain for each format, in order of precedence.
NEGOTIATION = [
    ("application/vnd.apache.arrow", "arrow"),
    ("application/parquet", "parquet"),
    ("application/octet-stream", "parquet"),
    ("text/csv", "csv"),
    ("application/json", "json"),
    ("*/*", "json"),
]


def negotiate(accept: str | None) -> str:
    """Pick the output format for an Accept header, by fixed precedence; JSON without one."""
    a = "application/json" if accept is None else accept
    for mime, fmt in NEGOTIATION:
        if mime in a:
            return fmt
    raise ValueError(f"unsupported media type: {accept}")


def sink_negotiate(df: DataFrame, path: str, accept: str | None) -> tuple[str, str]:
    fmt = negotiate(accept)
    writer: dict[str, Callable[[DataFrame, str], str]] = {
        "arrow": sink_arrow, "parquet": sink_parquet, "csv": sink_csv, "json": sink_json}
    return fmt, writer[fmt](df, path)


def stream_transform_file(spark: SparkSession, src: str, dst: str, fn: Callable[[DataFrame], DataFrame],
                          fmt: str = "parquet") -> str:
    """Larger-than-memory read -> transform -> write as one lazy plan; Spark
    streams partitions through ``fn`` (no chunk loop on the driver)."""
    fn(spark.read.format(fmt).load(src)).write.mode("overwrite").format(fmt).save(dst)
    return dst


def files_for_bytes(total_bytes: int, target: int = TARGET_FILE_BYTES) -> int:
    return max(1, math.ceil(total_bytes / target))
