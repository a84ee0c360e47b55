"""Versioned Parquet tables that change file by file.

A table is a folder of immutable data files and, per version, a manifest: one row a live
file with its rows, bytes and the least and greatest key tuple.  Each commit also writes
the Bloom filters of its files' keys as pages of 32,768 bits (Spark's bitmap
aggregate; a key has its four bits on one page).  A version is committed by creating its
marker (``commits``); a writer that loses the race makes its change again on the new one.

A change by key touches only files that hold one of the keys:

1. source keys are counted in ranges between their quantiles; a file whose key range
   meets no counted range is out;
2. a file that meets few source keys is probed in its Bloom filter, key by key; one that
   meets many is taken as it is, so probes are at most ``PROBES`` a file;
3. the key columns of the files left are read and joined: files without a match stay.

The others are carried over by name.  Only file names and sizes come to the driver.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeline.operators.splitters import placed, splitters
from lakeline.sources import commits
from lakeline.sources.tables import pack_files, tbl_bulk_update, tbl_merge_upsert, unique_by, write_bins

PAGE_BITS = 32_768  # fixed by Spark's bitmap aggregate
BITS_PER_KEY = 10
PROBES = 1_000
RANGES = 256


@dataclass(frozen=True)
class Table:
    spark: SparkSession
    root: str
    name: str

    @property
    def folder(self) -> str:
        return f"{self.root.rstrip('/')}/{self.name}"

    @property
    def log(self) -> str:
        return f"{self.folder}/commits"

    def version(self) -> int:
        """The newest version; 0 where there is none."""
        return max(commits.numbers(self.spark, self.log), default=0)

    def entry(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version not in commits.numbers(self.spark, self.log) or version in commits.numbers(self.spark, f"{self.folder}/vacuumed"):
            raise KeyError(f"no version {version or ''} of {self.name}")
        return commits.read_marker(self.spark, self.log, version)

    def manifest(self, version: int | None = None) -> DataFrame:
        """file, rows, bytes, least, most of each live file."""
        entry = self.entry(version)
        return self.spark.read.schema(T.StructType.fromJson(json.loads(entry["manifest_schema"]))).parquet(f"{self.folder}/{entry['manifest']}")

    def read(self, version: int | None = None, files: list[str] | None = None) -> DataFrame:
        """The rows of a version, or of some of its files."""
        schema = T.StructType.fromJson(json.loads(self.entry(version)["schema"]))
        if files is None:
            files = [r.file for r in self.manifest(version).select("file").collect()]
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{f}" for f in files])


def _pages(rows: Column) -> Column:
    """Pages of the Bloom filter of a file of so many rows."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(rows * BITS_PER_KEY / PAGE_BITS))


def _hashes(keys: list[str], rows: Column) -> dict[str, Column]:
    """Page of a key in a file of so many rows, and its four bits on the page."""
    bits = F.xxhash64(F.lit(2), *keys)
    at = F.array(*[F.shiftright(bits, 15 * i).bitwiseAND(F.lit(PAGE_BITS - 1)) for i in range(4)])
    return {"page": F.pmod(F.xxhash64(F.lit(1), *keys), _pages(rows)), "bits": at}


def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: (file, pages, page, bits) -> bitmap of each page met, in the layout of
    ``bitmap_construct_agg``.  Rows of a task come file by file, so one file's bits are held; a
    file in several tasks or parts gives a page more than once."""
    page_bits, name, held = PAGE_BITS, None, None

    def given() -> Iterator[pa.RecordBatch]:
        pages = held.reshape(-1, page_bits // 8)
        met = np.flatnonzero(pages.any(axis=1))
        for some in np.array_split(met, -(-len(met) // 1024) or 1):
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int64()),
                                                  pa.array([x.tobytes() for x in pages[some]], pa.binary())], ["file", "page", "bitmap"])

    for batch in batches:
        if not batch.num_rows:
            continue
        files = batch.column(0).dictionary_encode()
        codes = np.array(files.indices)
        pages, page = np.array(batch.column(1)), np.array(batch.column(2))
        bits = np.array(batch.column(3).flatten()).reshape(len(codes), -1)
        cuts = np.flatnonzero(codes[1:] != codes[:-1]) + 1
        for begin, end in zip(np.r_[0, cuts], np.r_[cuts, len(codes)]):
            now = files.dictionary[codes[begin].item()].as_py()
            if now != name:
                if name is not None:
                    yield from given()
                name, held = now, np.zeros(int(pages[begin]) * (page_bits // 8), np.uint8)
            at = (page[begin:end, None] * page_bits + bits[begin:end]).ravel()
            np.bitwise_or.at(held, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    if name is not None:
        yield from given()


def _stats(rows: DataFrame, file: Column, keys: list[str]) -> DataFrame:
    """rows, bytes, least and greatest key of each file.  The set of a file's one size makes the
    aggregate one of objects, which keeps a few files a task without sorting the rows."""
    stats = rows.select(file.alias("file"), F.col("_metadata.file_size").alias("bytes"), F.struct(*keys).alias("key"))
    return stats.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.get(F.collect_set("bytes"), F.lit(0)).alias("bytes"),
                                     F.min("key").alias("least"), F.max("key").alias("most"))


def _filters(rows: DataFrame, file: Column, keys: list[str], stats: DataFrame) -> DataFrame:
    """file, page, bitmap: rows become bits where they are read; only pages are shuffled."""
    held = rows.select(file.alias("file"), *keys).dropna(subset=keys)
    held = held.join(F.broadcast(stats.select(F.col("file").alias("f"), F.col("rows").alias("n"))), F.col("file") == F.col("f"))
    held = held.select("file", _pages(F.col("n")).alias("pages"), *[c.alias(n) for n, c in _hashes(keys, F.col("n")).items()])
    some = held.mapInArrow(bitmaps, "file string, page long, bitmap binary")
    return some.groupBy("file", "page").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def _write_files(t: Table, df: DataFrame, keys: list[str], commit: str) -> DataFrame:
    """Write rows as data files with their Bloom filters; the manifest rows."""
    df.write.parquet(f"{t.folder}/data/{commit}")
    return _described(t, df.schema, keys, commit)


def _described(t: Table, schema: T.StructType, keys: list[str], commit: str) -> DataFrame:
    """Stores statistics and Bloom filters of a commit's data files; the manifest rows."""
    spark, folder = t.spark, f"{t.folder}/data/{commit}"
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)
    name = F.substring_index(F.col("_metadata.file_path"), f"/{commit}/", -1)
    file = F.concat(F.lit(f"data/{commit}/"), name)
    stats = _stats(rows, file, keys)
    stats.write.parquet(f"{t.folder}/stats/{commit}")
    stats = spark.read.schema(stats.schema).parquet(f"{t.folder}/stats/{commit}")
    _filters(rows, file, keys, stats).write.parquet(f"{t.folder}/filters/{commit}")
    return stats


def _commit(t: Table, change: Callable[[int, str], dict], tries: int = 100) -> int:
    """Make ``change`` on the newest version until its marker can be created."""
    for _ in range(tries):
        base, commit = t.version(), uuid.uuid4().hex
        entry = change(base, commit) | {"commit": commit, "committed_at": time.time()}
        if commits.create_if_absent(t.spark, commits.marker(t.log, base + 1), json.dumps(entry)):
            return base + 1
    raise RuntimeError(f"{t.name}: {tries} commits lost to other writers")


def _entry(t: Table, manifest: DataFrame, schema: T.StructType, keys: list[str], commit: str, operation: str) -> dict:
    path = f"manifest/{commit}"
    manifest.coalesce(1 + manifest.sparkSession.sparkContext.defaultParallelism // 8).write.parquet(f"{t.folder}/{path}")
    return {"manifest": path, "manifest_schema": manifest.schema.json(), "schema": schema.json(), "keys": keys, "operation": operation}


def create(t: Table, df: DataFrame, keys: list[str], operation: str = "create") -> int:
    """Write ``df`` as the whole table; rows keep their partitions, a file each."""
    return _commit(t, lambda base, commit: _entry(t, _write_files(t, df, keys, commit), df.schema, keys, commit, operation))


def append(t: Table, df: DataFrame) -> int:
    """Add rows; no file is read.  Data files are written once however often the commit is tried."""
    entry, own = t.entry(), uuid.uuid4().hex
    df = df.select(*[f["name"] for f in json.loads(entry["schema"])["fields"]])
    added = _write_files(t, df, entry["keys"], own)
    return _commit(t, lambda base, commit: _entry(t, t.manifest(base).unionByName(added), df.schema, entry["keys"], commit, "append"))


def candidate_files(t: Table, version: int, keys_df: DataFrame, keys: list[str]) -> DataFrame:
    """file of each live file that may hold one of the keys: by key range, then by Bloom filter."""
    key = F.struct(*keys)
    given = keys_df.select(*keys).dropna(subset=keys)
    split = splitters(given, [F.col(k) for k in keys], RANGES)
    given = placed(given, [F.col(k) for k in keys], "cell", split, RANGES)
    files = t.manifest(version).where("rows > 0")
    ends = placed(placed(files, [F.col(f"most.{k}") for k in keys], "last", split, RANGES), [F.col(f"least.{k}") for k in keys], "first", split, RANGES)
    cells = ends.select("file", "rows", "least", "most", F.explode(F.sequence("first", "last")).alias("cell"))
    counts = given.groupBy("cell").agg(F.count(F.lit(1)).alias("keys"))
    met = cells.join(counts, "cell")
    bound = met.groupBy("file").agg(F.sum("keys").alias("meets"))
    many = bound.where(F.col("meets") > PROBES).select("file")
    few = met.join(bound.where(F.col("meets") <= PROBES).select("file"), "file").select("file", "rows", "least", "most", "cell")
    pairs = few.join(given, "cell").where((F.col("least") <= key) & (F.col("most") >= key))
    pairs = pairs.select("file", *[c.alias(n) for n, c in _hashes(keys, F.col("rows")).items()])
    pages = t.spark.read.schema("file string, page long, bitmap binary").option("recursiveFileLookup", True).parquet(f"{t.folder}/filters")
    probed = pairs.join(pages, ["file", "page"])

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring("bitmap", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
        return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1

    held = probed.where(F.forall("bits", is_set)).select("file")
    return many.unionAll(held).distinct()


def _hits(t: Table, version: int, keys_df: DataFrame, keys: list[str]) -> list[str]:
    """Names of the files that hold one of the keys."""
    files = [r.file for r in candidate_files(t, version, keys_df, keys).collect()]
    if not files:
        return []
    name = F.concat(F.lit("data/"), F.substring_index(F.col("_metadata.file_path"), "/data/", -1))
    rows = t.read(version, files).select(*keys, name.alias("file"))
    found = rows.join(keys_df.select(*keys), keys, "left_semi").select("file").distinct()
    return [r.file for r in found.collect()]


def _staged(t: Table, df: DataFrame, commit: str) -> DataFrame:
    """The source, written once for the passes over it."""
    df.write.parquet(f"{t.folder}/staging/{commit}")
    return t.spark.read.schema(df.schema).parquet(f"{t.folder}/staging/{commit}")


def _rewrite(t: Table, base: int, hits: list[str], rows: DataFrame, files: int, commit: str, operation: str) -> dict:
    """Files ``hits`` give way to ``rows``, written in key order; the others stay."""
    entry = t.entry(base)
    schema, keys = T.StructType.fromJson(json.loads(entry["schema"])), entry["keys"]
    out = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    out = out.repartitionByRange(max(1, files), *keys).sortWithinPartitions(*keys)
    new = _write_files(t, out, keys, commit)
    old = t.manifest(base)
    if hits:
        gone = t.spark.createDataFrame([(f,) for f in hits], "file string")
        old = old.join(gone, "file", "left_anti")
    return _entry(t, old.unionByName(new), schema, keys, commit, operation)


def merge_into(t: Table, source: DataFrame, target_rows: int = 1_000_000) -> int:
    """MERGE by the table's keys: a matched key takes the whole source row, others are
    inserted.  Only files that hold a source key are rewritten.  A source key that comes
    twice is an error; a null key matches nothing and is inserted."""
    def change(base: int, commit: str) -> dict:
        keys = t.entry(base)["keys"]
        src = _staged(t, unique_by(source, keys, "MERGE source has a key more than once"), commit)
        hits = _hits(t, base, src, keys)
        merged = tbl_merge_upsert(t.read(base, hits), src, keys) if hits else src
        try:
            return _rewrite(t, base, hits, merged, len(hits) + src.count() // target_rows + (not hits), commit, "merge")
        finally:
            commits.delete(t.spark, f"{t.folder}/staging/{commit}")

    return _commit(t, change)


def update_into(t: Table, column: str, updates: DataFrame) -> int:
    """UPDATE SET ``column`` from ``updates`` (id, value) by the table's one key; files
    without an updated id stay."""
    def change(base: int, commit: str) -> dict:
        (key,) = t.entry(base)["keys"]
        src = _staged(t, updates, commit)
        hits = _hits(t, base, src.select(F.col("id").alias(key)), [key])
        try:
            return _rewrite(t, base, hits, tbl_bulk_update(t.read(base, hits), key, column, src), len(hits), commit, "update")
        finally:
            commits.delete(t.spark, f"{t.folder}/staging/{commit}")

    return _commit(t, change)


def compact(t: Table, target_bytes: int = 128 << 20) -> int:
    """Pack small files (under half the target) into files of up to ``target_bytes``; rows
    keep their order within a file, other files are carried over by name."""
    def change(base: int, commit: str) -> dict:
        entry, old = t.entry(base), t.manifest(base)
        small = old.where(F.col("bytes") < target_bytes // 2).select("file", "bytes").collect()  # names and sizes
        bins = pack_files([(r.file, r.bytes) for r in small], target_bytes)
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        if not bins:
            return _entry(t, old, schema, entry["keys"], commit, "compact")
        write_bins(t.spark, [[f"{t.folder}/{f}" for f in fs] for fs in bins], schema, [f"{t.folder}/data/{commit}/bin={b}" for b in range(len(bins))])
        new = _described(t, schema, entry["keys"], commit)
        gone = t.spark.createDataFrame([(f,) for fs in bins for f in fs], "file string")
        rest = old.join(gone, "file", "left_anti")
        return _entry(t, rest.unionByName(new), schema, entry["keys"], commit, "compact")

    return _commit(t, change)


def vacuum(t: Table, retention_hours: float = 168) -> list[str]:
    """Delete the data files that no version holds which is the newest or younger than the
    retention; returns their names.  Older versions cannot be read afterwards.  Files of
    commits younger than the retention stay, whether they are committed yet or not."""
    gone = set(commits.numbers(t.spark, f"{t.folder}/vacuumed"))
    entries = {v: commits.read_marker(t.spark, t.log, v) for v in commits.numbers(t.spark, t.log) if v not in gone}
    newest, limit = max(entries, default=0), time.time() - retention_hours * 3600
    old = [v for v, e in entries.items() if v != newest and e["committed_at"] < limit]
    if not old:
        return []
    files = {v: {r.file for r in t.manifest(v).select("file").collect()} for v in entries}
    for v in old:  # first, so that no reader starts on what is about to go
        commits.create_if_absent(t.spark, commits.marker(f"{t.folder}/vacuumed", v), "{}")
    live = set().union(*(files[v] for v in entries if v not in old))
    dead = sorted(set().union(*(files[v] for v in old)) - live)
    for f in dead:
        commits.delete(t.spark, f"{t.folder}/{f}")
    return dead
