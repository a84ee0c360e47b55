"""Catalog tables and table maintenance (SURVEY 2.1 tbl_*, sql_query, 2.8
rep_materialize / rep_cached).

Parquet tables have no row-level UPDATE/MERGE in open-source Spark, so
changes are expressed as DataFrames (upsert = full outer join with a match
flag) and written as a new version folder; a small registry of versions is
the commit point (append one row), which also gives time travel.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeline.operators.splitters import placed, splitters
from lakeline.sources import commits

# SQL type names accepted in a {column: type} table spec.
TYPE_MAP = {
    "VARCHAR": "STRING", "TEXT": "STRING", "STRING": "STRING", "CHAR": "STRING",
    "INTEGER": "INT", "INT": "INT", "INT4": "INT", "SERIAL": "INT", "SMALLINT": "SMALLINT",
    "BIGINT": "BIGINT", "INT8": "BIGINT", "BIGSERIAL": "BIGINT",
    "DOUBLE": "DOUBLE", "FLOAT8": "DOUBLE", "DOUBLE PRECISION": "DOUBLE", "FLOAT": "FLOAT", "REAL": "FLOAT",
    "BOOLEAN": "BOOLEAN", "BOOL": "BOOLEAN", "DATE": "DATE",
    "TIMESTAMP": "TIMESTAMP_NTZ", "TIMESTAMPTZ": "TIMESTAMP", "TIMESTAMP WITH TIME ZONE": "TIMESTAMP",
    "BLOB": "BINARY", "BYTEA": "BINARY", "JSON": "STRING", "JSONB": "STRING", "UUID": "STRING",
}
_IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def spark_type(sql_type: str) -> str:
    t = sql_type.strip().upper()
    m = re.match(r"^(DECIMAL|NUMERIC)\s*\((\d+)\s*,\s*(\d+)\)$", t)
    if m:
        return f"DECIMAL({m.group(2)},{m.group(3)})"
    m = re.match(r"^(VARCHAR|CHAR)\s*\(\d+\)$", t)
    if m:
        return "STRING"
    if t.endswith("[]"):
        return f"ARRAY<{spark_type(t[:-2])}>"
    if t not in TYPE_MAP:
        raise ValueError(f"unsupported column type {sql_type!r}")
    return TYPE_MAP[t]


def quote(ident: str) -> str:
    if not _IDENT.match(ident):
        raise ValueError(f"invalid identifier {ident!r}")
    return f"`{ident}`"


def table_schema(columns: dict[str, str]) -> T.StructType:
    ddl = ", ".join(f"{quote(c)} {spark_type(t)}" for c, t in columns.items())
    return T.StructType.fromDDL(ddl)


def tbl_create(spark: SparkSession, name: str, columns: dict[str, str], location: str | None = None) -> str:
    ddl = ", ".join(f"{quote(c)} {spark_type(t)}" for c, t in columns.items())
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {quote(name)} ({ddl}) USING parquet{loc}")
    return name


def tbl_append(spark: SparkSession, name: str, df: DataFrame) -> int:
    """Append by position (as INSERT INTO t SELECT *), casting to the table
    schema; the row count comes from an Observation of the same write, not
    from a second scan."""
    target = spark.table(quote(name)).schema
    if len(df.columns) != len(target.fields):
        raise ValueError(f"{name}: expected {len(target.fields)} columns, got {len(df.columns)}")
    cast = df.select(*[F.col(c).cast(f.dataType).alias(f.name) for c, f in zip(df.columns, target.fields)])
    obs = Observation("append")
    cast.observe(obs, F.count(F.lit(1)).alias("rows")).write.insertInto(quote(name))
    return int(obs.get["rows"])


def tbl_drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {quote(name)}")


def tbl_describe(spark: SparkSession, name: str) -> DataFrame:
    cols = spark.catalog.listColumns(name)
    return spark.createDataFrame([(c.name, c.dataType) for c in cols], "column_name string, data_type string")


def tbl_list(spark: SparkSession, database: str | None = None) -> DataFrame:
    ts = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    return spark.createDataFrame([(t.name, t.tableType, bool(t.isTemporary)) for t in ts],
                                 "name string, table_type string, is_temporary boolean")


def sql_query(spark: SparkSession, query: str, args: dict | None = None) -> DataFrame:
    """Arbitrary SQL; values go in as named parameters (``:name``), never by
    string formatting."""
    return spark.sql(query, args=args or {})


def tbl_schema_merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append with schema evolution: columns are matched by name; columns
    missing on either side become null."""
    return existing.unionByName(incoming, allowMissingColumns=True)


def unique_by(df: DataFrame, keys: list[str], message: str) -> DataFrame:
    """One row per key; reading a key that comes more than once raises ``message``."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.any_value(F.struct(*rest, F.lit(1).alias("__x"))).alias("__r"))
    checked = F.coalesce(F.assert_true(F.col("__n") == 1, message).cast("boolean"), F.lit(True))
    return one.filter(checked).select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns])


def tbl_merge_upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """MERGE: matched keys take the *whole* source row (nulls included),
    unmatched target rows are kept, unmatched source rows are inserted.

    One full outer join on the keys with a source-present flag (not
    ``coalesce``, which would keep old values where the update is null).
    A source key that comes twice is an error when the rows are read, as in MERGE."""
    cols = target.columns
    source = unique_by(source, keys, "MERGE source has a key more than once")
    s = source.select(*[F.col(c).alias("__s_" + c) for c in cols], F.lit(True).alias("__hit"))
    t = target.select(*[F.col(c).alias("__t_" + c) for c in cols])
    cond = [F.col("__t_" + k) == F.col("__s_" + k) for k in keys]
    j = t.join(s, cond, "full_outer")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    return j.select(*[F.when(hit, F.col("__s_" + c)).otherwise(F.col("__t_" + c)).alias(c) for c in cols])


def tbl_bulk_update(target: DataFrame, key: str, column: str, updates: DataFrame) -> DataFrame:
    """UPDATE t SET column = u.value FROM updates u WHERE t.key = u.id.
    An id that comes twice in ``updates`` (id, value) is an error when the rows are read."""
    u = unique_by(updates.filter(F.col("id").isNotNull()), ["id"], "an id is updated more than once").select(F.col("id").alias("__id"), F.col("value").alias("__value"), F.lit(True).alias("__hit"))
    j = target.join(u, target[key] == u["__id"], "left")
    return j.select(*[F.when(F.col("__hit"), F.col("__value").cast(target.schema[c].dataType)).otherwise(F.col(c))
                      .alias(c) if c == column else F.col(c) for c in target.columns])


def updates_from_arrays(spark: SparkSession, ids: list, values: list) -> DataFrame:
    """(id, value) rows from two parallel arrays (the UNNEST form) -- for a short
    caller-supplied list; large update sets should be passed to
    ``tbl_bulk_update`` as a DataFrame so they never pass through the driver."""
    if len(set(ids)) != len(ids):
        raise ValueError("ids must be unique")
    one = spark.createDataFrame([(list(ids), list(values))], "ids array<bigint>, vals array<string>")
    return one.select(F.explode(F.arrays_zip("ids", "vals")).alias("z")).select(
        F.col("z.ids").alias("id"), F.col("z.vals").alias("value"))


def pack_files(files: list[tuple[str, int]], target_bytes: int) -> list[list[str]]:
    """Best-fit decreasing: names of files by bin of at most ``target_bytes``; a bin with
    one file is left out, as nothing is gained.  Equal sizes go by name.

    Open bins are kept in order of their free space, so many files stay quick to pack."""
    bins, free = [], []  # free: (space left, bin) in order
    for name, size in sorted(files, key=lambda x: (-x[1], x[0])):
        at = bisect.bisect_left(free, (size, -1))
        if at < len(free):
            left, b = free.pop(at)
        else:
            left, b = target_bytes, len(bins)
            bins.append([])
        bins[b].append(name)
        bisect.insort(free, (max(0, left - size), b))
    return [b for b in bins if len(b) > 1]


def write_bins(spark: SparkSession, bins: list[list[str]], schema: T.StructType, folders: list[str]) -> None:
    """Write the rows of each bin's files as one file in its folder, one after another.

    A job of one task a bin, as many at a time as there are cores.  The task reads file after
    file and writes as it reads; nothing is shuffled or sorted, so its memory does not hang on
    how many rows fit a bin."""
    def put(paths: list[str], folder: str) -> None:
        spark.read.schema(schema).parquet(*paths).coalesce(1).write.parquet(folder)

    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max(1, min(len(bins), spark.sparkContext.defaultParallelism))) as pool:
        for job in [pool.submit(inherit(put), paths, folder) for paths, folder in zip(bins, folders)]:
            job.result()


def tbl_compact(spark: SparkSession, src: str, dst: str, target_bytes: int = 128 * 1024 * 1024) -> list[str]:
    """Pack a folder's small files (under half of ``target_bytes``) into files of up to that
    size in ``dst``, whose earlier content goes, in the order of the rows within each file; returns the paths that now
    make the table: the packed files and the other files of ``src``, which stay as they are.

    Sizes come from a listing, no data is read for them; the listing and the bins are on
    the driver, a name and a number a file."""
    found = spark.read.format("binaryFile").options(pathGlobFilter="*.parquet", recursiveFileLookup="true").load(src)
    sizes = {r["path"]: r["length"] for r in found.select("path", "length").collect()}
    bins = pack_files([(p, n) for p, n in sizes.items() if n < target_bytes // 2], target_bytes)
    moved = [p for paths in bins for p in paths]
    kept = sorted(set(sizes) - set(moved))
    if not moved:
        return kept
    folders = [f"{dst.rstrip('/')}/__bin={b}" for b in range(len(bins))]
    inside = commits.qualified(spark, dst)
    if any(p == inside or p.startswith(f"{inside}/") for p in sizes):
        raise ValueError(f"{dst} holds files of {src}")
    commits.delete(spark, dst)
    write_bins(spark, bins, spark.read.parquet(*moved).schema, folders)
    return kept + folders


def z_value(cols: list[Column], bits: int) -> Column:
    """Bit-interleaved key of non-negative integer columns (Morton order)."""
    if bits * len(cols) > 63:
        raise ValueError(f"{len(cols)} columns of {bits} bits do not fit a 63-bit key")
    z = F.lit(0).cast("long")
    k = len(cols)
    for b in range(bits):
        for i, c in enumerate(cols):
            bit = F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1))
            z = z.bitwiseOR(F.shiftleft(bit, b * k + i))
    return z


def hilbert(df: DataFrame, axes: list[str], bits: int, name: str) -> DataFrame:
    """``df`` with the place of the ``bits``-bit integer columns ``axes`` on a Hilbert curve
    (Skilling's transform, AIP Conf. Proc. 707, 2004; a projection a step).  The axes are used up."""
    x = [F.col(a) for a in axes]
    for level in range(bits - 1, 0, -1):
        low = F.lit((1 << level) - 1)
        for i, a in enumerate(axes):
            is_set = F.shiftright(x[i], level).bitwiseAND(F.lit(1)) == 1
            swap = x[0].bitwiseXOR(x[i]).bitwiseAND(low)
            first = F.when(is_set, x[0].bitwiseXOR(low)).otherwise(x[0].bitwiseXOR(swap))
            other = {a: F.when(is_set, x[i]).otherwise(x[i].bitwiseXOR(swap))} if i else {}
            df = df.withColumns({axes[0]: first, **other})
    for before, a in zip(axes, axes[1:]):
        df = df.withColumn(a, F.col(a).bitwiseXOR(F.col(before)))
    turn = F.lit(0)
    for level in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.shiftright(x[-1], level).bitwiseAND(F.lit(1)) == 1, (1 << level) - 1).otherwise(0))
    df = df.withColumn("__turn", turn)
    return df.withColumn(name, z_value([c.bitwiseXOR(F.col("__turn")) for c in reversed(x)], bits)).drop("__turn", *axes)


def tbl_zorder(df: DataFrame, cols: list[str], partitions: int, bits: int | None = None) -> DataFrame:
    """Cluster rows on several columns so that file statistics prune on any of them: each
    column becomes its rank among 2^``bits`` quantile ranges (so outliers and skew change
    nothing), the ranks a place on a Hilbert curve, and rows are range partitioned and
    sorted by that place.  Nulls rank lowest."""
    bits = bits or max(1, min(10, 20 // len(cols)))  # a curve of a million places at most; the plan grows with bits x columns
    if bits * len(cols) > 63:
        raise ValueError(f"{len(cols)} columns of {bits} bits do not fit a 63-bit key")
    axes = [f"__z{i}" for i in range(len(cols))]
    ranked = df
    for a, c in zip(axes, cols):
        ranked = placed(ranked, [F.col(c)], a, splitters(df, [F.col(c)], 1 << bits), 1 << bits)
    curve = hilbert(ranked, axes, bits, "__z")
    return curve.repartitionByRange(partitions, "__z").sortWithinPartitions("__z").select(*df.columns)


def tbl_vacuum(versions: DataFrame, retention_hours: int = 168, asof=None,
               table: str = "table_name", created: str = "created_at", vid: str = "snapshot_id") -> DataFrame:
    """Versions to delete: not the latest of their table and created before
    asof - retention (asof = newest version time unless given)."""
    from lakeline.functions import max_of

    now = max_of(versions, created) if asof is None else asof
    latest = versions.groupBy(table).agg(F.max_by(vid, F.struct(created, vid)).alias("__latest"))
    v = versions.join(latest, table)
    return v.filter((F.col(vid) != F.col("__latest"))
                    & (F.col(created) < now - F.make_dt_interval(hours=F.lit(retention_hours)))).drop("__latest")


# ------------------------------------------------------------------ committed versions

VERSIONS = "name string, version bigint, path string, committed_at timestamp, deleted boolean"


def versions_of(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Versions of a table: version, path, committed_at and whether it was deleted."""
    try:
        log = spark.read.schema(VERSIONS).parquet(f"{root.rstrip('/')}/_versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        log = spark.createDataFrame([], VERSIONS)
    rows = log.filter(F.col("name") == name).groupBy("version")
    return rows.agg(F.max("path").alias("path"), F.min("committed_at").alias("committed_at"), F.bool_or("deleted").alias("deleted"))


def commit_version(spark: SparkSession, root: str, name: str, df: DataFrame) -> int:
    """Write ``df`` (an upsert, bulk update, compaction, z-order ...) as the table's next
    version: a folder of its own, then one registry row, which is the commit.  Version
    numbers are claimed by a marker that one writer alone can create, stored, and never
    used again.  (``versions`` changes tables file by file.)"""
    known = versions_of(spark, root, name).agg(F.max("version")).first()[0] or 0
    version = commits.claim(spark, f"{root.rstrip('/')}/_claims/{name}", known)
    path = f"{root.rstrip('/')}/{name}/v={version}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _log_version(spark, root, name, version, path, False)
    return version


def _log_version(spark: SparkSession, root: str, name: str, version: int, path: str, deleted: bool) -> None:
    row = spark.createDataFrame([(name, version, path, None, deleted)], VERSIONS).withColumn("committed_at", F.current_timestamp())
    # A folder a write: writers into one folder would delete each other's temporary files.
    row.write.parquet(f"{root.rstrip('/')}/_versions/commit={uuid.uuid4().hex}")


def read_version(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """The newest version of the table, or the one given."""
    rows = versions_of(spark, root, name).filter(~F.col("deleted"))
    rows = rows if version is None else rows.filter(F.col("version") == version)
    row = rows.orderBy(F.desc("version")).first()
    if row is None:
        raise KeyError(f"no version {version or ''} of {name}")
    return spark.read.parquet(row["path"])


def vacuum_versions(spark: SparkSession, root: str, name: str, retention_hours: float = 168) -> list[int]:
    """Delete the folders of versions older than ``retention_hours``, never the newest;
    returns their numbers.  The others keep theirs."""
    rows = versions_of(spark, root, name).filter(~F.col("deleted"))
    newest = rows.agg(F.max("version")).first()[0]
    limit = F.current_timestamp() - F.make_dt_interval(secs=F.lit(retention_hours * 3600))
    old = rows.filter((F.col("version") != newest) & (F.col("committed_at") < limit)).orderBy("version").collect()
    for row in old:
        _log_version(spark, root, name, row["version"], row["path"], True)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(row["path"])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return [row["version"] for row in old]


# ------------------------------------------------------------------ materialised results

def _registry_schema() -> str:
    return "name string, version string, path string, refreshed_at timestamp, kind string"


def rep_materialize(spark: SparkSession, root: str, name: str, df: DataFrame) -> DataFrame:
    """Build the result into a new version folder, then append one registry
    row (the swap: readers resolve the newest version).  Returns the registry."""
    version = uuid.uuid4().hex
    path = f"{root.rstrip('/')}/{name}/v={version}"
    df.write.mode("overwrite").parquet(path)
    reg = f"{root.rstrip('/')}/_registry"
    row = spark.createDataFrame([(name, version, path, None, "materialized")], _registry_schema()) \
        .withColumn("refreshed_at", F.current_timestamp())
    row.write.parquet(f"{reg}/commit={version}")  # a folder a write: writers do not touch each other's files
    return spark.read.schema(_registry_schema()).parquet(reg).drop("commit")


def read_materialized(spark: SparkSession, root: str, name: str) -> DataFrame:
    reg = spark.read.parquet(f"{root.rstrip('/')}/_registry").filter(F.col("name") == name)
    path = reg.agg(F.max_by("path", "refreshed_at")).first()[0]
    return spark.read.parquet(path)


def cache_key(query: str, params: dict | None = None) -> str:
    """sha256 of 'query:' + JSON of params with sorted keys."""
    return hashlib.sha256(f"{query}:{json.dumps(params or {}, sort_keys=True, default=str)}".encode()).hexdigest()


def fingerprint(df: DataFrame) -> str:
    """What a result depends on: the canonical analysed plan (names of aliases do not matter)
    and path, size and time of each input file, folded by Spark and not on the driver."""
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    files = sorted(df.inputFiles())
    seen = None
    if files:
        folders = sorted({f.rsplit("/", 1)[0] for f in files})
        listed = df.sparkSession.read.format("binaryFile").load(folders).select("path", "length", "modificationTime")
        seen = listed.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    return hashlib.sha256(f"{df.semanticHash()}:{plan}:{seen and tuple(seen)}".encode()).hexdigest()


def rep_cached(spark: SparkSession, root: str, query: str, params: dict | None = None,
               ttl_hours: int = 24) -> DataFrame:
    """Result cache keyed by the query's plan and its inputs' files: a fresh registry entry
    (younger than the TTL) is a hit and its Parquet copy is read, under the query's column
    names; otherwise the query runs once, is written, and a registry row is appended.  A
    changed input file is a miss."""
    df = spark.sql(query, args=params or {})
    key = fingerprint(df)
    reg = f"{root.rstrip('/')}/_cache_registry"
    try:  # a cache without a registry yet has no hit
        hit = (spark.read.schema(_registry_schema()).parquet(reg).filter((F.col("name") == key)
               & (F.col("refreshed_at") >= F.current_timestamp() - F.make_dt_interval(hours=F.lit(ttl_hours))))
               .agg(F.max_by("path", "refreshed_at")).first()[0])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        hit = None
    if hit:
        return spark.read.parquet(hit).toDF(*df.columns)
    version = uuid.uuid4().hex
    path = f"{root.rstrip('/')}/{key}/v={version}"
    places = [f"c{i}" for i in range(len(df.columns))]
    df.toDF(*places).write.parquet(path)
    row = spark.createDataFrame([(key, version, path, None, "cache")], _registry_schema())
    row.withColumn("refreshed_at", F.current_timestamp()).write.parquet(f"{reg}/commit={version}")
    return spark.read.parquet(path).toDF(*df.columns)
