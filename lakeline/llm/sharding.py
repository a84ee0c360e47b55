"""Sharding by proportional stratified interleaving.

Within each source rows are shuffled by a seeded hash and ranked; the row of rank r of n
gets the fractional rank (r + phase) / n, where the phase, the same for a whole source, is
seeded by its name, so that small sources do not all meet at one place.  Sorted by
fractional rank every stretch of the whole holds each source in its proportion; cut into
equal stretches, every shard does.

Nothing sorts a source or the whole in one task.  Ranks: a source's rows are dealt into
buckets, equal ranges of their hash; counts per (source, bucket) tell how many rows
come before a bucket, and a bucket's rows are numbered by themselves.  Positions: the
same again over cells, equal ranges of the fractional rank, which hold near-equal numbers
of rows as every source is spread evenly over them.  A source that holds a third of all
rows is in every bucket and every cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeline.llm.common import saved

PER_BUCKET = 20_000  # rows of a bucket and of a cell, about
LEAST = 64  # buckets and cells of a small table
BLOCK = 1_024  # cells whose counts are added up in one task


def md5_part(*values: Column) -> Column:
    """The first 32 bits of a seeded name's MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *values)), 1, 8), 16, 10).cast("long")


def ranked(docs: DataFrame, rows: int, stratum: Column, seed: int, id_col: str, text_col: str) -> DataFrame:
    """Struct ``doc``, source key, hash, tie and fractional rank of each row."""
    buckets = LEAST + rows // PER_BUCKET
    key = F.to_json(F.array(stratum.cast("string")), {"ignoreNullFields": "false"})  # a null source is a source
    body = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    hash_ = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), body))
    keyed = docs.select(F.struct("*").alias("doc"), key.alias("path"), hash_.alias("hash"), F.monotonically_increasing_id().alias("tie"))
    keyed = keyed.withColumn("bucket", F.expr(f"CAST(conv(substring(hash, 1, 8), 16, 10) AS BIGINT) * {buckets} div 4294967296"))
    counts = keyed.groupBy("path", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("path")
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("path", "bucket", F.sum("rows").over(whole).alias("n"), F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("before"))
    own = Window.partitionBy("path", "bucket").orderBy("hash", "tie")
    keyed = keyed.withColumn("own", F.row_number().over(own)).join(counts, ["path", "bucket"])
    phase = md5_part(F.lit(str(seed)), F.col("path")) / F.lit(float(1 << 32))
    return keyed.select("doc", "path", "hash", "tie", ((F.col("before") + F.col("own") - 1 + phase) / F.col("n")).alias("part"))


def shard_rows(
    docs: DataFrame, shards: int, stratum: Column | str = "source", seed: int = 12, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Struct ``doc`` (all columns), shard (0 to shards - 1) and slot (gapless from 0 in a shard).

    Shards hold counts of rows at most one apart.  Of any source of n rows a shard holds
    n / shards give or take two.  A null source is a source of its own; null or empty texts
    are rows like others.  Ties: rows of a source with equal id and text are ordered by
    their place in the input, rows of two sources with equal fractional rank by source.
    An empty table gives an empty result, and fewer rows than shards leave shards empty.
    """
    stratum = F.col(stratum) if isinstance(stratum, str) else stratum
    rows = docs.count()
    cells = LEAST + rows // PER_BUCKET
    cell = F.least(F.floor(F.col("part") * cells), F.lit(cells - 1)).cast("long")
    dealt = saved(ranked(docs, rows, stratum, seed, id_col, text_col).withColumn("cell", cell), "shard-rows")
    counts = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).withColumn("block", F.expr(f"cell div {BLOCK}"))
    blocks = counts.groupBy("block").agg(F.sum("rows").alias("rows"))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per thousand cells
    blocks = blocks.select("block", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("base"))
    inner = Window.partitionBy("block").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("cell", "block", F.coalesce(F.sum("rows").over(inner), F.lit(0)).alias("before")).join(blocks, "block")
    counts = counts.select("cell", (F.col("base") + F.col("before")).alias("before"))
    own = Window.partitionBy("cell").orderBy("part", "path", "hash", "tie")
    placed = dealt.withColumn("own", F.row_number().over(own)).join(counts, "cell")
    placed = placed.select("doc", (F.col("before") + F.col("own") - 1).alias("at"))
    shard = F.expr(f"CAST((at * {shards}) div {max(rows, 1)} AS INT)")
    first = F.expr(f"(CAST(shard AS BIGINT) * {rows} + {shards - 1}) div {shards}")  # least position of the shard
    return placed.withColumn("shard", shard).select("doc", "shard", (F.col("at") - first).alias("slot"))


def write_shards(placed: DataFrame, path: str, per_file: int = 1_000_000) -> None:
    """A folder ``shard=k`` of Parquet files each, of up to ``per_file`` rows in slot order."""
    spark = placed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = placed.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.option("maxRecordsPerFile", per_file).partitionBy("shard").parquet(path)
