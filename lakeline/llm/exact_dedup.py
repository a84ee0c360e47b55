"""Exact dedup: tree-merge of sorted digest runs, in DataFrame operations only.

Every input partition makes a run: its distinct digests, each with the smallest
identifier and the number of rows.  In each round ``fan_in`` neighbouring runs
meet (run number // fan_in): the rows are dealt by (run, digest), sorted, and one
ordered pass over each digest keeps the smallest identifier and adds the counts.
A group of equal rows in a round has at most ``fan_in`` members, whatever the
number of copies, and a merged run is spread over all tasks by digest, so neither
a hot text nor the last round lands in one task.  The verdicts then go back down
the same tree, again at most ``fan_in`` to one, to the rows of each run.

A match is verified at every level: rows are the same text only if SHA-256, an
independent 64-bit hash and the byte length all agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeline.llm.common import WS, saved

KEY = ["digest", "check", "n_bytes"]


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WS, " ")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2(norm, 256)).alias("digest"),
        F.xxhash64(norm).alias("check"),
        F.octet_length(norm).alias("n_bytes"),
    )


def merge_runs(level: DataFrame, fan_in: int) -> DataFrame:
    """One round: ``fan_in`` sorted runs into one, smallest identifier first."""
    key = ["run", *KEY]
    up = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
    runs = up.repartition("run", "digest").sortWithinPartitions(*key, F.asc_nulls_last("keep_id"))
    ordered = Window.partitionBy(*key).orderBy(F.asc_nulls_last("keep_id"))
    whole = Window.partitionBy(*key)
    return (
        runs.withColumn("rank", F.row_number().over(ordered))
        .withColumn("group_size", F.sum("group_size").over(whole))
        .where("rank = 1")
        .select(*key, "keep_id", "group_size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of white space (space,
    \\x09-\\x0D) became one space.  Null text counts as empty.  The smallest
    identifier stays; a null identifier loses to any other, and a group of null
    identifiers only keeps them all (keep_id null).  A row repeated with the same
    identifier and text gets the same verdict each time, and counts each time in
    group_size.  An empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    keys = saved(digests(docs, id_col, text_col), "digests")
    level = keys.groupBy("run", *KEY).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    levels = [saved(level, "run0")]
    runs = (keys.agg(F.max("run")).first()[0] or 0) + 1
    while runs > 1:
        levels.append(saved(merge_runs(levels[-1], fan_in), f"run{len(levels)}"))
        runs = -(-runs // fan_in)
    verdict = levels.pop()
    while levels:
        lower = levels.pop().select("run", *KEY, F.floor(F.col("run") / fan_in).cast("int").alias("up"))
        verdict = lower.join(verdict.withColumnRenamed("run", "up"), ["up", *KEY]).drop("up")
    out = keys.join(verdict, ["run", *KEY])
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
