"""Mixing sources to target weights: hierarchical budgets, seeded epochs, token prefixes.

The tree has one level per given column (say domain, language, source) and leaves
that hold documents.  A leaf can give its tokens ``max_epochs`` times over.  Budgets
go down from the root: a node's budget is split among its children by weight, and a
child that cannot take its part (its subtree holds less) leaves the rest to its
siblings.  As a child's capacity is that of its whole subtree, a shortage is made
up among siblings first and reaches an ancestor's siblings only when the whole
subtree is short.  All of it is integer arithmetic in windows over the tree's nodes.

A leaf's budget is so many whole epochs and a prefix of the next one.  An epoch's
order is a seeded hash.  The prefix is found by the hash's leading digits: token
sums per (leaf, digits), running sums over those, and an ordered pass within each,
so a leaf that holds a third of all documents is read by many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeline.llm.common import hand_down, salt_of, saved

UNIT = 1_000_000  # weights count in millionths
MOST_WEIGHT = 1_000_000_000
DIGITS = 3  # hexadecimal digits of the hash that make a bucket
WORDS = r"[^\x20\x09-\x0D]+"


def path_of(columns: list[str]) -> Column:
    """The values down to a node as one string; nulls are values of their own."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in columns]), {"ignoreNullFields": "false"})


def split_budget(nodes: DataFrame) -> DataFrame:
    """(parent, node, cap, weight, budget of the parent) -> (node, share).

    Children are taken in order of cap / weight; those that would be full at the
    level the parent's budget reaches take their cap, the others share what is left.
    """
    nodes = nodes.select("parent", "node", *(F.col(c).cast("decimal(20,0)").alias(c) for c in ("cap", "budget")), F.col("weight").cast("decimal(16,0)").alias("weight"))
    nodes = nodes.where("weight > 0").withColumn("ratio", F.col("cap").cast("double") / F.col("weight").cast("double"))
    order = Window.partitionBy("parent").orderBy("ratio", "node")
    full = order.rowsBetween(Window.unboundedPreceding, -1)
    open_ = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy("parent")
    nodes = nodes.withColumn("before", F.coalesce(F.sum("cap").over(full), F.lit(0))).withColumn("rest", F.sum("weight").over(open_))
    nodes = nodes.withColumn("is_full", F.expr("before * weight + cap * rest <= budget * weight"))
    nodes = nodes.withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("is_full"), F.col("cap"))).over(every), F.lit(0)))
    nodes = nodes.withColumn("open", F.sum(F.when(~F.col("is_full"), F.col("weight"))).over(every))
    return nodes.select("node", F.expr("CASE WHEN is_full THEN CAST(cap AS BIGINT) ELSE (left * weight) div open END").alias("share"))


def budgets(leaves: DataFrame, levels: list[str], weights: Mapping[tuple, float], share: float, max_epochs: int) -> DataFrame:
    """(path, tokens, budget) of each leaf with a budget."""
    spark = leaves.sparkSession
    if not all(0 <= w <= MOST_WEIGHT for w in weights.values()):
        raise ValueError(f"weights must be 0 to {MOST_WEIGHT}")
    given = [(len(k), list(k), int(round(w * UNIT))) for k, w in weights.items()]
    given = spark.createDataFrame(given or [(0, [""], 0)], "depth int, values array<string>, weight long")
    given = given.select("depth", F.to_json("values", {"ignoreNullFields": "false"}).alias("node"), "weight")
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    wanted = F.floor(F.sum("tokens") * F.lit(int(round(share * UNIT))) / UNIT)
    whole = leaves.select(F.least(wanted, F.sum("cap")).cast("long")).scalar()
    for depth in range(1, len(levels) + 1):
        parent = F.lit("") if depth == 1 else path_of(levels[: depth - 1])
        nodes = leaves.groupBy(parent.alias("parent"), path_of(levels[:depth]).alias("node")).agg(F.sum("cap").alias("cap"))
        here = given.where(F.col("depth") == depth).select("node", "weight")
        nodes = nodes.join(here, "node", "left").withColumn("weight", F.coalesce("weight", F.lit(UNIT)))
        nodes = nodes.withColumn("budget", whole) if depth == 1 else nodes.join(above, "parent")
        above = split_budget(nodes).select(F.col("node").alias("parent"), F.col("share").alias("budget"))
    return leaves.select(path_of(levels).alias("path"), "tokens").join(above.withColumnRenamed("parent", "path"), "path")


def epochs_of(sized: DataFrame, leaf_budgets: DataFrame, seed: int) -> DataFrame:
    """(row, copies) of each document that is taken at least once."""
    part = sized.select("salt", "path").distinct()
    told = hand_down(leaf_budgets.withColumnRenamed("tokens", "supply"), ["path"], part)
    rows = sized.where("tokens > 0").join(told, ["salt", "path"])
    rows = rows.withColumn("whole", F.expr("budget div supply")).withColumn("rest", F.expr("budget % supply"))
    name = F.concat_ws("|", F.lit(str(seed)), F.col("whole"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_md5"))
    rows = rows.withColumn("hash", F.md5(name)).withColumn("bucket", F.substring("hash", 1, DIGITS))
    rows = rows.select("row", "path", "bucket", "hash", "tokens", "whole", "rest")
    sums = rows.groupBy("path", "bucket").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("path").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("path", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    upto = Window.partitionBy("path", "bucket").orderBy("hash", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(sums, ["path", "bucket"]).withColumn("upto", F.col("base") + F.sum("tokens").over(upto))
    copies = F.col("whole") + (F.col("upto") <= F.col("rest")).cast("long")
    return rows.select("row", copies.alias("copies")).where("copies > 0")


def mix(
    docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple, float], share: float, max_epochs: int = 1,
    seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Struct ``doc`` (all columns), the levels, tokens and epoch (from 0), a row per copy taken.

    ``levels``: name -> column, from the root down.  ``weights``: path of values ->
    weight against its siblings, 0 to a billion, 1 where not given; weight 0 takes nothing.  The
    whole budget is ``share`` of all tokens, or what the tree can give if that is
    less.  A token is a word between white space.

    A document is taken where it ends within the leaf's budget, so no leaf exceeds
    it, and what a leaf's last place leaves open is not handed on: ``mix_report`` tells
    what each leaf was given and delivers.  Null level values are values like others.  Null or empty texts have no
    token and are not taken.  Rows with equal id and text are ordered by their place;
    an empty table gives an empty result.
    """
    sized, taken, _ = _mixed(docs, levels, weights, share, max_epochs, seed, id_col, text_col)
    out = sized.select("row", "doc", "leaf", "tokens").join(taken, "row")
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return out.select("doc", "leaf", "tokens", "epoch")


def mix_report(
    docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple, float], share: float, max_epochs: int = 1,
    seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The levels, tokens, budget and delivered of each leaf that has a budget, for ``mix`` with the same arguments."""
    sized, taken, budget = _mixed(docs, levels, weights, share, max_epochs, seed, id_col, text_col)
    rows = sized.where("tokens > 0").select("row", "path", "leaf", "tokens").join(taken, "row", "left")
    leaves = rows.groupBy("path", "leaf").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.coalesce("copies", F.lit(0))).alias("delivered"))
    return leaves.join(budget.select("path", "budget"), "path").select("leaf.*", "tokens", "budget", "delivered")


def _mixed(docs: DataFrame, levels: Mapping[str, Column], weights, share, max_epochs, seed, id_col, text_col) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with path and tokens, copies taken of each, budgets of leaves)."""
    names = list(levels)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.struct("*").alias("doc"), F.col(id_col).alias("doc_id"), F.md5(text).alias("text_md5"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("tokens"), F.struct(*[c.alias(n) for n, c in levels.items()]).alias("leaf"),
    )
    rows = rows.withColumn("path", path_of([f"leaf.{n}" for n in names])).withColumn("row", F.monotonically_increasing_id())
    sized = saved(rows.withColumn("salt", salt_of(docs.sparkSession, F.col("row"))), "mix-docs")
    leaves = saved(sized.where("tokens > 0").groupBy("leaf").agg(F.sum("tokens").alias("tokens")).select("leaf.*", "tokens"), "mix-leaves")
    budget = saved(budgets(leaves, names, weights, share, max_epochs), "mix-budgets")
    return sized, epochs_of(sized, budget, seed), budget
