"""Connected components of a distributed edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import saved


def large_star(edges: DataFrame) -> DataFrame:
    """Every edge (hi, lo) becomes (hi, smallest neighbour of lo or lo)."""
    both = edges.select(F.col("lo").alias("node"), F.col("hi").alias("other")).unionAll(edges.select("hi", "lo"))
    least = both.groupBy("node").agg(F.min("other").alias("m"))
    least = least.select(F.col("node").alias("lo"), F.least("node", "m").alias("m"))
    return edges.join(least, "lo").select("hi", F.col("m").alias("lo")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """All smaller neighbours of a node, and the node, point at the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
    return moved.unionAll(least.select("hi", "m")).distinct()


def is_stars(edges: DataFrame) -> bool:
    """True when each node has one parent and no parent has one."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionAll(edges.select("lo", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component.

    ``edges`` has two columns a, b of one orderable type, in any order and with
    repeats.  A round is two aggregations with partial sums and two joins; where a
    hub makes a join key hot, adaptive execution splits the edge side.  Each round's
    edges are written once, which cuts lineage; rounds grow with the logarithm of
    the longest path.  No edge, node or label passes through the driver.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    edges = saved(edges.where("a <> b").select(hi, lo).distinct(), "edges")
    while not is_stars(edges):
        edges = saved(small_star(large_star(edges)), "edges")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
