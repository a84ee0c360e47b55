"""Splitters: cut rows into ranges of an order tuple that hold about equally many rows.

A sample of the tuples, chosen by their hash, is a quantile sketch that merges by
union; evenly spaced elements of the sorted sample are the splitters.  They follow the
rows and not the values: an outlying value, many equal leading values or text columns
do not make a range large.  Null sorts before everything, as in Spark's struct order.

The tuple's hash decides and nothing else, so every evaluation of a plan finds the same
splitters.  Rows with one tuple share a range.  Nothing runs while a plan is built: row
count and sample are scalar subqueries, the array has at most ``MOST`` elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeline.session import shuffle_partitions

PER_RANGE = 16  # sampled tuples a range, about
MOST = 16_384  # ranges at most


def default_ranges(df: DataFrame) -> int:
    return min(MOST, max(64, 4 * shuffle_partitions(df.sparkSession)))


def splitters(df: DataFrame, order: list[Column], ranges: int) -> Column:
    """Sorted array of at most ``ranges`` - 1 tuples (as a scalar subquery)."""
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rows = df.select(F.count(F.lit(1))).scalar()
    every = F.greatest(F.lit(1).cast("long"), F.floor(rows / (ranges * PER_RANGE)))
    some = df.select(at.alias("at")).filter(F.pmod(F.xxhash64(F.lit(17), "at"), every) == 0).distinct()
    picked = some.agg(F.sort_array(F.collect_list("at")).alias("all"))
    n = F.size("all")
    places = F.sequence(F.lit(1), F.lit(max(1, ranges - 1)))
    cut = F.transform(places, lambda i: F.get("all", F.floor(i * n / ranges).cast("int")))
    return picked.select(F.when((n > 0) & F.lit(ranges > 1), F.array_distinct(cut)).alias("s")).scalar()


def placed(df: DataFrame, order: list[Column], name: str, split: Column, ranges: int) -> DataFrame:
    """``df`` with ``name``: the number of splitters at or before the row's tuple, found by
    halving (a projection a step, so the steps stay linear in size)."""
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    out = df.withColumns({"__at": at, name: F.lit(0)})
    step = 1 << max(0, ranges - 1).bit_length()
    while step > 1:
        step //= 2
        below = F.get(split, F.col(name) + (step - 1))
        out = out.withColumn(name, F.col(name) + F.when(below <= F.col("__at"), step).otherwise(0))
    return out.drop("__at")


def with_range(df: DataFrame, order: list[Column], name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``, the range that the row's tuple is in, from 0."""
    ranges = ranges or default_ranges(df)
    return placed(df, order, name, splitters(df, order, ranges), ranges)
