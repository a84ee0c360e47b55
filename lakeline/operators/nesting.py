"""Bounded nesting: ordered lists per key, split into pages.

``collect_list`` per key puts a whole group into one task and one row; a key
that holds a third of the rows would build one giant array.  ``paged_lists``
numbers the rows of each key with the skew-safe position scan and groups by
(key, page), so no array exceeds ``page_size`` elements and the pages of a
hot key are built by many tasks.  Concatenating the pages of a key in page
order gives the full ordered list.

Most keys have few rows: ``by_length`` tells the keys of more than ``SHORT`` rows from
the others, whose rows are gathered whole and cut into pages as arrays, without a scan.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeline.operators.scan import with_position

DEFAULT_PAGE_SIZE = 1000
SHORT = 10_000  # rows of a key, about, that one array may hold
COUNTED = 16  # one row of so many, by its hash, is counted


def by_length(df: DataFrame, by: Iterable[str], limit: int = SHORT) -> tuple[DataFrame, DataFrame]:
    """(rows of keys of about ``limit`` rows or fewer, rows of the other keys); null keys are keys like others.

    The rows' hashes decide which are counted, so every evaluation finds the same keys; equal
    rows are counted all or none.  The other keys, some one in ``limit`` rows at most, are broadcast.
    """
    by = list(by)
    counted = df.filter(F.pmod(F.xxhash64(F.lit(29), *df.columns), F.lit(COUNTED)) == 0)
    over = counted.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit // COUNTED)
    over = F.broadcast(over.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.lit(True).alias("__over")))
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by]
    short = df.join(over, same, "left").filter(F.col("__over").isNull())
    return short.select(*df.columns), df.join(over, same).select(*df.columns)


def page_numbers(length: Column, page_size: int) -> Column:
    """0 and on, one for each page of a list; at least one page."""
    return F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((length - 1) / page_size), F.lit(0)).cast("long"))


def page_of(items: Column, page: Column, page_size: int) -> Column:
    """The elements of one page, from 0; none beyond the end."""
    return F.slice(items, (page * page_size + 1).cast("int"), page_size)


def with_page(df: DataFrame, by: Iterable[str], order: Iterable, page_size: int = DEFAULT_PAGE_SIZE,
              name: str = "page") -> DataFrame:
    """Add ``page`` = (position within key - 1) div page_size; null keys are keys like others."""
    pos = with_position(df, by, order, "__pos")
    return pos.withColumn(name, F.floor((F.col("__pos") - 1) / page_size).cast("long")).drop("__pos")


def paged_lists(df: DataFrame, by: Iterable[str], order: Iterable, items: dict[str, Column],
                page_size: int = DEFAULT_PAGE_SIZE, descending: bool = False) -> DataFrame:
    """One row per (key, page) with ``items`` collected as sorted arrays.

    ``items`` maps output name -> struct Column whose leading fields are the
    sort key; rows where the struct is null are skipped (conditional lists).
    """
    by = list(by)
    paged = with_page(df, by, order, page_size)
    aggs = [F.sort_array(F.collect_list(c), asc=not descending).alias(n) for n, c in items.items()]
    return paged.groupBy(*by, "page").agg(*aggs)
