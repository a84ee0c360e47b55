"""Skew-safe ordered windows: running aggregates and lags per key.

A window ``PARTITION BY key ORDER BY t`` sends every row of a key to one task;
when one key holds a third of the data that task holds a third of the data.
Here all rows are cut into chunks of about equally many rows along (key, order)
(``splitters``: quantiles of the whole tuple, so neither a hot key nor an outlying
time nor equal times make a chunk large), and the windows run per (key, chunk):

1. per-(key, chunk) totals are aggregated (partial sums before the shuffle);
2. a small window over the totals gives what each chunk carries in from the
   chunks before it;
3. that carry is added to the rows as one leading row per chunk (and, for
   lags, the last rows before the chunk), and one window over (key, chunk)
   does the rest.  The carry needs no join, so null keys are keys like others.

Rows are shuffled once, by (key, chunk).  Everything is a lazy DataFrame plan
of Spark windows, so SQL's null, decimal and 64-bit rules hold.  Rows equal in key
and all order columns share a chunk.  Scans that follow one another in the same order
can share chunks: ``chunked`` adds them once, and the later scans shuffle no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeline.operators.splitters import with_range

_OPS = ("sum", "count", "max", "min", "last", "prev")
START = Window.unboundedPreceding


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chunked(df: DataFrame, by: Iterable[str], order: Iterable, chunks: int | None = None) -> DataFrame:
    """``df`` with ``__chunk``, which rises with ``order`` within a key."""
    return with_range(df, [*map(_col, by), *map(_col, order)], "__chunk", chunks)


def _value(df: DataFrame, op: str, src) -> Column:
    """What a row contributes to its running value."""
    if op == "count":
        return F.lit(1).cast("long") if src is None else F.when(_col(src).isNotNull(), 1).otherwise(0).cast("long")
    c = _col(src)
    if op == "sum":
        kind = df.select(c.alias("x")).schema[0].dataType
        if isinstance(kind, T.DecimalType):
            return c.cast(f"decimal(38,{kind.scale})")
        return c.cast("double" if isinstance(kind, (T.DoubleType, T.FloatType)) else "long")
    if op == "last":
        return F.when(c.isNotNull(), F.struct(c.alias("x")))
    return F.struct(c.alias("x")) if op == "prev" else c


def _total(op: str, v: Column, order: Column) -> Column:
    if op in ("sum", "count"):
        return F.sum(v)
    if op in ("max", "min"):
        return F.max(v) if op == "max" else F.min(v)
    return F.max_by(v, F.when(v.isNotNull(), order))


def _over(op: str, v: Column, window) -> Column:
    if op in ("sum", "count"):
        return F.sum(v).over(window)
    if op in ("max", "min"):
        return (F.max(v) if op == "max" else F.min(v)).over(window)
    return F.last(v, ignorenulls=True).over(window)


def scanned(df: DataFrame, by: Iterable[str], order: Iterable, aggs: dict | None = None, halo: int = 0,
            halo_cols: Iterable[str] = (), chunks: int | None = None):
    """(rows with their carry rows, window over a chunk, column of each running value).

    Data rows have ``__kind`` = 1.  ``halo`` adds up to so many rows that come
    before a chunk, with ``halo_cols`` filled, for lags and moving frames.
    """
    by, order, aggs = list(by), [_col(c) for c in order], dict(aggs or {})
    for op, _ in aggs.values():
        if op not in _OPS:
            raise ValueError(f"unsupported running op {op!r}")
    cut = df if "__chunk" in df.columns else chunked(df, by, order, chunks)
    base = cut.select("*", *[_value(df, op, src).alias(f"__v_{n}") for n, (op, src) in aggs.items()])
    keys = [*by, "__chunk"]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    earlier = Window.partitionBy(*by).orderBy("__chunk")
    marks = [F.lit(0).alias("__kind"), F.lit(0).alias("__halo")]
    rows = base.withColumn("__kind", F.lit(1)).withColumn("__halo", F.lit(0))
    if aggs:
        totals = base.groupBy(*keys).agg(*[_total(op, F.col(f"__v_{n}"), rank).alias(f"__v_{n}") for n, (op, _) in aggs.items()])
        before = earlier.rowsBetween(START, -1)
        carry = totals.select(*keys, *[_over(op, F.col(f"__v_{n}"), before).cast(base.schema[f"__v_{n}"].dataType).alias(f"__v_{n}")
                                       for n, (op, _) in aggs.items()], *marks)
        rows = rows.unionByName(carry, allowMissingColumns=True)
    if halo:
        back = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
        cols = [c for c in halo_cols if c not in by]
        ends = base.withColumn("__back", F.row_number().over(back)).filter(F.col("__back") <= halo)
        tail = F.sort_array(F.collect_list(F.struct((-F.col("__back")).alias("at"), F.struct(*cols).alias("row"))))
        tails = ends.groupBy(*keys).agg(tail.alias("tail"))
        near = F.flatten(F.collect_list("tail").over(earlier.rowsBetween(-halo, -1)))
        near = tails.select(*keys, near.alias("near"))
        last = F.slice("near", F.greatest(F.lit(1), F.size("near") - halo + 1), halo)
        near = near.select(*keys, F.posexplode(last).alias("__halo", "one"))
        near = near.select(*keys, *[F.col(f"one.row.{c}").alias(c) for c in cols], F.lit(0).alias("__kind"), (F.col("__halo") + 1).alias("__halo"))
        rows = rows.unionByName(near, allowMissingColumns=True)
    window = Window.partitionBy(*keys).orderBy("__kind", "__halo", *order)
    upto = window.rowsBetween(START, Window.currentRow)
    outs = {}
    for n, (op, _) in aggs.items():
        v = F.col(f"__v_{n}")
        if op == "prev":
            outs[n] = F.lag(v).over(window).getField("x")
        elif op == "last":
            outs[n] = _over(op, v, upto).getField("x")
        else:
            outs[n] = _over(op, v, upto)
    return rows, window, outs


def _finish(df: DataFrame, rows: DataFrame, outs: dict[str, Column]) -> DataFrame:
    done = rows.select("*", *[c.alias(f"__o_{n}") for n, c in outs.items()]).filter(F.col("__kind") == 1)
    return done.select(*df.columns, *[F.col(f"__o_{n}").alias(n) for n in outs])


def running(df: DataFrame, by: Iterable[str], order: Iterable, aggs: dict, chunks: int | None = None) -> DataFrame:
    """Add running aggregates per key ordered by ``order`` (ROWS UNBOUNDED PRECEDING).

    ``aggs`` maps output column -> (op, column or Column); op in sum / count /
    max / min / last (last non-null) / prev (the previous row's value, null or
    not); ("count", None) counts rows.  ``order`` must make the order total (add a
    unique tie-breaker) for deterministic results.  Order columns are ascending.
    A frame that ``chunked`` cut along the same key and order keeps its ``__chunk``.
    """
    rows, _, outs = scanned(df, by, order, aggs, chunks=chunks)
    return _finish(df, rows, outs)


def with_position(df: DataFrame, by: Iterable[str], order: Iterable, name: str = "pos",
                  chunks: int | None = None) -> DataFrame:
    """1-based row position per key in ``order`` (skew-safe ROW_NUMBER)."""
    return running(df, by, order, {name: ("count", None)}, chunks)


def lag_rows(df: DataFrame, by: Iterable[str], order: Iterable, cols: Iterable[str], n: int = 1,
             prefix: str = "prev_", chunks: int | None = None) -> DataFrame:
    """``lag(col, n)`` of each column per key; no self join."""
    cols = list(cols)
    if n == 1:
        aggs = {prefix + c: ("prev", c) for c in cols}
        return running(df, by, order, aggs, chunks)
    rows, window, _ = scanned(df, by, order, halo=n, halo_cols=cols, chunks=chunks)
    return _finish(df, rows, {prefix + c: F.lag(c, n).over(window) for c in cols})


def rolling_sum(df: DataFrame, by: Iterable[str], order: Iterable, value: str, n: int, name: str = "rolling_sum",
                pos: str = "pos", chunks: int | None = None) -> DataFrame:
    """Row position and the sum of the last ``n`` values (as SQL: of the non-null ones)."""
    rows, window, outs = scanned(df, by, order, {pos: ("count", None)}, halo=n - 1, halo_cols=[value], chunks=chunks)
    return _finish(df, rows, outs | {name: F.sum(value).over(window.rowsBetween(1 - n, Window.currentRow))})
