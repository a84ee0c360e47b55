"""Relational, window, reshape and time-series patterns.

Per-key ordered computations (running sums, lags, rolling means, dense
ranks, as-of lookups) go through ``lakeline.operators.scan`` so that a key
holding a large share of the rows is split across tasks.  Windows are used
directly only where the group size has a proven bound (e.g. months per
cohort) and that bound is stated next to the code.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lakeline.operators.scan import lag_rows, rolling_sum, running
from lakeline.session import scratch_path


# ------------------------------------------------------------------ relational

def safe_div(num: Column, den: Column) -> Column:
    """num / den, null when den is 0 or null (ANSI mode raises on /0)."""
    return F.when(den != 0, num / den)


def rel_filter_agg_sort(df: DataFrame, predicate: Column, keys: list[str], sums: dict[str, Column],
                        ratio: tuple[str, Column], order_by: str) -> DataFrame:
    """filter -> group by keys -> sums and mean of a ratio -> sort desc."""
    aggs = [F.sum(c).alias(n) for n, c in sums.items()]
    aggs.append(F.avg(ratio[1]).alias(ratio[0]))
    return df.filter(predicate).groupBy(*keys).agg(*aggs).orderBy(F.col(order_by).desc())


def rel_null_inject(df: DataFrame, column: str, mask: Column, name: str | None = None) -> DataFrame:
    """when(mask) -> null, otherwise the value."""
    return df.withColumn(name or column, F.when(~mask, F.col(column)))


def rel_concat(frames: Iterable[DataFrame]) -> DataFrame:
    """Vertical concat by column name (missing columns become null)."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def apply_steps(df: DataFrame, steps: Iterable[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """``df`` through (name, function) steps; an error carries a note that names its step."""
    for name, step in steps:
        try:
            df = df.transform(step)
        except Exception as e:
            e.add_note(f"in step {name!r}")
            raise
    return df


# ------------------------------------------------------------------ joins

def join_asof(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str,
              values: list[str], left_id: str) -> DataFrame:
    """Inner as-of join: for each left row the latest right row with
    right_ts <= left_ts and equal ``by`` keys; left rows without one are dropped.

    Linear: both sides are unioned and ordered by (by, ts, side) with right rows
    first on ties; the last right row, as one struct (its nulls included), is
    carried forward with the skew-safe scan -- no range join, no per-key window.
    Null keys and null times match nothing.
    """
    kept = F.struct(*[F.col(c) for c in left.columns])
    found = F.struct(*[F.col(v) for v in values], F.col(right_ts).alias(right_ts + "_matched"))
    lu = left.dropna(subset=[*by, left_ts]).select(
        *by, F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.col(left_id).alias("__lid"), kept.alias("__l"))
    ru = right.dropna(subset=[*by, right_ts]).select(
        *by, F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), found.alias("__r"))
    u = lu.unionByName(ru, allowMissingColumns=True)
    s = running(u, by, ["__ts", "__side", "__lid", "__r"], {"__c": ("last", "__r")})
    return s.filter((F.col("__side") == 1) & F.col("__c").isNotNull()).select("__l.*", "__c.*")


def join_existence(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str = "exists") -> DataFrame:
    """left rows with a boolean: right has the key (a null key has no match); left is read once."""
    keys = right.select(F.col(right_key).alias("__key")).distinct()
    j = left.join(keys, F.col(left_key) == F.col("__key"), "left")
    return j.withColumn(name, F.col("__key").isNotNull()).drop("__key")


# ------------------------------------------------------------------ windows

def win_running_sum(df: DataFrame, by: list[str], order: list, value: str, name: str = "running") -> DataFrame:
    return running(df, by, order, {name: ("sum", value)})


def _same(left: DataFrame, right: DataFrame, cols: dict[str, str]) -> list[Column]:
    """Null-safe equality of left and right columns."""
    return [left[a].eqNullSafe(right[b]) for a, b in cols.items()]


def win_dense_rank(df: DataFrame, by: list[str], value: str, name: str = "dense_rank",
                   descending: bool = True) -> DataFrame:
    """Dense rank of ``value`` within ``by``: number of distinct values ranked
    at or before it, null last; null keys are a group.  Distinct (key, value)
    pairs are aggregated first (partial aggregation), numbered with the scan,
    then joined back."""
    names = {c: f"__d{i}" for i, c in enumerate([*by, value])}
    d = df.select(*[F.col(c).alias(n) for c, n in names.items()]).distinct()
    v = F.col(names[value])
    key = -v if descending else v
    ranked = running(d, [names[b] for b in by], [v.isNull(), key], {name: ("count", None)})
    return df.join(ranked, _same(df, ranked, names), "left").drop(*names.values())


def win_rolling_mean(df: DataFrame, by: list[str], order: list, value_cents: str, n: int = 7,
                     name: str = "rolling_mean", scale: float = 100.0) -> DataFrame:
    """Mean of the last ``n`` rows (null until ``n`` rows).  ``value_cents`` is an
    exact integer column (value scaled by ``scale``), so the sum does not depend
    on summation order."""
    s = rolling_sum(df, by, order, value_cents, n, "__sum", "pos")
    return s.withColumn(name, F.when(F.col("pos") >= n, F.col("__sum") / (n * scale))).drop("__sum")


def win_lag_diff(df: DataFrame, by: list[str], order: list, value: str, name: str = "diff") -> DataFrame:
    lj = lag_rows(df, by, order, [value])
    return lj.withColumn(name, F.col(value) - F.col("prev_" + value))


def win_first_value_ratio(df: DataFrame, by: list[str], order: str, value: str, name: str = "ratio") -> DataFrame:
    """value / first value of the partition in ``order`` (min_by per key, joined
    null-safe: null keys are a partition)."""
    names = {c: f"__k{i}" for i, c in enumerate(by)}
    first = df.groupBy(*[F.col(c).alias(n) for c, n in names.items()]).agg(F.min_by(value, order).alias("__first"))
    j = df.join(first, _same(df, first, names))
    return j.withColumn(name, safe_div(F.col(value).cast("double"), F.col("__first").cast("double"))).drop("__first", *names.values())


def month_diff(later: Column, earlier: Column) -> Column:
    """12 * (year diff) + (month diff): calendar months between two dates."""
    return (F.year(later) - F.year(earlier)) * 12 + (F.month(later) - F.month(earlier))


def cohort_retention(orders: DataFrame, user: str, ts: str, amount_cents: str) -> DataFrame:
    """Monthly cohorts: cohort = month of first order; per (cohort, months since):
    users, revenue, revenue per user, cumulative and previous revenue, retention.

    The cumulative / previous windows are partitioned by cohort and ordered by
    month offset: a cohort has at most one row per calendar month of the data,
    a bound independent of the row count, so these windows stay small.
    """
    first = orders.groupBy(user).agg(F.date_trunc("month", F.min(ts)).alias("cohort_month"))
    o = orders.join(first, user).withColumn("months_since", month_diff(F.col(ts), F.col("cohort_month")))
    g = o.groupBy("cohort_month", "months_since").agg(
        F.count_distinct(user).alias("users"), F.sum(amount_cents).alias("rev_cents"))
    w = Window.partitionBy("cohort_month").orderBy("months_since")
    size = first.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("cohort_size"))
    g = g.join(size, "cohort_month")
    return g.select(
        "cohort_month", "months_since", "users",
        (F.col("rev_cents") / 100.0).alias("revenue"),
        (F.col("rev_cents") / 100.0 / F.col("users")).alias("revenue_per_user"),
        (F.sum("rev_cents").over(w.rowsBetween(Window.unboundedPreceding, 0)) / 100.0).alias("cumulative_revenue"),
        (F.lag("rev_cents").over(w) / 100.0).alias("previous_revenue"),
        (F.col("users") / F.col("cohort_size")).alias("retention"))


# ------------------------------------------------------------------ reshape

def rs_pivot(df: DataFrame, keys: list[str], pivot: str, values: dict[str, str], agg_col: Column) -> DataFrame:
    """Pivot ``pivot`` into columns for a fixed value list (no discovery pass).

    ``values`` maps pivot value -> output column name.  A value outside the list
    is an error when the rows are read, not a silent loss; null is passed over.
    """
    known = F.col(pivot).isNull() | F.col(pivot).isin(*values)
    checked = df.filter(F.coalesce(F.assert_true(known, F.concat(F.lit(f"value of {pivot} not in the list: "), F.col(pivot))).cast("boolean"), F.lit(True)))
    p = checked.groupBy(*keys).pivot(pivot, list(values)).agg(agg_col)
    for v, name in values.items():
        p = p.withColumnRenamed(v, name)
    return p


def _written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once and read from there: lineage stays short, a lost executor costs a round."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rs_recursive(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """Hierarchy with level: roots (parent null) are level 0, children level+1.

    Where every child has one row, levels come from pointer doubling: each node points at
    an ancestor and knows its distance, and a round lets it take over its ancestor's
    pointer, so rounds grow with the logarithm of the depth.  Nodes whose ancestors end in
    a missing node or go in a circle have no root and are not in the result.

    Where a child has several parents, it comes once per path from a root, a round a level
    (``_levels_by_path``); a cycle below a root is an error.
    """
    path = scratch_path(edges.sparkSession, f"hierarchy-{uuid.uuid4().hex}")
    nodes = _written(edges.select(F.col(child).alias("node"), F.col(parent).alias("parent")), f"{path}/nodes")
    if not nodes.groupBy("node").count().where("count > 1").isEmpty():
        return _levels_by_path(nodes, path)
    at = nodes.select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("far"), F.col("parent").isNull().alias("done"))
    at = at.withColumn("far", F.when(F.col("done"), 0).otherwise(F.col("far")))
    most, rounds = nodes.count(), 0
    while not at.where(~F.col("done")).isEmpty():
        if 1 << rounds > most:  # a pointer that has passed more links than there are nodes goes in a circle
            break
        above = at.select(F.col("node").alias("n"), F.col("up").alias("u"), F.col("far").alias("f"), F.col("done").alias("d"))
        moved = at.where(~F.col("done")).join(above, F.col("up") == F.col("n"))
        moved = moved.select("node", F.coalesce("u", "up").alias("up"), (F.col("far") + F.col("f")).alias("far"), "d")
        rounds += 1
        at = _written(at.where("done").unionAll(moved.withColumnRenamed("d", "done")), f"{path}/{rounds}")
    return nodes.join(at.where("done").select("node", F.col("far").cast("int").alias("level")), "node").select("node", "parent", "level")


def _levels_by_path(nodes: DataFrame, path: str) -> DataFrame:
    """Breadth-first over a hierarchy with several parents: a row per path from a root.

    Each row carries the node its path had at the last level that is a power of two
    (Brent's method): a path that meets it again has run through a cycle, which is named."""
    level = nodes.filter(F.col("parent").isNull()).withColumns({"level": F.lit(0), "mark": F.lit(None).cast(nodes.schema["node"].dataType)})
    depth, parts = 0, []
    while True:
        last = _written(level, f"{path}/{depth}")
        if last.isEmpty():
            break
        turn = last.where(F.col("node") == F.col("mark")).select("node").first()
        if turn is not None:
            raise ValueError(f"hierarchy has a cycle through {turn[0]!r}")
        parts.append(f"{path}/{depth}")
        mark = F.col("node") if depth and depth & (depth - 1) == 0 else F.col("mark")
        above = last.select(F.col("node").alias("parent"), mark.alias("mark"))
        depth += 1
        level = nodes.join(above, "parent").select("node", "parent", F.lit(depth).alias("level"), "mark")
    if not parts:
        return level.drop("mark")
    return nodes.sparkSession.read.schema(level.schema).parquet(*parts).drop("mark")


# ------------------------------------------------------------------ time series

def ts_ohlc(ticks: DataFrame, instrument: str, ts: str, price: str, tiebreak: str,
            unit: str = "minute") -> DataFrame:
    """OHLC bars per instrument and time unit; open/close by (ts, tiebreak)."""
    o = F.struct(F.col(ts), F.col(tiebreak))
    return ticks.groupBy(F.col(instrument).alias("instrument"),
                         F.date_trunc(unit, F.col(ts)).alias("bar_start")).agg(
        F.min_by(price, o).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, o).alias("close"), F.count(F.lit(1)).alias("ticks"))


def ts_continuity(bars: DataFrame) -> DataFrame:
    """Flag bars whose open equals the previous bar's close (per instrument)."""
    lj = lag_rows(bars, ["instrument"], ["bar_start"], ["close"])
    return lj.select("instrument", "bar_start", "open", F.col("prev_close"),
                     (F.col("open") == F.col("prev_close")).alias("continuous"))


# ------------------------------------------------------------------ small relational operators

def rel_drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in any (or the given) column."""
    return df.dropna(how="any", subset=subset)


def rel_in_like(df: DataFrame, column_in: str, values: list, column_like: str, patterns: list[str]) -> DataFrame:
    """``column_in IN values AND (column_like LIKE p1 OR ...)`` -- both pushable to the scan.
    As in SQL a null matches neither a pattern nor its negation."""
    like = None
    for p in patterns:
        c = F.col(column_like).like(p)
        like = c if like is None else (like | c)
    return df.filter(F.col(column_in).isin(*values) & like)


def join_inner_left(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, children: DataFrame,
                    fact_id: str, child_key: str, name: str = "n_children") -> DataFrame:
    """facts INNER JOIN dim (fact_key = dim_key), LEFT JOIN per-fact child counts
    (fact_id = child_key; facts without children keep 0).  Children are counted
    before the join (partial aggregation), so that join is 1:1."""
    counts = children.groupBy(F.col(child_key).alias("__ck")).agg(F.count(F.lit(1)).alias(name))
    j = facts.join(dim, F.col(fact_key) == F.col(dim_key)).join(counts, F.col(fact_id) == F.col("__ck"), "left")
    return j.drop("__ck").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def agg_distinct(df: DataFrame, keys: list[str], distinct_of: str, name: str = "distinct") -> DataFrame:
    """COUNT(DISTINCT x) and COUNT(*) per group (exact; use approx_count_distinct
    explicitly when an estimate is acceptable)."""
    return df.groupBy(*keys).agg(F.count_distinct(distinct_of).alias(name), F.count(F.lit(1)).alias("rows"))


def agg_conditional(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Conditional aggregates (COUNT/MAX/SUM of CASE) in one pass per group."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def topk(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """ORDER BY ... LIMIT k: per-task top-k then a merge (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)


def rs_list_agg(df: DataFrame, by: list[str], order: list[str], item: Column, name: str = "items",
                page_size: int | None = None) -> DataFrame:
    """Ordered list (of scalars or structs) per key, paged (see nesting)."""
    from lakeline.operators.nesting import DEFAULT_PAGE_SIZE, paged_lists

    return paged_lists(df, by, order, {name: item}, page_size or DEFAULT_PAGE_SIZE)
