"""Access-scoped and reporting views.

Row-level security becomes a filter the optimizer pushes into the scan;
role inheritance is a breadth-first closure, a written table per level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeline.functions import exact_avg, exact_sum, max_of, preview
from lakeline.session import scratch_path


def secured(df: DataFrame, tenant: str | None, tenant_col: str = "tenant") -> DataFrame:
    """Rows of the current tenant only; an unset tenant sees no rows."""
    if tenant is None:
        return df.filter(F.lit(False))
    return df.filter(F.col(tenant_col) == F.lit(tenant))


def sec_recent(df: DataFrame, ts: str, days: int = 30, asof=None) -> DataFrame:
    """Business users see the last ``days`` days before asof."""
    now = max_of(df, ts) if asof is None else asof
    return df.filter(F.col(ts) >= now - F.make_dt_interval(days=F.lit(days)))


def role_closure(edges: DataFrame, member: str = "member", parent: str = "parent") -> DataFrame:
    """(role, ancestor) pairs incl. (role, role): every role a role inherits.

    Path doubling: the pairs that are new since the last round (twice as far apart) meet
    all pairs known, so rounds grow with the logarithm of the longest chain; pairs seen
    before go no further, so a cycle ends.  Each round's new pairs are written once in the
    shared folder.
    """
    spark = edges.sparkSession
    path = scratch_path(spark, f"roles-{uuid.uuid4().hex}")
    e = edges.select(F.col(member).alias("role"), F.col(parent).alias("anc")).dropna().distinct()
    roles = edges.select(F.col(member).alias("role")).union(edges.select(F.col(parent).alias("role"))).distinct()
    new = e.where("role <> anc")
    roles.select("role", F.col("role").alias("anc")).write.parquet(f"{path}/0")
    rounds = 0
    while True:
        rounds += 1
        new.write.parquet(f"{path}/{rounds}")
        last = spark.read.schema(new.schema).parquet(f"{path}/{rounds}")
        seen = spark.read.schema(new.schema).parquet(*[f"{path}/{i}" for i in range(rounds + 1)])
        if last.isEmpty():
            return seen
        far = seen.where("role <> anc").select(F.col("role").alias("anc"), F.col("anc").alias("next"))
        step = last.join(far, "anc").select("role", F.col("next").alias("anc")).distinct()
        new = step.join(seen, ["role", "anc"], "left_anti")


def sec_roles(edges: DataFrame, grants: DataFrame) -> DataFrame:
    """Effective grants: a role's own grants plus those of every role it inherits."""
    c = role_closure(edges)
    g = grants.select(F.col("role").alias("anc"), "privilege", "object")
    return c.join(g, "anc").select("role", "privilege", "object").distinct()


def rep_daily(df: DataFrame, ts: str, tenant: str, value: str, scale: int | None = None) -> DataFrame:
    """Per day and tenant: events, sum and average of ``value`` (exact when
    ``value`` has a fixed number of decimals, given as ``scale``)."""
    total = exact_sum(value, scale) if scale else F.sum(value)
    avg = exact_avg(value, scale) if scale else F.avg(value)
    return df.groupBy(F.date_trunc("day", ts).alias("day"), F.col(tenant).alias("tenant")).agg(
        F.count(F.lit(1)).alias("events"), total.alias("total"), avg.alias("average"))


def rep_daily_last(daily: DataFrame, days: int = 30, asof=None) -> DataFrame:
    return sec_recent(daily, "day", days, asof)


def rep_activity(df: DataFrame, user: str, users: DataFrame | list, text: str, n: int = 100) -> DataFrame:
    """Activity of listed users with an ``n``-character preview.  ``users`` may be
    a DataFrame of user names (semi join) or a short literal list (IN)."""
    if isinstance(users, DataFrame):
        d = df.join(users.select(F.col(users.columns[0]).alias(user)), user, "left_semi")
    else:
        d = df.filter(F.col(user).isin(*users))
    return d.withColumn("preview", preview(text, n)).drop(text)


def rep_query_hourly(df: DataFrame, user: str, ts: str, duration: str, active: Column,
                     patterns: list[str], scale: int | None = None) -> DataFrame:
    """Per user-hour for users matching any LIKE pattern: count, avg duration, active count."""
    cond = None
    for p in patterns:
        c = F.col(user).like(p)
        cond = c if cond is None else (cond | c)
    return df.filter(cond).groupBy(user, F.date_trunc("hour", ts).alias("hour")).agg(
        F.count(F.lit(1)).alias("queries"),
        (exact_avg(duration, scale) if scale else F.avg(duration)).alias("avg_duration"),
        F.count(F.when(active, 1)).alias("active"))


def rep_dashboard_daily(events: DataFrame, days: int = 90, asof=None) -> DataFrame:
    """Daily: distinct users, events, purchase revenue (exact cents), average value."""
    recent = sec_recent(events, "ts", days, asof)
    cents = F.round(F.col("value") * 100).cast("long")
    return recent.groupBy(F.date_trunc("day", "ts").alias("day")).agg(
        F.count_distinct("user_id").alias("dau"), F.count(F.lit(1)).alias("events"),
        (F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", cents)), F.lit(0)) / 100.0).alias("revenue"),
        exact_avg("value", 100).alias("avg_session"))


def rep_week_cohorts(events: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Signup week x weeks since signup -> distinct active users."""
    first = events.groupBy(user).agg(F.date_trunc("week", F.min(ts)).alias("cohort_week"))
    e = events.join(first, user)
    weeks = (F.datediff(F.date_trunc("week", ts), F.col("cohort_week")) / 7).cast("int")
    return e.groupBy("cohort_week", weeks.alias("weeks_since")).agg(F.count_distinct(user).alias("users"))
