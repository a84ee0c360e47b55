"""URL filters: a sort-merge range join of urls with host/path rules, native.

A rule (host, path) becomes an interval of canonical keys: the host's labels in
reverse order, then the path.  All keys that begin with the rule's key lie in
[key, key + 0xFF], and such intervals nest or are apart.  Rules are swept once in
key order with a stack, which turns them into boundaries: from a start the rule is
active, from its end the rule that encloses it.  A url gives one point per
ancestor of its host, and the last boundary at or before a point names the
innermost active rule there.

Points and boundaries are range-partitioned and sorted together.  Each range is
swept by a window; what is active where a range begins is carried from the last
boundary of earlier ranges.  Equal urls are folded before, and a key may be split
over ranges, since the carry is exact anywhere: a hot host is swept by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeline.llm.common import saved

Rule = tuple[str, str, str]  # host, path, verdict
BOUNDARY = "at binary, rule string, verdict string, size int"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_key(host: str, path: str) -> bytes:
    """Reversed labels in hexadecimal (keeps prefix and order; ``.`` and ``/`` stay free), then the path."""
    labels = [x.encode().hex().upper() for x in reversed(host.split("."))]
    return (".".join(labels) + "/").encode() + path.encode()


def boundaries(rules: Sequence[Rule]) -> list[tuple[bytearray, str | None, str | None, int]]:
    """Sweep the sorted rules with a stack of those still open."""
    by_key = {rule_key(h.lower(), p): (h.lower() + p, v) for h, p, v in rules}  # of equal rules the last counts
    out, open_ = [], []

    def close() -> None:
        key, _, _ = open_.pop()
        rule, verdict = (open_[-1][1], open_[-1][2]) if open_ else (None, None)
        out.append((bytearray(key + b"\xff"), rule, verdict, len(rule or "")))

    for key in sorted(by_key):
        while open_ and not key.startswith(open_[-1][0]):
            close()
        rule, verdict = by_key[key]
        open_.append((key, rule, verdict))
        out.append((bytearray(key), rule, verdict, len(rule)))
    while open_:
        close()
    return out


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per input row: the id, host, path, rule and verdict.

    A rule fits its host and all subdomains where the url's path begins with the
    rule's; the longest fitting rule wins (of equally long ones the more specific
    host), ``default`` where none fits (rule null).  A null url, or one without
    ``://``, has empty host and path and no rule.  Null ids and repeated rows stay
    as they are; an empty table gives an empty result; no rules at all leave the
    default everywhere.  Other columns are ignored.
    """
    spark = pages.sparkSession
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.groupBy("id", "host", "path").agg(F.count(F.lit(1)).alias("copies"))
    labels = F.transform(F.reverse(F.split("host", r"\.")), lambda x: F.hex(x.cast("binary")))
    points = rows.withColumn("labels", labels).withColumn("level", F.explode(F.sequence(F.lit(1), F.size("labels"))))
    at = F.concat(F.array_join(F.slice("labels", 1, F.col("level")), "."), F.lit("/"), F.col("path")).cast("binary")
    points = points.select(at.alias("at"), F.lit(1).alias("kind"), "level", "id", "host", "path", "copies")
    bounds = spark.createDataFrame(boundaries(rules), BOUNDARY).withColumn("kind", F.lit(0))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = points.unionByName(bounds, allowMissingColumns=True).repartitionByRange(n, "at", "kind", "id", "level")
    dealt = saved(dealt.withColumn("range", F.spark_partition_id()), "url-points")
    mark = F.struct("rule", "verdict", "size")
    last = dealt.where("kind = 0").groupBy("range").agg(F.max_by(mark, "at").alias("last"))
    every = dealt.select("range").distinct().join(last, "range", "left")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carry = every.select("range", F.last("last", ignorenulls=True).over(earlier).alias("carry"))
    swept = Window.partitionBy("range").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = F.last(F.when(F.col("kind") == 0, mark), ignorenulls=True).over(swept)
    found = dealt.withColumn("active", active).where("kind = 1").join(carry, "range", "left")
    found = found.withColumn("active", F.coalesce("active", "carry")).withColumn("size", F.coalesce("active.size", F.lit(0)))
    best = found.groupBy("id", "host", "path", "copies").agg(F.max_by("active", F.struct("size", "level")).alias("active"))
    out = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(
        F.col("id").alias(id_col), "host", "path", F.col("active.rule").alias("rule"),
        F.coalesce("active.verdict", F.lit(default)).alias("verdict"),
    )
