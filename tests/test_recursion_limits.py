"""Rate limiting as it happens, hierarchies and role closures against plain replays."""
import collections
import random

import pytest
from pyspark.sql import functions as F

from lakeline.operators import access as A
from lakeline.operators import monitoring as M
from lakeline.operators import patterns as P


def replay(rows, window, limit):
    held, out = collections.defaultdict(list), {}
    for user, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        live = [a for a in held[user] if a > t - window]
        out[i] = len(live) < limit
        held[user] = live + [t] if out[i] else live
    return out


@pytest.mark.parametrize("limit,window", [(1, 10), (3, 40), (7, 200), (50, 100_000), (0, 5)])
def test_admitted_equals_a_replay(spark, limit, window):
    rng = random.Random(limit)
    rows = []
    for i in range(2400):
        user = "hot" if i % 3 else rng.choice(["a", "b", None, "c"])
        rows.append((user, rng.randrange(4000) if user == "hot" else rng.choice([rng.randrange(60), rng.randrange(30_000)]), i))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)  # the state crosses batches
    try:
        df = spark.createDataFrame(rows, "u string, s long, rid long").withColumn("at", F.timestamp_seconds("s").cast("timestamp_ntz"))
        got = {r.rid: r.admitted for r in M.mon_rate_limit_admitted(df, "u", "at", "rid", window, limit).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == replay(rows, window, limit)
    assert M.mon_rate_limit_admitted(df.where("false"), "u", "at", "rid", window, limit).count() == 0


def written(monkeypatch):
    seen = []
    plain = P._written
    monkeypatch.setattr(P, "_written", lambda df, path: seen.append(path) or plain(df, path))
    return seen


def test_deep_chain_takes_few_rounds(spark, monkeypatch):
    rounds = written(monkeypatch)
    chain = spark.range(10_000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"))
    rows = P.rs_recursive(chain, "id", "up")
    assert rows.where("level <> node").count() == 0 and rows.count() == 10_000 and len(rounds) <= 16


def test_hierarchies(spark, monkeypatch):
    rows = [(1, None), (2, 1), (3, 2), (4, 2), (5, None), (6, 99), (7, 8), (8, 9), (9, 7), (10, 7), (11, 11), (12, 4)]
    got = {(r.node, r.parent, r.level) for r in P.rs_recursive(spark.createDataFrame(rows, "c int, p int"), "c", "p").collect()}
    assert got == {(1, None, 0), (2, 1, 1), (3, 2, 2), (4, 2, 2), (5, None, 0), (12, 4, 3)}  # no root: missing parent, circles
    assert P.rs_recursive(spark.createDataFrame([], "c int, p int"), "c", "p").count() == 0
    two = [(1, None), (2, 1), (3, 1), (4, 2), (4, 3), (5, 4)]
    got = collections.Counter((r.node, r.parent, r.level) for r in P.rs_recursive(spark.createDataFrame(two, "c int, p int"), "c", "p").collect())
    assert got == {(1, None, 0): 1, (2, 1, 1): 1, (3, 1, 1): 1, (4, 2, 2): 1, (4, 3, 2): 1, (5, 4, 3): 2}
    rounds = written(monkeypatch)
    with pytest.raises(ValueError, match="cycle through"):
        P.rs_recursive(spark.createDataFrame([(1, None), (2, 1), (3, 2), (2, 3)], "c int, p int"), "c", "p")
    assert len(rounds) < 12


def test_role_closure_of_a_chain_and_a_graph(spark):
    chain = spark.range(1, 120).select(F.col("id").alias("member"), (F.col("id") - 1).alias("parent"))
    assert A.role_closure(chain).count() == 120 * 121 // 2
    rng = random.Random(2)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    up = collections.defaultdict(set)
    for m, p in edges:
        up[m].add(p)
    want = set()
    for r in {x for e in edges for x in e}:
        todo, seen = [r], {r}
        while todo:
            for p in up[todo.pop()] - seen:
                seen.add(p)
                todo.append(p)
        want |= {(r, a) for a in seen}
    got = [(r.role, r.anc) for r in A.role_closure(spark.createDataFrame(sorted(edges), "member int, parent int")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
