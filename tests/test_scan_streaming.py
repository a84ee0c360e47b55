"""Skew-safe scan vs. plain windows on a hot key; properties; stream restarts."""
import datetime as dt
import glob
import os
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeline.operators import quality as Q
from lakeline.operators.scan import lag_rows, rolling_sum, running
from lakeline.plans.fixtures import Fixtures
from lakeline.streaming import jobs as J

from conftest import SF_SMALL


def test_running_matches_window_with_hot_key(spark):
    # key 0 holds a third of the rows
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"),
        F.col("id").alias("t"), (F.col("id") % 7).alias("v"),
        F.when(F.col("id") % 5 == 0, F.col("id")).alias("maybe"))
    r = running(df, ["k"], ["t"], {"s": ("sum", "v"), "c": ("count", None), "m": ("max", "v"),
                                    "l": ("last", "maybe")}, chunks=9)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("t", F.sum("v").over(w).alias("s2"), F.count("*").over(w).alias("c2"),
                    F.max("v").over(w).alias("m2"), F.last("maybe", True).over(w).alias("l2"))
    bad = r.join(ref, "t").filter((F.col("s") != F.col("s2")) | (F.col("c") != F.col("c2"))
                                  | (F.col("m") != F.col("m2")) | ~F.col("l").eqNullSafe(F.col("l2")))
    assert r.count() == 3000 and bad.count() == 0


def test_lag_and_rolling_match_windows(spark):
    df = spark.range(500).select((F.col("id") % 4).alias("k"), F.col("id").alias("t"),
                                 F.when(F.col("id") % 5 > 0, F.col("id") * 3).alias("v"))
    df = df.unionAll(spark.createDataFrame([(None, 7, 1), (None, 9, 2), (None, None, 3)], "k long, t long, v long"))
    w = Window.partitionBy("k").orderBy("t")
    for n in (1, 3):
        got = lag_rows(df, ["k"], ["t"], ["v"], n, chunks=40)
        ref = df.select("*", F.lag("v", n).over(w).alias("prev_v"))
        assert got.count() == df.count() and got.exceptAll(ref).count() == 0
    got = rolling_sum(df, ["k"], ["t"], "v", 7, chunks=90)
    ref = df.select("*", F.row_number().over(w).cast("long").alias("pos"), F.sum("v").over(w.rowsBetween(-6, 0)).alias("rolling_sum"))
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_running_keeps_sql_null_decimal_and_long_rules(spark):
    big = 2 ** 53 + 1
    rows = [(1, 1, big, "1.10", 9), (1, 2, None, None, 1), (1, 3, 1, "2.20", None), (1, 4, None, None, 3), (None, 1, 5, "0.05", None), (2, 1, None, None, None)]
    df = spark.createDataFrame(rows, "k int, t int, a long, d string, m int").withColumn("d", F.col("d").cast("decimal(12,2)"))
    ops = {"s": ("sum", "a"), "sd": ("sum", "d"), "c": ("count", "a"), "n": ("count", None), "hi": ("max", "m"), "lo": ("min", "m"),
           "l": ("last", "m"), "p": ("prev", "m")}
    w = Window.partitionBy("k").orderBy("t")
    u = w.rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("k", "t", F.sum("a").over(u), F.sum("d").over(u).cast("decimal(38,2)"), F.count("a").over(u), F.count("*").over(u),
                    F.max("m").over(u), F.min("m").over(u), F.last("m", True).over(u), F.lag("m").over(w))
    for chunks in (1, 2, 50):
        got = running(df, ["k"], ["t"], ops, chunks=chunks).select("k", "t", *ops)
        assert sorted(map(str, got.collect())) == sorted(map(str, ref.toDF("k", "t", *ops).collect()))


def test_event_order_writer_keeps_null_times(spark, tmp_dir):
    df = spark.createDataFrame([(1, None), (2, dt.datetime(2024, 1, 1)), (3, dt.datetime(2024, 1, 2)), (4, dt.datetime(2024, 1, 2))], "id int, ts timestamp_ntz")
    src = J.write_in_event_order(df, tmp_dir, "ts", 3)
    assert sorted(r.id for r in spark.read.parquet(src).collect()) == [1, 2, 3, 4]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 10 ** 6)), min_size=1, max_size=40))
def test_group_sums_add_up(spark, rows):
    df = spark.createDataFrame(rows, "g int, v long")
    r = Q.dq_agg_invariant(df, "g", F.col("v")).first()
    assert r.consistent and r.sum_of_groups == sum(v for _, v in rows) and r.negatives == 0


def test_stream_restart_adds_nothing(spark, tmp_dir):
    ev = Fixtures(spark, SF_SMALL).events
    src, out, ck = f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ck"
    src = J.write_in_event_order(ev, src, "ts", 3)
    J.st_dedup(J.file_stream(spark, src, ev.schema), out, ck, key="event_id", ts="ts").awaitTermination()
    n1 = spark.read.parquet(out).count()
    J.st_dedup(J.file_stream(spark, src, ev.schema), out, ck, key="event_id", ts="ts").awaitTermination()
    assert spark.read.parquet(out).count() == n1 == ev.count()


def test_dedup_stream_keeps_first_of_one_micro_batch(spark, tmp_dir):
    """Deliveries of one message in files that one micro-batch reads, the later ones in the file read first."""
    schema = "msg_id long, enqueued_at timestamp_ntz, n int"
    src, out, ck = f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ck"
    for n in (2, 1, 0):
        rows = spark.range(400).select(F.when(F.col("id") > 0, F.col("id")).alias("msg_id"), F.timestamp_seconds(1000 + 30 * n + F.col("id") % 7).cast("timestamp_ntz").alias("enqueued_at"), F.lit(n).alias("n"))
        rows.repartition(3).write.mode("append").parquet(src)
    J.st_dedup(J.file_stream(spark, src, schema, files_per_trigger=9), out, ck).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(out).groupBy("n").count().collect()] == [(0, 400)]


def test_dedup_stream_takes_few_micro_batches(spark, monkeypatch):
    from lakeline.plans import q_streams

    taken = []
    start = J.st_dedup

    def started(*args):
        taken.append(start(*args))
        return taken[0]

    monkeypatch.setattr(J, "st_dedup", started)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = q_streams.q_st_dedup_stream(spark, SF_SMALL)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got.count() == Fixtures(spark, SF_SMALL).events.count()
    assert len([p for p in taken[0].recentProgress if p["numInputRows"]]) <= 4


def test_ingest_keeps_no_batch_in_executors(spark, tmp_dir, monkeypatch):
    """A batch's events wait in files, gone afterwards, and not in the executors' memory."""
    from lakeline.operators import lineage_events as E

    ev = Fixtures(spark, SF_SMALL).ol_events()
    src, out, ck = f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ck"
    src = J.write_in_event_order(ev, src, "ts", 2)
    held = []
    monkeypatch.setattr(type(ev), "persist", lambda self, *level: held.append(level) or self)
    J.st_ingest(spark, src, out, ck).awaitTermination()
    assert not held and J._stored_partitions(spark, f"{out}/_valid", "batch") == []
    want = E.ingest(ev)
    assert J.store_tables(spark, out)["run_events"].count() == want["run_events"].count() > 0


def test_ingest_stream_equals_batch(spark, tmp_dir):
    from lakeline.operators import lineage_events as E

    f = Fixtures(spark, SF_SMALL)
    src, out, ck = f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ck"
    src = J.write_in_event_order(f.ol_events(), src, "ts", 3)
    J.st_ingest(spark, src, out, ck).awaitTermination()
    J.st_ingest(spark, src, out, ck).awaitTermination()  # restart: nothing new
    stream_runs = J.store_tables(spark, out)["runs"]
    g, _ = E.split_valid(E.ol_validate(E.ol_parse(f.ol_events())))
    batch_runs = E.ol_runs(g)
    assert stream_runs.count() == batch_runs.count()
    assert stream_runs.exceptAll(batch_runs).count() == 0


def test_tumbling_stream_equals_closed_batch_windows(spark, tmp_dir):
    from lakeline.operators import streams as S

    ev = Fixtures(spark, SF_SMALL).events
    src, out, ck = f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ck"
    src = J.write_in_event_order(ev, src, "ts", 3)
    J.st_window_tumbling(J.file_stream(spark, src, ev.schema), out, ck).awaitTermination()
    cut = ev.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    batch = S.st_window_tumbling(ev, "ts", "1 hour", ["event_type"]).filter(F.col("window_end") <= F.lit(cut))
    got = spark.read.parquet(out)
    assert got.count() == batch.count()
    assert got.select(*batch.columns).exceptAll(batch).count() == 0


def test_redelivered_messages_add_nothing(spark, tmp_dir):
    """The same messages again in later batches: no row more in any table."""
    from lakeline.operators import lineage_events as E

    f = Fixtures(spark, SF_SMALL)
    ev = f.ol_events()
    out, ck, src = f"{tmp_dir}/out", f"{tmp_dir}/ck", f"{tmp_dir}/in"
    ev.repartition(2).write.parquet(src)
    ev.filter(F.col("seq") % 2 == 0).coalesce(1).write.mode("append").parquet(src)
    J.st_ingest(spark, src, out, ck).awaitTermination()
    good, bad = E.split_valid(E.ol_validate(E.ol_parse(ev)))
    store = J.store_tables(spark, out)
    assert store["run_events"].count() == good.count()
    assert spark.read.parquet(f"{out}/dead_letters").count() == bad.count()
    for name, want in (("jobs", E.ol_jobs(good)), ("datasets", E.ol_datasets(good)), ("edges", E.ol_edges(good))):
        assert store[name].select(*want.columns).exceptAll(want).count() == 0 and store[name].count() == want.count()


def test_liveness_stream_reports_and_recovers(spark, tmp_dir):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, at(i), i, "ping") for i in range(4)] + [(1, at(10), 10, "pong"), (2, at(0), 20, "connect"), (2, at(5), 21, "ping"),
            (2, at(100), 22, "ping"), (3, at(0), 30, "connect"), (3, at(100), 31, "connect")]
    pings = spark.createDataFrame(rows, "client_id long, ts timestamp_ntz, event_id long, kind string")
    src = J.write_in_event_order(pings, f"{tmp_dir}/in", "ts", 1)
    J.ev_liveness(J.file_stream(spark, src, pings.schema), f"{tmp_dir}/out", f"{tmp_dir}/ck").awaitTermination()
    got = {(r.client_id, r.reason, r.detected_at) for r in spark.read.parquet(f"{tmp_dir}/out").collect()}
    assert got == {(1, "missed_pings", at(3)), (1, "recovered", at(10)), (2, "no_pong", at(100))}


def replay_of_liveness(rows):
    """(client, reason, second) by a plain replay, one group of (second, kind) at a time, all timeouts due by then told."""
    groups = {}
    for client, us, kind in rows:
        n, first, last = groups.get((client, us // 10**6, kind), (0, us, us))
        groups[client, us // 10**6, kind] = n + 1, min(first, us), max(last, us)
    watermark = max(us for _, us, _ in rows) // 1000 * 1000 - 600 * 10**6
    told, state = set(), {}
    for (client, _, kind), (n, first, last) in sorted(groups.items(), key=lambda g: (g[0][1], g[1][2], g[0][2])):
        s = state.setdefault(client, dict(since=first, base=first, ping=False, pong=False, missed=0, full=0, errors=0, out=False))
        if not s["out"] and s["base"] + 120 * 10**6 < first:
            s["out"] = bool(told.add((client, "ping_timeout", s["base"] + 120 * 10**6))) or True
        if kind == "ping":
            s.update(base=last, ping=True, missed=s["missed"] + n)
        elif kind == "pong":
            s.update(pong=True, missed=0)
            if s["out"]:
                told.add((client, "recovered", last))
                s.update(base=last, full=0, errors=0, out=False)
        s["full"] += n * (kind == "queue_full")
        s["errors"] += n * (kind == "write_error")
        rules = [("missed_pings", s["missed"] > 3), ("queue_full", s["full"] > 10), ("write_errors", s["errors"] > 5),
                 ("no_pong", s["ping"] and not s["pong"] and last - s["since"] > 90 * 10**6)]
        first_rule = next((r for r, holds in rules if holds), None)
        if first_rule and not s["out"]:
            told.add((client, first_rule, last))
            s["out"] = True
    return told | {(c, "ping_timeout", s["base"] + 120 * 10**6) for c, s in state.items() if not s["out"] and s["base"] + 120 * 10**6 < watermark}


def test_liveness_stream_equals_a_replay_however_it_is_cut(spark, tmp_dir):
    """A client with a third of the rows, many in one second; null client, null times, all rules; 1 and 3 micro-batches."""
    rng = random.Random(5)
    kinds = ["ping"] * 6 + ["pong"] * 5 + ["queue_full"] * 3 + ["write_error", "connect"]
    clients = [1] * 7 + [2, 3, 4, 5, None] + [6] * 2
    rows = [(1, 0, "connect"), (1, 5400 * 10**6, "connect")]
    rows += [(rng.choice(clients), rng.randrange(5400 * 10**6), rng.choice(kinds)) for _ in range(3000)]
    rows += [(1, 2700 * 10**6 + rng.randrange(10**6), "ping") for _ in range(1500)]
    rows += [(7, 1000 * 10**6, "ping"), (8, 100 * 10**6, "ping"), (8, 200 * 10**6, "connect"), (9, 5390 * 10**6, "ping")]
    rows += [(10, i * 10**7, "write_error") for i in range(8)]
    silent = [(c, us, k) for c, us, k in rows if not (c == 6 and 1500 * 10**6 < us < 3000 * 10**6)]
    day = dt.datetime(2024, 1, 1)
    at = lambda us: day + dt.timedelta(microseconds=us)
    pings = spark.createDataFrame([(c, at(us), i, k) for i, (c, us, k) in enumerate(silent)] + [(1, None, -1, "pong")],
                                  "client_id long, ts timestamp_ntz, event_id long, kind string")
    want = {(c, r, at(us)) for c, r, us in replay_of_liveness(silent)}
    assert {r for _, r, _ in want} == {"ping_timeout", "missed_pings", "queue_full", "write_errors", "no_pong", "recovered"}
    for files in (1, 3):
        src = J.write_in_event_order(pings, f"{tmp_dir}/in{files}", "ts", files)
        J.ev_liveness(J.file_stream(spark, src, pings.schema), f"{tmp_dir}/out{files}", f"{tmp_dir}/ck{files}").awaitTermination()
        got = [tuple(r) for r in spark.read.parquet(f"{tmp_dir}/out{files}").select("client_id", "reason", "detected_at").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_pings_are_folded_before_the_shuffle():
    """A million pings of one client in ten seconds leave a task as one row a second and kind."""
    us = np.arange(1_000_000, dtype=np.int64) * 10
    kind = pa.array(np.where(us % 3 == 0, "ping", "pong"))
    slot = us - us % 10**6
    batches = [pa.record_batch([pa.array(np.ones(50_000, np.int64)), pa.array(slot[i:i + 50_000]), kind[i:i + 50_000], pa.array(us[i:i + 50_000])],
                               ["client_id", "slot", "kind", "us"]) for i in range(0, len(us), 50_000)]
    folded = pa.Table.from_batches(list(J.ping_slots(batches))).to_pylist()
    assert len(folded) == 20 and sum(r["n"] for r in folded) == 1_000_000
    assert min(r["first"] for r in folded) == 0 and max(r["last"] for r in folded) == int(us[-1])
    assert list(J.ping_slots([])) == []


def test_latest_state_stream_folds_its_changes(spark, tmp_dir):
    rows = [(k, dt.datetime(2024, 1, 1, 0, 0, s), s, "row_deleted" if (k, s) == (2, 5) else "row_updated", float(s)) for s in range(8) for k in (1, 2, 3) if (k, s) not in ((2, 6), (2, 7))]
    c = spark.createDataFrame(rows, "entity_id long, ts timestamp_ntz, seq long, type string, row_count double")
    src = J.write_in_event_order(c, f"{tmp_dir}/in", "ts", 8)
    J.ev_latest_state(J.file_stream(spark, src, c.schema), f"{tmp_dir}/out", f"{tmp_dir}/ck", compact_every=3).awaitTermination()
    assert set(J._stored_partitions(spark, f"{tmp_dir}/out/base", "base")) == {3, 6}
    assert {(r.entity_id, r.seq) for r in J.current_state(spark, f"{tmp_dir}/out").collect()} == {(1, 7), (3, 7)}


def test_latest_state_forgets_old_deletes(spark, tmp_dir):
    """A change older than a delete is dropped while the delete is remembered, and late once it is forgotten."""
    schema = "entity_id long, ts timestamp_ntz, seq long, type string, row_count double"
    at = lambda s: None if s is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    change = lambda k, s, seq, kind="updated": (k, at(s), seq, f"row_{kind}", float(seq))
    first = [change(1, 5, 1), change(1, 9, 2, "deleted"), change(2, 5, 3), change(2, 4, 4), change(None, 5, 5), change(None, None, 6), change(3, 1, 7)]
    first += [change(4, i % 50, i) for i in range(1000)]  # a hot key
    second = [change(1, 7, 9), change(2, 4, 99), change(None, 6, 11), change(3, 52, 12, "deleted"), change(5, 500, 13)]
    third = [change(1, 8, 14), change(3, 51, 15), change(1, 450, 16), change(5, 499, 17)]
    src, out, ck = (f"{tmp_dir}/{x}" for x in ("in", "out", "ck"))
    states = []
    for rows in (first, second, third):
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(src)
        q = J.ev_latest_state(J.file_stream(spark, src, schema, files_per_trigger=10), out, ck, forget_deleted_s=100)
        q.awaitTermination()
        states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {(r.entity_id, r.seq) for r in J.current_state(spark, out).collect()}
    assert got == {(1, 16), (2, 3), (None, 11), (4, 999), (5, 13)}
    assert states[1] < states[0] + 1  # key 5 came; the marks of keys 1 and 3 went, with their timers


def chunk_sizes(spark, df, by, order, chunks):
    from lakeline.operators.scan import chunked

    return sorted(r["count"] for r in chunked(df, by, order, chunks).groupBy("__chunk").count().collect())


def test_chunks_stay_even(spark):
    """No outlying value, run of equal times, text order or hot key makes a chunk large."""
    i = F.col("id")
    hot = F.when(i % 3 > 0, 0).otherwise(i % 900)
    base = spark.range(20_000).select(i, hot.alias("k"), F.when(i == 7, F.lit(dt.datetime(2999, 1, 1))).otherwise(
        F.timestamp_seconds(i)).alias("t"), F.lit(5).alias("same"), F.concat(F.lit("name-"), F.lpad(i.cast("string"), 6, "0")).alias("name"))
    for by, order in ((["k"], ["t", "id"]), (["k"], ["same", "id"]), (["k"], ["name"]), ([], ["t", "id"]), (["k"], ["same", "name", "t"])):
        sizes = chunk_sizes(spark, base, by, order, 64)
        assert 48 <= len(sizes) <= 64 and sizes[-1] <= 4 * sizes[len(sizes) // 2]
    assert chunk_sizes(spark, base, ["k"], ["id"], 1) == [20_000]
    assert chunk_sizes(spark, base.limit(3), ["k"], ["id"], 64)
    assert chunk_sizes(spark, base.filter("false"), ["k"], ["id"], 64) == []
    assert chunk_sizes(spark, base, [], ["same"], 64) == [20_000]  # rows with one tuple share a chunk


def test_chunks_rise_with_the_order(spark):
    from lakeline.operators.scan import chunked

    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 11 > 0, (F.col("id") * 37) % 501 - 250).alias("a"),
                                  F.when(F.col("id") % 7 > 0, F.col("id").cast("double") / 3).otherwise(float("nan")).alias("b"), "id")
    w = Window.partitionBy("k").orderBy("a", "b", "id")
    rows = chunked(df, ["k"], ["a", "b", "id"], 40).withColumn("before", F.lag("__chunk").over(w))
    assert rows.filter("before > __chunk").count() == 0 and rows.select("__chunk").distinct().count() > 30


def test_outlier_equal_times_and_text_order_match_windows(spark):
    i = F.col("id")
    df = spark.range(4000).select(F.when(i % 3 > 0, "hot").otherwise((i % 40).cast("string")).alias("k"), i,
                                  F.when(i == 9, 10**15).when(i % 2 == 0, 77).otherwise(i).alias("t"), F.sha2(i.cast("string"), 256).alias("name"), (i % 13).alias("v"))
    for order in (["t", "id"], ["name"]):
        w = Window.partitionBy("k").orderBy(*order)
        u = w.rowsBetween(Window.unboundedPreceding, 0)
        got = rolling_sum(df, ["k"], order, "v", 5, chunks=64)
        ref = df.select("*", F.row_number().over(w).cast("long").alias("pos"), F.sum("v").over(w.rowsBetween(-4, 0)).alias("rolling_sum"))
        assert got.exceptAll(ref).count() == 0 and got.count() == 4000
        got = running(df, ["k"], order, {"s": ("sum", "v"), "p": ("prev", "v")}, chunks=64)
        assert got.exceptAll(df.select("*", F.sum("v").over(u).alias("s"), F.lag("v").over(w).alias("p"))).count() == 0


def test_pong_reset_and_features_with_a_hot_client(spark):
    from lakeline.operators import streams as ST

    kinds = F.element_at(F.array(*map(F.lit, ["ping", "ping", "pong", "queue_full", "ping", "write_error", None])), (F.pmod(F.xxhash64("event_id"), F.lit(7)) + 1).cast("int"))
    p = spark.range(3000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 > 0, 1).when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 20).alias("client_id"),
                                 F.timestamp_seconds(F.floor(F.col("id") / 40)).cast("timestamp_ntz").alias("ts"))
    p = p.withColumn("kind", kinds)
    got = {(r.client_id, r.event_id): r.missed_pings for r in ST.ev_pong_reset(p).collect()}
    want, count = {}, {}
    for r in p.orderBy("ts", "event_id").collect():
        if r.kind == "pong":
            count[r.client_id] = 0
        if r.kind == "ping":
            count[r.client_id] = want[r.client_id, r.event_id] = count.get(r.client_id, 0) + 1
    assert got == want
    assert {r.client_id: r.missed_pings for r in ST.liveness_features(p).collect() if r.missed_pings} == {k: v for k, v in count.items() if v}


def test_seen_ids_against_a_set(spark, tmp_dir, monkeypatch):
    """Sequential, sparse and redelivered ids, nulls, replays: each id is fresh once; a batch
    touches the pages of its own ids and keeps two indexes."""
    import random

    from lakeline.sources import commits
    from lakeline.streaming import seen as M

    monkeypatch.setattr(M, "PAGE", 20)
    rng, known, upto = random.Random(4), set(), 0
    for n in range(9):
        ids = [upto + i for i in range(60)] + rng.sample(sorted(known), min(len(known), 15)) + [None, None]
        ids += [-(10**12) + rng.randrange(10**6) * 7 for _ in range(25)] if n % 3 == 0 else []  # sparse: many runs
        ids += [upto + 3] * 5
        upto += 60 if n != 4 else 0  # the fifth batch is delivered again whole
        batch = spark.createDataFrame([(i, "x") for i in ids], "seq long, body string")
        for attempt in range(2 if n % 4 == 1 else 1):
            s = M.SeenIds(spark, f"{tmp_dir}/seen", n)
            fresh = s.fresh(batch, "seq")
            got = sorted((r.seq is None, r.seq or 0) for r in fresh.collect())
            assert got == sorted((i is None, i or 0) for i in set(ids) - known)
            if n > 4 and n % 3:
                assert len(s.pages) >= 3 and len(s.touched) < len(s.pages)
            s.store(fresh, "seq")
        known |= set(ids) - {None}
        assert len(commits.numbers(spark, f"{tmp_dir}/seen/index")) <= 2
    pages = M.SeenIds(spark, f"{tmp_dir}/seen", 99).pages
    runs = spark.read.schema(M.RUNS).parquet(*[f"{tmp_dir}/seen/{p['folder']}" for p in pages]).collect()
    assert sorted(i for r in runs for i in range(r.lo, r.hi + 1)) == sorted(known)
    assert all(r["count"] <= 20 for r in spark.read.schema(M.RUNS).parquet(*[f"{tmp_dir}/seen/{p['folder']}" for p in pages]).groupBy(F.input_file_name()).count().collect())


def test_sequential_ids_stay_one_run(spark, tmp_dir):
    from lakeline.streaming.seen import SeenIds

    for n in range(4):
        s = SeenIds(spark, f"{tmp_dir}/seen", n)
        batch = spark.range(n * 1000, n * 1000 + 1500).withColumnRenamed("id", "seq")  # 500 come again
        fresh = s.fresh(batch, "seq")
        assert fresh.count() == (1500 if n == 0 else 1000)
        s.store(fresh, "seq")
    pages = SeenIds(spark, f"{tmp_dir}/seen", 9).pages
    rows = spark.read.schema("lo long, hi long").parquet(*[f"{tmp_dir}/seen/{p['folder']}" for p in pages]).collect()
    assert [(r.lo, r.hi) for r in rows] == [(0, 4499)]


def test_event_order_writer_cuts_slices_between_tasks(spark, tmp_dir):
    """Many rows of one time in one slice: several files, in time order, and a stream reads them all."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 if i < 600 else t0 + dt.timedelta(minutes=i - 600)) for i in range(1000)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz").repartition(3)
    src = J.write_in_event_order(df, f"{tmp_dir}/in", "ts", 2, parts=4)
    files = sorted((os.stat(p).st_mtime, p) for p in glob.glob(f"{src}/part-*".removeprefix("file:")))
    read = [[r.ts for r in spark.read.parquet(p).collect()] for _, p in files]
    assert len(files) >= 6 and max(map(len, read)) < 400 and sum(map(len, read)) == 1001
    times = [t for part in read for t in sorted(t for t in part if t is not None)]
    assert times == sorted(times)
    J.st_transform(J.file_stream(spark, src, df.schema, files_per_trigger=5), lambda d: d, f"{tmp_dir}/out", f"{tmp_dir}/ck").awaitTermination()
    got = spark.read.parquet(f"{tmp_dir}/out")
    assert got.count() == 1001 and got.exceptAll(df).count() == 0


def test_streams_are_cut_for_many_tasks(spark, tmp_dir):
    """More files than slices, in time order; rows of one second share a file if asked."""
    from lakeline.plans.q_streams import _stream_of

    df = spark.range(4_000).select("id", F.timestamp_micros(F.lit(10**15) + F.col("id") * 90_000).cast("timestamp_ntz").alias("ts"))
    _stream_of(spark, df, f"{tmp_dir}/in", "ts", 1_000_000)
    rows = spark.read.parquet(f"{tmp_dir}/in").select("ts", F.col("_metadata.file_path").alias("file"))
    assert rows.count() == 4_000 and rows.select("file").distinct().count() >= 8
    second = rows.groupBy(F.date_trunc("second", "ts").alias("s")).agg(F.count_distinct("file").alias("files"))
    assert second.where("files > 1").count() == 0
