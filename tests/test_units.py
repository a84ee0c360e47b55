"""Hand-written edge cases (FIXTURES.md section 4) on small DataFrames."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lakeline.functions import format_bytes
from lakeline.operators import access as A
from lakeline.operators import lineage_events as E
from lakeline.operators import monitoring as M
from lakeline.operators import patterns as P
from lakeline.operators import streams as S
from lakeline.sources import tables as TB

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def ts(sec):
    return T0 + dt.timedelta(seconds=sec)


def ev(seq, typ, t, run="00000000-0000-4000-8000-000000000001", inputs=None, outputs=None):

    d = {"eventType": typ, "eventTime": ts(t).isoformat(), "run": {"runId": run},
         "job": {"namespace": "ns", "name": "job"}}
    if inputs is not None:
        d["inputs"] = inputs
    if outputs is not None:
        d["outputs"] = outputs
    return (seq, ts(t), json.dumps(d))


def events_df(spark, rows):
    return spark.createDataFrame(rows, "seq long, ts timestamp_ntz, payload string")


def good(spark, rows):
    return E.split_valid(E.ol_validate(E.ol_parse(events_df(spark, rows))))


# ---------------------------------------------------------------- run state

def test_later_terminal_event_wins(spark):
    g, _ = good(spark, [ev(1, "START", 0), ev(2, "COMPLETE", 10), ev(3, "FAIL", 20)])
    r = E.ol_runs(g).first()
    assert r.state == "FAIL" and r.ended_at == ts(20) and r.started_at == ts(0)


def test_start_only_run_stays_open(spark):
    g, _ = good(spark, [ev(1, "START", 0)])
    r = E.ol_runs(g).first()
    assert r.state == "START" and r.ended_at is None


def test_terminal_before_start(spark):
    g, _ = good(spark, [ev(1, "COMPLETE", 0), ev(2, "START", 10)])
    r = E.ol_runs(g).first()
    assert r.state == "COMPLETE" and r.started_at == ts(0) and r.ended_at == ts(0)


def test_bad_events_are_dead_lettered(spark):
    rows = [
        (1, ts(0), '{"eventType": "START", "eventTime": '),
        (2, ts(0), '{"eventType":"START","eventTime":"2024-01-01T00:00:00","run":{},"job":{"namespace":"n","name":"j"}}'),
        (3, ts(0), '{"eventType":"START","eventTime":"2024-01-01T00:00:00","run":{"runId":"x1"},'
                   '"job":{"namespace":"n","name":"j"}}'),
        (4, ts(0), '{"eventType":"PAUSE","eventTime":"2024-01-01T00:00:00",'
                   '"run":{"runId":"00000000-0000-4000-8000-000000000009"},"job":{"namespace":"n","name":"j"}}'),
    ]
    g, bad = good(spark, rows)
    assert g.count() == 0
    errs = {r.msg_id: r.error for r in bad.collect()}
    assert errs == {1: "malformed JSON", 2: "missing run.runId", 3: "runId is not a UUID",
                    4: "unknown eventType: PAUSE"}


def test_edges_dedup_and_first_uri(spark):
    d1 = {"namespace": "n", "name": "a"}
    d1u = {"namespace": "n", "name": "a", "facets": {"dataSource": {"name": "n", "uri": "s3://a"}}}
    rows = [ev(1, "RUNNING", 0, inputs=[d1], outputs=[d1]),
            ev(2, "COMPLETE", 5, inputs=[d1u, d1u], outputs=[d1u])]
    g, _ = good(spark, rows)
    edges = E.ol_edges(g).collect()
    assert sorted((e.direction, e.name) for e in edges) == [("INPUT", "a"), ("OUTPUT", "a")]
    ds = E.ol_datasets(g).collect()
    assert len(ds) == 1 and ds[0].uri == ""  # first sighting had no URI


def test_merge_metadata_later_wins_artifacts_only_if_absent(spark):
    df = spark.range(1).select(
        F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")).alias("m"),
        F.create_map(F.lit("b"), F.lit("2")).alias("x"),
        F.create_map(F.lit("b"), F.lit("3"), F.lit("c"), F.lit("3")).alias("art"))
    m = df.select(E.ol_merge_metadata(F.col("m"), F.col("x"), F.col("art")).alias("r")).first().r
    assert m == {"a": "1", "b": "2", "c": "3"}


# ---------------------------------------------------------------- as-of join

def test_asof_equal_timestamps_match_and_early_trade_dropped(spark):
    trades = spark.createDataFrame([(1, 7, ts(10)), (2, 7, ts(0)), (3, 7, ts(25))],
                                   "trade_id long, symbol long, ts timestamp_ntz")
    prices = spark.createDataFrame([(7, ts(10), 1.5), (7, ts(20), 2.5)], "symbol long, ts timestamp_ntz, price double")
    out = {r.trade_id: r.price for r in P.join_asof(trades, prices, ["symbol"], "ts", "ts", ["price"], "trade_id")
           .collect()}
    assert out == {1: 1.5, 3: 2.5}


# ---------------------------------------------------------------- memory

def samples(spark, n):
    return spark.createDataFrame([(1, ts(i), i, 1000 + i * 10) for i in range(n)],
                                 "component long, ts timestamp_ntz, event_id long, rss long")


@pytest.mark.parametrize("n,growth", [(1, 0.0), (2, 10.0)])
def test_growth_rate(spark, n, growth):
    assert M.mon_mem_stats(samples(spark, n)).first().growth_per_sec == growth


def test_growth_rate_empty(spark):
    assert M.mon_mem_stats(samples(spark, 1).limit(0)).count() == 0


def test_leak_needs_ten_samples(spark):
    assert M.mon_mem_leak(samples(spark, 9), 50).count() == 0
    assert M.mon_mem_leak(samples(spark, 10), 50).count() == 1


# ---------------------------------------------------------------- windows

def test_rolling_mean_null_until_seven_and_dense_rank_ties(spark):
    df = spark.createDataFrame([(1, i, 100 * (i + 1)) for i in range(8)], "k long, t long, v long")
    r = {x.t: x.rolling_mean for x in P.win_rolling_mean(df, ["k"], ["t"], "v", 7).collect()}
    assert all(r[i] is None for i in range(6))
    assert r[6] == 4.0 and r[7] == 5.0
    d = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 3.0), (2, 1.0)], "k long, v double")
    ranks = sorted((x.k, x.v, x.dense_rank) for x in P.win_dense_rank(d, ["k"], "v").collect())
    assert ranks == [(1, 3.0, 2), (1, 5.0, 1), (1, 5.0, 1), (2, 1.0, 1)]


# ---------------------------------------------------------------- upsert

def test_upsert_null_overwrites_unmatched_kept_empty_noop(spark):
    target = spark.createDataFrame([(1, "a", 10.0), (2, "b", 20.0)], "id long, s string, v double")
    source = spark.createDataFrame([(2, "B", None), (3, "c", 30.0)], "id long, s string, v double")
    out = sorted(tuple(r) for r in TB.tbl_merge_upsert(target, source, ["id"]).collect())
    assert out == [(1, "a", 10.0), (2, "B", None), (3, "c", 30.0)]
    empty = source.limit(0)
    assert sorted(tuple(r) for r in TB.tbl_merge_upsert(target, empty, ["id"]).collect()) == \
        sorted(tuple(r) for r in target.collect())
    twice = TB.tbl_merge_upsert(TB.tbl_merge_upsert(target, source, ["id"]), source, ["id"])
    assert sorted(tuple(r) for r in twice.collect()) == out  # replay-safe


# ---------------------------------------------------------------- formats, health, tenant

def test_byte_format(spark):
    vals = [0, 1023, 1024, 1536, 1024 ** 4]
    df = spark.createDataFrame([(v,) for v in vals], "b long")
    got = [r.f for r in df.select(format_bytes("b").alias("f")).collect()]
    assert got == ["0 Bytes", "1023 Bytes", "1 KB", "1.5 KB", "1 TB"]


def test_health_rollup(spark):
    rows = [("g1", "healthy"), ("g1", "healthy"), ("g2", "healthy"), ("g2", "warning"),
            ("g3", "error"), ("g3", "warning")]
    df = spark.createDataFrame(rows, "g string, status string")
    got = {r.g: r.overall for r in M.mon_health(df, ["g"]).collect()}
    assert got == {"g1": "healthy", "g2": "warning", "g3": "unhealthy"}


def test_tenant_unset_sees_nothing(spark):
    df = spark.createDataFrame([(1, "x")], "id long, tenant string")
    assert A.secured(df, None).count() == 0
    assert A.secured(df, "x").count() == 1


def test_subscription_defaults_and_unknown_names(spark):
    c = spark.createDataFrame([(1, ""), (2, " error , bogus"), (3, None)], "client_id long, events string")
    got = sorted((r.client_id, r.event_type) for r in S.ev_subscribe(c).collect())
    assert (2, "error") in got and not any(t == "bogus" for _, t in got)
    assert sorted(t for cid, t in got if cid == 1) == sorted(S.DEFAULT_SUBSCRIPTION)
    assert sorted(t for cid, t in got if cid == 3) == sorted(S.DEFAULT_SUBSCRIPTION)


def test_liveness_first_rule_wins(spark):
    rows = [(1, ts(0), 1, "connect"), (1, ts(1), 2, "ping"), (1, ts(2), 3, "ping"), (1, ts(3), 4, "ping"),
            (1, ts(4), 5, "ping"), (2, ts(0), 6, "connect"), (2, ts(4), 7, "ping"), (2, ts(5), 8, "pong"),
            (3, ts(0), 9, "connect"), (3, ts(300), 10, "pong"),
            (4, ts(250), 11, "connect"), (4, ts(290), 12, "ping"), (4, ts(295), 13, "pong")]
    p = spark.createDataFrame(rows, "client_id long, ts timestamp_ntz, event_id long, kind string")
    got = {r.client_id: r.reason for r in S.ev_liveness(p).collect()}
    # client 1: 4 pings without pong (missed > 3) but silent for 296 s -> timeout first;
    # client 3 was never pinged since connecting 300 s ago (last ping = connect time)
    assert got == {1: "ping_timeout", 2: "ping_timeout", 3: "ping_timeout", 4: None}
    got2 = {r.client_id: r.reason for r in S.ev_liveness(p, asof=F.lit(ts(100)).cast("timestamp_ntz")).collect()}
    assert got2[1] == "missed_pings"


def test_steps_name_the_failing_one(spark):
    with pytest.raises(Exception) as e:
        P.apply_steps(spark.range(3), [("keep_id", lambda d: d.select("id")), ("broken", lambda d: d.select("nope"))])
    assert e.value.__notes__ == ["in step 'broken'"]
    assert P.apply_steps(spark.range(3), [("half", lambda d: d.filter("id < 2"))]).count() == 2


def test_bad_times_and_dataset_forms(spark):
    job = '"job":{"namespace":"n","name":"j"}'
    rows = [(1, ts(0), f'{{"eventType":"START","eventTime":"not-a-date","run":{{"runId":"{"0" * 32}"}},{job}}}'),
            (2, ts(0), f'{{"eventType":"START","eventTime":"2024-01-01T00:00:00.5Z","run":{{"runId":"{"0" * 31}A"}},{job},"inputs":["a",{{"name":"b","uri":"s3://b"}}]}}')]
    g, bad = good(spark, rows)
    assert [(r.msg_id, r.error) for r in bad.collect()] == [(1, "eventTime is not a time")]
    assert sorted((r.namespace, r.name, r.uri) for r in E.ol_datasets(g).collect()) == [("lake", "a", "lake://tables/a"), ("lake", "b", "s3://b")]
    assert g.first().run_id == "00000000-0000-0000-0000-00000000000a"


def test_bad_log_times_do_not_stop_a_job(spark):
    from lakeline.operators import logs

    lines = spark.createDataFrame([("postgresql", 1, "2024-13-45 00:00:00.000 UTC [1] LOG: x"), ("backend", 2, '{"timestamp":"2024-01-01T00:00:00Z","level":"INFO"}'),
                                   ("backend", 3, '{"timestamp":"soon"}')], "container string, event_id long, line string")
    assert {r.event_id: r.log_ts for r in logs.log_route(lines).collect()} == {1: None, 2: ts(0), 3: None}


def test_rate_limit_counts_requests_before(spark):
    r = spark.createDataFrame([(1, 1, ts(0)), (2, 1, ts(1)), (3, 1, ts(2)), (4, 1, ts(60)), (5, None, ts(0)), (6, 1, None)], "rid int, u int, t timestamp_ntz")
    got = {x.rid: (x.in_window, x.over_limit) for x in M.mon_rate_limit(r, "u", "t", "rid", 60, 2).collect()}
    assert got == {1: (0, False), 2: (1, False), 3: (2, True), 4: (2, True), 5: (0, False)}


def test_never_pinged_client_is_no_zombie(spark):
    p = spark.createDataFrame([(1, ts(0), 1, "connect"), (2, ts(100), 2, "connect")], "client_id long, ts timestamp_ntz, event_id long, kind string")
    assert {r.client_id: r.reason for r in S.ev_liveness(p).collect()} == {1: None, 2: None}


def test_envelope_keeps_any_data(spark):
    rows = [(1, '{"s":"x","n":1,"o":{"a":[1]}}'), (2, "plain \"text\""), (3, None)]
    df = spark.createDataFrame(rows, "event_id int, data string").withColumn("event_type", F.lit("e")).withColumn("timestamp", F.lit(ts(0)))
    data = {r.event_id: json.loads(r.frame.split("data: ")[1])["data"] for r in S.ev_envelope(df).collect()}
    assert data == {1: {"s": "x", "n": 1, "o": {"a": [1]}}, 2: 'plain "text"', 3: None}


def test_asof_carries_whole_rows_and_skips_null_keys(spark):
    trades = spark.createDataFrame([(1, "a", ts(9)), (2, None, ts(9))], "trade_id long, symbol string, ts timestamp_ntz")
    prices = spark.createDataFrame([("a", ts(0), 1.0), ("a", ts(5), None), (None, ts(0), 2.0)], "symbol string, ts timestamp_ntz, price double")
    out = P.join_asof(trades, prices, ["symbol"], "ts", "ts", ["price"], "trade_id").collect()
    assert [(r.trade_id, r.price, r.ts_matched) for r in out] == [(1, None, ts(5))]


def test_null_keys_are_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 5), (None, 7), (None, None)], "k string, v int")
    assert sorted((str(r.k), str(r.v), r.dense_rank) for r in P.win_dense_rank(df, ["k"], "v").collect()) == [
        ("None", "5", 2), ("None", "7", 1), ("None", "None", 3), ("a", "1", 2), ("a", "2", 1)]
    assert P.win_first_value_ratio(df, ["k"], "v", "v").count() == 5
    lists = {(r.k, r.page): list(r["items"]) for r in P.rs_list_agg(df.dropna(subset=["v"]), ["k"], ["v"], F.col("v"), page_size=1).collect()}
    assert lists == {("a", 0): [1], ("a", 1): [2], (None, 0): [5], (None, 1): [7]}


def test_pivot_rejects_unknown_values(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y")], "k int, p string")
    assert P.rs_pivot(df.filter("p = 'x'"), ["k"], "p", {"x": "nx"}, F.count(F.lit(1))).first().nx == 1
    with pytest.raises(Exception, match="not in the list: y"):
        P.rs_pivot(df, ["k"], "p", {"x": "nx"}, F.count(F.lit(1))).collect()


def test_role_closure_terminates_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "member string, parent string")
    c = {(r.role, r.anc) for r in A.role_closure(edges).collect()}
    assert ("d", "c") in c and ("a", "a") in c and len(c) == 4 * 3 + 1  # a,b,c reach each other; d reaches all


def test_fanout_pairs_match_counts(spark):
    ev = spark.createDataFrame([(1, "error", ts(0)), (2, "job_status", ts(1)), (3, "error", ts(2))],
                               "event_id long, event_type string, timestamp timestamp_ntz")
    subs = spark.createDataFrame([(10, "error"), (11, "error"), (11, "job_status")], "client_id long, event_type string")
    pairs = S.ev_fanout_pairs(ev, subs).groupBy("client_id").count()
    counts = S.ev_fanout_counts(ev, subs).select("client_id", F.col("deliveries").alias("count"))
    assert sorted(tuple(r) for r in pairs.collect()) == sorted(tuple(r) for r in counts.collect()) == [(10, 2), (11, 3)]
    zombies = spark.createDataFrame([(11,)], "client_id long")
    assert [r.client_id for r in S.ev_fanout_counts(ev, subs, zombies=zombies).collect()] == [10]


def test_throughput_is_lazy_and_spans_an_outlying_time(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(seconds=s), 200 if i % 3 else 500, 0.25) for i, s in enumerate([0, 3, 3, 9, 10, 65, 200])]
    rows += [(90, day + dt.timedelta(days=30, seconds=5), 200, 1.0), (91, None, 200, 9.0)]
    r = spark.createDataFrame(rows, "request_id long, start_time timestamp_ntz, status_code int, duration double")
    M.mon_throughput(r.withColumn("start_time", F.raise_error("run").cast("timestamp_ntz")))  # builds, runs nothing
    got = M.mon_throughput(r)
    n = 30 * 8640 + 6
    assert got.count() == n and got.select("window_start").distinct().count() == n
    busy = {x.window_start: (x.requests, x.error_rate) for x in got.where("requests > 0").collect()}
    want = {}
    for k in [*range(-5, 21), *range(30 * 8640 - 5, 30 * 8640 + 1)]:
        lo = day + dt.timedelta(seconds=10 * k)
        inside = [c for _, t, c, _ in rows if t is not None and lo <= t < lo + dt.timedelta(seconds=60)]
        if inside:
            want[lo] = (len(inside), sum(c >= 400 for c in inside) / len(inside))
    assert busy == want
    assert M.mon_throughput(r.limit(0)).count() == 0
