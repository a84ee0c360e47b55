"""Plan properties that matter at scale, read from ``explain`` output."""
import contextlib
import io
import re

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

QUERIES = {k: f for k, f in entry.queries().items() if not re.match(r"op\d+_|pipeline$", k)}
BATCH_KEYS = sorted(k for k in QUERIES if not (k.endswith("_stream") or k == "st_ingest"))


def plan(df, mode="formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.mark.parametrize("key", BATCH_KEYS)
def test_no_cartesian_or_nested_loop_join(spark, key):
    p = plan(QUERIES[key](spark, SF_SMALL), "simple")
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_filter_and_projection_reach_the_scan(spark):
    p = plan(QUERIES["src_parquet"](spark, SF_SMALL))
    assert "EqualTo(o_orderstatus,F)" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double>" in p


def test_aggregation_is_partial_before_shuffle(spark):
    p = plan(QUERIES["lin_list_datasets"](spark, SF_SMALL))
    assert "partial_max" in p and "partial_count" in p


@pytest.mark.parametrize("key,key_col", [("win_running_sum", "o_custkey"), ("win_lag_diff", "user_id"),
                                         ("join_asof", "symbol"), ("mon_rate_limit", "client_id"),
                                         ("win_rolling_mean", "user_id"), ("mon_mem_leak", "component")])
def test_no_per_key_window_on_hot_key_paths(spark, key, key_col):
    """Windows are per (key, chunk), or per key over the chunks' totals in chunk order."""
    p = plan(QUERIES[key](spark, SF_SMALL), "simple")
    specs = re.findall(rf"windowspecdefinition\({key_col}#\d+L?, (\w+)#", p)
    assert set(specs) <= {"__chunk"}
    assert not re.search(rf"windowspecdefinition\({key_col}#\d+L?, (?!__chunk)", p)


def test_fanout_broadcasts_only_the_bounded_side(spark):
    p = plan(QUERIES["ev_fanout"](spark, SF_SMALL), "simple")
    assert "BroadcastExchange" in p


def test_scan_moves_rows_once_and_is_lazy(spark):
    """A running aggregate shuffles the rows by (key, chunk) once; the other exchanges
    carry per-chunk totals, aggregated before they move.  Nothing runs while it is built."""
    from pyspark.sql import functions as F

    from lakeline.operators.scan import running

    bad = spark.range(10).select(F.col("id").alias("k"), F.raise_error(F.lit("ran")).cast("long").alias("t"))
    df = running(bad, ["k"], ["t"], {"s": ("sum", "k")})
    p = plan(df, "simple")
    assert "Join" not in p
    p = plan(QUERIES["win_running_sum"](spark, SF_SMALL), "simple")
    assert "Join" not in p and "ArrowPython" not in p and "MapInArrow" not in p
    assert "partial_sum" in p


def test_log_route_reads_the_log_once(spark):
    p = plan(QUERIES["log_route"](spark, SF_SMALL), "simple")
    assert p.count("FileScan") == 1


def test_zorder_ranks_come_from_a_sample(spark):
    """Row count and sample are subqueries; rows are read once and shuffled once by place."""
    p = plan(QUERIES["tbl_zorder"](spark, SF_SMALL), "simple")
    assert "Window" not in p and "Join" not in p and p.count("rangepartitioning") == p.count("REPARTITION_BY_NUM")


@pytest.mark.parametrize("key", ["lin_stats_ingested", "lin_list_datasets_ingested"])
def test_ingested_store_parses_events_once(spark, key):
    """The tables of the store are read from parsed events, not each from a parse of its own."""
    assert "from_json" not in plan(QUERIES[key](spark, SF_SMALL), "simple")
