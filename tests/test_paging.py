"""Lists of a run's datasets: short ones as arrays, long ones by a scan, with the same pages."""

import pytest
from pyspark.sql import functions as F

from lakeline.operators import lineage as L
from lakeline.operators import lineage_events as E
from lakeline.operators import nesting


def store(spark, rows):
    """(edges, datasets, runs, jobs): ``rows`` edges of run 1, three of run 2, none of run 3, one of a null run."""
    at = "timestamp_ntz'2024-01-01 00:00:00'"
    n = spark.range(rows).selectExpr("1L run_id", "id dataset_id", "if(id % 3 = 0, 'OUTPUT', 'INPUT') direction")
    n = n.unionAll(spark.sql("SELECT * FROM VALUES (2L, 1L, 'INPUT'), (2L, 2L, 'INPUT'), (2L, 2L, 'OUTPUT'), (NULL, 1L, 'INPUT')"))
    edges = n.withColumn("created_at", F.expr(at))
    datasets = spark.range(rows).selectExpr("id", "concat('n', id % 7) namespace", "concat('d', id) name", "if(id % 5 = 0, null, concat('u', id)) source_uri")
    runs = spark.sql(f"SELECT *, 'COMPLETE' state, {at} started_at, {at} ended_at FROM VALUES (1L, 1L), (2L, 1L), (3L, 1L) t(run_id, job_id)")
    jobs = spark.sql("SELECT 1L id, 'n' namespace, 'j' name")
    return edges, datasets, runs, jobs


def run_pages(spark, rows, page_size):
    edges, datasets, runs, jobs = store(spark, rows)
    got = L.lin_run(runs, jobs, datasets, edges, page_size).select("run_id", "page", F.to_json(F.struct("inputs", "outputs")).alias("lists"))
    return sorted(map(tuple, got.collect()))


def event_pages(spark, rows, page_size):
    edges, datasets, runs, _ = store(spark, rows)
    ended = runs.select("run_id", "ended_at", F.lit(True).alias("success"), F.lit("n").alias("namespace"), F.lit("j").alias("job_name"))
    rd = edges.join(datasets, edges.dataset_id == datasets.id).select("run_id", "direction", "namespace", "name", F.col("source_uri").alias("uri"))
    return sorted(map(tuple, E.ol_complete_event(ended, rd, page_size).collect()))


@pytest.mark.parametrize("pages", [run_pages, event_pages])
@pytest.mark.parametrize("page_size", [3, 1000])
def test_short_and_long_lists_agree(spark, monkeypatch, pages, page_size):
    short = pages(spark, 300, page_size)
    everything = nesting.by_length.__defaults__
    monkeypatch.setattr(nesting.by_length, "__defaults__", (0,))  # every key that is counted is long
    assert everything == (nesting.SHORT,)
    assert pages(spark, 300, page_size) == short
    assert len(short) > (60 if page_size == 3 else 2)


def test_long_keys_are_told_and_no_row_is_lost(spark):
    rows = spark.range(40_000).selectExpr("if(id < 30000, 1L, if(id < 30010, null, id)) k", "id v")
    short, long = nesting.by_length(rows, ["k"])
    assert [r.k for r in long.select("k").distinct().collect()] == [1]
    assert long.count() == 30_000 and short.count() == 10_000
    assert short.filter("k is null").count() == 10


def test_short_lists_need_no_scan(spark):
    """No window is left when all runs are short: rows are not ranked, sampled or totalled."""
    edges, datasets, runs, jobs = store(spark, 300)
    df = L.lin_run(runs, jobs, datasets, edges)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("Initial Plan")[0]
