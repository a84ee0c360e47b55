"""Lineage queries over the normalised store (jobs, runs, datasets, edges).

Tables: jobs(id, namespace, name, created_at); runs(run_id, job_id, state,
started_at, ended_at); datasets(id, namespace, name, source_uri);
edges(run_id, dataset_id, direction, created_at).

Joins are plain equi-joins: AQE turns them into broadcast joins when the
runtime size of a side is under ``spark.sql.autoBroadcastJoinThreshold`` and
into skew-split sort-merge joins otherwise, so no side is broadcast on faith.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeline.operators.nesting import DEFAULT_PAGE_SIZE, by_length, page_numbers, page_of, paged_lists

TERMINAL = ("COMPLETE", "FAIL", "ABORT")


def lin_job_runs(jobs: DataFrame, runs: DataFrame, namespace: str | None = None,
                 name: str | None = None) -> DataFrame:
    """Runs of a job (or of every job), newest first within a job."""
    j = jobs
    if namespace is not None:
        j = j.filter(F.col("namespace") == namespace)
    if name is not None:
        j = j.filter(F.col("name") == name)
    out = j.join(runs, runs.job_id == j.id).select(
        j.namespace, j.name.alias("job_name"), runs.run_id, runs.state, runs.started_at, runs.ended_at)
    if namespace is not None or name is not None:  # one job: newest first (distributed sort)
        out = out.orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    return out


def _edge_datasets(edges: DataFrame, datasets: DataFrame) -> DataFrame:
    return edges.join(datasets, edges.dataset_id == datasets.id).select(
        edges.run_id, edges.dataset_id, edges.direction, edges.created_at,
        datasets.namespace, datasets.name, datasets.source_uri.alias("uri"))


def _short_run_pages(rows: DataFrame, page_size: int) -> DataFrame:
    """(run_id, page, inputs, outputs) of runs whose edges fit one array; each direction has its own pages."""
    ds = F.struct("namespace", "name", "uri")

    def side(direction: str) -> Column:
        return F.transform(F.filter("all", lambda x: x["direction"] == direction), lambda x: x["ds"])

    lists = rows.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("direction", ds.alias("ds")))).alias("all"))
    lists = lists.select("run_id", side("INPUT").alias("ins"), side("OUTPUT").alias("outs"))
    longer = F.greatest(F.size("ins"), F.size("outs"))
    lists = lists.select("*", F.explode(page_numbers(longer, page_size)).alias("page"))
    return lists.select("run_id", "page", *[page_of(F.col(c), F.col("page"), page_size).alias(n)
                                            for c, n in (("ins", "inputs"), ("outs", "outputs"))])


def _long_run_pages(rows: DataFrame, page_size: int) -> DataFrame:
    """As ``_short_run_pages`` for runs of any number of edges, by a scan over their rows."""
    pages = paged_lists(rows, ["run_id", "direction"], ["namespace", "name", "uri"],
                        {"items": F.struct("namespace", "name", "uri")}, page_size)
    return pages.groupBy("run_id", "page").agg(
        F.max(F.when(F.col("direction") == "INPUT", F.col("items"))).alias("inputs"),
        F.max(F.when(F.col("direction") == "OUTPUT", F.col("items"))).alias("outputs"))


def lin_run(runs: DataFrame, jobs: DataFrame, datasets: DataFrame, edges: DataFrame,
            page_size: int = DEFAULT_PAGE_SIZE, run_id=None) -> DataFrame:
    """Run detail (of one run, or of every run) with ordered ``inputs``/``outputs`` arrays of {namespace, name, uri}.

    Arrays are paged (``page``) so one run with a huge fan-in never becomes a
    single unbounded row; runs without edges keep one row with empty arrays.
    """
    if run_id is not None:  # reaches both scans
        runs, edges = runs.filter(F.col("run_id") == run_id), edges.filter(F.col("run_id") == run_id)
    ed = _edge_datasets(edges, datasets)
    short, long = by_length(ed.select("run_id", "direction", "namespace", "name", "uri"), ["run_id"])
    pages = _short_run_pages(short, page_size).unionByName(_long_run_pages(long, page_size))
    base = runs.join(jobs, runs.job_id == jobs.id).select(
        runs.run_id, jobs.namespace, jobs.name.alias("job_name"), runs.state, runs.started_at, runs.ended_at)
    empty = F.array().cast("array<struct<namespace:string,name:string,uri:string>>")
    out = base.join(pages, "run_id", "left").select(
        "run_id", "namespace", "job_name", "state", "started_at", "ended_at",
        F.coalesce(F.col("page"), F.lit(0).cast("long")).alias("page"),
        F.coalesce(F.col("inputs"), empty).alias("inputs"),
        F.coalesce(F.col("outputs"), empty).alias("outputs"))
    return out


def lin_list_jobs(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Every job with its number of runs (jobs without runs keep 0)."""
    per_job = runs.groupBy("job_id").agg(F.count("run_id").alias("run_count"))
    return jobs.join(per_job, jobs.id == per_job.job_id, "left").select(
        jobs.id, jobs.namespace, jobs.name, jobs.created_at,
        F.coalesce(per_job.run_count, F.lit(0)).alias("run_count"))


def lin_list_datasets(datasets: DataFrame, edges: DataFrame) -> DataFrame:
    """Datasets with distinct runs touching them and last input/output edge time.

    Edges are aggregated per dataset first (partial aggregation before the
    shuffle), then joined to the dimension; datasets with no edge keep 0.
    """
    per_ds = edges.groupBy("dataset_id").agg(
        F.count_distinct("run_id").alias("run_count"),
        F.max(F.when(F.col("direction") == "INPUT", F.col("created_at"))).alias("last_input"),
        F.max(F.when(F.col("direction") == "OUTPUT", F.col("created_at"))).alias("last_output"))
    return datasets.join(per_ds, datasets.id == per_ds.dataset_id, "left").select(
        datasets.id, datasets.namespace, datasets.name, datasets.source_uri,
        F.coalesce(per_ds.run_count, F.lit(0)).alias("run_count"),
        per_ds.last_input, per_ds.last_output)


def lin_dataset_uses(datasets: DataFrame, edges: DataFrame, runs: DataFrame, jobs: DataFrame,
                     namespace: str | None = None, name: str | None = None) -> DataFrame:
    """Who consumed / produced each dataset (or one dataset), newest edge first."""
    d = datasets
    if namespace is not None:
        d = d.filter(F.col("namespace") == namespace)
    if name is not None:
        d = d.filter(F.col("name") == name)
    e = edges.join(d, edges.dataset_id == d.id).select(
        d.namespace.alias("dataset_namespace"), d.name.alias("dataset_name"),
        edges.run_id, edges.direction, edges.created_at)
    rj = runs.join(jobs, runs.job_id == jobs.id).select(
        runs.run_id, runs.state, jobs.namespace.alias("job_namespace"), jobs.name.alias("job_name"))
    out = e.join(rj, "run_id").select(
        "dataset_namespace", "dataset_name",
        F.when(F.col("direction") == "INPUT", "consumed_by").otherwise("produced_by").alias("relation"),
        "job_namespace", "job_name", "run_id", "state", "created_at")
    if namespace is not None or name is not None:  # one dataset: newest edge first
        out = out.orderBy(F.col("created_at").desc(), F.col("run_id").desc())
    return out


def lin_stats(jobs: DataFrame, runs: DataFrame, datasets: DataFrame, run_events: DataFrame) -> DataFrame:
    """Totals of jobs/runs/datasets/run events and active runs, as one row.

    Each total is an independent global aggregate evaluated as a scalar
    subquery (partial counts per task, one row each), not a cross join.
    ``active_runs`` counts non-terminal runs; ``active_runs_literal`` counts
    state = 'RUNNING' exactly.
    """
    spark = jobs.sparkSession

    def cnt(df):
        return df.select(F.count(F.lit(1))).scalar()

    # One pass over runs for its three counts (a struct-valued scalar subquery).
    r = runs.select(F.struct(
        F.count(F.lit(1)).alias("total"),
        F.sum((~F.col("state").isin(*TERMINAL)).cast("long")).alias("active"),
        F.sum((F.col("state") == "RUNNING").cast("long")).alias("literal"))).scalar()
    return spark.range(1).select(
        cnt(jobs).alias("total_jobs"),
        r.getField("total").alias("total_runs"),
        cnt(datasets).alias("total_datasets"),
        cnt(run_events).alias("total_events"),
        F.coalesce(r.getField("active"), F.lit(0)).alias("active_runs"),
        F.coalesce(r.getField("literal"), F.lit(0)).alias("active_runs_literal"))


def lin_complete_view(jobs: DataFrame, runs: DataFrame, edges: DataFrame, datasets: DataFrame) -> DataFrame:
    """Lineage of completed runs: job, run, dataset, direction."""
    r = runs.filter(F.col("state") == "COMPLETE")
    return (r.join(jobs, r.job_id == jobs.id)
            .join(edges, edges.run_id == r.run_id)
            .join(datasets, datasets.id == edges.dataset_id)
            .select(jobs.namespace.alias("job_namespace"), jobs.name.alias("job_name"),
                    r.run_id, r.started_at, r.ended_at,
                    datasets.namespace.alias("dataset_namespace"), datasets.name.alias("dataset_name"),
                    edges.direction))


def lin_run_datasets(edges: DataFrame, datasets: DataFrame, table_prefix: str = "lake://tables/") -> DataFrame:
    """Datasets of each run, flagged as tables when the URI has the table prefix."""
    ed = _edge_datasets(edges, datasets)
    return ed.select("run_id", "dataset_id", "namespace", "name", "uri", "direction",
                     F.col("uri").startswith(table_prefix).alias("is_table"))


def lin_event_counts(messages: DataFrame) -> DataFrame:
    """Counts per (event_type, status) with avg/min/max processing seconds.

    event_type = queue, status = 'retried' when read more than once.
    """
    us = (F.unix_micros(F.col("archived_at").cast("timestamp"))
          - F.unix_micros(F.col("enqueued_at").cast("timestamp")))
    m = messages.select(F.col("queue_name").alias("event_type"),
                        F.when(F.col("read_ct") > 1, "retried").otherwise("ok").alias("status"),
                        us.alias("us"))
    return m.groupBy("event_type", "status").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum("us") / F.count("us") / 1e6).alias("avg_secs"),  # exact integer sum, one division
        (F.min("us") / 1e6).alias("min_secs"),
        (F.max("us") / 1e6).alias("max_secs"))


def lin_nested_json(jobs: DataFrame, runs: DataFrame, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One JSON document per job (per page of runs), runs newest first.

    Jobs without runs keep a document with an empty ``runs`` list.
    """
    started = F.date_format("started_at", "yyyy-MM-dd HH:mm:ss")
    r = runs.select("job_id", "run_id", "state", "started_at")
    child = F.struct(started.alias("started_at"), F.col("run_id"), F.col("state"))
    pages = paged_lists(r, ["job_id"],
                        [-F.unix_micros(F.col("started_at").cast("timestamp")), -F.col("run_id")],
                        {"runs": child}, page_size, descending=True)
    empty = F.array().cast("array<struct<started_at:string,run_id:bigint,state:string>>")
    j = jobs.join(pages, jobs.id == pages.job_id, "left")
    doc = F.to_json(F.struct(jobs.id.alias("id"), jobs.namespace.alias("namespace"), jobs.name.alias("name"),
                             F.coalesce(F.col("runs"), empty).alias("runs")))
    return j.select(jobs.id.alias("job_id"), F.coalesce(F.col("page"), F.lit(0).cast("long")).alias("page"),
                    doc.alias("doc"))
