"""Registered lineage queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakeline.operators import lineage as L
from lakeline.plans.catalog import ORACLE as QUERY_ORACLES
from lakeline.plans.catalog import register
from lakeline.plans.fixtures import Fixtures
from lakeline.plans.oracle import sql
from lakeline.session import scratch_path


def jsonify(col):
    return F.to_json(col, {"ignoreNullFields": "false"})


@register("lin_job_runs", sql("""
SELECT j.namespace, j.name AS job_name, r.run_id, r.state, r.started_at, r.ended_at
FROM jobs j JOIN runs r ON r.job_id = j.id""", "jobs", "runs"))
def q_lin_job_runs(spark, sf):
    f = Fixtures(spark, sf)
    return L.lin_job_runs(f.jobs(), f.runs())


@register("lin_run", sql("""
, e AS (SELECT ed.run_id, ed.direction, d.namespace, d.name, d.source_uri AS uri
        FROM edges ed JOIN datasets d ON d.id = ed.dataset_id)
, p AS (SELECT *, (row_number() OVER (PARTITION BY run_id, direction ORDER BY namespace, name, uri) - 1) // 1000 AS page FROM e)
, g AS (SELECT run_id, page,
          to_json(coalesce(list({'namespace': namespace, 'name': name, 'uri': uri} ORDER BY namespace, name, uri)
                           FILTER (WHERE direction = 'INPUT'), [])) AS inputs,
          to_json(coalesce(list({'namespace': namespace, 'name': name, 'uri': uri} ORDER BY namespace, name, uri)
                           FILTER (WHERE direction = 'OUTPUT'), [])) AS outputs
        FROM p GROUP BY run_id, page)
SELECT r.run_id, j.namespace, j.name AS job_name, r.state, r.started_at, r.ended_at,
       coalesce(g.page, 0) AS page, coalesce(g.inputs, '[]') AS inputs, coalesce(g.outputs, '[]') AS outputs
FROM runs r JOIN jobs j ON j.id = r.job_id LEFT JOIN g ON g.run_id = r.run_id""".replace("\n, e AS", ", e AS", 1),
    "jobs", "runs", "datasets", "edges").replace(")\n, e AS", "),\ne AS"))
def q_lin_run(spark, sf):
    f = Fixtures(spark, sf)
    r = L.lin_run(f.runs(), f.jobs(), f.datasets(), f.edges())
    return r.withColumn("inputs", jsonify("inputs")).withColumn("outputs", jsonify("outputs"))


@register("lin_list_jobs", sql("""
SELECT j.id, j.namespace, j.name, j.created_at, count(r.run_id) AS run_count
FROM jobs j LEFT JOIN runs r ON r.job_id = j.id GROUP BY j.id, j.namespace, j.name, j.created_at""",
    "jobs", "runs"))
def q_lin_list_jobs(spark, sf):
    f = Fixtures(spark, sf)
    return L.lin_list_jobs(f.jobs(), f.runs())


@register("lin_list_datasets", sql("""
SELECT d.id, d.namespace, d.name, d.source_uri, count(DISTINCT e.run_id) AS run_count,
       max(CASE WHEN e.direction = 'INPUT' THEN e.created_at END) AS last_input,
       max(CASE WHEN e.direction = 'OUTPUT' THEN e.created_at END) AS last_output
FROM datasets d LEFT JOIN edges e ON e.dataset_id = d.id
GROUP BY d.id, d.namespace, d.name, d.source_uri""", "datasets", "edges"))
def q_lin_list_datasets(spark, sf):
    f = Fixtures(spark, sf)
    return L.lin_list_datasets(f.datasets(), f.edges())


@register("lin_dataset_uses", sql("""
SELECT d.namespace AS dataset_namespace, d.name AS dataset_name,
       CASE WHEN e.direction = 'INPUT' THEN 'consumed_by' ELSE 'produced_by' END AS relation,
       j.namespace AS job_namespace, j.name AS job_name, r.run_id, r.state, e.created_at
FROM edges e JOIN datasets d ON d.id = e.dataset_id JOIN runs r ON r.run_id = e.run_id
JOIN jobs j ON j.id = r.job_id""", "jobs", "runs", "datasets", "edges"))
def q_lin_dataset_uses(spark, sf):
    f = Fixtures(spark, sf)
    return L.lin_dataset_uses(f.datasets(), f.edges(), f.runs(), f.jobs())


@register("lin_stats", sql("""
SELECT (SELECT count(*) FROM jobs) AS total_jobs, (SELECT count(*) FROM runs) AS total_runs,
       (SELECT count(*) FROM datasets) AS total_datasets,
       (SELECT count(*) + count(ended_at) FROM runs) AS total_events,
       (SELECT count(*) FROM runs WHERE state NOT IN ('COMPLETE', 'FAIL', 'ABORT')) AS active_runs,
       (SELECT count(*) FROM runs WHERE state = 'RUNNING') AS active_runs_literal""",
    "jobs", "runs", "datasets", "edges"))
def q_lin_stats(spark, sf):
    f = Fixtures(spark, sf)
    started, ended = f.runs().select("run_id"), f.runs().filter(F.col("ended_at").isNotNull()).select("run_id")
    return L.lin_stats(f.jobs(), f.runs(), f.datasets(), started.unionAll(ended))


@register("lin_complete_view", sql("""
SELECT j.namespace AS job_namespace, j.name AS job_name, r.run_id, r.started_at, r.ended_at,
       d.namespace AS dataset_namespace, d.name AS dataset_name, e.direction
FROM runs r JOIN jobs j ON j.id = r.job_id JOIN edges e ON e.run_id = r.run_id
JOIN datasets d ON d.id = e.dataset_id WHERE r.state = 'COMPLETE'""", "jobs", "runs", "datasets", "edges"))
def q_lin_complete_view(spark, sf):
    f = Fixtures(spark, sf)
    return L.lin_complete_view(f.jobs(), f.runs(), f.edges(), f.datasets())


@register("lin_run_datasets", sql("""
SELECT e.run_id, e.dataset_id, d.namespace, d.name, d.source_uri AS uri, e.direction,
       starts_with(d.source_uri, 'lake://tables/') AS is_table
FROM edges e JOIN datasets d ON d.id = e.dataset_id""", "datasets", "edges"))
def q_lin_run_datasets(spark, sf):
    f = Fixtures(spark, sf)
    return L.lin_run_datasets(f.edges(), f.datasets())


@register("lin_event_counts", sql("""
SELECT queue_name AS event_type, CASE WHEN read_ct > 1 THEN 'retried' ELSE 'ok' END AS status,
       count(*) AS n,
       sum(epoch_us(archived_at) - epoch_us(enqueued_at)) / count(*) / 1e6 AS avg_secs,
       min(epoch_us(archived_at) - epoch_us(enqueued_at)) / 1e6 AS min_secs,
       max(epoch_us(archived_at) - epoch_us(enqueued_at)) / 1e6 AS max_secs
FROM messages GROUP BY 1, 2""", "messages"))
def q_lin_event_counts(spark, sf):
    return L.lin_event_counts(Fixtures(spark, sf).messages())


@register("lin_nested_json", sql("""
, p AS (SELECT job_id, run_id, state, started_at,
          (row_number() OVER (PARTITION BY job_id ORDER BY started_at DESC, run_id DESC) - 1) // 1000 AS page
        FROM runs)
, g AS (SELECT job_id, page,
          list({'started_at': strftime(started_at, '%Y-%m-%d %H:%M:%S'), 'run_id': run_id, 'state': state}
               ORDER BY started_at DESC, run_id DESC) AS runs
        FROM p GROUP BY job_id, page)
SELECT j.id AS job_id, coalesce(g.page, 0) AS page,
       to_json({'id': j.id, 'namespace': j.namespace, 'name': j.name, 'runs': coalesce(g.runs, [])}) AS doc
FROM jobs j LEFT JOIN g ON g.job_id = j.id""", "jobs", "runs").replace(")\n, p AS", "),\np AS"))
def q_lin_nested_json(spark, sf):
    f = Fixtures(spark, sf)
    return L.lin_nested_json(f.jobs(), f.runs())


# ------------------------------------------------------------------ on the ingested store
# The same queries over the store that event ingestion produces (events ->
# parse -> validate -> normalise -> store), not over the fixture views.

def _ingested_store(spark, sf):
    from lakeline.operators import lineage_events as E

    good, _ = E.split_valid(E.ol_validate(E.ol_parse(Fixtures(spark, sf).ol_events())))
    path = scratch_path(spark, f"lakeline-scratch/ingested-{uuid.uuid4().hex}")
    good.write.parquet(path)  # built and parsed once, not once a table of the store
    return E.lineage_store(spark.read.schema(good.schema).parquet(path))


@register("lin_list_datasets_ingested", sql("""
SELECT d.namespace, d.name, d.source_uri, count(DISTINCT e.run_id) AS run_count,
       max(CASE WHEN e.direction = 'INPUT' THEN r.ended_at END) AS last_input,
       max(CASE WHEN e.direction = 'OUTPUT' THEN r.ended_at END) AS last_output
FROM edges e JOIN runs r ON r.run_id = e.run_id JOIN datasets d ON d.id = e.dataset_id
WHERE r.ended_at IS NOT NULL GROUP BY 1, 2, 3""", "runs", "datasets", "edges"))
def q_lin_list_datasets_ingested(spark, sf):
    s = _ingested_store(spark, sf)
    return L.lin_list_datasets(s["datasets"], s["edges"]).drop("id")


@register("lin_stats_ingested", sql("""
SELECT (SELECT count(DISTINCT job_id) FROM runs) AS total_jobs, (SELECT count(*) FROM runs) AS total_runs,
       (SELECT count(DISTINCT e.dataset_id) FROM edges e JOIN runs r ON r.run_id = e.run_id
         WHERE r.ended_at IS NOT NULL) AS total_datasets,
       (SELECT count(*) + count(ended_at) FROM runs) AS total_events,
       (SELECT count(*) FROM runs WHERE ended_at IS NULL) AS active_runs,
       CAST(0 AS BIGINT) AS active_runs_literal""", "runs", "edges"))
def q_lin_stats_ingested(spark, sf):
    s = _ingested_store(spark, sf)
    return L.lin_stats(s["jobs"], s["runs"], s["datasets"], s["run_events"])


# ------------------------------------------------------------------ lookups of one run, job, dataset

def _first(df, order: str, *cols: str):
    """Scalars of the first row by ``order``: the lookup's arguments."""
    row = df.select(F.min_by(F.struct(*cols), order)).scalar()
    return [row.getField(c) for c in cols]


@register("lin_run_one", QUERY_ORACLES["lin_run"] + " WHERE r.run_id = (SELECT max(run_id) FROM runs WHERE ended_at IS NOT NULL)")
def q_lin_run_one(spark, sf):
    f = Fixtures(spark, sf)
    run = f.runs().filter(F.col("ended_at").isNotNull()).select(F.max("run_id")).scalar()
    r = L.lin_run(f.runs(), f.jobs(), f.datasets(), f.edges(), run_id=run)
    return r.withColumn("inputs", jsonify("inputs")).withColumn("outputs", jsonify("outputs"))


@register("lin_job_runs_one", QUERY_ORACLES["lin_job_runs"] + " WHERE j.id = (SELECT min(job_id) FROM runs)")
def q_lin_job_runs_one(spark, sf):
    f = Fixtures(spark, sf)
    job = f.runs().select(F.min("job_id").alias("id"))
    space, name = _first(f.jobs().join(job, "id"), "id", "namespace", "name")
    return L.lin_job_runs(f.jobs(), f.runs(), space, name)


@register("lin_dataset_uses_one", QUERY_ORACLES["lin_dataset_uses"] + " WHERE d.id = (SELECT min(dataset_id) FROM edges)")
def q_lin_dataset_uses_one(spark, sf):
    f = Fixtures(spark, sf)
    dataset = f.edges().select(F.min("dataset_id").alias("id"))
    space, name = _first(f.datasets().join(dataset, "id"), "id", "namespace", "name")
    return L.lin_dataset_uses(f.datasets(), f.edges(), f.runs(), f.jobs(), space, name)


@register("lin_run_paged", QUERY_ORACLES["lin_run"].replace("// 1000", "// 3"))
def q_lin_run_paged(spark, sf):
    """Pages smaller than the largest run."""
    f = Fixtures(spark, sf)
    r = L.lin_run(f.runs(), f.jobs(), f.datasets(), f.edges(), page_size=3)
    return r.withColumn("inputs", jsonify("inputs")).withColumn("outputs", jsonify("outputs"))


@register("lin_nested_json_paged", QUERY_ORACLES["lin_nested_json"].replace("// 1000", "// 4"))
def q_lin_nested_json_paged(spark, sf):
    f = Fixtures(spark, sf)
    return L.lin_nested_json(f.jobs(), f.runs(), page_size=4)
