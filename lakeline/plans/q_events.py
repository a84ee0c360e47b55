"""Registered OpenLineage ingest/normalisation queries.

The Spark side builds the event log from the fixture store, then parses,
validates and normalises it; the oracle states the expected store directly
from the source tables, so agreement is a full round-trip check.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeline.operators import lineage_events as E
from lakeline.plans.catalog import ORACLE as QUERY_ORACLES
from lakeline.plans.catalog import register
from lakeline.plans.fixtures import Fixtures
from lakeline.plans.oracle import sql

UUID_SQL = "'00000000-0000-4000-8000-' || lpad(lower(hex({k})), 12, '0')"
ISO_SQL = "strftime({t}, '%Y-%m-%dT%H:%M:%S.%f')"

PAGES_CTE = """
pg AS (SELECT DISTINCT e.run_id,
          (row_number() OVER (PARTITION BY e.run_id ORDER BY e.direction, d.namespace, d.name) - 1) // 1000 AS page
        FROM edges e JOIN datasets d ON d.id = e.dataset_id)"""

VALID_ROWS = f"""
SELECT r.run_id * 1048576 AS seq, {UUID_SQL.format(k='r.run_id')} AS run_id, 'START' AS event_type,
       r.started_at AS event_time, j.namespace AS job_namespace, j.name AS job_name, 0 AS n_inputs, 0 AS n_outputs
FROM runs r JOIN jobs j ON j.id = r.job_id
UNION ALL
SELECT r.run_id * 1048576 + 1 + coalesce(pg.page, 0), {UUID_SQL.format(k='r.run_id')},
       CASE WHEN r.state = 'COMPLETE' THEN 'COMPLETE' ELSE 'FAIL' END, r.ended_at, j.namespace, j.name,
       (SELECT count(*) FROM edges e WHERE e.run_id = r.run_id AND e.direction = 'INPUT'),
       (SELECT count(*) FROM edges e WHERE e.run_id = r.run_id AND e.direction = 'OUTPUT')
FROM runs r JOIN jobs j ON j.id = r.job_id LEFT JOIN pg ON pg.run_id = r.run_id
WHERE r.ended_at IS NOT NULL"""


def _events(spark, sf):
    return Fixtures(spark, sf).ol_events()


def _good(spark, sf):
    good, _ = E.split_valid(E.ol_validate(E.ol_parse(_events(spark, sf))))
    return good


@register("ol_parse", sql(f""", {PAGES_CTE.strip()}
, v AS ({VALID_ROWS})
SELECT seq, false AS corrupt, event_type, event_time, run_id, job_namespace, job_name, n_inputs, n_outputs FROM v
UNION ALL
SELECT -1 - event_id AS seq, (event_id // 100) % 5 = 0 AS corrupt,
       CASE (event_id // 100) % 5 WHEN 0 THEN NULL WHEN 3 THEN 'PAUSE' ELSE 'START' END,
       CASE WHEN (event_id // 100) % 5 NOT IN (0, 4) THEN CAST(strptime({ISO_SQL.format(t='ts')}, '%Y-%m-%dT%H:%M:%S.%f') AS TIMESTAMP) END,
       CASE (event_id // 100) % 5 WHEN 2 THEN 'run-' || event_id
            WHEN 1 THEN NULL WHEN 0 THEN NULL ELSE {UUID_SQL.format(k='event_id + 1000000000')} END,
       CASE WHEN (event_id // 100) % 5 <> 0 THEN 'bad' END,
       CASE WHEN (event_id // 100) % 5 <> 0 THEN 'bad_' || event_id END, 0, 0
FROM events WHERE event_id % 100 = 0""", "jobs", "runs", "datasets", "edges"))
def q_ol_parse(spark, sf):
    p = E.ol_parse(_events(spark, sf))
    return p.select("seq", "corrupt", "event_type", "event_time", "run_id", "job_namespace", "job_name",
                    F.size("inputs").alias("n_inputs"), F.size("outputs").alias("n_outputs"))


@register("ol_validate", sql(f""", {PAGES_CTE.strip()}
, v AS ({VALID_ROWS})
SELECT seq, true AS valid, CAST(NULL AS VARCHAR) AS error FROM v
UNION ALL
SELECT -1 - event_id, false,
       CASE (event_id // 100) % 5 WHEN 0 THEN 'malformed JSON' WHEN 1 THEN 'missing run.runId'
            WHEN 2 THEN 'runId is not a UUID' WHEN 4 THEN 'eventTime is not a time'
            ELSE 'unknown eventType: PAUSE' END
FROM events WHERE event_id % 100 = 0""", "jobs", "runs", "datasets", "edges"))
def q_ol_validate(spark, sf):
    return E.ol_validate(E.ol_parse(_events(spark, sf))).select("seq", "valid", "error")


@register("st_dlq", sql("""
SELECT -1 - event_id AS msg_id,
       CASE (event_id // 100) % 5 WHEN 0 THEN 'malformed JSON' WHEN 1 THEN 'missing run.runId'
            WHEN 2 THEN 'runId is not a UUID' WHEN 4 THEN 'eventTime is not a time'
            ELSE 'unknown eventType: PAUSE' END AS error,
       ts AS "timestamp"
FROM events WHERE event_id % 100 = 0"""))
def q_st_dlq(spark, sf):
    _, bad = E.split_valid(E.ol_validate(E.ol_parse(_events(spark, sf))))
    return bad.select("msg_id", "error", "timestamp")


@register("ol_start_event", sql(f"""
SELECT r.run_id * 1048576 AS seq, r.started_at AS ts,
  to_json({{'eventType': 'START', 'eventTime': {ISO_SQL.format(t='r.started_at')},
            'run': {{'runId': {UUID_SQL.format(k='r.run_id')}, 'facets': MAP {{}}}},
            'job': {{'namespace': j.namespace, 'name': j.name,
                     'facets': {{'documentation': {{'description': 'Lakeline job run'}}}}}},
            'inputs': [], 'outputs': [], 'producer': 'lakeline',
            'schemaURL': '{E.SCHEMA_URL}'}}) AS payload
FROM runs r JOIN jobs j ON j.id = r.job_id""", "jobs", "runs"))
def q_ol_start_event(spark, sf):
    f = Fixtures(spark, sf)
    runs, jobs = f.runs(), f.jobs()
    rj = runs.join(jobs, runs.job_id == jobs.id).select(
        runs.run_id, runs.started_at, jobs.namespace, jobs.name.alias("job_name"))
    return E.ol_start_event(rj)


@register("ol_complete_event", sql(f"""
, e AS (SELECT e.run_id, e.direction, d.namespace, d.name, d.source_uri AS uri,
          (row_number() OVER (PARTITION BY e.run_id ORDER BY e.direction, d.namespace, d.name) - 1) // 1000 AS page
        FROM edges e JOIN datasets d ON d.id = e.dataset_id)
, g AS (SELECT run_id, page,
          list({{'namespace': namespace, 'name': name, 'facets': {{'dataSource': {{'name': namespace, 'uri': uri}}}}}}
               ORDER BY namespace, name) FILTER (WHERE direction = 'INPUT') AS ins,
          list({{'namespace': namespace, 'name': name, 'facets': {{'dataSource': {{'name': namespace, 'uri': uri}}}}}}
               ORDER BY namespace, name) FILTER (WHERE direction = 'OUTPUT') AS outs
        FROM e GROUP BY run_id, page)
SELECT r.run_id * 1048576 + 1 + coalesce(g.page, 0) AS seq, r.ended_at AS ts,
  to_json({{'eventType': CASE WHEN r.state = 'COMPLETE' THEN 'COMPLETE' ELSE 'FAIL' END,
            'eventTime': {ISO_SQL.format(t='r.ended_at')},
            'run': {{'runId': {UUID_SQL.format(k='r.run_id')}}},
            'job': {{'namespace': j.namespace, 'name': j.name}},
            'inputs': coalesce(g.ins, []), 'outputs': coalesce(g.outs, []), 'producer': 'lakeline',
            'schemaURL': '{E.SCHEMA_URL}'}}) AS payload
FROM runs r JOIN jobs j ON j.id = r.job_id LEFT JOIN g ON g.run_id = r.run_id
WHERE r.ended_at IS NOT NULL""", "jobs", "runs", "datasets", "edges"))
def q_ol_complete_event(spark, sf):
    f = Fixtures(spark, sf)
    runs, jobs, ds, ed = f.runs(), f.jobs(), f.datasets(), f.edges()
    rj = runs.join(jobs, runs.job_id == jobs.id).filter(runs.ended_at.isNotNull()).select(
        runs.run_id, runs.ended_at, (runs.state == "COMPLETE").alias("success"),
        jobs.namespace, jobs.name.alias("job_name"))
    rd = ed.join(ds, ed.dataset_id == ds.id).select(
        ed.run_id, ed.direction, ds.namespace, ds.name, ds.source_uri.alias("uri"))
    return E.ol_complete_event(rj, rd)


@register("ol_dataset_facet", sql("""
SELECT id, to_json({'namespace': namespace, 'name': name,
  'facets': {'dataSource': {'name': namespace, 'uri': 'lake://tables/' || name},
             'schema': {'fields': [{'name': 'p_partkey', 'type': 'BIGINT'}, {'name': 'p_size', 'type': 'INTEGER'}]}}}) AS facet
FROM datasets""", "datasets"))
def q_ol_dataset_facet(spark, sf):
    d = Fixtures(spark, sf).datasets()
    fields = F.array(F.struct(F.lit("p_partkey").alias("name"), F.lit("BIGINT").alias("type")),
                     F.struct(F.lit("p_size").alias("name"), F.lit("INTEGER").alias("type")))
    return d.select("id", F.to_json(E.ol_dataset_facet(F.col("namespace"), F.col("name"), fields=fields))
                    .alias("facet"))


@register("ol_jobs", sql("""
SELECT j.namespace, j.name, min(r.started_at) AS created_at
FROM runs r JOIN jobs j ON j.id = r.job_id GROUP BY 1, 2""", "jobs", "runs"))
def q_ol_jobs(spark, sf):
    return E.ol_jobs(_good(spark, sf)).select("namespace", "name", "created_at")


@register("ol_runs", sql(f"""
SELECT {UUID_SQL.format(k='r.run_id')} AS run_id, j.namespace AS job_namespace, j.name AS job_name,
       CASE r.state WHEN 'RUNNING' THEN 'START' ELSE r.state END AS state, r.started_at, r.ended_at
FROM runs r JOIN jobs j ON j.id = r.job_id""", "jobs", "runs"))
def q_ol_runs(spark, sf):
    return E.ol_runs(_good(spark, sf))


@register("ol_datasets", sql("""
SELECT d.namespace, d.name, d.source_uri AS uri, min(r.ended_at) AS created_at
FROM edges e JOIN runs r ON r.run_id = e.run_id JOIN datasets d ON d.id = e.dataset_id
WHERE r.ended_at IS NOT NULL GROUP BY 1, 2, 3""", "runs", "datasets", "edges"))
def q_ol_datasets(spark, sf):
    return E.ol_datasets(_good(spark, sf))


@register("ol_run_events", sql(f""", {PAGES_CTE.strip()}
, v AS ({VALID_ROWS})
SELECT seq, run_id, event_type, event_time, 'lakeline' AS producer, '{E.SCHEMA_URL}' AS schema_url FROM v""",
    "jobs", "runs", "datasets", "edges"))
def q_ol_run_events(spark, sf):
    return E.ol_run_events(_good(spark, sf)).drop("event_data")


@register("ol_edges", sql(f"""
SELECT {UUID_SQL.format(k='e.run_id')} AS run_id, d.namespace, d.name, e.direction, r.ended_at AS created_at
FROM edges e JOIN runs r ON r.run_id = e.run_id JOIN datasets d ON d.id = e.dataset_id
WHERE r.ended_at IS NOT NULL""", "runs", "datasets", "edges"))
def q_ol_edges(spark, sf):
    return E.ol_edges(_good(spark, sf))


@register("ol_merge_metadata", sql("""
SELECT r.run_id, k AS key, v AS value FROM (
  SELECT o_orderkey AS run_id, 'segment' AS k, c.c_mktsegment AS v FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
  UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders
  UNION ALL SELECT o_orderkey, 'status', o_orderstatus FROM orders
  UNION ALL SELECT o_orderkey, 'artifact', 'out_' || o_orderkey FROM orders) r"""))
def q_ol_merge_metadata(spark, sf):
    f = Fixtures(spark, sf)
    o, c = f.orders, f.customer
    j = o.join(c, o.o_custkey == c.c_custkey)
    meta = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("priority"), F.lit("base"))
    extra = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus"))
    arts = F.create_map(F.lit("status"), F.lit("ignored"), F.lit("artifact"),
                        F.concat(F.lit("out_"), F.col("o_orderkey").cast("string")))
    m = j.select(F.col("o_orderkey").alias("run_id"), E.ol_merge_metadata(meta, extra, arts).alias("m"))
    return m.select("run_id", F.explode("m").alias("key", "value"))


@register("ol_parse_forms", f"""
SELECT event_id AS seq, {UUID_SQL.format(k='event_id')} AS run_id, date_trunc('millisecond', ts) AS event_time,
       CAST(NULL AS VARCHAR) AS error,
       '[{{"namespace":"lake","name":"in_' || event_id || '","uri":"lake://tables/in_' || event_id || '"}}]' AS inputs,
       '[{{"namespace":"lake","name":"d","uri":"s3://b/' || user_id || '"}},{{"namespace":"n","name":"e"}}]' AS outputs
FROM events""")
def q_ol_parse_forms(spark, sf):
    """Accepted forms: datasets by name, as {{name, uri}} and without facets; run ids
    without hyphens, in braces or as urn; times with Z or an offset."""
    e = Fixtures(spark, sf).events
    run = E.uuid_of(F.col("event_id"))
    bare = F.regexp_replace(run, "-", "")
    k = F.col("event_id") % 3
    run = F.when(k == 0, bare).when(k == 1, F.concat(F.lit("{"), F.upper(run), F.lit("}"))).otherwise(F.concat(F.lit("urn:uuid:"), run))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    at = F.concat(at, F.when(k == 0, "Z").when(k == 1, "+00:00").otherwise(""))
    text = F.format_string(
        '{"eventType":"START","eventTime":"%s","run":{"runId":"%s"},"job":{"namespace":"n","name":"j"},"inputs":["in_%d"],'
        '"outputs":[{"name":"d","uri":"s3://b/%d"},{"namespace":"n","name":"e"}]}', at, run, F.col("event_id"), F.col("user_id"))
    p = E.ol_validate(E.ol_parse(e.select(F.col("event_id").alias("seq"), "ts", text.alias("payload"))))

    def short(c):
        flat = F.transform(c, lambda d: F.struct(d["namespace"].alias("namespace"), d["name"].alias("name"), d["facets"]["dataSource"]["uri"].alias("uri")))
        return F.to_json(flat)

    return p.select("seq", "run_id", "event_time", "error", short("inputs").alias("inputs"), short("outputs").alias("outputs"))


@register("ol_complete_event_paged", QUERY_ORACLES["ol_complete_event"].replace("// 1000", "// 2"))
def q_ol_complete_event_paged(spark, sf):
    """Pages smaller than the largest run."""
    f = Fixtures(spark, sf)
    runs, jobs, ds, ed = f.runs(), f.jobs(), f.datasets(), f.edges()
    rj = runs.join(jobs, runs.job_id == jobs.id).filter(runs.ended_at.isNotNull()).select(
        runs.run_id, runs.ended_at, (runs.state == "COMPLETE").alias("success"),
        jobs.namespace, jobs.name.alias("job_name"))
    rd = ed.join(ds, ed.dataset_id == ds.id).select(
        ed.run_id, ed.direction, ds.namespace, ds.name, ds.source_uri.alias("uri"))
    return E.ol_complete_event(rj, rd, page_size=2)
