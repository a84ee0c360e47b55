"""Registered log-analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeline.operators import logs as G
from lakeline.plans.catalog import register
from lakeline.plans.fixtures import Fixtures
from lakeline.plans.oracle import sql


def _x(pat: str, i: int, col: str = "line") -> str:
    return f"nullif(regexp_extract({col}, '{pat}', {i}), '')"


@register("log_parse_pg", sql(f"""
SELECT event_id, ts, pid AS pid_label, {_x(G.PG_LINE, 1)} AS ts_text,
       CAST(strptime(left({_x(G.PG_LINE, 1)}, 23), '%Y-%m-%d %H:%M:%S.%g') AS TIMESTAMP) AS log_ts,
       CAST({_x(G.PG_LINE, 2)} AS BIGINT) AS pid, {_x(G.PG_LINE, 3)} AS "user", {_x(G.PG_LINE, 4)} AS database,
       {_x(G.PG_LINE, 5)} AS level, {_x(G.PG_LINE, 6)} AS message
FROM log_lines""", "log_lines"))
def q_log_parse_pg(spark, sf):
    ll = Fixtures(spark, sf).log_lines().withColumnRenamed("pid", "pid_label")
    return G.log_parse_pg(ll)


@register("log_duration", sql(f"""
SELECT event_id, TRY_CAST({_x(G.DURATION, 1)} AS DOUBLE) AS duration_ms FROM log_lines""", "log_lines"))
def q_log_duration(spark, sf):
    ll = Fixtures(spark, sf).log_lines()
    return ll.select("event_id", G.log_duration(F.col("line")).alias("duration_ms"))


@register("log_queue_name", sql(f"""
SELECT event_id, {_x(G.QUEUE_NAME, 1)} AS queue_name FROM log_lines""", "log_lines"))
def q_log_queue_name(spark, sf):
    ll = Fixtures(spark, sf).log_lines()
    return ll.select("event_id", G.log_queue_name(F.col("line")).alias("queue_name"))


@register("log_vacuum", sql(f"""
SELECT event_id, {_x(G.VACUUM, 1)} AS vacuum_type, {_x(G.VACUUM, 2)} AS table_name FROM log_lines""",
    "log_lines"))
def q_log_vacuum(spark, sf):
    ll = Fixtures(spark, sf).log_lines()
    vt, tn = G.log_vacuum(F.col("line"))
    return ll.select("event_id", vt.alias("vacuum_type"), tn.alias("table_name"))


JSON_FIELDS = [f.name for f in G.JSON_LOG.fields]


@register("log_parse_json", sql("""
SELECT event_id, """ + ", ".join(f"json_extract_string(line, '$.{n}') AS {n}" for n in JSON_FIELDS) + """,
       CAST(strptime(json_extract_string(line, '$.timestamp'), '%Y-%m-%dT%H:%M:%S.%f') AS TIMESTAMP) AS log_ts
FROM raw_logs WHERE container = 'backend'""", "raw_logs"))
def q_log_parse_json(spark, sf):
    r = Fixtures(spark, sf).raw_logs().filter(F.col("container") == "backend").select("event_id", "line")
    return G.log_parse_json(r)


@register("log_level_guess", sql(f"""
SELECT event_id, lower({_x(G.LEVEL_GUESS, 1)}) AS level FROM raw_logs""", "raw_logs"))
def q_log_level_guess(spark, sf):
    r = Fixtures(spark, sf).raw_logs()
    return r.select("event_id", G.log_level_guess(F.col("line")).alias("level"))


@register("log_route", sql(f"""
SELECT container, event_id, CAST(strptime(left({_x(G.PG_LINE, 1)}, 23), '%Y-%m-%d %H:%M:%S.%g') AS TIMESTAMP) AS log_ts,
       lower({_x(G.PG_LINE, 5)}) AS level, {_x(G.PG_LINE, 6)} AS message
FROM raw_logs WHERE container = 'postgresql'
UNION ALL
SELECT container, event_id,
       CAST(strptime(json_extract_string(line, '$.timestamp'), '%Y-%m-%dT%H:%M:%S.%f') AS TIMESTAMP),
       lower(json_extract_string(line, '$.level')), json_extract_string(line, '$.message')
FROM raw_logs WHERE container = 'backend'
UNION ALL
SELECT container, event_id, CAST(NULL AS TIMESTAMP), lower({_x(G.LEVEL_GUESS, 1)}), line
FROM raw_logs WHERE container NOT IN ('postgresql', 'backend')""", "raw_logs"))
def q_log_route(spark, sf):
    return G.log_route(Fixtures(spark, sf).raw_logs())


def _filters_sql(since: str) -> str:
    parts = [f"SELECT event_id, '{n}' AS filter FROM recent WHERE regexp_matches(line, '{p}')"
             for n, p in G.NAMED_FILTERS.items()]
    return (f", recent AS (SELECT * FROM log_lines WHERE ts >= (SELECT max(ts) FROM log_lines) - INTERVAL {since})\n"
            + "\nUNION ALL ".join(parts))


@register("log_filter", sql(_filters_sql("1440 MINUTE"), "log_lines"))
def q_log_filter(spark, sf):
    f = G.log_filter(Fixtures(spark, sf).log_lines(), "ts", 1440)
    return f.select("event_id", "filter")


@register("log_by_namespace", sql("""
SELECT event_id, container, line FROM raw_logs WHERE namespace = 'apps'""", "raw_logs"))
def q_log_by_namespace(spark, sf):
    return G.log_by_namespace(Fixtures(spark, sf).raw_logs(), "apps").select("event_id", "container", "line")


def _labels(r):
    base = F.create_map(F.lit("container"), F.col("container"), F.lit("namespace"), F.col("namespace"))
    svc = F.when(F.col("container") == "backend", F.create_map(F.lit("service"), F.lit("lakeline-api")))
    return F.coalesce(F.map_concat(base, svc), base)


@register("log_labels", sql("""
SELECT DISTINCT label FROM (
  SELECT 'container' AS label FROM raw_logs UNION ALL SELECT 'namespace' FROM raw_logs
  UNION ALL SELECT 'service' FROM raw_logs WHERE container = 'backend')""", "raw_logs"))
def q_log_labels(spark, sf):
    r = Fixtures(spark, sf).raw_logs()
    return G.log_labels(r, _labels(r))


def _report_sql() -> str:
    secs = ", ".join(f"('{s}')" for s in G.REPORT_SECTIONS)
    parts = [f"SELECT event_id, ts, line, '{s}' AS section FROM recent WHERE regexp_matches(line, '{G.NAMED_FILTERS[s]}')"
             for s in G.REPORT_SECTIONS]
    return (", recent AS (SELECT * FROM log_lines WHERE ts >= (SELECT max(ts) FROM log_lines) - INTERVAL 24 HOUR)\n"
            f", s(section) AS (VALUES {secs})\n"
            ", m AS (" + "\nUNION ALL ".join(parts) + ")\n"
            ", c AS (SELECT section, count(*) AS matches FROM m GROUP BY 1)\n"
            ", t AS (SELECT section, event_id AS sample_id, line AS sample,\n"
            "        row_number() OVER (PARTITION BY section ORDER BY ts DESC, event_id DESC) AS rn FROM m)\n"
            "SELECT s.section, coalesce(c.matches, 0) AS matches, t.sample_id, t.sample\n"
            "FROM s LEFT JOIN c ON c.section = s.section LEFT JOIN t ON t.section = s.section AND t.rn <= 3")


@register("log_report", sql(_report_sql(), "log_lines"))
def q_log_report(spark, sf):
    return G.log_report(Fixtures(spark, sf).log_lines(), "ts", 24, 3)


@register("log_health", sql("""
, a AS (SELECT
   count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM log_lines) - INTERVAL 5 MINUTE
                    AND regexp_matches(line, '(?i)(error|fatal|panic)')) AS e,
   count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM log_lines) - INTERVAL 10 MINUTE
                    AND regexp_matches(line, '(?i)(connection.*failed|could not connect)')) AS c,
   count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM log_lines) - INTERVAL 30 MINUTE
                    AND regexp_matches(line, 'automatic vacuum')) AS v FROM log_lines)
SELECT 'recent_errors' AS "check", e AS matches, CASE WHEN e > 0 THEN 'WARN' ELSE 'OK' END AS status FROM a
UNION ALL SELECT 'connection_issues', c, CASE WHEN c > 0 THEN 'WARN' ELSE 'OK' END FROM a
UNION ALL SELECT 'autovacuum', v, CASE WHEN v > 0 THEN 'OK' ELSE 'WARN' END FROM a""", "log_lines"))
def q_log_health(spark, sf):
    return G.log_health(Fixtures(spark, sf).log_lines(), "ts")
