"""Registered monitoring and catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeline.operators import monitoring as M
from lakeline.plans.catalog import register
from lakeline.plans.fixtures import Fixtures
from lakeline.plans.oracle import VIEWS, sql

BYTES_SQL = """CASE WHEN {b} = 0 THEN '0 Bytes' ELSE
  regexp_replace(regexp_replace(CAST(CAST(round({b} / pow(1024.0, {i}), 2) AS DECIMAL(38, 2)) AS VARCHAR), '0+$', ''), '\\.$', '')
  || ' ' || ['Bytes', 'KB', 'MB', 'GB', 'TB'][{i} + 1] END"""
IDX_SQL = """CASE WHEN {b} >= 1099511627776 THEN 4 WHEN {b} >= 1073741824 THEN 3 WHEN {b} >= 1048576 THEN 2
  WHEN {b} >= 1024 THEN 1 ELSE 0 END"""


def bytes_sql(b: str) -> str:
    return BYTES_SQL.format(b=b, i=IDX_SQL.format(b=b))


@register("mon_requests_5m", sql("""
SELECT count(*) AS total_requests, sum(CAST(round(duration * 10000) AS BIGINT)) / count(duration) / 10000.0 AS avg_duration, min(duration) AS min_duration,
       max(duration) AS max_duration, count(*) / 300.0 AS rps,
       CASE WHEN count(*) <> 0 THEN count(*) FILTER (WHERE status_code >= 400) / count(*) ELSE 0.0 END AS error_rate
FROM requests WHERE start_time >= (SELECT max(start_time) FROM requests) - INTERVAL 300 SECOND""", "requests"))
def q_mon_requests_5m(spark, sf):
    return M.mon_requests_window(Fixtures(spark, sf).requests(), 300, scale=10000)


@register("mon_throughput", sql("""
, b AS (SELECT CAST(floor(epoch_us(start_time) / 10000000) * 10000000 AS BIGINT) AS bucket, count(*) AS n,
          sum(CAST(round(duration * 10000) AS BIGINT)) AS dsum, sum(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) AS errs
        FROM requests GROUP BY 1)
, s AS (SELECT g AS ws FROM generate_series((SELECT min(bucket) FROM b) - 50000000, (SELECT max(bucket) FROM b), 10000000) t(g))
, j AS (SELECT s.ws, coalesce(sum(b.n), 0) AS requests, sum(b.dsum) AS dsum, coalesce(sum(b.errs), 0) AS errs
        FROM s LEFT JOIN b ON b.bucket >= s.ws AND b.bucket < s.ws + 60000000 GROUP BY s.ws)
SELECT make_timestamp(ws) AS window_start, make_timestamp(ws + 60000000) AS window_end,
       CAST(requests AS BIGINT) AS requests, requests / 60.0 AS rps,
       CASE WHEN requests <> 0 THEN dsum / requests ELSE 0.0 END / 10000.0 AS avg_response,
       CASE WHEN requests <> 0 THEN errs / requests ELSE 0.0 END AS error_rate
FROM j""", "requests"))
def q_mon_throughput(spark, sf):
    return M.mon_throughput(Fixtures(spark, sf).requests())


@register("mon_active", sql("""
, u AS (SELECT request_id, start_time AS ts, 1 AS delta FROM requests
        UNION ALL SELECT request_id, make_timestamp(epoch_us(start_time) + CAST(round(duration * 1e6) AS BIGINT)), -1
        FROM requests)
SELECT request_id, ts, delta,
       CAST(sum(delta) OVER (ORDER BY ts, delta, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS active
FROM u""", "requests"))
def q_mon_active(spark, sf):
    return M.mon_active(Fixtures(spark, sf).requests())


@register("mon_endpoint_counts", sql("""
SELECT method, endpoint, status_code, count(*) AS requests FROM requests GROUP BY 1, 2, 3""", "requests"))
def q_mon_endpoint_counts(spark, sf):
    return M.mon_endpoint_counts(Fixtures(spark, sf).requests())


@register("mon_histogram", sql("""
, b(le, bound) AS (VALUES """ + ", ".join(f"('{repr(float(x))}', {x})" for x in M.DEFAULT_BUCKETS) + """, ('+Inf', NULL))
SELECT method, endpoint, b.le,
       CAST(sum(CASE WHEN b.bound IS NULL OR r.duration <= b.bound THEN 1 ELSE 0 END) AS BIGINT) AS bucket_count,
       (SELECT sum(CAST(round(duration * 10000) AS BIGINT)) FROM requests r2
         WHERE r2.method = r.method AND r2.endpoint = r.endpoint) / 10000.0 AS sum,
       (SELECT count(*) FROM requests r2 WHERE r2.method = r.method AND r2.endpoint = r.endpoint) AS count
FROM requests r, b GROUP BY method, endpoint, b.le""", "requests"))
def q_mon_histogram(spark, sf):
    return M.mon_histogram(Fixtures(spark, sf).requests(), ["method", "endpoint"], "duration", scale=10000)


@register("mon_query_stats", sql("""
, s AS (SELECT * FROM requests WHERE start_time >= (SELECT max(start_time) FROM requests) - INTERVAL 1 HOUR)
SELECT endpoint AS operation, count(*) AS n, sum(CAST(round(duration * 10000) AS BIGINT)) / count(duration) / 10000.0 AS avg_duration,
       min(duration) AS min_duration, max(duration) AS max_duration FROM s GROUP BY 1
UNION ALL SELECT '*', count(*), sum(CAST(round(duration * 10000) AS BIGINT)) / count(duration) / 10000.0, min(duration), max(duration) FROM s""", "requests"))
def q_mon_query_stats(spark, sf):
    return M.mon_query_stats(Fixtures(spark, sf).requests(), "endpoint", "duration", "start_time", 1, scale=10000)


@register("mon_query_preview", """
SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS preview FROM documents""")
def q_mon_query_preview(spark, sf):
    d = Fixtures(spark, sf).documents
    return M.mon_query_preview(d, "text", 100).select("doc_id", "preview")


@register("mon_slow", sql("""
SELECT * FROM requests WHERE duration > 1.0 ORDER BY duration DESC, request_id LIMIT 10""", "requests"))
def q_mon_slow(spark, sf):
    return M.mon_slow(Fixtures(spark, sf).requests(), "duration", 1.0, 10, "request_id")


OPS_SQL = """CASE event_type WHEN 'click' THEN 'get_object' WHEN 'view' THEN 'list_objects'
  WHEN 'purchase' THEN 'put_object' ELSE 'delete_object' END"""


@register("mon_ops_status", f"""
SELECT {OPS_SQL} AS operation, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
       count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) / 100000.0 AS total_seconds
FROM events GROUP BY 1, 2""")
def q_mon_ops_status(spark, sf):
    e = Fixtures(spark, sf).events
    op = (F.when(F.col("event_type") == "click", "get_object").when(F.col("event_type") == "view", "list_objects")
          .when(F.col("event_type") == "purchase", "put_object").otherwise("delete_object"))
    st = F.when(F.col("event_type") == "error", "error").otherwise("success")
    # total seconds = value / 1000, summed exactly in integer hundredths of a value
    g = M.mon_ops_status(e, op, st, F.round(F.col("value") * 100).cast("long"))
    return g.withColumn("total_seconds", F.col("total_seconds") / 100000.0)


@register("mon_mem_stats", sql("""
, g AS (SELECT component, count(*) AS samples, min(rss) AS min_rss, max(rss) AS max_rss,
          sum(rss) / count(*) AS avg_rss, arg_min(rss, (ts, event_id)) AS first_rss,
          arg_max(rss, (ts, event_id)) AS last_rss, min(ts) AS first_ts, max(ts) AS last_ts
        FROM samples GROUP BY component)
SELECT component, samples, min_rss, max_rss, avg_rss,
       CASE WHEN samples >= 2 AND (epoch_us(last_ts) - epoch_us(first_ts)) / 1e6 > 0
            THEN (last_rss - first_rss) / ((epoch_us(last_ts) - epoch_us(first_ts)) / 1e6) ELSE 0.0 END
         AS growth_per_sec
FROM g""", "samples"))
def q_mon_mem_stats(spark, sf):
    return M.mon_mem_stats(Fixtures(spark, sf).samples())


@register("mon_mem_leak", sql("""
, l AS (SELECT component, ts, event_id, rss,
          lag(rss, 9) OVER (PARTITION BY component ORDER BY ts, event_id) AS rss_before FROM samples)
SELECT component, ts, event_id, rss, rss_before, rss - rss_before AS growth FROM l
WHERE rss - rss_before > 209715200""", "samples"))
def q_mon_mem_leak(spark, sf):
    return M.mon_mem_leak(Fixtures(spark, sf).samples(), 200 * 1024 * 1024)


@register("mon_mem_components", sql("""
SELECT component, ts, event_id, rss - 50000000 AS alloc,
       CAST(sum(rss - 50000000) OVER (PARTITION BY component ORDER BY ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_bytes,
       sum(rss - 50000000) OVER (PARTITION BY component ORDER BY ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 1048576.0 AS running_mb
FROM samples""", "samples"))
def q_mon_mem_components(spark, sf):
    s = Fixtures(spark, sf).samples().select("component", "ts", "event_id",
                                             (F.col("rss") - 50000000).alias("alloc"))
    return M.mon_mem_components(s, "component", ["ts", "event_id"], "alloc")


@register("mon_retention", sql("""
SELECT * FROM samples WHERE ts > (SELECT max(ts) FROM samples) - INTERVAL 1 HOUR""", "samples"))
def q_mon_retention(spark, sf):
    return M.mon_retention(Fixtures(spark, sf).samples(), "ts", 1.0)


@register("mon_db_activity", sql("""
SELECT count(*) AS total, count(*) FILTER (WHERE kind IN ('ping', 'pong')) AS active,
       count(DISTINCT client_id) AS clients FROM pings""", "pings"))
def q_mon_db_activity(spark, sf):
    p = Fixtures(spark, sf).pings()
    return M.mon_db_activity(p, F.col("kind").isin("ping", "pong"), "client_id")


@register("mon_hit_ratio", """
SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS hits,
       count(*) FILTER (WHERE l_linestatus = 'O') AS reads,
       CASE WHEN count(*) FILTER (WHERE l_linestatus IN ('F', 'O')) <> 0
            THEN floor((count(*) FILTER (WHERE l_linestatus = 'F') * 20000 + count(*) FILTER (WHERE l_linestatus IN ('F', 'O')))
                       / (count(*) FILTER (WHERE l_linestatus IN ('F', 'O')) * 2)) / 100.0 ELSE 0.0 END AS hit_ratio
FROM lineitem GROUP BY 1""")
def q_mon_hit_ratio(spark, sf):
    li = Fixtures(spark, sf).lineitem
    g = li.groupBy("l_returnflag").agg(F.sum((F.col("l_linestatus") == "F").cast("long")).alias("hits"),
                                       F.sum((F.col("l_linestatus") == "O").cast("long")).alias("reads"))
    return g.withColumn("hit_ratio", M.mon_hit_ratio(F.col("hits"), F.col("reads")))


@register("mon_dead_ratio", sql("""
, g AS (SELECT entity_id, count(*) FILTER (WHERE type <> 'table_deleted') AS n_live,
          count(*) FILTER (WHERE type = 'table_deleted') AS n_dead FROM changelog GROUP BY 1)
SELECT entity_id, n_live, n_dead, floor((n_dead * 20000 + (n_live + n_dead)) / ((n_live + n_dead) * 2)) / 100.0 AS dead_ratio
FROM g WHERE n_live > 0 ORDER BY dead_ratio DESC""", "changelog"))
def q_mon_dead_ratio(spark, sf):
    c = Fixtures(spark, sf).changelog()
    g = c.groupBy("entity_id").agg(F.sum((F.col("type") != "table_deleted").cast("long")).alias("n_live"),
                                   F.sum((F.col("type") == "table_deleted").cast("long")).alias("n_dead"))
    return g.filter(F.col("n_live") > 0).withColumn(
        "dead_ratio", M.mon_hit_ratio(F.col("n_dead"), F.col("n_live"))).orderBy(
        F.col("dead_ratio").desc())


@register("mon_run_metrics", sql("""
, n AS (SELECT run_id, count(*) AS rows FROM edges GROUP BY 1)
SELECT r.run_id, (epoch_us(ended_at) - epoch_us(started_at)) / 1e6 AS duration_s, coalesce(n.rows, 0) AS rows,
       CASE WHEN (epoch_us(ended_at) - epoch_us(started_at)) / 1e6 > 0
            THEN coalesce(n.rows, 0) / ((epoch_us(ended_at) - epoch_us(started_at)) / 1e6) ELSE 0.0 END AS rows_per_sec,
       r.state = 'COMPLETE' AS success
FROM runs r LEFT JOIN n ON n.run_id = r.run_id""", "runs", "edges"))
def q_mon_run_metrics(spark, sf):
    f = Fixtures(spark, sf)
    rows = f.edges().groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"))
    return M.mon_run_metrics(f.runs(), rows)


CHECK_SQL = """CASE WHEN avg(CASE WHEN status_code >= 400 THEN 1.0 ELSE 0.0 END) > 0.5 THEN 'unhealthy'
  WHEN avg(CASE WHEN status_code >= 400 THEN 1.0 ELSE 0.0 END) > 0.03 THEN 'warning' ELSE 'healthy' END"""


def _checks(spark, sf):
    r = Fixtures(spark, sf).requests()
    er = F.avg((F.col("status_code") >= 400).cast("double"))
    return r.groupBy(F.date_trunc("day", "start_time").alias("day"), "endpoint").agg(
        F.when(er > 0.5, "unhealthy").when(er > 0.03, "warning").otherwise("healthy").alias("status"))


@register("mon_health", sql(f"""
, c AS (SELECT date_trunc('day', start_time) AS day, endpoint, {CHECK_SQL} AS status FROM requests GROUP BY 1, 2)
SELECT day, count(*) AS checks, count(*) FILTER (WHERE status = 'healthy') AS healthy,
       count(*) FILTER (WHERE status = 'warning') AS warnings,
       count(*) FILTER (WHERE status IN ('unhealthy', 'error')) AS failing,
       CASE WHEN count(*) FILTER (WHERE status IN ('unhealthy', 'error')) > 0 THEN 'unhealthy'
            WHEN count(*) FILTER (WHERE status = 'warning') > 0 THEN 'warning' ELSE 'healthy' END AS overall
FROM c GROUP BY day""", "requests"))
def q_mon_health(spark, sf):
    return M.mon_health(_checks(spark, sf), ["day"])


@register("mon_config_drift", sql("""
, h AS (SELECT entity_id, ts, seq,
          left(sha256(array_to_string(list_sort(['rows=' || CAST(round(row_count * 100) AS BIGINT), 'type=' || type]), '|')), 16)
            AS config_hash FROM changelog)
SELECT entity_id, ts, seq, config_hash,
       lag(config_hash) OVER (PARTITION BY entity_id ORDER BY ts, seq) AS prev_config_hash,
       coalesce(lag(config_hash) OVER (PARTITION BY entity_id ORDER BY ts, seq) <> config_hash, false) AS changed
FROM h""", "changelog"))
def q_mon_config_drift(spark, sf):
    c = Fixtures(spark, sf).changelog()
    pairs = F.array(F.concat(F.lit("rows="), F.round(F.col("row_count") * 100).cast("long").cast("string")),
                    F.concat(F.lit("type="), F.col("type")))
    return M.mon_config_drift(c.select("entity_id", "ts", "seq", pairs.alias("pairs")), "entity_id",
                              ["ts", "seq"], F.col("pairs")).drop("pairs")


@register("mon_success_rate", sql("""
SELECT endpoint, count(*) AS total, count(*) FILTER (WHERE status_code < 400) AS successes,
       CASE WHEN count(*) <> 0 THEN count(*) FILTER (WHERE status_code < 400) / count(*) ELSE 0.0 END AS success_rate
FROM requests GROUP BY 1""", "requests"))
def q_mon_success_rate(spark, sf):
    return M.mon_success_rate(Fixtures(spark, sf).requests(), "endpoint", F.col("status_code") < 400)


@register("mon_rate_limit", sql("""
SELECT request_id, client_id, start_time, endpoint, method, status_code, duration,
       before - expired AS in_window, before - expired >= 20 AS over_limit
FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY start_time, request_id) - 1 AS before,
             count(*) OVER (PARTITION BY client_id ORDER BY start_time
                            RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 7 DAY PRECEDING) AS expired
      FROM requests)""", "requests"))
def q_mon_rate_limit(spark, sf):
    r = Fixtures(spark, sf).requests()
    return M.mon_rate_limit(r, "client_id", "start_time", "request_id", 7 * 86400, 20)


@register("mon_rate_limit_admitted", f"""
WITH RECURSIVE requests AS ({VIEWS['requests']}),
q AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY start_time, request_id) AS n,
             row_number() OVER (PARTITION BY client_id ORDER BY start_time, request_id) - 1 - count(*) OVER (
               PARTITION BY client_id ORDER BY start_time RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 7 DAY PRECEDING) AS in_window
      FROM requests),
r AS (
  SELECT client_id, 0::BIGINT AS n, []::TIMESTAMP[] AS held, false AS admitted FROM (SELECT DISTINCT client_id FROM q)
  UNION ALL
  SELECT client_id, n, CASE WHEN len(live) < 10 THEN list_append(live, start_time) ELSE live END, len(live) < 10
  FROM (SELECT r.client_id, q.n, q.start_time, list_filter(r.held, lambda a: a > q.start_time - INTERVAL 7 DAY) AS live
        FROM r JOIN q ON q.client_id = r.client_id AND q.n = r.n + 1)
)
SELECT request_id, client_id, start_time, endpoint, method, status_code, duration, in_window, admitted
FROM q JOIN r USING (client_id, n)""")
def q_mon_rate_limit_admitted(spark, sf):
    r = Fixtures(spark, sf).requests()
    return M.mon_rate_limit_admitted(r, "client_id", "start_time", "request_id", 7 * 86400, 10)


# ------------------------------------------------------------------ catalog

@register("cat_overview", """
WITH t AS (SELECT 't' || user_id AS name, CAST(max_by(round(value * 100), event_id) AS BIGINT) AS row_count
           FROM events GROUP BY user_id)
SELECT (SELECT CAST(sum(row_count) AS BIGINT) FROM t) AS total_rows,
       (SELECT CAST(sum(row_count) * 100 AS BIGINT) FROM t) AS total_bytes,
       (SELECT count(DISTINCT p_brand) FROM part) AS buckets,
       (SELECT to_json(list(name ORDER BY name)) FROM (SELECT name FROM t ORDER BY name LIMIT 5)) AS first_tables""")
def q_cat_overview(spark, sf):
    f = Fixtures(spark, sf)
    t = f.events.groupBy("user_id").agg(
        F.max_by(F.round(F.col("value") * 100), "event_id").cast("long").alias("row_count")).select(
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("name"), "row_count")
    return M.cat_overview(t, f.part, "row_count", 100, "p_brand")


@register("cat_status_counts", sql("SELECT state, count(*) AS jobs FROM runs GROUP BY 1", "runs"))
def q_cat_status_counts(spark, sf):
    return M.cat_status_counts(Fixtures(spark, sf).runs(), "state", "jobs")


@register("cat_bytes_fmt", f"""
WITH b AS (SELECT o_orderkey,
             CASE WHEN o_orderkey % 11 = 0 THEN 0
                  ELSE CAST(floor(o_totalprice) AS BIGINT) * CAST(pow(1024, o_orderkey % 5) AS BIGINT) END AS size_bytes
           FROM orders)
SELECT o_orderkey, size_bytes, {bytes_sql('size_bytes')} AS size_text FROM b""")
def q_cat_bytes_fmt(spark, sf):
    o = Fixtures(spark, sf).orders
    size = F.when(F.col("o_orderkey") % 11 == 0, F.lit(0).cast("long")).otherwise(
        F.floor("o_totalprice").cast("long") * F.pow(F.lit(1024), F.col("o_orderkey") % 5).cast("long"))
    b = o.select("o_orderkey", size.alias("size_bytes"))
    return M.cat_bytes_fmt(b, "size_bytes")


CAT_SEARCH_SQL = sql("""
, items AS (SELECT 'job' AS kind, CAST(id AS VARCHAR) AS item_id, name FROM jobs
            UNION ALL SELECT 'dataset', CAST(id AS VARCHAR), name FROM datasets
            UNION ALL SELECT DISTINCT 'table', table_name, table_name FROM snapshots)
, tok AS (SELECT kind, item_id, name, unnest(regexp_split_to_array(lower(name), '[^a-z0-9]+')) AS token FROM items)
, sc AS (SELECT kind, item_id, name, levenshtein(token, 'custmer') / greatest(length(token), 7) AS score
         FROM tok WHERE length(token) > 0)
SELECT kind, item_id, name, min(score) AS score FROM sc GROUP BY 1, 2, 3 HAVING min(score) <= 0.3""",
    "jobs", "datasets", "snapshots")


def _catalog_items(spark, sf):
    f = Fixtures(spark, sf)
    return (f.jobs().select(F.lit("job").alias("kind"), F.col("id").cast("string").alias("item_id"), "name")
             .unionByName(f.datasets().select(F.lit("dataset").alias("kind"),
                                              F.col("id").cast("string").alias("item_id"), "name"))
             .unionByName(f.snapshots().select(F.lit("table").alias("kind"), F.col("table_name").alias("item_id"),
                                               F.col("table_name").alias("name")).distinct()))


@register("cat_search", CAT_SEARCH_SQL)
def q_cat_search(spark, sf):
    return M.cat_search(_catalog_items(spark, sf), "custmer")


@register("cat_search_indexed", CAT_SEARCH_SQL)
def q_cat_search_indexed(spark, sf):
    from lakeline.plans.q_io import scratch

    path = scratch(spark, "search")
    M.write_search_index(_catalog_items(spark, sf), path)
    return M.cat_search_indexed(spark, path, "custmer")


@register("mon_run_observed")
def q_mon_run_observed(spark, sf):
    """Metrics of a real write of lineitem, counted by an Observation (rows-only:
    the duration varies run to run)."""
    from lakeline.plans.q_io import scratch

    out = scratch(spark, "observed")
    m = M.run_with_metrics("lineitem_copy", Fixtures(spark, sf).lineitem,
                           lambda d: d.write.mode("overwrite").parquet(out))
    assert m.first().rows == Fixtures(spark, sf).lineitem.count()
    return m
