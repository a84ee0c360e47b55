"""DuckDB oracle SQL for the registered queries.

``VIEWS`` re-states each derived fixture view in plain SQL over the provided
tables; ``sql(body, *views)`` prefixes a query with the CTEs it needs.  The
oracle is written independently of the DataFrame code so that the two agree
only when the semantics agree.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "jobs": """SELECT c_custkey AS id, c_mktsegment AS namespace, c_name AS name,
        CAST(DATE '1995-01-01' + CAST(c_custkey % 365 AS INTEGER) AS TIMESTAMP) AS created_at
        FROM customer""",
    "runs": """SELECT o_orderkey AS run_id, o_custkey AS job_id,
        CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'P' THEN 'FAIL' ELSE 'RUNNING' END AS state,
        o_orderdate AS started_at,
        CASE WHEN o_orderstatus <> 'O'
             THEN o_orderdate + to_hours(CAST(o_orderkey % 48 + 1 AS INTEGER)) END AS ended_at
        FROM orders""",
    "datasets": """SELECT p_partkey AS id, p_brand AS namespace, 'part_' || p_partkey AS name,
        'lake://tables/part_' || p_partkey AS source_uri FROM part""",
    "edges": """SELECT l_orderkey AS run_id, l_partkey AS dataset_id,
        CASE WHEN l_linestatus = 'O' THEN 'OUTPUT' ELSE 'INPUT' END AS direction,
        max(l_shipdate) AS created_at FROM lineitem GROUP BY 1, 2, 3""",
    "requests": """SELECT event_id AS request_id, user_id AS client_id, ts AS start_time,
        event_type AS endpoint, CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
        CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 50 = 0 THEN 404 ELSE 200 END AS status_code,
        value / 100.0 AS duration FROM events""",
    "tenant_requests": """SELECT r.*, n.n_name AS tenant, c.c_mktsegment || '_' || c.c_name AS "user"
        FROM requests r JOIN customer c ON c.c_custkey = r.client_id JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "messages": """SELECT event_id AS msg_id,
        CASE event_type WHEN 'error' THEN 'lineage_events_dlq' WHEN 'signup' THEN 'lineage_notifications'
             ELSE 'lineage_events' END AS queue_name,
        ts AS enqueued_at, ts + to_seconds(CAST(event_id % 120 AS BIGINT)) AS archived_at,
        event_id % 8 AS read_ct, props AS message FROM events""",
    "trades": "SELECT event_id AS trade_id, user_id AS symbol, ts FROM events WHERE event_type = 'purchase'",
    "prices": "SELECT user_id AS symbol, ts, value AS price FROM events WHERE event_type = 'view'",
    "samples": """SELECT user_id AS component, ts, event_id,
        CAST(50000000 + (event_id % 97) * 4194304 AS BIGINT) AS rss FROM events""",
    "pings": """SELECT user_id AS client_id, ts, event_id,
        CASE event_type WHEN 'click' THEN 'ping' WHEN 'view' THEN 'pong' WHEN 'error' THEN 'write_error'
             WHEN 'signup' THEN 'queue_full' ELSE 'connect' END AS kind FROM events""",
    "changelog": """SELECT user_id AS entity_id, ts, event_id AS seq,
        CASE event_type WHEN 'error' THEN 'table_deleted' WHEN 'signup' THEN 'table_created'
             ELSE 'table_updated' END AS type, value AS row_count FROM events""",
    "log_lines": """SELECT event_id, ts, user_id AS pid,
        strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' UTC [' || user_id || '] ' ||
        CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'FATAL' ELSE 'LOG' END || ': ' ||
        CASE event_type WHEN 'click' THEN 'duration: ' || event_id || '.5 ms'
             WHEN 'view' THEN 'queue: lineage_events'
             WHEN 'purchase' THEN 'automatic vacuum of table "lake.public.t"'
             ELSE 'connection failed' END AS line FROM events""",
    "raw_logs": """SELECT event_id, ts,
        CASE user_id % 3 WHEN 0 THEN 'postgresql' WHEN 1 THEN 'backend' ELSE 'worker' END AS container,
        CASE WHEN user_id % 3 = 0 THEN 'database' ELSE 'apps' END AS namespace,
        CASE user_id % 3
          WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' UTC [' || user_id || '] ' ||
            CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'FATAL' ELSE 'LOG' END || ': ' ||
            CASE event_type WHEN 'click' THEN 'duration: ' || event_id || '.5 ms'
                 WHEN 'view' THEN 'queue: lineage_events'
                 WHEN 'purchase' THEN 'automatic vacuum of table "lake.public.t"'
                 ELSE 'connection failed' END
          WHEN 1 THEN '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","level":"' ||
            CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END ||
            '","service":"lakeline-api","message":"' || event_type || ' handled","request_id":"' || event_id ||
            '","job_name":"job_' || user_id || '","table_name":"t' || user_id || '"' ||
            CASE WHEN event_type = 'error' THEN ',"error":"boom"' ELSE '' END || '}'
          ELSE CASE WHEN event_type = 'error' THEN 'worker error: failed item ' || event_id
                    ELSE 'worker processed item ' || event_id || ' INFO' END END AS line
        FROM events""",
    "snapshots": """SELECT 't' || user_id AS table_name, event_id AS snapshot_id, ts AS created_at,
        '/snap/' || event_id AS uri, 'parquet' AS format FROM events""",
    "employees": """SELECT s_suppkey AS employee_id,
        CASE WHEN s_suppkey <> 0 THEN CAST(floor((s_suppkey - 1) / 3.0) AS BIGINT) END AS manager_id,
        s_name AS name, s_nationkey AS nation_id FROM supplier""",
    "sse_events": """SELECT event_id,
        CASE event_type WHEN 'click' THEN 'lineage_event' WHEN 'view' THEN 'job_status'
             WHEN 'purchase' THEN 'system_metric' WHEN 'signup' THEN 'queue_status' ELSE 'error' END AS event_type,
        props AS data, ts AS "timestamp", user_id AS origin FROM events""",
    "subscriptions": """SELECT DISTINCT user_id AS client_id,
        CASE user_id % 4 WHEN 0 THEN 'lineage_event, job_status, system_metric'
             WHEN 1 THEN 'lineage_event,error' WHEN 2 THEN ' job_status , error,bogus'
             ELSE 'system_metric,queue_status,error' END AS events FROM events""",
}


def sql(body: str, *views: str) -> str:
    """``WITH <views> <body>``: views listed in dependency order."""
    if not views:
        return body
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views)
    return f"WITH {ctes}\n{body}"
