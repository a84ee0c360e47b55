"""Registered queue / event-stream queries, batch forms.

The streaming forms (``lakeline.streaming``) run the same operators per
micro-batch or with Structured Streaming state; tests check stream == batch.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeline.operators import streams as S
from lakeline.plans.catalog import ORACLE as QUERY_ORACLES
from lakeline.plans.catalog import register
from lakeline.plans.fixtures import Fixtures
from lakeline.plans.oracle import sql
from lakeline.session import shuffle_partitions


@register("st_route_notify", """
SELECT event_id AS msg_id, ts AS enqueued_at,
  CASE event_type WHEN 'click' THEN 'job_status' WHEN 'view' THEN 'job_status' WHEN 'purchase' THEN 'system_metric'
       ELSE 'notification' END AS route,
  CASE event_type WHEN 'click' THEN 'job_' || user_id WHEN 'view' THEN 'unknown' END AS job_name,
  CASE event_type WHEN 'click' THEN CAST(event_id AS VARCHAR) WHEN 'view' THEN 'unknown' END AS run_id,
  CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'done' END AS status,
  CASE WHEN event_type = 'click' THEN CAST(event_id % 100 AS DOUBLE) END AS progress,
  CASE WHEN event_type = 'purchase' THEN 'latency' END AS metric_type,
  CASE WHEN event_type = 'purchase' THEN value END AS value,
  CASE WHEN event_type = 'purchase' THEN '{}' END AS metadata,
  CASE WHEN event_type = 'signup' THEN '{"kind":"other"}' END AS payload
FROM events WHERE event_type <> 'error'""")
def q_st_route_notify(spark, sf):
    return S.st_route_notify(Fixtures(spark, sf).notifications())


@register("st_drop_failed_notify", """
SELECT event_id AS msg_id, ts AS enqueued_at, 'not json {' AS message FROM events WHERE event_type = 'error'""")
def q_st_drop_failed_notify(spark, sf):
    return S.st_drop_failed_notify(Fixtures(spark, sf).notifications())


@register("q_depth", sql("""
, p AS (SELECT queue_name, count(*) AS depth FROM messages
        WHERE enqueued_at <= (SELECT max(enqueued_at) FROM messages)
          AND (archived_at IS NULL OR archived_at > (SELECT max(enqueued_at) FROM messages)) GROUP BY 1)
, q(queue_name) AS (VALUES ('lineage_events'), ('lineage_events_dlq'), ('lineage_notifications'))
, per AS (SELECT q.queue_name, coalesce(p.depth, 0) AS depth FROM q LEFT JOIN p USING (queue_name))
SELECT * FROM per UNION ALL SELECT 'total_messages', CAST(sum(depth) AS BIGINT) FROM per""", "messages"))
def q_q_depth(spark, sf):
    return S.q_depth(Fixtures(spark, sf).messages())


@register("q_live_status", sql("""
SELECT queue_name, count(*) AS pending, max(enqueued_at) AS last_message_at FROM messages GROUP BY 1""", "messages"))
def q_q_live_status(spark, sf):
    return S.q_live_status(Fixtures(spark, sf).messages())


@register("q_hourly_perf", sql("""
SELECT queue_name, date_trunc('hour', archived_at) AS hour, count(*) AS processed,
       sum(epoch_us(archived_at) - epoch_us(enqueued_at)) / count(*) / 1e6 AS avg_seconds
FROM messages WHERE archived_at IS NOT NULL GROUP BY 1, 2""", "messages"))
def q_q_hourly_perf(spark, sf):
    return S.q_hourly_perf(Fixtures(spark, sf).messages())


@register("q_stuck", sql("SELECT * FROM messages WHERE read_ct > 5 ORDER BY enqueued_at, msg_id", "messages"))
def q_q_stuck(spark, sf):
    return S.q_stuck(Fixtures(spark, sf).messages())


@register("q_dlq_recent", sql("""
SELECT * FROM messages WHERE queue_name = 'lineage_events_dlq' ORDER BY enqueued_at DESC, msg_id DESC LIMIT 10""",
    "messages"))
def q_q_dlq_recent(spark, sf):
    return S.q_dlq_recent(Fixtures(spark, sf).messages())


@register("q_retention", sql("""
, r(queue_name, retention_days) AS (VALUES ('lineage_events', 7), ('lineage_events_dlq', 30), ('lineage_notifications', 1))
, x AS (SELECT m.msg_id, m.queue_name, m.enqueued_at,
       (epoch_us((SELECT max(enqueued_at) FROM messages)) - epoch_us(m.enqueued_at)) / 1e6 AS age_seconds,
       CASE WHEN m.queue_name = 'lineage_events_dlq' THEN least(r.retention_days * 86400, 604800)
            ELSE r.retention_days * 86400 END AS limit_seconds
  FROM messages m JOIN r USING (queue_name))
SELECT * FROM x WHERE age_seconds > limit_seconds""",
    "messages"))
def q_q_retention(spark, sf):
    return S.q_retention(Fixtures(spark, sf).messages())


SUBS_SQL = """
, known(t) AS (VALUES ('lineage_event'), ('job_status'), ('queue_status'), ('system_metric'), ('error'),
                      ('heartbeat'), ('ping'))
, items AS (SELECT DISTINCT client_id, trim(x) AS t FROM subscriptions, unnest(string_split(events, ',')) u(x))
, valid AS (SELECT i.client_id, i.t FROM items i JOIN known k ON k.t = i.t)
, subs AS (SELECT client_id, t AS event_type FROM valid
           UNION ALL SELECT s.client_id, d.t FROM subscriptions s,
             (VALUES ('lineage_event'), ('job_status'), ('system_metric')) d(t)
           WHERE s.client_id NOT IN (SELECT client_id FROM valid))"""


@register("ev_subscribe", sql(SUBS_SQL + "\nSELECT client_id, event_type FROM subs", "subscriptions"))
def q_ev_subscribe(spark, sf):
    return S.ev_subscribe(Fixtures(spark, sf).subscriptions())


@register("ev_presets", sql("""
SELECT event_id, event_type, preset FROM sse_events, (VALUES ('lineage', 'lineage_event'), ('lineage', 'error'),
  ('jobs', 'job_status'), ('jobs', 'error'), ('metrics', 'system_metric'), ('metrics', 'queue_status'),
  ('metrics', 'error')) p(preset, t) WHERE p.t = sse_events.event_type""", "sse_events"))
def q_ev_presets(spark, sf):
    return S.ev_presets(Fixtures(spark, sf).sse_events()).select("event_id", "event_type", "preset")


@register("ev_fanout", sql(SUBS_SQL + """
, c AS (SELECT event_type, count(*) AS n, max("timestamp") AS last_ts FROM sse_events GROUP BY 1)
SELECT s.client_id, CAST(sum(c.n) AS BIGINT) AS deliveries, max(c.last_ts) AS last_event_at
FROM subs s JOIN c USING (event_type)
WHERE s.client_id % 5 <> 0 AND s.client_id % 3 <> 1 GROUP BY 1""", "subscriptions", "sse_events"))
def q_ev_fanout(spark, sf):
    f = Fixtures(spark, sf)
    clients = f.subscriptions().select("client_id")
    return S.ev_fanout_counts(f.sse_events(), S.ev_subscribe(f.subscriptions()),
                              zombies=clients.filter(F.col("client_id") % 5 == 0),
                              targets=clients.filter(F.col("client_id") % 3 != 1))


@register("ev_replay", sql(SUBS_SQL + """
, top AS (SELECT * FROM sse_events ORDER BY "timestamp" DESC, event_id DESC LIMIT 50)
SELECT s.client_id, t.event_id, t.event_type, t."timestamp" FROM subs s JOIN top t USING (event_type)""",
    "subscriptions", "sse_events"))
def q_ev_replay(spark, sf):
    f = Fixtures(spark, sf)
    return S.ev_replay(f.sse_events(), S.ev_subscribe(f.subscriptions()))


@register("ev_history_cap", sql("""
SELECT * FROM sse_events ORDER BY "timestamp" DESC, event_id DESC LIMIT 1000""", "sse_events"))
def q_ev_history_cap(spark, sf):
    return S.ev_history_cap(Fixtures(spark, sf).sse_events())


@register("ev_last_n_logs", sql("""
SELECT * FROM raw_logs ORDER BY ts DESC, event_id DESC LIMIT 100""", "raw_logs"))
def q_ev_last_n_logs(spark, sf):
    return S.ev_history_cap(Fixtures(spark, sf).raw_logs(), 100, "ts")


@register("ev_envelope", sql("""
SELECT event_id, 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: ' ||
       '{"timestamp":"' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') || '","data":' || data || '}' || chr(10) || chr(10) AS frame
FROM sse_events""", "sse_events"))
def q_ev_envelope(spark, sf):
    return S.ev_envelope(Fixtures(spark, sf).sse_events())


@register("ev_latest_state", sql("""
, l AS (SELECT entity_id, arg_max({'ts': ts, 'seq': seq, 'type': type, 'row_count': row_count}, (ts, seq)) AS s
        FROM changelog GROUP BY 1)
SELECT entity_id, s.ts AS ts, s.seq AS seq, s.type AS type, s.row_count AS row_count FROM l
WHERE NOT ends_with(s.type, '_deleted')""", "changelog"))
def q_ev_latest_state(spark, sf):
    return S.ev_latest_state(Fixtures(spark, sf).changelog(), "entity_id", ["ts", "seq"])


@register("ev_pong_reset", sql("""
, g AS (SELECT *, sum(CASE WHEN kind = 'pong' THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY ts, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM pings)
SELECT client_id, ts, event_id,
       CAST(sum(CASE WHEN kind = 'ping' THEN 1 ELSE 0 END) OVER (PARTITION BY client_id, grp ORDER BY ts, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS missed_pings
FROM g QUALIFY kind = 'ping'""", "pings"))
def q_ev_pong_reset(spark, sf):
    return S.ev_pong_reset(Fixtures(spark, sf).pings())


LIVENESS_SQL = """
, f AS (SELECT client_id, min(ts) AS connected_at, max(ts) FILTER (WHERE kind = 'ping') AS last_ping,
          max(ts) FILTER (WHERE kind = 'pong') AS last_pong, count(*) FILTER (WHERE kind = 'ping') AS ping_count,
          max((ts, event_id)) FILTER (WHERE kind = 'pong') AS pong_at,
          count(*) FILTER (WHERE kind = 'queue_full') AS queue_full_count,
          count(*) FILTER (WHERE kind = 'write_error') AS write_errors FROM pings GROUP BY 1)
, a AS (SELECT f.client_id, count(p.event_id) AS missed_pings FROM f LEFT JOIN pings p
          ON p.client_id = f.client_id AND p.kind = 'ping' AND (f.last_pong IS NULL OR (p.ts, p.event_id) > f.pong_at) GROUP BY 1)
, x AS (SELECT f.*, a.missed_pings,
          (epoch_us((SELECT max(ts) FROM pings)) - epoch_us(coalesce(last_ping, connected_at))) / 1e6 AS seconds_since_ping,
          epoch_us((SELECT max(ts) FROM pings)) - epoch_us(coalesce(last_ping, connected_at)) AS us_since_ping,
          (epoch_us((SELECT max(ts) FROM pings)) - epoch_us(connected_at)) / 1e6 AS since_conn
        FROM f JOIN a USING (client_id))
, l AS (SELECT client_id, connected_at, last_ping, last_pong, ping_count, queue_full_count, write_errors, missed_pings,
          CASE WHEN seconds_since_ping > 120 THEN 'ping_timeout' WHEN missed_pings > 3 THEN 'missed_pings'
               WHEN queue_full_count > 10 THEN 'queue_full' WHEN write_errors > 5 THEN 'write_errors'
               WHEN last_pong IS NULL AND ping_count > 0 AND since_conn > 90 THEN 'no_pong' END AS reason, seconds_since_ping,
          us_since_ping
        FROM x)"""


@register("ev_liveness", sql(LIVENESS_SQL + "\nSELECT *, reason IS NULL AS healthy FROM l", "pings"))
def q_ev_liveness(spark, sf):
    return S.ev_liveness(Fixtures(spark, sf).pings())


@register("ev_liveness_stats", sql(LIVENESS_SQL + """
SELECT coalesce(reason, 'healthy') AS reason, count(*) AS clients,
       max(us_since_ping) / 1e6 AS max_seconds_since_ping,
       sum(us_since_ping) / count(*) / 1e6 AS avg_seconds_since_ping FROM l GROUP BY 1""", "pings"))
def q_ev_liveness_stats(spark, sf):
    return S.ev_liveness_stats(S.ev_liveness(Fixtures(spark, sf).pings()))


@register("st_window_tumbling", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       event_type, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def q_st_window_tumbling(spark, sf):
    return S.st_window_tumbling(Fixtures(spark, sf).events, "ts", "1 hour", ["event_type"])


@register("st_window_sliding", """
WITH s AS (SELECT make_timestamp(CAST(floor(epoch_us(ts) / 10000000) * 10000000 AS BIGINT) - k * 10000000) AS window_start
           FROM events, range(0, 6) r(k))
SELECT window_start, window_start + INTERVAL 60 SECOND AS window_end, count(*) AS n FROM s GROUP BY 1""")
def q_st_window_sliding(spark, sf):
    return S.st_window_sliding(Fixtures(spark, sf).events, "ts", "60 seconds", "10 seconds", [])


@register("st_session", sql("""
, g AS (SELECT client_id, ts, event_id,
          CASE WHEN lag(ts) OVER w IS NULL OR (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 > 120 THEN 1 ELSE 0 END AS st
        FROM pings WINDOW w AS (PARTITION BY client_id ORDER BY ts, event_id))
, s AS (SELECT *, sum(st) OVER (PARTITION BY client_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          AS session FROM g)
SELECT client_id, CAST(session AS BIGINT) AS session, min(ts) AS session_start,
       max(ts) + INTERVAL 120 SECOND AS session_end, count(*) AS events FROM s GROUP BY 1, 2""", "pings"))
def q_st_session(spark, sf):
    return S.st_session(Fixtures(spark, sf).pings(), "client_id", "ts", "event_id", 120)


@register("st_dedup", sql("SELECT * FROM messages", "messages"))
def q_st_dedup(spark, sf):
    m = Fixtures(spark, sf).messages()
    redelivered = m.filter(F.col("read_ct") > 5).withColumn(
        "enqueued_at", F.col("enqueued_at") + F.make_dt_interval(secs=F.lit(30)))
    return S.st_dedup(m.unionByName(redelivered), "msg_id", ["enqueued_at"])


# ------------------------------------------------------------------ Structured Streaming runs
# Each query writes its input (derived from the given tables) as a few files
# in event order, runs the stream to completion with an availableNow trigger,
# and returns the stream's output read back.  Oracles are the batch twins,
# restricted to what append mode can have emitted (closed by the watermark).

def _stream_dirs(spark, what):
    from lakeline.plans.q_io import scratch

    root = scratch(spark, f"stream-{what}")
    return f"{root}/in", f"{root}/out", f"{root}/ckpt"


def _stream_of(spark, df, path, ts, whole_us: int = 1):
    """A stream over ``df`` in event order: four micro-batches, written and read by many tasks."""
    from lakeline.streaming import jobs as J

    parts = max(1, shuffle_partitions(spark) // 4)
    # One more a micro-batch, as a file may be cut in two where a slice begins.
    return J.file_stream(spark, J.write_in_event_order(df, path, ts, 4, parts, whole_us), df.schema, files_per_trigger=parts + 1 if parts > 1 else 1)


@register("st_ingest", sql("""
SELECT '00000000-0000-4000-8000-' || lpad(lower(hex(r.run_id)), 12, '0') AS run_id, j.namespace AS job_namespace,
       j.name AS job_name, CASE r.state WHEN 'RUNNING' THEN 'START' ELSE r.state END AS state, r.started_at, r.ended_at
FROM runs r JOIN jobs j ON j.id = r.job_id""", "jobs", "runs"))
def q_st_ingest(spark, sf):
    from lakeline.streaming import jobs as J

    src, out, ck = _stream_dirs(spark, "ingest")
    Fixtures(spark, sf).ol_events().write.parquet(f"{src}-events")  # built once for the passes that cut it
    parts = max(1, shuffle_partitions(spark) // 4)
    src = J.write_in_event_order(spark.read.parquet(f"{src}-events"), src, "ts", 4, parts)
    # One more a micro-batch, as a file may be cut in two where a slice begins.
    J.st_ingest(spark, src, out, ck, files_per_trigger=parts + 1).awaitTermination()
    return J.store_tables(spark, out)["runs"]


@register("st_window_tumbling_stream", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       event_type, count(*) AS n FROM events GROUP BY 1, 2, 3
HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def q_st_window_tumbling_stream(spark, sf):
    from lakeline.streaming import jobs as J

    src, out, ck = _stream_dirs(spark, "tumble")
    ev = Fixtures(spark, sf).events
    J.st_window_tumbling(_stream_of(spark, ev, src, "ts"), out, ck).awaitTermination()
    return spark.read.parquet(out)


@register("st_session_stream", sql("""
, g AS (SELECT client_id, ts, event_id,
          CASE WHEN lag(ts) OVER w IS NULL OR (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 > 120 THEN 1 ELSE 0 END AS st
        FROM pings WINDOW w AS (PARTITION BY client_id ORDER BY ts, event_id))
, s AS (SELECT *, sum(st) OVER (PARTITION BY client_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          AS session FROM g)
SELECT client_id, min(ts) AS session_start, max(ts) + INTERVAL 120 SECOND AS session_end, count(*) AS events
FROM s GROUP BY client_id, session
HAVING max(ts) + INTERVAL 120 SECOND < (SELECT max(ts) FROM pings) - INTERVAL 10 MINUTE""", "pings"))
def q_st_session_stream(spark, sf):
    from lakeline.streaming import jobs as J

    src, out, ck = _stream_dirs(spark, "session")
    p = Fixtures(spark, sf).pings()
    J.st_session(_stream_of(spark, p, src, "ts"), out, ck).awaitTermination()
    return spark.read.parquet(out)


@register("st_dedup_stream", sql("SELECT * FROM messages", "messages"))
def q_st_dedup_stream(spark, sf):
    from lakeline.streaming import jobs as J

    src, out, ck = _stream_dirs(spark, "dedup")
    m = Fixtures(spark, sf).messages()
    redelivered = m.filter(F.col("read_ct") > 5).withColumn(
        "enqueued_at", F.col("enqueued_at") + F.make_dt_interval(secs=F.lit(30)))
    J.st_dedup(_stream_of(spark, m.unionByName(redelivered), src, "enqueued_at"), out, ck).awaitTermination()
    return spark.read.parquet(out)


@register("ev_latest_state_stream", sql("""
, l AS (SELECT entity_id, arg_max({'ts': ts, 'seq': seq, 'type': type, 'row_count': row_count}, (ts, seq)) AS s
        FROM changelog GROUP BY 1)
SELECT entity_id, s.ts AS ts, s.seq AS seq, s.type AS type, s.row_count AS row_count FROM l
WHERE NOT ends_with(s.type, '_deleted')""", "changelog"))
def q_ev_latest_state_stream(spark, sf):
    from lakeline.streaming import jobs as J

    src, out, ck = _stream_dirs(spark, "latest")
    c = Fixtures(spark, sf).changelog()
    J.ev_latest_state(_stream_of(spark, c, src, "ts"), out, ck).awaitTermination()
    return J.current_state(spark, out)


@register("ev_latest_state_forget_stream", QUERY_ORACLES["ev_latest_state_stream"])
def q_ev_latest_state_forget_stream(spark, sf):
    """Latest state whose deletes are remembered while changes up to a week late are taken."""
    from lakeline.streaming import jobs as J

    src, out, ck = _stream_dirs(spark, "latest-forget")
    c = Fixtures(spark, sf).changelog()
    J.ev_latest_state(_stream_of(spark, c, src, "ts"), out, ck, forget_deleted_s=7 * 86400).awaitTermination()
    return J.current_state(spark, out)


# Every report of a replay, client by client and one group of rows (client, second, kind) a step,
# and the timeouts that the last watermark (10 minutes before the last event) has passed.
LIVENESS_STREAM_SQL = """
, u AS (SELECT client_id, coalesce(kind, 'connect') AS kind, epoch_us(ts) AS us FROM pings WHERE ts IS NOT NULL)
, g AS (SELECT client_id, kind, count(*) AS n, min(us) AS f, max(us) AS l,
          row_number() OVER (PARTITION BY client_id ORDER BY us // 1000000, max(us), kind) AS rn
        FROM u GROUP BY client_id, us // 1000000, kind)
, w AS (SELECT max(us) // 1000 * 1000 - 600000000 AS wm FROM u)
, r AS (
  SELECT DISTINCT client_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS connected, CAST(NULL AS BIGINT) AS base,
         CAST(NULL AS BIGINT) AS seen, FALSE AS pinged, FALSE AS ponged, CAST(0 AS HUGEINT) AS missed, CAST(0 AS HUGEINT) AS qf,
         CAST(0 AS HUGEINT) AS we, FALSE AS reported, CAST(NULL AS BIGINT) AS timed_out, CAST(NULL AS VARCHAR) AS reason
  FROM g
  UNION ALL
  SELECT client_id, rn, connected, base, l, pinged, ponged, missed, qf, we, reported OR (reason IS NOT NULL AND reason <> 'recovered'),
         timed_out, reason
  FROM (SELECT *, CASE WHEN recovered THEN 'recovered' WHEN reported THEN NULL WHEN missed > 3 THEN 'missed_pings'
                       WHEN qf > 10 THEN 'queue_full' WHEN we > 5 THEN 'write_errors'
                       WHEN pinged AND NOT ponged AND l - connected > 90000000 THEN 'no_pong' END AS reason
        FROM (SELECT client_id, rn, l, kind, connected, timed_out, reported AND kind <> 'pong' AS reported,
                     reported AND kind = 'pong' AS recovered, pinged OR kind = 'ping' AS pinged, ponged OR kind = 'pong' AS ponged,
                     CASE WHEN kind = 'ping' OR (reported AND kind = 'pong') THEN l ELSE base END AS base,
                     CASE kind WHEN 'ping' THEN missed + n WHEN 'pong' THEN 0 ELSE missed END AS missed,
                     CASE WHEN reported AND kind = 'pong' THEN 0 WHEN kind = 'queue_full' THEN qf + n ELSE qf END AS qf,
                     CASE WHEN reported AND kind = 'pong' THEN 0 WHEN kind = 'write_error' THEN we + n ELSE we END AS we
              FROM (SELECT client_id, rn, n, f, l, kind, timed_out, reported AND NOT fresh AS reported,
                           CASE WHEN fresh THEN f ELSE connected END AS connected, CASE WHEN fresh THEN f ELSE base END AS base,
                           pinged AND NOT fresh AS pinged, ponged AND NOT fresh AS ponged,
                           CASE WHEN fresh THEN 0 ELSE missed END AS missed, CASE WHEN fresh THEN 0 ELSE qf END AS qf,
                           CASE WHEN fresh THEN 0 ELSE we END AS we
                    FROM (SELECT *, connected IS NULL OR (reported AND seen + 86400000000 < f) AS fresh
                          FROM (SELECT client_id, rn, n, f, l, kind, connected, base, pinged, ponged, missed, qf, we, timed_out,
                                       reported OR timed_out IS NOT NULL AS reported, greatest(seen, timed_out) AS seen
                                FROM (SELECT r.* EXCLUDE (rn, reason, timed_out), g.rn, g.n, g.f, g.l, g.kind,
                                             CASE WHEN NOT r.reported AND r.base + 120000000 < g.f THEN r.base + 120000000 END AS timed_out
                                      FROM r JOIN g ON g.client_id IS NOT DISTINCT FROM r.client_id AND g.rn = r.rn + 1)))))))
, e AS (
  SELECT client_id, reason, seen AS us FROM r WHERE reason IS NOT NULL
  UNION ALL SELECT client_id, 'ping_timeout', timed_out FROM r WHERE timed_out IS NOT NULL
  UNION ALL SELECT client_id, 'ping_timeout', base + 120000000 FROM r
            WHERE NOT reported AND base + 120000000 < (SELECT wm FROM w)
              AND (client_id, rn) IN (SELECT (client_id, max(rn)) FROM g GROUP BY client_id))
SELECT client_id, reason, make_timestamp(us) AS detected_at FROM e"""


@register("ev_liveness_stream", sql(LIVENESS_STREAM_SQL, "pings").replace("WITH", "WITH RECURSIVE", 1))
def q_ev_liveness_stream(spark, sf):
    """Zombies and recoveries reported by the stateful detector."""
    from lakeline.streaming import jobs as J

    src, out, ck = _stream_dirs(spark, "liveness")
    p = Fixtures(spark, sf).pings()
    J.ev_liveness(_stream_of(spark, p, src, "ts", 1_000_000), out, ck).awaitTermination()
    return spark.read.parquet(out)


@register("st_route_notify_stream", QUERY_ORACLES["st_route_notify"])
def q_st_route_notify_stream(spark, sf):
    from lakeline.streaming import jobs as J

    src, out, ck = _stream_dirs(spark, "route")
    n = Fixtures(spark, sf).notifications()
    J.st_transform(_stream_of(spark, n, src, "enqueued_at"), S.st_route_notify, out, ck).awaitTermination()
    return spark.read.parquet(out)


@register("ev_presets_stream", QUERY_ORACLES["ev_presets"])
def q_ev_presets_stream(spark, sf):
    from lakeline.streaming import jobs as J

    src, out, ck = _stream_dirs(spark, "presets")
    e = Fixtures(spark, sf).sse_events()
    J.st_transform(_stream_of(spark, e, src, "timestamp"),
                   lambda d: S.ev_presets(d).select("event_id", "event_type", "preset"), out, ck).awaitTermination()
    return spark.read.parquet(out)


@register("st_window_sliding_stream", """
SELECT w AS window_start, w + INTERVAL 60 SECOND AS window_end, count(*) AS n
FROM (SELECT unnest(generate_series(time_bucket(INTERVAL 10 SECOND, ts) - INTERVAL 50 SECOND,
                                    time_bucket(INTERVAL 10 SECOND, ts), INTERVAL 10 SECOND)) AS w FROM events)
GROUP BY 1, 2 HAVING w + INTERVAL 60 SECOND <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def q_st_window_sliding_stream(spark, sf):
    from lakeline.streaming import jobs as J

    src, out, ck = _stream_dirs(spark, "slide")
    ev = Fixtures(spark, sf).events
    J.st_window_sliding(_stream_of(spark, ev, src, "ts"), out, ck).awaitTermination()
    return spark.read.parquet(out)


@register("ev_envelope_stream", QUERY_ORACLES["ev_envelope"])
def q_ev_envelope_stream(spark, sf):
    from lakeline.streaming import jobs as J

    src, out, ck = _stream_dirs(spark, "envelope")
    e = Fixtures(spark, sf).sse_events()
    J.st_transform(_stream_of(spark, e, src, "timestamp"), S.ev_envelope, out, ck).awaitTermination()
    return spark.read.parquet(out)


@register("ev_subscribe_stream", QUERY_ORACLES["ev_subscribe"])
def q_ev_subscribe_stream(spark, sf):
    from lakeline.streaming import jobs as J

    src, out, ck = _stream_dirs(spark, "subscribe")
    c = Fixtures(spark, sf).subscriptions()
    c.repartition(4).write.parquet(src)
    J.st_transform(J.file_stream(spark, src, c.schema), S.ev_subscribe, out, ck).awaitTermination()
    return spark.read.parquet(out)


@register("ev_fanout_stream", sql(SUBS_SQL + """
, c AS (SELECT event_type, count(*) AS n, max("timestamp") AS last_ts FROM sse_events GROUP BY 1)
SELECT s.client_id, CAST(sum(c.n) AS BIGINT) AS deliveries, max(c.last_ts) AS last_event_at
FROM subs s JOIN c USING (event_type) GROUP BY 1""", "subscriptions", "sse_events"))
def q_ev_fanout_stream(spark, sf):
    from lakeline.streaming import jobs as J

    src, out, ck = _stream_dirs(spark, "fanout")
    f = Fixtures(spark, sf)
    e = f.sse_events()
    J.ev_fanout(_stream_of(spark, e, src, "timestamp"), S.ev_subscribe(f.subscriptions()), out, ck).awaitTermination()
    return spark.read.parquet(f"{out}/deliveries").groupBy("client_id").agg(
        F.sum("deliveries").alias("deliveries"), F.max("last_event_at").alias("last_event_at"))
