"""Queue and event-stream processing.

Every operator here is ``DataFrame -> DataFrame`` and works on a batch
DataFrame or on a streaming micro-batch (``foreachBatch``); the stateful
streaming forms live in ``lakeline.streaming``.  Per-client state questions
(latest state, liveness, missed pings) are aggregates -- partial aggregation
per task -- or skew-safe scans, never per-key windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeline.functions import from_micros, max_of, micros, split_trim
from lakeline.operators.scan import chunked, lag_rows, running

# Fixed values from the reference.
QUEUES = ["lineage_events", "lineage_events_dlq", "lineage_notifications"]
QUEUE_RETENTION_DAYS = {"lineage_events": 7, "lineage_events_dlq": 30, "lineage_notifications": 1}
DLQ_MAX_AGE_S = 7 * 24 * 3600
EVENT_TYPES = ["lineage_event", "job_status", "queue_status", "system_metric", "error", "heartbeat", "ping"]
DEFAULT_SUBSCRIPTION = ["lineage_event", "job_status", "system_metric"]
PRESETS = {
    "lineage": ["lineage_event", "error"],
    "jobs": ["job_status", "error"],
    "metrics": ["system_metric", "queue_status", "error"],
}
STUCK_READS = 5
REPLAY_LAST = 50
HISTORY_CAP = 1000
LOG_ROWS_KEPT = 100
# Liveness rules, checked in this order (first one that holds names the reason).
PING_TIMEOUT_S = 120
MAX_MISSED_PINGS = 3
MAX_QUEUE_FULL = 10
MAX_WRITE_ERRORS = 5
NO_PONG_GRACE_S = 90


# ------------------------------------------------------------------ notifications

def st_route_notify(notes: DataFrame, message: str = "message") -> DataFrame:
    """Route notifications by ``type``: job_status / system_metric / other
    ('notification'), with 'unknown' defaults for missing fields; malformed
    JSON rows are dropped (not dead-lettered)."""
    m = F.col(message)
    ok = notes.filter(F.json_object_keys(m).isNotNull())
    typ = F.coalesce(F.get_json_object(m, "$.type"), F.lit("general"))
    route = F.when(typ == "job_status", "job_status").when(typ == "system_metric", "system_metric") \
        .otherwise("notification")
    def g(p, d=None):
        v = F.get_json_object(m, p)
        return F.coalesce(v, F.lit(d)) if d is not None else v
    job = route == "job_status"
    met = route == "system_metric"
    return ok.select(
        *[c for c in notes.columns if c != message], route.alias("route"),
        F.when(job, g("$.job_name", "unknown")).alias("job_name"),
        F.when(job, g("$.run_id", "unknown")).alias("run_id"),
        F.when(job, g("$.status", "unknown")).alias("status"),
        F.when(job, g("$.progress")).try_cast("double").alias("progress"),
        F.when(met, g("$.metric_type", "unknown")).alias("metric_type"),
        F.when(met, g("$.value")).try_cast("double").alias("value"),
        F.when(met, g("$.metadata", "{}")).alias("metadata"),
        F.when(route == "notification", m).alias("payload"))


def st_drop_failed_notify(notes: DataFrame, message: str = "message") -> DataFrame:
    """The notifications that ``st_route_notify`` drops (malformed JSON)."""
    return notes.filter(F.json_object_keys(F.col(message)).isNull())


# ------------------------------------------------------------------ queues

def _queue_list(spark) -> DataFrame:
    return spark.createDataFrame([(q, QUEUE_RETENTION_DAYS[q]) for q in QUEUES],
                                 "queue_name string, retention_days int")


def q_depth(messages: DataFrame, asof=None) -> DataFrame:
    """Pending messages per known queue at asof (enqueued, not yet archived);
    absent queues report 0; plus a 'total_messages' row."""
    now = max_of(messages, "enqueued_at") if asof is None else asof
    pending = messages.filter((F.col("enqueued_at") <= now)
                              & (F.col("archived_at").isNull() | (F.col("archived_at") > now)))
    counts = pending.groupBy("queue_name").agg(F.count(F.lit(1)).alias("depth"))
    per = F.broadcast(_queue_list(messages.sparkSession)).join(counts, "queue_name", "left").select(
        "queue_name", F.coalesce("depth", F.lit(0)).alias("depth"))
    total = per.agg(F.sum("depth").alias("depth")).select(F.lit("total_messages").alias("queue_name"), "depth")
    return per.unionByName(total)


def q_live_status(messages: DataFrame) -> DataFrame:
    return messages.groupBy("queue_name").agg(F.count(F.lit(1)).alias("pending"),
                                              F.max("enqueued_at").alias("last_message_at"))


def q_hourly_perf(messages: DataFrame) -> DataFrame:
    us = micros("archived_at") - micros("enqueued_at")
    return messages.filter(F.col("archived_at").isNotNull()).groupBy(
        "queue_name", F.date_trunc("hour", "archived_at").alias("hour")).agg(
        F.count(F.lit(1)).alias("processed"), (F.sum(us) / F.count(F.lit(1)) / 1e6).alias("avg_seconds"))


def q_stuck(messages: DataFrame, reads: int = STUCK_READS) -> DataFrame:
    return messages.filter(F.col("read_ct") > reads).orderBy("enqueued_at", "msg_id")


def q_dlq_recent(messages: DataFrame, k: int = 10, dlq: str = "lineage_events_dlq") -> DataFrame:
    return messages.filter(F.col("queue_name") == dlq).orderBy(
        F.col("enqueued_at").desc(), F.col("msg_id").desc()).limit(k)


def q_retention(messages: DataFrame, asof=None, dlq: str = "lineage_events_dlq",
                dlq_max_age_s: int = DLQ_MAX_AGE_S) -> DataFrame:
    """Messages past their limit at asof (expired = to purge): the queue's
    retention, and for the dead-letter queue also the dead-letter max age
    (whichever is shorter)."""
    now = max_of(messages, "enqueued_at") if asof is None else asof
    ret = F.broadcast(_queue_list(messages.sparkSession))
    m = messages.join(ret, "queue_name")
    age_s = (micros(now) - micros("enqueued_at")) / 1e6
    limit_s = F.when(F.col("queue_name") == dlq, F.least(F.col("retention_days") * 86400, F.lit(dlq_max_age_s))) \
        .otherwise(F.col("retention_days") * 86400)
    return m.filter(age_s > limit_s).select(
        "msg_id", "queue_name", "enqueued_at", age_s.alias("age_seconds"), limit_s.alias("limit_seconds"))


# ------------------------------------------------------------------ subscriptions

def ev_subscribe(clients: DataFrame, events_col: str = "events") -> DataFrame:
    """(client_id, event_type): comma list split and trimmed, unknown names
    ignored, and the default set when the list is empty or missing."""
    known = F.array(*[F.lit(t) for t in EVENT_TYPES])
    items = F.array_intersect(F.array_distinct(split_trim(F.coalesce(F.col(events_col), F.lit("")))), known)
    subs = F.when(F.size(items) > 0, items).otherwise(F.array(*[F.lit(t) for t in DEFAULT_SUBSCRIPTION]))
    return clients.select("client_id", F.explode(subs).alias("event_type"))


def ev_presets(events: DataFrame) -> DataFrame:
    """(event, preset) for each preset subscription the event belongs to."""
    hits = F.filter(F.array(*[F.when(F.col("event_type").isin(*ts), F.lit(p)) for p, ts in PRESETS.items()]),
                    lambda x: x.isNotNull())
    return events.select("*", F.explode(hits).alias("preset"))


def ev_fanout_counts(events: DataFrame, subs: DataFrame, zombies: DataFrame | None = None,
                     targets: DataFrame | None = None) -> DataFrame:
    """Deliveries per healthy subscribed client without materialising
    (event, client) pairs: events are counted per type (a fixed, enumerated
    set -- at most len(EVENT_TYPES) rows, so broadcasting it is bounded) and
    joined to the exploded subscriptions.  ``zombies`` (client_id) are
    excluded; ``targets`` (client_id) restrict delivery when given."""
    per_type = events.filter(F.col("event_type").isin(*EVENT_TYPES)).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last_ts"))  # <= len(EVENT_TYPES) rows
    s = subs
    if zombies is not None:
        s = s.join(zombies.select("client_id"), "client_id", "left_anti")
    if targets is not None:
        s = s.join(targets.select("client_id"), "client_id", "left_semi")
    j = s.join(F.broadcast(per_type), "event_type")
    return j.groupBy("client_id").agg(F.sum("n").alias("deliveries"), F.max("last_ts").alias("last_event_at"))


def ev_fanout_pairs(batch: DataFrame, subs: DataFrame) -> DataFrame:
    """(event, client) deliveries for one bounded micro-batch of events
    (streaming ``foreachBatch``); the batch size is capped by the trigger."""
    return batch.join(subs, "event_type")


def ev_replay(events: DataFrame, subs: DataFrame, last: int = REPLAY_LAST) -> DataFrame:
    """The newest ``last`` events overall, *then* filtered per client by its
    subscription (not the newest ``last`` matching ones).  The top-k is a
    distributed TakeOrderedAndProject; the joined side has <= ``last`` rows."""
    top = events.orderBy(F.col("timestamp").desc(), F.col("event_id").desc()).limit(last)
    return subs.join(F.broadcast(top), "event_type").select("client_id", "event_id", "event_type", "timestamp")


def ev_history_cap(events: DataFrame, cap: int = HISTORY_CAP, ts: str = "timestamp",
                   tiebreak: str = "event_id") -> DataFrame:
    return events.orderBy(F.col(ts).desc(), F.col(tiebreak).desc()).limit(cap)


def ev_envelope(events: DataFrame) -> DataFrame:
    """Server-sent-event frame: 'id: ..\\nevent: ..\\ndata: {timestamp, data}\\n\\n'.
    ``data`` is JSON text and goes in as it is, whatever its shape; text that is
    not JSON goes in as a JSON string, null as null."""
    at = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.to_json(F.struct(F.col("data").alias("d")))
    quoted = F.substring(text, 6, F.length(text) - 6)
    flat = F.regexp_replace(F.col("data"), r"[\r\n]+", " ")  # a frame's data is one line
    data = F.when(F.col("data").isNull(), "null").when(F.expr("try_parse_json(data) IS NOT NULL"), flat).otherwise(quoted)
    body = F.concat(F.lit('{"timestamp":"'), at, F.lit('","data":'), data, F.lit("}"))
    frame = F.concat(F.lit("id: "), F.col("event_id").cast("string"), F.lit("\nevent: "), F.col("event_type"),
                     F.lit("\ndata: "), body, F.lit("\n\n"))
    return events.select("event_id", frame.alias("frame"))


# ------------------------------------------------------------------ state

def ev_latest_state(changelog: DataFrame, key: str, order: list[str], delete_suffix: str = "_deleted") -> DataFrame:
    """Changelog -> current rows: last change per key wins (max_by, partial
    aggregation -- a hot key is reduced per task before the shuffle); keys
    whose last change is a delete disappear."""
    o = F.struct(*[F.col(c) for c in order])
    cols = [c for c in changelog.columns if c != key]
    last = changelog.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), o).alias("__l"))
    out = last.select(key, *[F.col("__l." + c).alias(c) for c in cols])
    return out.filter(~F.col("type").endswith(delete_suffix))


def ev_pong_reset(pings: DataFrame) -> DataFrame:
    """For every ping: pings since the client's last pong (a pong resets the
    count): the running number of pings less its value at the last pong.

    Both running values use the chunks of one cut, so rows are shuffled once."""
    k = F.col("kind")
    x = pings.filter(k.isin("ping", "pong")).select("client_id", "ts", "event_id", (k == "ping").cast("long").alias("__ping"))
    order = ["ts", "event_id"]
    s = running(chunked(x, ["client_id"], order), ["client_id"], order, {"__pings": ("sum", "__ping")})
    s = running(s, ["client_id"], order, {"__base": ("last", F.when(F.col("__ping") == 0, F.col("__pings")))})
    return s.filter(F.col("__ping") == 1).select(
        "client_id", "ts", "event_id", (F.col("__pings") - F.coalesce("__base", F.lit(0))).alias("missed_pings"))


def liveness_features(pings: DataFrame, salts: int = 32) -> DataFrame:
    """Per client: first connect, last ping/pong, pings sent and pings after the last
    pong (in order of time, then event), queue-full and write-error counts.

    The last pong of each client is one aggregate; it meets the client's rows again under
    ``salts`` keys, so a hot client is joined by many tasks, and the rest is a second
    aggregate with partial sums."""
    k = F.col("kind")
    at = F.struct("ts", "event_id")
    last = pings.filter(k == "pong").groupBy("client_id").agg(F.max(at).alias("__pong"))
    last = last.select(F.col("client_id").alias("__c"), "__pong", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__s"))
    salt = F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int")
    rows = pings.select("client_id", "ts", "event_id", "kind", salt.alias("__salt"))
    rows = rows.join(last, F.col("client_id").eqNullSafe(F.col("__c")) & (F.col("__salt") == F.col("__s")), "left")
    after = (k == "ping") & (F.col("__pong").isNull() | (at > F.col("__pong")))
    return rows.groupBy("client_id").agg(
        F.min("ts").alias("connected_at"),
        F.max(F.when(k == "ping", F.col("ts"))).alias("last_ping"),
        F.max(F.when(k == "pong", F.col("ts"))).alias("last_pong"),
        F.sum((k == "ping").cast("long")).alias("ping_count"),
        F.sum((k == "queue_full").cast("long")).alias("queue_full_count"),
        F.sum((k == "write_error").cast("long")).alias("write_errors"),
        F.sum(after.cast("long")).alias("missed_pings"))


def ev_liveness(pings: DataFrame, asof=None) -> DataFrame:
    """Classify clients at asof; the first rule that holds is the reason:
    ping timeout, missed pings, queue full, write errors, pinged but no pong after
    the grace period.  Healthy clients have a null reason."""
    now = max_of(pings, "ts") if asof is None else asof
    f = liveness_features(pings)
    us_since_ping = micros(now) - micros(F.coalesce("last_ping", "connected_at"))
    since_ping = us_since_ping / 1e6
    since_conn = (micros(now) - micros("connected_at")) / 1e6
    reason = (F.when(since_ping > PING_TIMEOUT_S, "ping_timeout")
              .when(F.col("missed_pings") > MAX_MISSED_PINGS, "missed_pings")
              .when(F.col("queue_full_count") > MAX_QUEUE_FULL, "queue_full")
              .when(F.col("write_errors") > MAX_WRITE_ERRORS, "write_errors")
              .when(F.col("last_pong").isNull() & (F.col("ping_count") > 0) & (since_conn > NO_PONG_GRACE_S), "no_pong"))
    return f.select("*", reason.alias("reason"), since_ping.alias("seconds_since_ping"),
                    us_since_ping.alias("us_since_ping")).withColumn(
        "healthy", F.col("reason").isNull())


def ev_liveness_stats(liveness: DataFrame) -> DataFrame:
    """Clients per reason ('healthy' for none) with max/avg zombie duration."""
    r = F.coalesce("reason", F.lit("healthy"))
    return liveness.groupBy(r.alias("reason")).agg(
        F.count(F.lit(1)).alias("clients"),
        (F.max("us_since_ping") / 1e6).alias("max_seconds_since_ping"),
        (F.sum("us_since_ping") / F.count(F.lit(1)) / 1e6).alias("avg_seconds_since_ping"))


# ------------------------------------------------------------------ windows (batch twins)

def st_window_tumbling(events: DataFrame, ts: str, size: str, keys: list[str]) -> DataFrame:
    w = F.window(ts, size)
    return events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def st_window_sliding(events: DataFrame, ts: str, size: str, slide: str, keys: list[str]) -> DataFrame:
    w = F.window(ts, size, slide)
    return events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def st_session(events: DataFrame, key: str, ts: str, tiebreak: str, gap_s: int) -> DataFrame:
    """Sessions per key: a gap > ``gap_s`` closes a session; end = last event
    + gap (as ``session_window``).  Batch form via the previous event and a
    running count of session starts -- no per-key window."""
    cut = chunked(events.select(key, ts, tiebreak), [key], [ts, tiebreak])
    lj = lag_rows(cut, [key], [ts, tiebreak], [ts])
    gap = (micros(ts) - micros("prev_" + ts)) / 1e6
    starts = lj.withColumn("__start", (F.col("prev_" + ts).isNull() | (gap > gap_s)).cast("long"))
    sid = running(starts, [key], [ts, tiebreak], {"session": ("sum", "__start")})
    return sid.groupBy(key, "session").agg(
        F.min(ts).alias("session_start"),
        from_micros(micros(F.max(ts)) + gap_s * 1_000_000).alias("session_end"),
        F.count(F.lit(1)).alias("events"))


def st_dedup(messages: DataFrame, key: str = "msg_id", order: list[str] | None = None) -> DataFrame:
    """One row per ``key`` (first delivery by ``order``), deterministic."""
    order = order or ["enqueued_at"]
    cols = [c for c in messages.columns if c != key]
    o = F.struct(*[F.col(c) for c in order])
    d = messages.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), o).alias("__f"))
    return d.select(key, *[F.col("__f." + c).alias(c) for c in cols])
