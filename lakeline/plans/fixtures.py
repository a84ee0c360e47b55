"""Derived views over the provided tables (one projection or aggregate each).

These turn the TPC-H-like test tables into the reference's data model (jobs,
runs, datasets, lineage edges, queue messages, request metrics, pings, ...).
Every view is lazy and grows with its source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


class Tables:
    """Lazy readers for ``<sf_dir>/<name>.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.read(name)
        raise AttributeError(name)


def uuid_of(key) -> "F.Column":
    """Deterministic UUID-shaped string for an integer key."""
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.lower(F.hex(key)), 12, "0"))


def iso(ts) -> "F.Column":
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


class Fixtures(Tables):
    """Derived views (FIXTURES.md section 3)."""

    # -- lineage model ---------------------------------------------------
    def jobs(self) -> DataFrame:
        c = self.customer
        return c.select(
            F.col("c_custkey").alias("id"),
            F.col("c_mktsegment").alias("namespace"),
            F.col("c_name").alias("name"),
            F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int"))
            .cast("timestamp_ntz").alias("created_at"),
        )

    def runs(self) -> DataFrame:
        o = self.orders
        return o.select(
            F.col("o_orderkey").alias("run_id"),
            F.col("o_custkey").alias("job_id"),
            F.when(F.col("o_orderstatus") == "F", "COMPLETE")
            .when(F.col("o_orderstatus") == "P", "FAIL").otherwise("RUNNING").alias("state"),
            F.col("o_orderdate").alias("started_at"),
            F.when(F.col("o_orderstatus") != "O",
                   F.col("o_orderdate") + F.make_dt_interval(
                       hours=(F.col("o_orderkey") % 48 + 1).cast("int"))).alias("ended_at"),
        )

    def datasets(self) -> DataFrame:
        p = self.part
        name = F.concat(F.lit("part_"), F.col("p_partkey").cast("string"))
        return p.select(
            F.col("p_partkey").alias("id"),
            F.col("p_brand").alias("namespace"),
            name.alias("name"),
            F.concat(F.lit("lake://tables/"), name).alias("source_uri"),
        )

    def edges(self) -> DataFrame:
        li = self.lineitem
        return li.groupBy(
            F.col("l_orderkey").alias("run_id"),
            F.col("l_partkey").alias("dataset_id"),
            F.when(F.col("l_linestatus") == "O", "OUTPUT").otherwise("INPUT").alias("direction"),
        ).agg(F.max("l_shipdate").alias("created_at"))

    # -- request / queue / monitoring streams ----------------------------
    def requests(self) -> DataFrame:
        e = self.events
        return e.select(
            F.col("event_id").alias("request_id"),
            F.col("user_id").alias("client_id"),
            F.col("ts").alias("start_time"),
            F.col("event_type").alias("endpoint"),
            F.when(F.col("event_id") % 3 == 0, "POST").otherwise("GET").alias("method"),
            F.when(F.col("event_type") == "error", 500)
            .when(F.col("event_id") % 50 == 0, 404).otherwise(200).alias("status_code"),
            (F.col("value") / 100.0).alias("duration"),
        )

    def tenant_requests(self) -> DataFrame:
        """Requests with the caller's tenant (customer nation) and user name."""
        r = self.requests()
        c = self.customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
        n = self.nation.select("n_nationkey", "n_name")
        j = r.join(c, r.client_id == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        return j.select(*r.columns, F.col("n_name").alias("tenant"),
                        F.concat(F.col("c_mktsegment"), F.lit("_"), F.col("c_name")).alias("user"))

    def messages(self) -> DataFrame:
        e = self.events
        return e.select(
            F.col("event_id").alias("msg_id"),
            F.when(F.col("event_type") == "error", "lineage_events_dlq")
            .when(F.col("event_type") == "signup", "lineage_notifications")
            .otherwise("lineage_events").alias("queue_name"),
            F.col("ts").alias("enqueued_at"),
            F.timestamp_add("SECOND", F.col("event_id") % 120, F.col("ts")).alias("archived_at"),
            (F.col("event_id") % 8).alias("read_ct"),
            F.col("props").alias("message"),
        )

    def trades(self) -> DataFrame:
        return self.events.filter(F.col("event_type") == "purchase").select(
            F.col("event_id").alias("trade_id"), F.col("user_id").alias("symbol"), "ts")

    def prices(self) -> DataFrame:
        return self.events.filter(F.col("event_type") == "view").select(
            F.col("user_id").alias("symbol"), "ts", F.col("value").alias("price"))

    def samples(self) -> DataFrame:
        return self.events.select(
            F.col("user_id").alias("component"), "ts", "event_id",
            (F.lit(50000000).cast("long") + (F.col("event_id") % 97) * 4194304).alias("rss"))

    def pings(self) -> DataFrame:
        kind = (F.when(F.col("event_type") == "click", "ping")
                .when(F.col("event_type") == "view", "pong")
                .when(F.col("event_type") == "error", "write_error")
                .when(F.col("event_type") == "signup", "queue_full")
                .otherwise("connect"))
        return self.events.select(F.col("user_id").alias("client_id"), "ts", "event_id", kind.alias("kind"))

    def changelog(self) -> DataFrame:
        typ = (F.when(F.col("event_type") == "error", "table_deleted")
               .when(F.col("event_type") == "signup", "table_created").otherwise("table_updated"))
        return self.events.select(
            F.col("user_id").alias("entity_id"), "ts", F.col("event_id").alias("seq"),
            typ.alias("type"), F.col("value").alias("row_count"))

    @staticmethod
    def _pg_line():
        level = (F.when(F.col("event_type") == "error", "ERROR")
                 .when(F.col("event_type") == "signup", "FATAL").otherwise("LOG"))
        body = (F.when(F.col("event_type") == "click",
                       F.concat(F.lit("duration: "), F.col("event_id").cast("string"), F.lit(".5 ms")))
                .when(F.col("event_type") == "view", F.lit("queue: lineage_events"))
                .when(F.col("event_type") == "purchase",
                      F.lit('automatic vacuum of table "lake.public.t"'))
                .otherwise(F.lit("connection failed")))
        return F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" UTC ["),
                        F.col("user_id").cast("string"), F.lit("] "), level, F.lit(": "), body)

    def log_lines(self) -> DataFrame:
        return self.events.select("event_id", "ts", F.col("user_id").alias("pid"), self._pg_line().alias("line"))

    def raw_logs(self) -> DataFrame:
        """Mixed log stream: database lines, JSON backend lines and plain worker
        lines, with container/namespace labels."""
        e = self.events
        r = F.col("user_id") % 3
        container = F.when(r == 0, "postgresql").when(r == 1, "backend").otherwise("worker")
        err = F.col("event_type") == "error"
        eid, uid = F.col("event_id").cast("string"), F.col("user_id").cast("string")
        js = F.concat(
            F.lit('{"timestamp":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
            F.lit('","level":"'), F.when(err, "ERROR").otherwise("INFO"),
            F.lit('","service":"lakeline-api","message":"'), F.col("event_type"), F.lit(' handled","request_id":"'),
            eid, F.lit('","job_name":"job_'), uid, F.lit('","table_name":"t'), uid, F.lit('"'),
            F.when(err, F.lit(',"error":"boom"')).otherwise(F.lit("")), F.lit("}"))
        worker = F.when(err, F.concat(F.lit("worker error: failed item "), eid)).otherwise(
            F.concat(F.lit("worker processed item "), eid, F.lit(" INFO")))
        return e.select(
            "event_id", "ts", container.alias("container"),
            F.when(r == 0, "database").otherwise("apps").alias("namespace"),
            F.when(r == 0, self._pg_line()).when(r == 1, js).otherwise(worker).alias("line"))

    def snapshots(self) -> DataFrame:
        e = self.events
        return e.select(
            F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("table_name"),
            F.col("event_id").alias("snapshot_id"),
            F.col("ts").alias("created_at"),
            F.concat(F.lit("/snap/"), F.col("event_id").cast("string")).alias("uri"),
            F.lit("parquet").alias("format"),
        )

    def employees(self) -> DataFrame:
        s = self.supplier
        return s.select(
            F.col("s_suppkey").alias("employee_id"),
            F.when(F.col("s_suppkey") != 0, F.floor((F.col("s_suppkey") - 1) / 3.0)).alias("manager_id"),
            F.col("s_name").alias("name"),
            F.col("s_nationkey").alias("nation_id"),
        )

    # -- event streams -----------------------------------------------------
    def sse_events(self) -> DataFrame:
        """Server-sent events: one per source event, typed by a fixed mapping."""
        typ = (F.when(F.col("event_type") == "click", "lineage_event")
               .when(F.col("event_type") == "view", "job_status")
               .when(F.col("event_type") == "purchase", "system_metric")
               .when(F.col("event_type") == "signup", "queue_status")
               .otherwise("error"))
        return self.events.select("event_id", typ.alias("event_type"), F.col("props").alias("data"),
                                  F.col("ts").alias("timestamp"), F.col("user_id").alias("origin"))

    def subscriptions(self) -> DataFrame:
        """One client per user; its subscription list follows ``user_id % 4``."""
        u = self.events.select(F.col("user_id").alias("client_id")).distinct()
        r = F.col("client_id") % 4
        subs = (F.when(r == 0, F.lit("lineage_event, job_status, system_metric"))
                .when(r == 1, F.lit("lineage_event,error"))
                .when(r == 2, F.lit(" job_status , error,bogus"))
                .otherwise(F.lit("system_metric,queue_status,error")))
        return u.select("client_id", subs.alias("events"))

    def notifications(self) -> DataFrame:
        e = self.events
        uid, eid = F.col("user_id").cast("string"), F.col("event_id").cast("string")
        msg = (F.when(F.col("event_type") == "click",
                      F.concat(F.lit('{"type":"job_status","job_name":"job_'), uid,
                               F.lit('","run_id":"'), eid, F.lit('","status":"running","progress":'),
                               (F.col("event_id") % 100).cast("string"), F.lit("}")))
               .when(F.col("event_type") == "purchase",
                     F.concat(F.lit('{"type":"system_metric","metric_type":"latency","value":'),
                              F.col("value").cast("string"), F.lit("}")))
               .when(F.col("event_type") == "view", F.lit('{"type":"job_status","status":"done"}'))
               .when(F.col("event_type") == "signup", F.lit('{"kind":"other"}'))
               .otherwise(F.lit("not json {")))
        return e.select(F.col("event_id").alias("msg_id"), F.col("ts").alias("enqueued_at"),
                        msg.alias("message"))

    def role_edges(self) -> DataFrame:
        emp = self.employees()
        return emp.filter(F.col("manager_id").isNotNull()).select(
            F.concat(F.lit("role_"), F.col("employee_id").cast("string")).alias("member"),
            F.concat(F.lit("role_"), F.col("manager_id").cast("string")).alias("parent"))

    def grants(self) -> DataFrame:
        emp = self.employees()
        return emp.select(
            F.concat(F.lit("role_"), F.col("employee_id").cast("string")).alias("role"),
            F.lit("SELECT").alias("privilege"),
            F.concat(F.lit("nation_"), F.col("nation_id").cast("string")).alias("object"))

    def ol_events(self) -> DataFrame:
        """OpenLineage events as JSON text: START per run, a terminal event per
        ended run (inputs/outputs from the edges), and malformed rows."""
        from lakeline.operators.lineage_events import build_events

        return build_events(self.runs(), self.jobs(), self.datasets(), self.edges(), self.events)
