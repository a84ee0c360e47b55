"""Structured Streaming jobs.

Every job reads a file stream (Parquet/JSON lines; Kafka works the same way
through ``spark.readStream.format('kafka')``), keeps its progress in a
checkpoint folder, and writes either with an idempotent ``foreachBatch``
(``batch=<id>`` folders written with overwrite, so a replayed micro-batch
replaces its own output) or with the file sink's exactly-once log.

Stateful operators are bounded: windows, sessions and dedup use a watermark;
latest-state keeps one row per key; the liveness detector keeps one small
state row per client with an event-time timer.

Event times in the test tables are zone-less (TIMESTAMP_NTZ), which
watermarks reject; streams cast them to TIMESTAMP (session time zone UTC).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from tempfile import TemporaryFile

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lakeline.functions import from_micros, micros
from lakeline.operators import lineage_events as E
from lakeline.operators import streams as S
from lakeline.session import DEFAULT_CONF
from lakeline.sources import commits
from lakeline.streaming.seen import SeenIds

WATERMARK = "10 minutes"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def _ltz(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.col(col).cast("timestamp"))


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .load(path))


def _trigger(writer, available_now: bool, interval: str):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)


def ev_fanout(events: DataFrame, subs: DataFrame, out_root: str, checkpoint: str, available_now: bool = True,
              interval: str = "10 seconds") -> StreamingQuery:
    """Deliveries per client and micro-batch, counted without (event, client) pairs."""
    writer = _batch_writer(out_root, lambda batch: {"deliveries": S.ev_fanout_counts(batch, subs)})
    w = events.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now, interval).start()


def _batch_writer(out_root: str, tables: Callable[[DataFrame], dict[str, DataFrame]], cache: bool = True):
    """foreachBatch body: derive tables from the batch (cached once when it
    feeds several outputs), write each to ``<out>/<table>/batch=<id>`` with
    overwrite, so a replayed batch replaces its own output."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if cache:
            batch = batch.persist()
        try:
            for name, df in tables(batch).items():
                df.write.mode("overwrite").parquet(f"{out_root.rstrip('/')}/{name}/batch={batch_id}")
        finally:
            if cache:
                batch.unpersist()

    return write


# ------------------------------------------------------------------ ingest

def st_ingest(spark: SparkSession, source: str, out_root: str, checkpoint: str, available_now: bool = True,
              interval: str = "10 seconds", files_per_trigger: int = 1) -> StreamingQuery:
    """Queue of OpenLineage events (seq, ts, payload) -> the normalised store.

    Each micro-batch is parsed and validated once and written as six tables: jobs,
    runs, datasets, edges (the batch's parts, one small row per key), run_events and
    dead letters.  ``store_tables`` merges the parts, so a run whose events span
    batches resolves without reading events again.  A message delivered again, in
    the same or any later batch, is dropped by its id (``seen``: runs of ids, of which a
    batch reads the pages its own ids fall into only, so a batch costs the same however many
    came before); a replayed batch replaces its own output.  The tables are written at
    the same time, each from the columns it needs of the validated events, which wait in
    files for the length of the batch, so executors hold none.  The ack is the checkpoint commit."""
    stream = file_stream(spark, source, "seq bigint, ts timestamp_ntz, payload string", "parquet", files_per_trigger)
    root = out_root.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        ids = SeenIds(batch.sparkSession, f"{root}/_seen", batch_id)
        valid, path = E.ol_validate(E.ol_parse(ids.fresh(batch, "seq"))), f"{root}/_valid/batch={batch_id}"
        valid.write.mode("overwrite").parquet(path)
        valid = batch.sparkSession.read.schema(valid.schema).parquet(path)
        good, bad = E.split_valid(valid)
        tables = {"jobs": E.ol_jobs(good), "runs": E.run_parts(good), "datasets": E.dataset_parts(good),
                  "edges": E.ol_edges(good), "dead_letters": bad, "run_events": E.ol_run_events(good)}

        def put(name: str) -> None:
            tables[name].write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")

        try:
            inherit = inheritable_thread_target(batch.sparkSession)
            with ThreadPoolExecutor(len(tables) + 1) as pool:
                jobs = [pool.submit(inherit(put), name) for name in tables]
                jobs.append(pool.submit(inherit(ids.store), valid, "seq"))
                for job in jobs:
                    job.result()
        finally:
            commits.delete(batch.sparkSession, path)

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now, interval).start()


def store_tables(spark: SparkSession, out_root: str) -> dict[str, DataFrame]:
    """The lineage store: the ingested batches' parts merged per key (lazy aggregates
    over small rows; payloads are not read)."""
    def read(name: str) -> DataFrame:
        path = f"{out_root.rstrip('/')}/{name}"
        return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")

    jobs = read("jobs").groupBy("id", "namespace", "name").agg(F.min("created_at").alias("created_at"))
    edges = read("edges").groupBy("run_id", "namespace", "name", "direction").agg(F.min("created_at").alias("created_at"))
    return {"jobs": jobs, "runs": E.runs_of(read("runs")), "datasets": E.datasets_of(read("datasets")),
            "edges": edges, "run_events": read("run_events")}


def st_transform(stream: DataFrame, fn: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
                 available_now: bool = True, interval: str = "10 seconds") -> StreamingQuery:
    """Stateless operator on a stream (routing, presets, envelopes, dead-letter
    split): the same ``DataFrame -> DataFrame`` function as in batch, written
    by the exactly-once file sink."""
    return _file_sink(fn(stream), out, checkpoint, "append", available_now, interval)


# ------------------------------------------------------------------ windows, sessions, dedup

def _file_sink(df: DataFrame, out: str, checkpoint: str, mode: str, available_now: bool, interval: str):
    w = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now, interval).start()


def st_window_tumbling(events: DataFrame, out: str, checkpoint: str, size: str = "1 hour",
                       keys: tuple[str, ...] = ("event_type",), ts: str = "ts", available_now: bool = True,
                       interval: str = "10 seconds") -> StreamingQuery:
    e = _ltz(events, ts).withWatermark(ts, WATERMARK)
    agg = e.groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"), *keys, "n")
    return _file_sink(agg, out, checkpoint, "append", available_now, interval)


def st_window_sliding(events: DataFrame, out: str, checkpoint: str, size: str = "60 seconds",
                      slide: str = "10 seconds", ts: str = "ts", available_now: bool = True,
                      interval: str = "10 seconds") -> StreamingQuery:
    e = _ltz(events, ts).withWatermark(ts, WATERMARK)
    agg = e.groupBy(F.window(ts, size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n")
    return _file_sink(agg, out, checkpoint, "append", available_now, interval)


def st_session(events: DataFrame, out: str, checkpoint: str, key: str = "client_id", ts: str = "ts",
               gap_s: int = 120, available_now: bool = True, interval: str = "10 seconds") -> StreamingQuery:
    """Sessions as in batch: a gap of more than ``gap_s`` closes one.  A session
    window closes at its gap exactly, hence the microsecond on top."""
    e = _ltz(events, ts).withWatermark(ts, WATERMARK)
    gap = f"{gap_s} seconds 1 microsecond"
    end = F.timestamp_micros(F.unix_micros("s.end") - 1)
    agg = e.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("events")).select(
        key, F.col("s.start").cast("timestamp_ntz").alias("session_start"),
        end.cast("timestamp_ntz").alias("session_end"), "events")
    return _file_sink(agg, out, checkpoint, "append", available_now, interval)


def first_deliveries(key: str, ts: str):
    """mapInArrow body: of each key's rows in the partition the one with the least time, null times first.

    Rows wait in a local file; memory holds a key and a time of each."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, writer = [], None
        with TemporaryFile() as file:
            for batch in batches:
                writer = writer or pa.ipc.new_stream(file, batch.schema)
                writer.write_batch(batch)
                marks.append(pa.table([batch.column(key), batch.column(ts)], ["k", "t"]))
            if writer is None:
                return
            writer.close()
            rows = pa.concat_tables(marks)
            at = pc.sort_indices(rows, sort_keys=[("t", "ascending")], null_placement="at_start")  # a stable sort
            held = pa.table([rows.column("k").take(at), at], ["k", "at"]).group_by("k", use_threads=False).aggregate([("at", "first")])
            stays = pc.sort_indices(held.column("at_first"))
            stays, done = held.column("at_first").take(stays).to_numpy(), 0
            file.seek(0)
            for batch in pa.ipc.open_stream(file):
                here = stays[stays.searchsorted(done) : stays.searchsorted(done + batch.num_rows)] - done
                done += batch.num_rows
                yield batch.take(pa.array(here))

    return first


def st_dedup(messages: DataFrame, out: str, checkpoint: str, key: str = "msg_id", ts: str = "enqueued_at",
             available_now: bool = True, interval: str = "10 seconds") -> StreamingQuery:
    """Exactly-once by message id: duplicates inside the watermark are dropped
    and the key state expires with it.  Of deliveries in one micro-batch the first by time
    stays, however many tasks read them."""
    m = messages.repartition(key).mapInArrow(first_deliveries(key, ts), messages.schema)
    m = _ltz(m, ts).withWatermark(ts, WATERMARK).dropDuplicatesWithinWatermark([key])
    m = m.withColumn(ts, F.col(ts).cast("timestamp_ntz"))
    return _file_sink(m, out, checkpoint, "append", available_now, interval)


# ------------------------------------------------------------------ latest state

def ev_latest_state(changes: DataFrame, out_root: str, checkpoint: str, key: str = "entity_id",
                    order: tuple[str, ...] = ("ts", "seq"), available_now: bool = True,
                    interval: str = "10 seconds", compact_every: int = 20,
                    forget_deleted_s: int | None = None) -> StreamingQuery:
    """Changelog -> current row per key.  A streaming aggregate keeps one state row per
    key (``max_by`` by (ts, seq)); a deleted key keeps its delete, the mark against
    late changes, for ever or, with ``forget_deleted_s``, while changes that late are
    taken at all (``newest_per_key``).  Each micro-batch writes the keys that changed as
    ``changes/batch=<id>``; every ``compact_every`` batches the changes so far are
    folded into one row per live key (``base=<id>``), so ``current_state`` reads one
    base and the few batches after it."""
    cols = [c for c in changes.columns if c != key]
    o = F.struct(*[F.col(c) for c in order])
    if forget_deleted_s is None:
        agg = changes.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), o).alias("s"))
        flat = agg.select(key, *[F.col("s." + c).alias(c) for c in cols])
    else:
        flat = newest_per_key(changes, key, order, forget_deleted_s)
    root = out_root.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/changes/batch={batch_id}")
        if batch_id and batch_id % compact_every == 0:
            now = current_state(batch.sparkSession, out_root, key, order, before=batch_id)
            now.write.mode("overwrite").parquet(f"{root}/base/base={batch_id}")

    w = flat.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    with _rocks_state(changes.sparkSession):
        return _trigger(w, available_now, interval).start()


def newest_per_key(changes: DataFrame, key: str, order: tuple[str, ...], forget_deleted_s: int,
                   delete_suffix: str = "_deleted") -> DataFrame:
    """A stream of each key's new newest row (``transformWithState``).  State is the order
    columns of a key's newest row.  The first order column is the event time; changes
    more than ``forget_deleted_s`` behind the latest one are late and left out, and a
    timer drops a delete's state once all older changes are late.  So the state is
    bounded by the live keys and the recent deletes, and no deleted key comes back.
    Each task first keeps its newest row per key, so a hot key brings one row a task.
    Rows equal in all order columns: the one met first stays.  Rows without an event
    time are left out; other null order values are the least; null keys are one key.
    """
    schema = changes.schema
    mark = T.StructType([*[T.StructField(f"o{i}", schema[c].dataType) for i, c in enumerate(order)], T.StructField("timer", T.LongType())])

    def newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
            at = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order], null_placement="at_start")
            rows = rows.take(at)
            last = pa.table([rows.column(key), pa.array(range(rows.num_rows), pa.int64())], ["k", "at"])
            held = rows.take(last.group_by("k").aggregate([("at", "max")]).column("at_max"))
            if held.num_rows > 200_000:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    def rank(values) -> tuple:
        return tuple((v is not None, v) if v is not None else (False,) for v in values)

    class Newest(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("newest", mark)

        def handleInputRows(self, key, rows, timerValues):
            best = max(rows, key=lambda r: rank(r[c] for c in order))
            at = tuple(best[c] for c in order)
            held = self.state.get()  # each call on state is a round trip
            if held and rank(held[:-1]) >= rank(at):
                return
            if held and held[-1] is not None:
                self.handle.deleteTimer(held[-1])
            timer = best["__us"] // 1000 + 1 if (best["type"] or "").endswith(delete_suffix) else None
            if timer is not None:
                self.handle.registerTimer(timer)
            self.state.update((*at, timer))
            yield Row(**{c: best[c] for c in names})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.state.clear()
            return iter([])

        def close(self) -> None:
            pass

    names = changes.columns
    reduced = changes.filter(F.col(order[0]).isNotNull()).mapInArrow(newest, schema)
    reduced = reduced.withColumns({"__us": micros(order[0]), "__at": F.col(order[0]).cast("timestamp")})
    reduced = reduced.withWatermark("__at", f"{forget_deleted_s} seconds")
    return reduced.groupBy(key).transformWithState(Newest(), schema, "update", "eventTime")


@contextmanager
def _rocks_state(spark: SparkSession) -> Iterator[None]:
    """transformWithState needs the RocksDB state store; a stream keeps the setting it was started with."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, DEFAULT_CONF[STATE_STORE])
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def current_state(spark: SparkSession, out_root: str, key: str = "entity_id",
                  order: tuple[str, ...] = ("ts", "seq"), before: int | None = None) -> DataFrame:
    """The newest row per key of the last base and the batches after it, less deleted
    keys; ``before``: as of that batch, itself included."""
    root = out_root.rstrip("/")
    changes = spark.read.option("basePath", f"{root}/changes").parquet(f"{root}/changes/batch=*")
    bases = _stored_partitions(spark, f"{root}/base", "base")
    bases = [b for b in bases if before is None or b < before]
    if before is not None:
        changes = changes.filter(F.col("batch") <= before)
    if bases:
        changes = changes.filter(F.col("batch") > max(bases))
        changes = changes.drop("batch").unionByName(spark.read.parquet(f"{root}/base/base={max(bases)}"))
    return S.ev_latest_state(changes.drop("batch"), key, list(order))


def _stored_partitions(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the ``name=<number>`` folders under ``path``."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = fs.listStatus(folder) if fs.exists(folder) else []
    names = [x.getPath().getName() for x in listed]
    return [int(n.split("=")[1]) for n in names if n.startswith(f"{name}=")]


# ------------------------------------------------------------------ liveness

LIVENESS_STATE = ("connected long, base long, seen long, pinged boolean, ponged boolean, missed long, "
                  "queue_full long, write_errors long, reported boolean, timer long")
SLOT_US = 1_000_000


def ping_slots(batches):
    """mapInArrow body: (client_id, slot, kind, us) -> one row per client, second and
    kind of the partition, with the number of rows and the first and last time."""
    keys = ["client_id", "slot", "kind"]
    names = [*keys, "n", "first", "last"]

    def grouped(parts: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(parts).group_by(keys).aggregate([("n", "sum"), ("first", "min"), ("last", "max")])
        return sums.select([*keys, "n_sum", "first_min", "last_max"]).rename_columns(names)

    held, rows = [], 0
    for batch in batches:
        one = pa.nulls(batch.num_rows, pa.int64()).fill_null(1)
        held.append(grouped([pa.table([*(batch.column(k) for k in keys), one, batch.column("us"), batch.column("us")], names)]))
        rows += held[-1].num_rows
        if rows > 500_000:
            held = [grouped(held)]
            rows = held[0].num_rows
            if rows > 250_000:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from grouped(held).to_batches()


def ev_liveness(pings: DataFrame, out: str, checkpoint: str, available_now: bool = True,
                interval: str = "10 seconds") -> StreamingQuery:
    """Zombie detection as a stateful stream (``transformWithState``): a value state per
    client and one event-time timer, at last ping + 120 s.

    Before the shuffle each task folds its rows into one per client, second and kind, so
    a client brings at most a few rows per task and second of a micro-batch however many
    pings it sends.  Kinds within one second count in the order of their last events.  A
    client is reported once, at the event that trips a rule, or at last ping + 120 s (no
    pong after 90 s as well); a pong after a report is ``recovered`` and the rules start
    again.  A day after the last sign of a reported client its state is dropped.  As
    timeouts carry the time they fell due, results do not hang on how input in time
    order is cut into micro-batches.  Rows without a time are left out.
    """
    # Thresholds are copied into the class so it ships by value (executors need no package of ours).
    max_missed, max_qfull, max_werr = S.MAX_MISSED_PINGS, S.MAX_QUEUE_FULL, S.MAX_WRITE_ERRORS
    timeout, grace, forget = S.PING_TIMEOUT_S * 1_000_000, S.NO_PONG_GRACE_S * 1_000_000, 86_400_000_000
    connected, base, seen, pinged, ponged, missed, qfull, werr, reported, timer = range(10)

    def settle(s: list | None, t: int, out: list) -> list | None:
        """What fell due before ``t``: a timeout, then the end of a reported client's state."""
        if s and not s[reported] and s[base] + timeout < t:
            s[reported], s[seen] = True, max(s[seen], s[base] + timeout)
            out.append(("ping_timeout", s[base] + timeout))
        return None if s and s[reported] and s[seen] + forget < t else s

    def fold(s: list | None, kind: str, n: int, first: int, last: int, out: list) -> list:
        s = settle(s, first, out) or [first, first, first, False, False, 0, 0, 0, False, None]
        s[seen] = max(s[seen], last)
        if kind == "ping":
            s[base], s[pinged], s[missed] = last, True, s[missed] + n
        elif kind == "pong":
            s[ponged], s[missed] = True, 0
            if s[reported]:
                s[base], s[qfull], s[werr], s[reported] = last, 0, 0, False
                out.append(("recovered", last))
        elif kind == "queue_full":
            s[qfull] += n
        elif kind == "write_error":
            s[werr] += n
        if not s[reported]:
            reason = ("missed_pings" if s[missed] > max_missed else "queue_full" if s[qfull] > max_qfull
                      else "write_errors" if s[werr] > max_werr
                      else "no_pong" if s[pinged] and not s[ponged] and last - s[connected] > grace else None)
            if reason:
                s[reported] = True
                out.append((reason, last))
        return s

    class Liveness(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("client", LIVENESS_STATE)

        def held(self) -> list | None:
            s = self.state.get()  # none or nothing in it: no state
            return list(s) if s else None

        def keep(self, s: list | None, old: int | None, watermark_ms: int, out: list) -> None:
            """Store the state and move the client's timer to when something next falls due."""
            s = settle(s, watermark_ms * 1000, out)
            due = None if s is None else ((s[seen] + forget) if s[reported] else (s[base] + timeout)) // 1000 + 1
            if old is not None and old != due:
                self.handle.deleteTimer(old)
            if s is None:
                self.state.clear()
                return
            if due != old:
                self.handle.registerTimer(due)
            s[timer] = due
            self.state.update(tuple(s))

        def rows_of(self, key: tuple, out: list) -> Iterator[Row]:
            return (Row(none=key[0], client=key[1], reason=reason, us=us) for reason, us in out)

        def handleInputRows(self, key, rows, timerValues):
            slots: dict = {}
            for r in rows:
                n, first, last = slots.get((r["slot"], r["kind"]), (0, r["first"], r["last"]))
                slots[r["slot"], r["kind"]] = n + r["n"], min(first, r["first"]), max(last, r["last"])
            s, out = self.held(), []
            old = s[timer] if s else None
            for (_, kind), (n, first, last) in sorted(slots.items(), key=lambda x: (x[0][0], x[1][2], x[0][1])):
                s = fold(s, kind, n, first, last, out)
            self.keep(s, old, timerValues.getCurrentWatermarkInMs(), out)
            yield from self.rows_of(key, out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            out: list = []
            self.keep(self.held(), None, timerValues.getCurrentWatermarkInMs(), out)
            yield from self.rows_of(key, out)

        def close(self) -> None:
            pass

    p = pings.filter("ts IS NOT NULL").select("client_id", micros("ts").alias("us"), F.coalesce("kind", F.lit("connect")).alias("kind"))
    p = p.select("client_id", (F.col("us") - F.pmod("us", F.lit(SLOT_US))).alias("slot"), "kind", "us")
    p = p.mapInArrow(ping_slots, "client_id long, slot long, kind string, n long, first long, last long")
    p = p.withColumn("at", F.timestamp_micros("last")).withWatermark("at", WATERMARK)
    p = p.withColumns({"none": F.isnull("client_id"), "client": F.coalesce("client_id", F.lit(0))})
    z = p.groupBy("none", "client").transformWithState(
        Liveness(), "none boolean, client long, reason string, us long", "append", "eventTime")
    z = z.select(F.when(~F.col("none"), F.col("client")).alias("client_id"), "reason", from_micros("us").alias("detected_at"))
    with _rocks_state(pings.sparkSession):
        return _file_sink(z, out, checkpoint, "append", available_now, interval)


# ------------------------------------------------------------------ helpers for tests / registered runs

def write_in_event_order(df: DataFrame, path: str, ts: str, files: int = 4, parts: int = 1, whole_us: int = 1) -> str:
    """Write ``df`` as one Parquet file per time slice (``files`` equal slices between
    the first and the last time; null times first) and return the path to stream
    from.  One partitioned write; the files' modification times are then set in
    time order, which is the order a file stream reads them in, so nothing is late.
    With ``parts`` the slices are cut further in time order, into about ``files`` x ``parts``
    files of equally many rows, a task each; a stream takes ``parts`` + 1 of them a micro-batch.
    Rows of one stretch of ``whole_us`` microseconds (1: no more than that) go to one file.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    us = us - F.pmod(us, F.lit(whole_us))
    bounds = df.select(F.struct(F.min(us).alias("lo"), F.max(us).alias("hi"))).scalar()
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    part = F.when(hi > lo, F.least(F.floor((us - lo) * files / (hi - lo)), F.lit(files - 1))).otherwise(0)
    part = F.coalesce(part.cast("int"), F.lit(-1))
    cut = df.withColumn("slice", part)
    if parts == 1:
        cut = cut.repartition(files, "slice")
    elif whole_us == 1:  # rows of one time may go to several files
        cut = cut.repartitionByRange(files * parts, "slice", ts, F.xxhash64(*df.columns))
    else:
        cut = cut.repartitionByRange(files * parts, "slice", us)
    cut.sortWithinPartitions("slice", ts).write.mode("append").partitionBy("slice").parquet(path)
    spark = df.sparkSession
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/slice=*").select("path")

    def place(file: str) -> tuple[int, str]:
        of, name = file.rsplit("/slice=", 1)[1].split("/")
        return int(of), name  # names begin with the number of the task, whose ranges are in time order

    names = sorted((r.path for r in listed.collect()), key=place)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for i, name in enumerate(names):
        file = hadoop(name)
        fs = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.setTimes(file, 1_600_000_000_000 + 1000 * i, -1)
    return f"{path}/slice=*"
