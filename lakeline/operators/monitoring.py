"""Monitoring aggregations over request, query, memory and catalog samples
(SURVEY 2.6).  "Now" is always a parameter or the input's own latest
timestamp (a scalar subquery), never the wall clock, so results replay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeline.functions import (exact_avg, exact_sum, from_micros, max_of, micros, ratio_or_zero,
                                round_half_up_ratio, scaled)
from lakeline.operators.scan import chunked, lag_rows, running
from lakeline.session import shuffle_partitions

# Default histogram bucket bounds of the Prometheus client library.
DEFAULT_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]

# Windows of a block of the spine of all windows.
SPINE_BLOCK = 8192

HEALTH_ORDER = ("healthy", "warning", "unhealthy", "error")


def _asof(df: DataFrame, ts: str, asof) -> Column:
    if asof is None:
        return max_of(df, ts)
    return F.lit(asof).cast("timestamp_ntz") if isinstance(asof, str) else asof


def _avg(c: str, scale: int | None) -> Column:
    return exact_avg(c, scale) if scale else F.avg(c)


def mon_requests_window(requests: DataFrame, seconds: int = 300, asof=None, scale: int | None = None) -> DataFrame:
    """Last ``seconds`` before ``asof``: total, avg/min/max duration, rps and error rate."""
    now = _asof(requests, "start_time", asof)
    r = requests.filter(F.col("start_time") >= now - F.make_dt_interval(secs=F.lit(seconds)))
    return r.agg(
        F.count(F.lit(1)).alias("total_requests"),
        _avg("duration", scale).alias("avg_duration"),
        F.min("duration").alias("min_duration"),
        F.max("duration").alias("max_duration"),
        (F.count(F.lit(1)) / float(seconds)).alias("rps"),
        ratio_or_zero(F.sum((F.col("status_code") >= 400).cast("long")), F.count(F.lit(1))).alias("error_rate"))


def mon_throughput(requests: DataFrame, window_s: int = 60, step_s: int = 10, scale: int = 10000) -> DataFrame:
    """Every ``step_s``: requests, rps, avg response and error rate over the
    trailing ``window_s``; windows without requests report zeros.

    Requests are pre-aggregated into ``step_s`` buckets (one row per busy bucket); each
    is added to the windows that cover it, and those meet the spine of all windows once.
    The spine is cut into blocks of ``SPINE_BLOCK`` windows, dealt over the partitions
    and unfolded there, so a far outlying time makes more blocks and no longer task.
    Nothing runs while the plan is built.  Requests without a time count in no window;
    no request with a time: no window.
    """
    step_us = step_s * 1_000_000
    k = window_s // step_s
    at = (F.floor(micros("start_time") / step_us) * step_us).cast("long")
    b = requests.select(at.alias("bucket"), scaled("duration", scale).alias("duration"),
                        (F.col("status_code") >= 400).cast("long").alias("err"))
    buckets = b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("dsum"),
                                      F.sum("err").alias("errs"))
    step, block = F.lit(step_us).cast("long"), F.lit(SPINE_BLOCK * step_us).cast("long")
    covers = F.sequence(F.col("bucket") - (k - 1) * step, F.col("bucket"), step)
    covered = buckets.where("bucket IS NOT NULL").select(F.explode(covers).alias("ws"), "n", "dsum", "errs")
    covered = covered.groupBy("ws").agg(F.sum("n").alias("n"), F.sum("dsum").alias("dsum"), F.sum("errs").alias("errs"))
    ends = requests.select(at.alias("bucket")).agg((F.min("bucket") - (k - 1) * step).alias("lo"), F.max("bucket").alias("hi"))
    blocks = ends.select("hi", F.explode(F.sequence("lo", "hi", block)).alias("first"))
    blocks = blocks.repartition(shuffle_partitions(requests.sparkSession), "first")
    spine = blocks.select(F.explode(F.sequence("first", F.least(F.col("first") + block - step, "hi"), step)).alias("ws"))
    j = spine.join(covered, "ws", "left").select(
        "ws", F.coalesce("n", F.lit(0)).alias("requests"), "dsum", F.coalesce("errs", F.lit(0)).alias("errs"))
    return j.select(
        from_micros("ws").alias("window_start"),
        from_micros(F.col("ws") + window_s * 1_000_000).alias("window_end"),
        "requests",
        (F.col("requests") / float(window_s)).alias("rps"),
        (ratio_or_zero(F.col("dsum"), F.col("requests")) / float(scale)).alias("avg_response"),
        ratio_or_zero(F.col("errs"), F.col("requests")).alias("error_rate"))


def mon_active(requests: DataFrame) -> DataFrame:
    """Requests in flight after each start/finish event: running sum of
    +1 (start) / -1 (finish) in time order; finishes sort first on ties.
    The running sum is the skew-safe global scan (no single-partition window)."""
    start = requests.select("request_id", F.col("start_time").alias("ts"), F.lit(1).alias("delta"))
    end = requests.select(
        "request_id",
        from_micros(micros("start_time") + F.round(F.col("duration") * 1e6).cast("long")).alias("ts"),
        F.lit(-1).alias("delta"))
    u = start.unionByName(end)
    return running(u, [], ["ts", "delta", "request_id"], {"active": ("sum", "delta")})


def mon_endpoint_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("method", "endpoint", "status_code").agg(F.count(F.lit(1)).alias("requests"))


def mon_histogram(df: DataFrame, labels: list[str], value: str, bounds: list[float] | None = None,
                  scale: int | None = None) -> DataFrame:
    """Cumulative bucket counts (le = bound, '+Inf' last) with sum and count per
    label set.  All buckets are conditional sums in one aggregate pass; the
    result is unpivoted from the (label-sized) aggregate."""
    bounds = bounds or DEFAULT_BUCKETS
    aggs = [F.sum((F.col(value) <= b).cast("long")).alias(f"__b{i}") for i, b in enumerate(bounds)]
    aggs += [F.count(F.lit(1)).alias("__n"), (exact_sum(value, scale) if scale else F.sum(value)).alias("__sum")]
    g = df.groupBy(*labels).agg(*aggs)
    items = [F.struct(F.lit(repr(float(b))).alias("le"), F.col(f"__b{i}").alias("bucket_count"))
             for i, b in enumerate(bounds)]
    items.append(F.struct(F.lit("+Inf").alias("le"), F.col("__n").alias("bucket_count")))
    return g.select(*labels, F.explode(F.array(*items)).alias("b"), "__n", "__sum").select(
        *labels, "b.le", "b.bucket_count", F.col("__sum").alias("sum"), F.col("__n").alias("count"))


def mon_query_stats(stats: DataFrame, operation: str, duration: str, ts: str, hours: int = 1,
                    asof=None, scale: int | None = None) -> DataFrame:
    """Last ``hours`` before asof: count/avg/min/max per operation plus an
    overall row (operation '*')."""
    now = _asof(stats, ts, asof)
    s = stats.filter(F.col(ts) >= now - F.make_dt_interval(hours=F.lit(hours)))
    aggs = [F.count(F.lit(1)).alias("n"), _avg(duration, scale).alias("avg_duration"),
            F.min(duration).alias("min_duration"), F.max(duration).alias("max_duration")]
    per = s.groupBy(F.col(operation).alias("operation")).agg(*aggs)
    total = s.agg(*aggs).select(F.lit("*").alias("operation"), "*")
    return per.unionByName(total)


def mon_slow(df: DataFrame, duration: str, threshold: float = 1.0, k: int = 10, tiebreak: str | None = None) -> DataFrame:
    """Top ``k`` slowest above the threshold (TakeOrderedAndProject)."""
    order = [F.col(duration).desc()] + ([F.col(tiebreak)] if tiebreak else [])
    return df.filter(F.col(duration) > threshold).orderBy(*order).limit(k)


def mon_mem_stats(samples: DataFrame, key: str = "component") -> DataFrame:
    """Per key: min/max/avg rss and growth = (last - first) / seconds between
    them; 0 with fewer than 2 samples or a non-positive time span."""
    o = F.struct(F.col("ts"), F.col("event_id"))
    g = samples.groupBy(key).agg(
        F.count(F.lit(1)).alias("samples"), F.min("rss").alias("min_rss"), F.max("rss").alias("max_rss"),
        (F.sum("rss") / F.count(F.lit(1))).alias("avg_rss"),
        F.min_by("rss", o).alias("first_rss"), F.max_by("rss", o).alias("last_rss"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    dt = (micros("last_ts") - micros("first_ts")) / 1e6
    growth = F.when((F.col("samples") >= 2) & (dt > 0), (F.col("last_rss") - F.col("first_rss")) / dt).otherwise(0.0)
    return g.select(key, "samples", "min_rss", "max_rss", "avg_rss", growth.alias("growth_per_sec"))


def mon_mem_leak(samples: DataFrame, threshold: int, key: str = "component", lookback: int = 9) -> DataFrame:
    """Alert rows: rss grew by more than ``threshold`` over the last
    ``lookback`` samples (needs lookback + 1 samples)."""
    lj = lag_rows(samples, [key], ["ts", "event_id"], ["rss"], lookback, prefix="ago_")
    return lj.filter((F.col("rss") - F.col("ago_rss")) > threshold).select(
        key, "ts", "event_id", "rss", F.col("ago_rss").alias("rss_before"),
        (F.col("rss") - F.col("ago_rss")).alias("growth"))


def mon_mem_components(allocs: DataFrame, key: str, order: list, size: str) -> DataFrame:
    """Running bytes allocated per component (skew-safe scan) and MB."""
    r = running(allocs, [key], order, {"running_bytes": ("sum", size)})
    return r.withColumn("running_mb", F.col("running_bytes") / 1048576.0)


def mon_retention(df: DataFrame, ts: str, hours: float = 1.0, asof=None) -> DataFrame:
    """Keep samples newer than ``hours`` before asof."""
    now = _asof(df, ts, asof)
    return df.filter(F.col(ts) > now - F.make_dt_interval(secs=F.lit(hours * 3600)))


def mon_hit_ratio(hits: Column, reads: Column) -> Column:
    """round(100 * hits / (hits + reads), 2) half up; 0 when both are 0."""
    return round_half_up_ratio(hits, hits + reads, 100, 2)


def mon_run_metrics(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Per run: duration seconds, rows processed, rows/s (0 if no positive
    duration), success = finished without error."""
    r = runs.join(rows, "run_id", "left")
    dur = (micros("ended_at") - micros("started_at")) / 1e6
    return r.select("run_id", dur.alias("duration_s"), F.coalesce("rows", F.lit(0)).alias("rows"),
                    F.when(dur > 0, F.coalesce("rows", F.lit(0)) / dur).otherwise(0.0).alias("rows_per_sec"),
                    (F.col("state") == "COMPLETE").alias("success"))


def mon_health(checks: DataFrame, group: list[str], status: str = "status") -> DataFrame:
    """Overall status per group: any unhealthy/error -> unhealthy; else any
    warning -> warning; else healthy; with counts per status."""
    s = F.col(status)
    g = checks.groupBy(*group).agg(
        F.count(F.lit(1)).alias("checks"),
        F.sum((s == "healthy").cast("long")).alias("healthy"),
        F.sum((s == "warning").cast("long")).alias("warnings"),
        F.sum(s.isin("unhealthy", "error").cast("long")).alias("failing"))
    overall = (F.when(F.col("failing") > 0, "unhealthy").when(F.col("warnings") > 0, "warning").otherwise("healthy"))
    return g.withColumn("overall", overall)


def config_hash(pairs: Column) -> Column:
    """First 16 hex chars of sha256 over sorted 'key=value' strings."""
    return F.left(F.sha2(F.concat_ws("|", F.array_sort(pairs)), 256), F.lit(16))


def mon_config_drift(configs: DataFrame, key: str, order: list, pairs: Column) -> DataFrame:
    """Config hash per snapshot and whether it changed vs the previous one."""
    h = configs.withColumn("config_hash", config_hash(pairs))
    lj = lag_rows(h, [key], order, ["config_hash"])
    return lj.withColumn("changed", F.col("prev_config_hash").isNotNull()
                                     & (F.col("prev_config_hash") != F.col("config_hash")))


def mon_success_rate(df: DataFrame, circuit: str, success: Column) -> DataFrame:
    return df.groupBy(circuit).agg(
        F.count(F.lit(1)).alias("total"), F.sum(success.cast("long")).alias("successes")).withColumn(
        "success_rate", ratio_or_zero(F.col("successes"), F.col("total")))


def _in_window(requests: DataFrame, user: str, ts: str, rid: str, window_s: int) -> DataFrame:
    """``__u``, ``__t``, ``__id``, ``__row`` and ``in_window``: the user's requests before
    the current one (by time, then id) in (ts - window, ts], with the scan's ``__chunk``.

    Each request adds one at its time and takes one away when it is ``window_s``
    old (before requests of that time), so one skew-safe running sum is the count."""
    rows = requests.filter(F.col(ts).isNotNull())
    here = rows.select(F.col(user).alias("__u"), F.col(ts).alias("__t"), F.lit(1).alias("__side"), F.col(rid).alias("__id"),
                       F.lit(1).alias("__w"), F.struct(*requests.columns).alias("__row"))
    gone = here.select("__u", from_micros(micros("__t") + window_s * 1_000_000).alias("__t"), F.lit(0).alias("__side"),
                       "__id", F.lit(-1).alias("__w"))
    order = ["__t", "__side", "__id"]
    u = chunked(here.unionByName(gone, allowMissingColumns=True), ["__u"], order)
    s = running(u, ["__u"], order, {"__n": ("sum", "__w")}).filter(F.col("__side") == 1)
    return s.withColumn("in_window", F.col("__n") - 1)


def mon_rate_limit(requests: DataFrame, user: str, ts: str, rid: str, window_s: int, limit: int) -> DataFrame:
    """Sliding-window audit: ``in_window`` counts the user's requests before the
    current one (by time, then id) in (ts - window, ts]; the request is over the
    limit when there are ``limit`` or more.  Requests without a time are not audited.
    """
    s = _in_window(requests, user, ts, rid, window_s)
    return s.select("__row.*", "in_window").withColumn("over_limit", F.col("in_window") >= limit)


def mon_rate_limit_admitted(requests: DataFrame, user: str, ts: str, rid: str, window_s: int, limit: int) -> DataFrame:
    """Rate limiting as it happens: a request is ``admitted`` when fewer than ``limit``
    admitted requests of its user lie in (ts - window, ts]; refused ones fill nothing.

    Fewer than ``limit`` requests of any kind in the window settle most requests at once.
    The state is the times of the last ``limit`` admitted requests; it is empty again at a
    request whose window holds none, so a user's requests fall into stretches that are
    independent of each other and are dealt over all tasks.  Within a stretch the state
    passes from one Arrow batch to the next in time order: settled requests are taken in
    runs, and from a refused one the walk jumps to the first at which a place is free.  A
    task holds a batch and the state.  A user who never pauses for a whole window is one
    stretch and read by one task, since each decision hangs on the ones before.
    """
    s = _in_window(requests, user, ts, rid, window_s)
    order = ["__t", "__side", "__id"]
    s = running(s.withColumn("__new", (F.col("in_window") == 0).cast("long")), ["__u"], order, {"__stretch": ("sum", "__new")})
    s = s.select("__u", "__stretch", "__t", "__id", "__row", "in_window", micros("__t").alias("__us"))
    parts = shuffle_partitions(requests.sparkSession)
    dealt = s.repartition(parts, "__u", "__stretch").sortWithinPartitions("__u", "__stretch", "__t", "__id")
    narrow = dealt.select("__row", "in_window", "__us")
    walked = narrow.mapInArrow(admission(window_s * 1_000_000, limit), T.StructType([*narrow.schema, T.StructField("admitted", T.BooleanType())]))
    return walked.select("__row.*", "in_window", "admitted")


def admission(window: int, limit: int):
    """Decide requests that come stretch by stretch in time order; a stretch begins where ``in_window`` is 0."""
    import numpy as np
    import pyarrow as pa

    def decide(batches):
        held: list[int] = []  # times of the last admitted requests, ``limit`` at most
        for batch in batches:
            before, times = (np.array(batch.column(c), np.int64) for c in (1, 2))
            admitted = np.zeros(len(times), bool)
            starts = np.flatnonzero(before == 0)
            for begin, end in zip(np.concatenate([[0], starts]), np.concatenate([starts, [len(times)]])):
                if begin < end and before[begin] == 0:
                    held = []
                i, unsettled = int(begin), np.flatnonzero(before[begin:end] >= limit) + begin
                while i < end and limit > 0:
                    at = np.searchsorted(unsettled, i)
                    settled = int(unsettled[at]) if at < len(unsettled) else int(end)
                    if i < settled:
                        admitted[i:settled] = True
                        held = (held + times[max(i, settled - limit) : settled].tolist())[-limit:]
                        i = settled
                    elif len(held) < limit or held[0] <= times[i] - window:
                        admitted[i] = True
                        held = (held + [int(times[i])])[-limit:]
                        i += 1
                    else:  # on to the first request at which the oldest has left, or that is settled
                        free = i + int(np.searchsorted(times[i:end], held[0] + window))
                        i = min(free, int(end))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(admitted)], [*batch.schema.names, "admitted"])

    return decide


def _tokens(items: DataFrame) -> DataFrame:
    tok = items.select("kind", "item_id", "name", F.explode(F.split(F.lower("name"), "[^a-z0-9]+")).alias("token"))
    return tok.filter(F.length("token") > 0)


def _edits(length: Column, term: str, threshold: float) -> Column:
    """Edits that a token of this length may be away from the term."""
    return F.floor(F.greatest(length, F.lit(len(term))) * threshold + 1e-9).cast("int")


def _score(tokens: DataFrame, term: str, threshold: float) -> DataFrame:
    """Tokens within the threshold with their score; the distance is banded by the most edits
    that any token of a fitting length may have."""
    most = int(threshold * len(term) / (1 - threshold) + 1e-9) if threshold < 1 else 1 << 30
    near = F.abs(F.length("token") - len(term)) <= _edits(F.length("token"), term, threshold)
    far = F.levenshtein("token", F.lit(term), most)
    scored = tokens.filter(near).withColumn("score", F.when(far >= 0, far / F.greatest(F.length("token"), F.lit(len(term)))))
    return scored.filter(F.col("score") <= threshold)


def cat_search(items: DataFrame, term: str, threshold: float = 0.3, min_term: int = 3) -> DataFrame:
    """Fuzzy search over catalog items (kind, item_id, name).

    Names are split into lower-case alphanumeric tokens; an item's score is
    the smallest normalised edit distance levenshtein(token, term) /
    max(len(token), len(term)); items scoring <= threshold are returned.
    Terms shorter than ``min_term`` characters match nothing.  (Our own
    documented metric, not a port of any search library's scoring.)
    Tokens whose length rules them out are not compared.  ``cat_search_indexed``
    searches a stored index instead of all items.
    """
    t = term.lower()
    if len(t) < min_term:
        return items.select("kind", "item_id", "name", F.lit(None).cast("double").alias("score")).filter(F.lit(False))
    return _score(_tokens(items), t, threshold).groupBy("kind", "item_id", "name").agg(F.min("score").alias("score"))


GRAM = 2


def _grams(text: Column) -> Column:
    """Pieces of ``GRAM`` characters, the n-th of a kind marked with its number."""
    n = F.length(text)
    plain = F.when(n >= GRAM, F.transform(F.sequence(F.lit(1), F.greatest(n - GRAM + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM))))
    plain = F.coalesce(plain, F.array().cast("array<string>"))
    return F.transform(plain, lambda g, i: F.concat(g, F.size(F.filter(F.slice(plain, F.lit(1), i + 1), lambda x: x == g)).cast("string")))


def write_search_index(items: DataFrame, path: str) -> None:
    """Index of item names for fuzzy search: ``tokens`` (token, kind, item_id, name) and
    ``postings`` (gram, length, token; each distinct token once per piece), both sorted by
    their first column, so that a search's filter reads few row groups."""
    parts = shuffle_partitions(items.sparkSession)
    tokens = _tokens(items).distinct()
    tokens.repartitionByRange(parts, "token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/tokens")
    each = items.sparkSession.read.parquet(f"{path}/tokens").select("token").distinct()
    posted = each.select(F.explode(_grams(F.col("token"))).alias("gram"), F.length("token").alias("length"), "token")
    posted.repartitionByRange(parts, "gram", "length").sortWithinPartitions("gram", "length").write.mode("overwrite").parquet(f"{path}/postings")


def search_candidates(spark: SparkSession, path: str, term: str, threshold: float) -> DataFrame:
    """Distinct tokens that may be within the threshold of the term.

    d edits change at most d * GRAM pieces, so a token shares at least
    max(lengths) - GRAM + 1 - d * GRAM pieces with the term.  Where that is one or more the
    postings of the term's pieces decide; tokens so short that it is not are taken by length."""
    length = F.col("length")
    longest = F.greatest(length, F.lit(len(term)))
    need = longest - GRAM + 1 - GRAM * _edits(length, term, threshold)
    fits = F.abs(length - len(term)) <= _edits(length, term, threshold)
    row = spark.range(1).select(_grams(F.lit(term)).alias("g")).first()  # the term's own pieces
    posted = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(row.g) & fits)
    by_gram = posted.groupBy("token", "length").agg(F.count(F.lit(1)).alias("shared")).where((need > 0) & (F.col("shared") >= need)).select("token")
    loose = [n for n in range(1, 4 * len(term) + 8) if abs(n - len(term)) <= int(max(n, len(term)) * threshold + 1e-9)
             and max(n, len(term)) - GRAM + 1 - GRAM * int(max(n, len(term)) * threshold + 1e-9) <= 0]
    if not loose and threshold < 0.5:
        return by_gram
    tokens = spark.read.parquet(f"{path}/tokens").select("token", F.length("token").alias("length"))
    return by_gram.unionAll(tokens.where(fits & (need <= 0)).select("token").distinct())


def cat_search_indexed(spark: SparkSession, path: str, term: str, threshold: float = 0.3, min_term: int = 3) -> DataFrame:
    """``cat_search`` on a stored index: candidates by length and shared pieces, the banded
    edit distance decides, and only the items of the tokens found are read."""
    t = term.lower()
    tokens = spark.read.parquet(f"{path}/tokens")
    if len(t) < min_term:
        return tokens.select("kind", "item_id", "name", F.lit(None).cast("double").alias("score")).filter(F.lit(False))
    found = _score(search_candidates(spark, path, t, threshold), t, threshold)
    return tokens.join(found, "token").groupBy("kind", "item_id", "name").agg(F.min("score").alias("score"))


def mon_query_preview(df: DataFrame, text: str, n: int = 100, name: str = "preview") -> DataFrame:
    """First ``n`` characters of a query text, with '...' when longer."""
    from lakeline.functions import preview

    return df.withColumn(name, preview(text, n))


def mon_ops_status(ops: DataFrame, operation: Column, status: Column, seconds: Column) -> DataFrame:
    """Object-store operations per (operation, status): count and total seconds."""
    return ops.groupBy(operation.alias("operation"), status.alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(seconds).alias("total_seconds"))


def mon_db_activity(sessions: DataFrame, active: Column, client: str) -> DataFrame:
    """Total rows, active rows and distinct clients (conditional aggregate)."""
    return sessions.agg(F.count(F.lit(1)).alias("total"), F.sum(active.cast("long")).alias("active"),
                        F.count_distinct(client).alias("clients"))


def cat_status_counts(items: DataFrame, status: str, name: str = "jobs") -> DataFrame:
    return items.groupBy(status).agg(F.count(F.lit(1)).alias(name))


def cat_bytes_fmt(df: DataFrame, size: str, name: str = "size_text") -> DataFrame:
    from lakeline.functions import format_bytes

    return df.withColumn(name, format_bytes(size))


def cat_overview(tables: DataFrame, datasets: DataFrame, rows: str, bytes_per_row: int, bucket: str,
                 name: str = "name", first: int = 5) -> DataFrame:
    """Catalog totals as one row: sum of rows and bytes, distinct buckets, and
    the first ``first`` table names (a distributed top-k, then a tiny list)."""
    spark = tables.sparkSession
    first_names = tables.orderBy(name).limit(first).agg(F.to_json(F.sort_array(F.collect_list(name))))
    return spark.range(1).select(
        tables.select(F.sum(rows)).scalar().alias("total_rows"),
        tables.select((F.sum(rows) * bytes_per_row).cast("long")).scalar().alias("total_bytes"),
        datasets.select(F.count_distinct(bucket)).scalar().alias("buckets"),
        first_names.scalar().alias("first_tables"))


def run_with_metrics(name: str, df: DataFrame, sink) -> DataFrame:
    """Run ``sink(observed_df)`` and return one metrics row: name, duration,
    rows, rows/s (0 when the duration is 0), success, error.  The row count
    is an ``Observation`` collected by the sink's own job -- no second scan."""
    import time

    from pyspark.sql import Observation

    spark = df.sparkSession
    obs = Observation(f"run_{name}")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    t0 = time.perf_counter()
    error = None
    try:
        sink(observed)
        rows = int(obs.get["rows"])
    except Exception as e:  # noqa: BLE001
        error, rows = f"{type(e).__name__}: {e}", 0
    dur = time.perf_counter() - t0
    return spark.createDataFrame(
        [(name, dur, rows, rows / dur if dur > 0 else 0.0, error is None, error)],
        "name string, duration_s double, rows long, rows_per_sec double, success boolean, error string")
