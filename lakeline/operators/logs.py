"""Log analytics: regex parsing of database log lines, JSON log
parsing, level guessing, routing by source, named filters, reports and a
health summary.  Everything is built-in ``regexp_extract``/``rlike``/
``from_json`` -- no Python in the per-line path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeline.functions import max_of

# Log patterns of the reference's log pipeline and helper scripts.
PG_LINE = (r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}.\d{3} \w+) \[(\d+)\] "
           r"(?:(\w+)@(\w+) )?(\w+):\s*(.*)")
DURATION = r"duration: (\d+\.\d+) ms"
QUEUE_NAME = r"queue:\s*(\w+)"
VACUUM = r'automatic (vacuum|analyze) of table "([^"]+)"'
LEVEL_GUESS = r"(?i)(debug|info|warn|warning|error|fatal|panic)"
NAMED_FILTERS = {
    "errors": r"(?i)(error|fatal|panic)",
    "slow": r"duration:",
    "autovacuum": r"automatic (vacuum|analyze)",
    "connections": r"(connection|disconnect)",
    "pgmq": r"pgmq",
    "lineage": r"(lineage|openlineage)",
}
REPORT_SECTIONS = ["errors", "slow", "autovacuum", "pgmq", "lineage", "connections"]
HEALTH_CHECKS = {  # name -> (pattern, minutes, status when matches found, status when none)
    "recent_errors": (r"(?i)(error|fatal|panic)", 5, "WARN", "OK"),
    "connection_issues": (r"(?i)(connection.*failed|could not connect)", 10, "WARN", "OK"),
    "autovacuum": (r"automatic vacuum", 30, "OK", "WARN"),
}

JSON_LOG = T.StructType([T.StructField(n, T.StringType()) for n in (
    "timestamp", "level", "service", "message", "request_id", "job_name", "run_id", "table_name", "error")])


def _nz(c: Column) -> Column:
    return F.when(c != "", c)


def log_parse_pg(lines: DataFrame, line: str = "line") -> DataFrame:
    """timestamp text and parsed timestamp, pid, optional user@database, level, message."""
    l = F.col(line)
    ts_text = _nz(F.regexp_extract(l, PG_LINE, 1))
    return lines.select(
        *[c for c in lines.columns if c != line],
        ts_text.alias("ts_text"),
        F.try_to_timestamp(F.left(ts_text, F.lit(23)), F.lit("yyyy-MM-dd HH:mm:ss.SSS")).cast("timestamp_ntz").alias("log_ts"),
        _nz(F.regexp_extract(l, PG_LINE, 2)).cast("long").alias("pid"),
        _nz(F.regexp_extract(l, PG_LINE, 3)).alias("user"),
        _nz(F.regexp_extract(l, PG_LINE, 4)).alias("database"),
        _nz(F.regexp_extract(l, PG_LINE, 5)).alias("level"),
        _nz(F.regexp_extract(l, PG_LINE, 6)).alias("message"))


def log_duration(line: Column) -> Column:
    return _nz(F.regexp_extract(line, DURATION, 1)).try_cast("double")


def log_queue_name(line: Column) -> Column:
    return _nz(F.regexp_extract(line, QUEUE_NAME, 1))


def log_vacuum(line: Column) -> tuple[Column, Column]:
    return _nz(F.regexp_extract(line, VACUUM, 1)), _nz(F.regexp_extract(line, VACUUM, 2))


def log_level_guess(line: Column) -> Column:
    return F.lower(_nz(F.regexp_extract(line, LEVEL_GUESS, 1)))


def log_parse_json(lines: DataFrame, line: str = "line") -> DataFrame:
    """JSON logs -> nine fields plus the parsed timestamp (any ISO form; null if it is no time)."""
    j = F.from_json(F.col(line), JSON_LOG)
    return lines.withColumn("__j", j).select(
        *[c for c in lines.columns if c != line],
        *[F.col("__j." + f.name).alias(f.name) for f in JSON_LOG.fields],
        F.col("__j.timestamp").try_cast("timestamp").cast("timestamp_ntz").alias("log_ts"))


def log_route(raw: DataFrame, container: str = "container", line: str = "line",
              keep: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """One pass over the lines into one schema (container, event_id, log_ts,
    level, message): 'postgresql' lines by the database regex, 'backend' lines
    as JSON, everything else by level guessing.  ``keep`` /
    ``drop`` are container allow/deny lists applied first."""
    r = raw
    if keep:
        r = r.filter(F.col(container).isin(*keep))
    if drop:
        r = r.filter(~F.col(container).isin(*drop))
    c, text = F.col(container), F.col(line)
    json = F.from_json(text, JSON_LOG)
    pg = [F.try_to_timestamp(F.left(_nz(F.regexp_extract(text, PG_LINE, 1)), F.lit(23)), F.lit("yyyy-MM-dd HH:mm:ss.SSS")),
          F.lower(_nz(F.regexp_extract(text, PG_LINE, 5))), _nz(F.regexp_extract(text, PG_LINE, 6))]
    js = [json.getField("timestamp").try_cast("timestamp"), F.lower(json.getField("level")), json.getField("message")]
    other = [F.lit(None).cast("timestamp"), log_level_guess(text), text]
    ts, level, message = (F.when(c == "postgresql", a).when(c == "backend", b).otherwise(d) for a, b, d in zip(pg, js, other))
    return r.select(container, "event_id", ts.cast("timestamp_ntz").alias("log_ts"), level.alias("level"), message.alias("message"))


def log_filter(lines: DataFrame, ts: str, since_minutes: int, filters: dict[str, str] | None = None,
               line: str = "line", asof=None) -> DataFrame:
    """(filter, line) for every named filter a line matches inside the
    since-window before asof; one pass, matches exploded."""
    filters = filters or NAMED_FILTERS
    now = max_of(lines, ts) if asof is None else asof
    recent = lines.filter(F.col(ts) >= now - F.make_dt_interval(mins=F.lit(since_minutes)))
    hits = F.filter(F.array(*[F.when(F.col(line).rlike(p), F.lit(n)) for n, p in filters.items()]),
                    lambda x: x.isNotNull())
    return recent.select("*", F.explode(hits).alias("filter"))


def log_labels(raw: DataFrame, labels: Column) -> DataFrame:
    """Distinct label names over all lines (labels is a map column)."""
    return raw.select(F.explode(F.map_keys(labels)).alias("label")).distinct()


def log_report(lines: DataFrame, ts: str, hours: int, k: int = 3, line: str = "line",
               id_col: str = "event_id", asof=None) -> DataFrame:
    """Six-section report for the last ``hours``: match count per section and
    the ``k`` newest matching lines.  Counts are partial sums; of the lines each
    task keeps its ``k`` newest per section (a row-number limit, which Spark pushes
    below the shuffle), so a section that most lines match moves few rows."""
    m = log_filter(lines, ts, hours * 60, {s: NAMED_FILTERS[s] for s in REPORT_SECTIONS}, line, asof)
    m = m.select(F.col("filter").alias("section"), ts, F.col(id_col).alias("sample_id"), F.col(line).alias("sample"))
    counts = m.groupBy("section").agg(F.count(F.lit(1)).alias("matches"))
    newest = Window.partitionBy("section").orderBy(F.col(ts).desc(), F.col("sample_id").desc())
    samples = m.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= k).drop("__n", ts)
    sections = lines.sparkSession.createDataFrame([(s,) for s in REPORT_SECTIONS], "section string")
    base = sections.join(counts, "section", "left").select(
        "section", F.coalesce("matches", F.lit(0)).alias("matches"))
    return base.join(samples, "section", "left")


def log_health(lines: DataFrame, ts: str, line: str = "line", asof=None) -> DataFrame:
    """OK/WARN per check with its match count; one aggregate with three cut-offs."""
    now = max_of(lines, ts) if asof is None else asof
    aggs = []
    for name, (pat, mins, hit, miss) in HEALTH_CHECKS.items():
        cond = (F.col(ts) >= now - F.make_dt_interval(mins=F.lit(mins))) & F.col(line).rlike(pat)
        aggs.append(F.sum(cond.cast("long")).alias(name))
    one = lines.agg(*aggs)
    rows = [F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(0)).alias("matches"),
                     F.when(F.coalesce(F.col(n), F.lit(0)) > 0, F.lit(hit)).otherwise(F.lit(miss)).alias("status"))
            for n, (_, _, hit, miss) in HEALTH_CHECKS.items()]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.check", "r.matches", "r.status")


def log_by_namespace(raw: DataFrame, namespace: str, label: str = "namespace") -> DataFrame:
    """Lines carrying a label value (``{namespace="x"}``); a pushed-down filter."""
    return raw.filter(F.col(label) == namespace)
