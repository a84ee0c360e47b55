"""OpenLineage events: build, parse, validate and normalise into the lineage store.

All operators are ``DataFrame -> DataFrame`` and are shared by batch jobs and
``foreachBatch`` in the streaming ingest.  Event order for state resolution is
(event_time, seq): arrival order is not reproducible on a cluster, so the
sequence number that the queue assigns breaks ties instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeline.operators.nesting import DEFAULT_PAGE_SIZE, by_length, page_numbers, page_of, with_page

# Fixed values (OpenLineage vocabulary used by the reference).
EVENT_TYPES = ("START", "RUNNING", "COMPLETE", "FAIL", "ABORT")
TERMINAL = ("COMPLETE", "FAIL", "ABORT")
PRODUCER = "lakeline"
SCHEMA_URL = "https://openlineage.io/spec/1-0-5/OpenLineage.json#/definitions/RunEvent"
UUID_RE = r"^(?:urn:)?(?:uuid:)?\{?[0-9a-fA-F]{8}(?:-?[0-9a-fA-F]{4}){3}-?[0-9a-fA-F]{12}\}?$"
DEFAULT_NAMESPACE = "lake"  # of datasets given by name only

SEQ_STRIDE = 1 << 20  # seq = run_id * stride + (0 for START, 1 + page for terminal pages); more pages are an error

FIELD = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])
DATASET = T.StructType([
    T.StructField("namespace", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("facets", T.StructType([
        T.StructField("dataSource", T.StructType([
            T.StructField("name", T.StringType()), T.StructField("uri", T.StringType())])),
        T.StructField("schema", T.StructType([T.StructField("fields", T.ArrayType(FIELD))])),
    ])),
])
EVENT = T.StructType([
    T.StructField("eventType", T.StringType()),
    T.StructField("eventTime", T.StringType()),
    T.StructField("run", T.StructType([
        T.StructField("runId", T.StringType()),
        T.StructField("facets", T.MapType(T.StringType(), T.StringType())),
    ])),
    T.StructField("job", T.StructType([
        T.StructField("namespace", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("facets", T.StructType([
            T.StructField("documentation", T.StructType([T.StructField("description", T.StringType())]))])),
    ])),
    T.StructField("inputs", T.ArrayType(T.StringType())),  # each a name, or an object as its JSON text
    T.StructField("outputs", T.ArrayType(T.StringType())),
    T.StructField("producer", T.StringType()),
    T.StructField("schemaURL", T.StringType()),
    T.StructField("_corrupt", T.StringType()),
])


def _json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "true"})


def iso(ts) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def uuid_of(key) -> Column:
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.lower(F.hex(key)), 12, "0"))


def ol_dataset_facet(namespace: Column, name: Column, uri: Column | None = None,
                     fields: Column | None = None, scheme: str = "lake") -> Column:
    """Dataset struct; default uri ``<scheme>://tables/<name>``; schema facet only
    when ``fields`` is a non-empty array of {name, type}."""
    uri = uri if uri is not None else F.concat(F.lit(f"{scheme}://tables/"), name)
    schema = (F.when(F.size(fields) > 0, F.struct(fields.alias("fields")))
              if fields is not None else F.lit(None).cast(DATASET["facets"].dataType["schema"].dataType))
    return F.struct(namespace.alias("namespace"), name.alias("name"),
                    F.struct(F.struct(namespace.alias("name"), uri.alias("uri")).alias("dataSource"),
                             schema.alias("schema")).alias("facets"))


def ol_start_event(runs_with_job: DataFrame, description: str = "Lakeline job run") -> DataFrame:
    """START event JSON per run: documentation facet plus run metadata facet.

    Input columns: run_id, started_at, namespace, job_name (+ optional metadata map).
    """
    meta = F.col("metadata") if "metadata" in runs_with_job.columns else F.create_map()
    ev = F.struct(
        F.lit("START").alias("eventType"),
        iso(F.col("started_at")).alias("eventTime"),
        F.struct(uuid_of(F.col("run_id")).alias("runId"), meta.alias("facets")).alias("run"),
        F.struct(F.col("namespace").alias("namespace"), F.col("job_name").alias("name"),
                 F.struct(F.struct(F.lit(description).alias("description")).alias("documentation"))
                 .alias("facets")).alias("job"),
        F.array().cast(T.ArrayType(DATASET)).alias("inputs"),
        F.array().cast(T.ArrayType(DATASET)).alias("outputs"),
        F.lit(PRODUCER).alias("producer"),
        F.lit(SCHEMA_URL).alias("schemaURL"))
    return runs_with_job.select(
        (F.col("run_id") * SEQ_STRIDE).alias("seq"), F.col("started_at").alias("ts"), _json(ev).alias("payload"))


def _short_pages(rows: DataFrame, page_size: int) -> DataFrame:
    """(run_id, page, ins, outs) of runs whose datasets fit one array."""
    order = F.struct("direction", "namespace", "name", "uri")
    lists = rows.groupBy("run_id").agg(F.sort_array(F.collect_list(order)).alias("all"))
    lists = lists.select("run_id", "all", F.explode(page_numbers(F.size("all"), page_size)).alias("page"))
    lists = lists.select("run_id", "page", page_of(F.col("all"), F.col("page"), page_size).alias("some"))

    def side(direction: str) -> Column:
        return F.transform(F.filter("some", lambda x: x["direction"] == direction),
                           lambda x: ol_dataset_facet(x["namespace"], x["name"], x["uri"]))

    return lists.select("run_id", "page", side("INPUT").alias("ins"), side("OUTPUT").alias("outs"))


def _long_pages(rows: DataFrame, page_size: int) -> DataFrame:
    """As ``_short_pages`` for runs of any number of datasets, by a scan over their rows."""
    paged = with_page(rows, ["run_id"], ["direction", "namespace", "name"], page_size)
    ds = ol_dataset_facet(F.col("namespace"), F.col("name"), F.col("uri"))

    def side(direction: str) -> Column:
        one = F.struct(F.col("namespace").alias("k1"), F.col("name").alias("k2"), ds.alias("d"))
        lists = F.sort_array(F.collect_list(F.when(F.col("direction") == direction, one)))
        return F.transform(lists, lambda x: x["d"])

    return paged.groupBy("run_id", "page").agg(side("INPUT").alias("ins"), side("OUTPUT").alias("outs"))


def ol_complete_event(ended_runs: DataFrame, run_datasets: DataFrame,
                      page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Terminal event(s) per ended run: COMPLETE when success else FAIL.

    ``ended_runs``: run_id, ended_at, success, namespace, job_name.
    ``run_datasets``: run_id, direction, namespace, name, uri.
    A run's datasets are split into pages of ``page_size``; each page is one
    terminal event (OpenLineage consumers union inputs/outputs over a run's
    events), so no event grows without bound.
    """
    rows = run_datasets.select("run_id", "direction", "namespace", "name", "uri")
    short, long = by_length(rows, ["run_id"])
    pages = _short_pages(short, page_size).unionByName(_long_pages(long, page_size))
    r = ended_runs.join(pages, "run_id", "left")
    empty = F.array().cast(T.ArrayType(DATASET))
    ev = F.struct(
        F.when(F.col("success"), "COMPLETE").otherwise("FAIL").alias("eventType"),
        iso(F.col("ended_at")).alias("eventTime"),
        F.struct(uuid_of(F.col("run_id")).alias("runId")).alias("run"),
        F.struct(F.col("namespace").alias("namespace"), F.col("job_name").alias("name")).alias("job"),
        F.coalesce("ins", empty).alias("inputs"),
        F.coalesce("outs", empty).alias("outputs"),
        F.lit(PRODUCER).alias("producer"),
        F.lit(SCHEMA_URL).alias("schemaURL"))
    page = F.assert_true(F.coalesce("page", F.lit(0)) < SEQ_STRIDE - 1, "a run has too many pages")
    page = F.coalesce(page.cast("long"), F.col("page"), F.lit(0))
    return r.select((F.col("run_id") * SEQ_STRIDE + 1 + page).alias("seq"),
                    F.col("ended_at").alias("ts"), _json(ev).alias("payload"))


def malformed_events(events: DataFrame) -> DataFrame:
    """Bad rows for the dead-letter path: one per source event with id % 100 = 0,
    cycling through broken JSON, missing runId, non-UUID runId, unknown type, and
    an event time that is none."""
    e = events.filter(F.col("event_id") % 100 == 0)
    v = (F.col("event_id") / 100).cast("long") % 5
    t = iso(F.col("ts"))
    bad_job = F.concat(F.lit('"job":{"namespace":"bad","name":"bad_'), F.col("event_id").cast("string"), F.lit('"}'))
    payload = (F.when(v == 0, F.concat(F.lit('{"eventType":"START","eventTime":"'), t, F.lit('",')))
               .when(v == 1, F.concat(F.lit('{"eventType":"START","eventTime":"'), t, F.lit('","run":{},'),
                                      bad_job, F.lit("}")))
               .when(v == 2, F.concat(F.lit('{"eventType":"START","eventTime":"'), t,
                                      F.lit('","run":{"runId":"run-'), F.col("event_id").cast("string"),
                                      F.lit('"},'), bad_job, F.lit("}")))
               .when(v == 4, F.concat(F.lit('{"eventType":"START","eventTime":"not-a-date","run":{"runId":"'),
                                      uuid_of(F.col("event_id") + 1000000000), F.lit('"},'), bad_job, F.lit("}")))
               .otherwise(F.concat(F.lit('{"eventType":"PAUSE","eventTime":"'), t, F.lit('","run":{"runId":"'),
                                   uuid_of(F.col("event_id") + 1000000000), F.lit('"},'), bad_job, F.lit("}"))))
    return e.select((-1 - F.col("event_id")).alias("seq"), "ts", payload.alias("payload"))


def build_events(runs: DataFrame, jobs: DataFrame, datasets: DataFrame, edges: DataFrame,
                 events: DataFrame) -> DataFrame:
    """Event log (seq, ts, payload) reproducing a lineage store plus bad rows."""
    rj = runs.join(jobs, runs.job_id == jobs.id).select(
        runs.run_id, runs.state, runs.started_at, runs.ended_at, jobs.namespace, jobs.name.alias("job_name"))
    starts = ol_start_event(rj)
    ended = rj.filter(F.col("ended_at").isNotNull()).select(
        "run_id", "ended_at", (F.col("state") == "COMPLETE").alias("success"), "namespace", "job_name")
    rd = edges.join(datasets, edges.dataset_id == datasets.id).select(
        edges.run_id, edges.direction, datasets.namespace, datasets.name, datasets.source_uri.alias("uri"))
    terms = ol_complete_event(ended, rd)
    return starts.unionByName(terms).unionByName(malformed_events(events))


# ---------------------------------------------------------------- parsing

def ol_datasets_of(items: Column) -> Column:
    """Dataset structs from the elements of an event's inputs or outputs: an
    OpenLineage object, a plain {name, uri} dict, or just a name.  What is not
    given is filled in: the namespace, and the uri from the data source facet,
    the top level or (for a name) the table path."""
    loose = T.StructType([*DATASET.fields, T.StructField("uri", T.StringType())])

    def one(x: Column) -> Column:
        text, d = x.getField("text"), x.getField("d")
        is_object = text.startswith("{") & d.getField("name").isNotNull()
        name = F.when(is_object, d.getField("name")).otherwise(text)
        space = F.coalesce(F.when(is_object, d.getField("namespace")), F.lit(DEFAULT_NAMESPACE))
        source = d.getField("facets").getField("dataSource")
        uri = F.when(is_object, F.coalesce(source.getField("uri"), d.getField("uri"))).otherwise(
            F.concat(F.lit("lake://tables/"), text))
        given = F.when(is_object, source.getField("name"))
        fields = F.when(is_object, d.getField("facets").getField("schema"))
        facets = F.struct(F.struct(given.alias("name"), uri.alias("uri")).alias("dataSource"), fields.alias("schema"))
        return F.struct(space.alias("namespace"), name.alias("name"), facets.alias("facets"))

    # Lambdas share no subexpressions: each element is parsed by a first transform, once.
    texts = F.filter(items, lambda x: x.isNotNull())
    return F.transform(F.transform(texts, lambda x: F.struct(x.alias("text"), F.from_json(x, loose).alias("d"))), one)


def ol_parse(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Parse JSON events with an explicit schema; fill defaults.

    Malformed JSON yields ``corrupt`` = true and null fields (never an error);
    an event time that is no time is null, which validation dead-letters.
    What is parsed sits in generators of one row, through which filters on parsed fields are
    not pushed: each payload is parsed once and not once a field that a filter names.
    """
    p = F.from_json(F.col(payload), EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    empty = F.array().cast(T.ArrayType(DATASET))
    given = F.col("__e.run.runId")
    digits = F.when(given.rlike(UUID_RE), F.lower(F.regexp_replace(given, r"^urn:|uuid:|[{}-]", "")))
    parts = [F.substring("__n.digits", at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    run = F.when(F.length("__n.digits") == 32, F.concat_ws("-", *parts)).when(F.col("__n.digits").isNull(), given)
    time = F.col("__e.eventTime").try_cast("timestamp").cast("timestamp_ntz")
    out = raw.select("*", F.explode(F.array(p)).alias("__e"))
    out = out.select("*", F.explode(F.array(F.struct(digits.alias("digits"), time.alias("time")))).alias("__n"))
    return out.select(
        *[c for c in raw.columns if c != payload],
        F.col(payload).alias("raw"),
        (F.col("__e").isNull() | F.col("__e._corrupt").isNotNull()).alias("corrupt"),
        F.col("__e.eventType").alias("event_type"),
        F.col("__e.eventTime").alias("event_time_text"),
        F.col("__n.time").alias("event_time"),
        run.alias("run_id"),
        F.col("__e.job.namespace").alias("job_namespace"),
        F.col("__e.job.name").alias("job_name"),
        F.coalesce(ol_datasets_of(F.col("__e.inputs")), empty).alias("inputs"),
        F.coalesce(ol_datasets_of(F.col("__e.outputs")), empty).alias("outputs"),
        F.coalesce(F.col("__e.producer"), F.lit(PRODUCER)).alias("producer"),
        F.coalesce(F.col("__e.schemaURL"), F.lit(SCHEMA_URL)).alias("schema_url"),
    )


def ol_validate(parsed: DataFrame) -> DataFrame:
    """Add ``error`` (null when valid) and ``valid``; first failing rule wins."""
    missing = [("event_type", "eventType"), ("event_time", "eventTime"), ("run_id", "run.runId"),
               ("job_namespace", "job.namespace"), ("job_name", "job.name")]
    err = F.when(F.col("corrupt"), F.lit("malformed JSON"))
    err = err.when(F.col("event_time_text").isNotNull() & F.col("event_time").isNull(), F.lit("eventTime is not a time"))
    for c, label in missing:
        err = err.when(F.col(c).isNull(), F.lit(f"missing {label}"))
    err = (err.when(~F.col("run_id").rlike(UUID_RE), F.lit("runId is not a UUID"))
           .when(~F.col("event_type").isin(*EVENT_TYPES), F.concat(F.lit("unknown eventType: "), F.col("event_type"))))
    return parsed.withColumn("error", err).withColumn("valid", F.col("error").isNull())


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good events, dead letters {original_message, error, timestamp, msg_id})."""
    good = validated.filter(F.col("valid"))
    bad = validated.filter(~F.col("valid")).select(
        F.col("raw").alias("original_message"), "error", F.col("ts").alias("timestamp"),
        F.col("seq").alias("msg_id"))
    return good, bad


# ---------------------------------------------------------------- normalising

def _ord() -> Column:
    return F.struct(F.col("event_time"), F.col("seq"))


def ol_jobs(good: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Get-or-create jobs by (namespace, name); id = xxhash64(namespace, name)."""
    seen = good.groupBy(F.col("job_namespace").alias("namespace"), F.col("job_name").alias("name")).agg(
        F.min("event_time").alias("created_at"))
    seen = seen.withColumn("id", F.xxhash64("namespace", "name"))
    if existing is None:
        return seen.select("id", "namespace", "name", "created_at")
    new = seen.join(existing, ["namespace", "name"], "left_anti")
    return existing.select("id", "namespace", "name", "created_at").unionByName(
        new.select("id", "namespace", "name", "created_at"))


def run_parts(events: DataFrame) -> DataFrame:
    """Per run: its first event and its last terminal event, as structs that order
    by (event_time, seq); parts of several batches merge with ``runs_of``."""
    when = [F.col("event_time"), F.col("seq")]
    first = F.struct(*when, "job_namespace", "job_name", "event_type")
    term = F.when(F.col("event_type").isin(*TERMINAL), F.struct(*when, "event_type"))
    return events.groupBy("run_id").agg(F.min(first).alias("first"), F.max(term).alias("term"))


def runs_of(parts: DataFrame) -> DataFrame:
    g = parts.groupBy("run_id").agg(F.min("first").alias("f"), F.max("term").alias("t"))
    return g.select(
        "run_id", F.col("f.job_namespace").alias("job_namespace"), F.col("f.job_name").alias("job_name"),
        F.coalesce(F.col("t.event_type"), F.col("f.event_type")).alias("state"),
        F.col("f.event_time").alias("started_at"), F.col("t.event_time").alias("ended_at"))


def ol_runs(good: DataFrame) -> DataFrame:
    """One row per run: state = last terminal type, else first type; started_at =
    first event time; ended_at = time of the last terminal event."""
    return runs_of(run_parts(good))


def _exploded(good: DataFrame) -> DataFrame:
    def side(name: str, direction: str) -> Column:
        return F.transform(name, lambda d: F.struct(F.lit(direction).alias("direction"), d.alias("d")))

    both = F.concat(side("inputs", "INPUT"), side("outputs", "OUTPUT"))
    return good.select("run_id", "event_time", "seq", F.explode(both).alias("x")).select(
        "run_id", "event_time", "seq", "x.direction", F.col("x.d").alias("d")).select(
        "run_id", "event_time", "seq", "direction",
        F.col("d.namespace").alias("namespace"), F.col("d.name").alias("name"),
        F.col("d.facets.dataSource.uri").alias("uri"))


def dataset_parts(events: DataFrame) -> DataFrame:
    """Per dataset its first sighting, a struct that orders by (event_time, seq)."""
    return _exploded(events).groupBy("namespace", "name").agg(F.min(F.struct("event_time", "seq", "uri")).alias("first"))


def datasets_of(parts: DataFrame) -> DataFrame:
    g = parts.groupBy("namespace", "name").agg(F.min("first").alias("f"))
    return g.select("namespace", "name", F.coalesce("f.uri", F.lit("")).alias("uri"), F.col("f.event_time").alias("created_at"))


def ol_datasets(good: DataFrame) -> DataFrame:
    """Datasets by (namespace, name); uri from the first sighting, default ''."""
    return datasets_of(dataset_parts(good))


def ol_run_events(good: DataFrame) -> DataFrame:
    """One row per event; an event delivered again (same seq) is stored once."""
    return good.dropDuplicates(["seq"]).select("seq", "run_id", "event_type", "event_time", "producer", "schema_url",
                       F.col("raw").alias("event_data"))


def ol_edges(good: DataFrame) -> DataFrame:
    """INPUT/OUTPUT edges, de-duplicated on (run, dataset, direction)."""
    x = _exploded(good)
    return x.groupBy("run_id", "namespace", "name", "direction").agg(
        F.min("event_time").alias("created_at"))


def ol_merge_metadata(metadata: Column, extra: Column | None = None, artifacts: Column | None = None) -> Column:
    """metadata, then extra (later keys win), then artifacts only for absent keys."""
    merged = metadata
    if extra is not None:
        merged = F.map_concat(
            F.map_filter(merged, lambda k, v: ~F.array_contains(F.map_keys(extra), k)), extra)
    if artifacts is not None:
        keys = F.map_keys(merged)
        merged = F.map_concat(merged, F.map_filter(artifacts, lambda k, v: ~F.array_contains(keys, k)))
    return merged


def ingest(raw: DataFrame) -> dict[str, DataFrame]:
    """Full normalisation of an event batch: parse, validate, split, normalise."""
    good, bad = split_valid(ol_validate(ol_parse(raw)))
    return {
        "jobs": ol_jobs(good), "runs": ol_runs(good), "datasets": ol_datasets(good),
        "run_events": ol_run_events(good), "edges": ol_edges(good), "dead_letters": bad,
    }


def lineage_store(good: DataFrame) -> dict[str, DataFrame]:
    """The normalised store in the shape the lineage queries read:
    jobs(id, namespace, name, created_at), runs(run_id, job_id, state,
    started_at, ended_at), datasets(id, namespace, name, source_uri),
    edges(run_id, dataset_id, direction, created_at), run_events.  Surrogate ids are
    xxhash64 of (namespace, name): stable, no coordination between writers."""
    jobs = ol_jobs(good)
    runs = ol_runs(good).select("run_id", F.xxhash64("job_namespace", "job_name").alias("job_id"), "state",
                                "started_at", "ended_at")
    datasets = ol_datasets(good).select(F.xxhash64("namespace", "name").alias("id"), "namespace", "name",
                                        F.col("uri").alias("source_uri"))
    edges = ol_edges(good).select("run_id", F.xxhash64("namespace", "name").alias("dataset_id"), "direction",
                                  "created_at")
    return {"jobs": jobs, "runs": runs, "datasets": datasets, "edges": edges, "run_events": ol_run_events(good)}
