"""Automatic lineage tracking around Spark jobs.

Inside ``track_job(...)``, reads made through ``tracked_read`` / ``snap_read``
are recorded as inputs and ``tracked_write`` targets as outputs; on exit one
START and one terminal event (COMPLETE, or FAIL when the block raised) are
appended as JSON rows to an event folder that the ingest reads.  Only event
metadata passes through the driver, never data.
"""

from __future__ import annotations

import contextlib
import json
import threading
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from lakeline.operators.lineage_events import PRODUCER, SCHEMA_URL

_active = threading.local()


def _ctx():
    return getattr(_active, "ctx", None)


def record_input(name: str, uri: str | None = None, namespace: str = "lake") -> None:
    c = _ctx()
    if c is not None:
        c["inputs"].append({"namespace": namespace, "name": name, "uri": uri})


def record_output(name: str, uri: str | None = None, namespace: str = "lake") -> None:
    c = _ctx()
    if c is not None:
        c["outputs"].append({"namespace": namespace, "name": name, "uri": uri})


def tracked_read(spark: SparkSession, name: str, uri: str, fmt: str = "parquet") -> DataFrame:
    record_input(name, uri)
    return spark.read.format(fmt).load(uri)


def tracked_write(df: DataFrame, name: str, uri: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    df.write.mode(mode).format(fmt).save(uri)
    record_output(name, uri)


def _ds(d: dict) -> dict:
    out = {"namespace": d["namespace"], "name": d["name"]}
    if d.get("uri"):
        out["facets"] = {"dataSource": {"name": d["namespace"], "uri": d["uri"]}}
    return out


def _now() -> str:
    return datetime.now(timezone.utc).replace(tzinfo=None).isoformat(timespec="microseconds")


@contextlib.contextmanager
def track_job(spark: SparkSession, events_dir: str, job: str, namespace: str = "lakeline",
              metadata: dict | None = None):
    """Context manager: success = no exception; events written on exit."""
    run_id = str(uuid.uuid4())
    ctx = {"inputs": [], "outputs": [], "run_id": run_id}
    prev = _ctx()
    _active.ctx = ctx
    start = {"eventType": "START", "eventTime": _now(), "run": {"runId": run_id, "facets": metadata or {}},
             "job": {"namespace": namespace, "name": job}, "inputs": [], "outputs": [],
             "producer": PRODUCER, "schemaURL": SCHEMA_URL}
    ok = False
    try:
        yield ctx
        ok = True
    finally:
        _active.ctx = prev
        end = {"eventType": "COMPLETE" if ok else "FAIL", "eventTime": _now(), "run": {"runId": run_id},
               "job": {"namespace": namespace, "name": job},
               "inputs": [_ds(d) for d in ctx["inputs"]], "outputs": [_ds(d) for d in ctx["outputs"]],
               "producer": PRODUCER, "schemaURL": SCHEMA_URL}
        rows = [(json.dumps(start),), (json.dumps(end),)]
        spark.createDataFrame(rows, "payload string").coalesce(1).write.mode("append").text(events_dir)
