"""Registry of named queries: key -> (spark, sf_dir) -> DataFrame, plus oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from lakeline.plans import q_lineage  # noqa: F401
    for mod in ("q_events", "q_patterns", "q_monitoring", "q_logs", "q_access", "q_streams", "q_io"):
        try:
            __import__(f"lakeline.plans.{mod}")
        except ModuleNotFoundError as e:  # module not written yet
            if e.name != f"lakeline.plans.{mod}":
                raise
