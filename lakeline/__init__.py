"""Lakeline: lakehouse, lineage and event analytics as lazy Spark DataFrame operators.

Every public operator is a function ``DataFrame(s) -> DataFrame`` built on the
public DataFrame / SQL API, so Catalyst plans it and executors run it.
"""

from lakeline.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
