"""Materialised aggregates that refresh from what is new in a versioned table.

The state is one partial aggregate per (source file, group): counts, sums, least and
greatest values, and HyperLogLog sketches for distinct counts.  A refresh reads only files
that no earlier refresh has read; a file that the table has dropped drops its states.  The
result merges the states of the files that are live, so after merges and compactions it
is still that of a full computation (distinct counts are the sketches' estimates).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeline.sources import commits
from lakeline.sources.versions import Table

PARTIAL = {"sum": F.sum, "min": F.min, "max": F.max, "distinct": F.hll_sketch_agg}
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "distinct": lambda c: F.hll_sketch_estimate(F.hll_union_agg(c))}


class Rollup:
    """``groups``: name -> column; ``measures``: name -> (count | sum | min | max | distinct, column)."""

    def __init__(self, source: Table, root: str, name: str, groups: Mapping[str, Column], measures: Mapping[str, tuple[str, Column | None]]):
        self.source, self.groups, self.measures = source, dict(groups), dict(measures)
        self.folder = f"{root.rstrip('/')}/{name}"
        self.log = f"{self.folder}/log"

    def covered(self) -> dict[str, str]:
        """file -> folder of its states, as of the last refresh."""
        done = commits.numbers(self.source.spark, self.log)
        return commits.read_marker(self.source.spark, self.log, done[-1])["files"] if done else {}

    def refresh(self) -> list[str]:
        """Bring the states up to the table's newest version; the files that were read."""
        spark = self.source.spark
        while True:
            done = commits.numbers(spark, self.log)
            known, version = self.covered(), self.source.version()
            live = [r.file for r in self.source.manifest(version).select("file").collect()]  # names, as a scan lists them
            new = [f for f in live if f not in known]
            part = f"states/{uuid.uuid4().hex}"
            if new:
                file = F.concat(F.lit("data/"), F.substring_index(F.col("_metadata.file_path"), "/data/", -1))
                rows = self.source.read(version, new).withColumn("__file", file)
                aggs = [(F.count(F.lit(1)) if c is None else F.count(c)) if op == "count" else PARTIAL[op](c) for op, c in self.measures.values()]
                states = rows.groupBy("__file", *[c.alias(n) for n, c in self.groups.items()])
                states.agg(*[a.alias(n) for a, n in zip(aggs, self.measures)]).write.parquet(f"{self.folder}/{part}")
            files = {f: known.get(f, part) for f in live}
            marker = commits.marker(self.log, (done[-1] if done else 0) + 1)
            if commits.create_if_absent(spark, marker, json.dumps({"version": version, "files": files})):
                return new

    def read(self) -> DataFrame:
        """The merged result as of the last refresh."""
        spark, files = self.source.spark, self.covered()
        folders = sorted({p for p in files.values()})
        states = spark.read.parquet(*[f"{self.folder}/{p}" for p in folders])
        live = spark.createDataFrame([(f,) for f in files], "__file string")
        merged = [MERGE[op](F.col(n)).alias(n) for n, (op, _) in self.measures.items()]
        return states.join(live, "__file", "left_semi").groupBy(*self.groups).agg(*merged)
