"""Data-quality checks: schema diff, rule violations,
column byte estimates, aggregate invariants and dataset description.

Rule checks run as **one** aggregate pass over the data (partial aggregation
per task) and are then unpivoted to one row per (column, rule).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# SQL names used when reporting Spark types.
SQL_TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT",
    "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
    "binary": "BLOB",
}


def sql_type(dt: T.DataType) -> str:
    s = dt.simpleString()
    if s.startswith("decimal"):
        return s.upper()
    if s.startswith("array<"):
        return sql_type(dt.elementType) + "[]"
    return SQL_TYPE_NAMES.get(s, s.upper())


def dq_schema(spark: SparkSession, df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Violations of a declared schema {column: SQL type}: missing columns and
    type mismatches.  Only schema metadata is compared (no data is read)."""
    actual = {f.name: sql_type(f.dataType) for f in df.schema.fields}
    rows = []
    for col, typ in expected.items():
        if col not in actual:
            rows.append((col, "missing_column", typ, None))
        elif actual[col] != typ.upper():
            rows.append((col, "type_mismatch", typ.upper(), actual[col]))
    schema = "column string, problem string, expected string, actual string"
    return spark.createDataFrame(rows, schema)


def _rule_expr(df: DataFrame, column: str, rule: str) -> Column | None:
    if column not in df.columns:
        return None
    c = F.col(column)
    if rule == "not_null":
        bad = c.isNull()
    elif rule == "finite":
        d = c.cast("double")
        bad = c.isNotNull() & (F.isnan(d) | (F.abs(d) == float("inf")))
    elif rule == "non_empty":
        bad = c.isNull() | (F.length(F.trim(c)) == 0)
    elif rule == "non_negative":
        bad = c.isNotNull() & (c < 0)
    else:
        raise ValueError(f"unknown rule {rule}")
    return F.sum(bad.cast("long"))


def dq_rules(df: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """One row per (column, rule): violations and rows checked; a missing
    column is reported as rule 'column_present' with violations = rows."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    names = []
    for col, rs in rules.items():
        for r in rs:
            e = _rule_expr(df, col, r)
            key = f"__{len(names)}"
            names.append((col, r if e is not None else "column_present", key))
            aggs.append((e if e is not None else F.count(F.lit(1))).alias(key))
    one = df.agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"),
                                         F.col(k).cast("long").alias("violations")) for c, r, k in names]))
    return one.select(F.col("__rows").alias("checked"), stack.alias("v")).select(
        "v.column", "v.rule", "v.violations", "checked")


def dq_col_bytes(df: DataFrame) -> DataFrame:
    """Estimated bytes per column: strings = sum of UTF-8 bytes; 8-byte types
    rows*8; 4-byte types rows*4; booleans rows div 8 (rows include nulls)."""
    aggs, meta = [F.count(F.lit(1)).alias("__rows")], []
    for i, f in enumerate(df.schema.fields):
        s = f.dataType.simpleString()
        if s == "string":
            aggs.append(F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0)).cast("long").alias(f"__{i}"))
            meta.append((f.name, s, F.col(f"__{i}")))
        elif s in ("bigint", "double", "timestamp", "timestamp_ntz"):
            meta.append((f.name, s, F.col("__rows") * 8))
        elif s in ("int", "float", "date"):
            meta.append((f.name, s, F.col("__rows") * 4))
        elif s == "boolean":
            meta.append((f.name, s, F.floor(F.col("__rows") / 8)))
        else:
            aggs.append(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(f.name)))), F.lit(0))
                        .cast("long").alias(f"__{i}"))
            meta.append((f.name, s, F.col(f"__{i}")))
    one = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(sql_type(df.schema[n].dataType)).alias("dtype"),
                             e.cast("long").alias("bytes")) for n, s, e in meta])
    return one.select(F.explode(arr).alias("v")).select("v.column", "v.dtype", "v.bytes")


def dq_agg_invariant(df: DataFrame, group: str, value: Column) -> DataFrame:
    """Sum of per-group sums equals the grand total; count negative values.

    ``value`` should be exact (integer or decimal) so equality is exact."""
    per_group = df.groupBy(group).agg(F.sum(value).alias("__s"))
    total = df.select(F.sum(value).alias("t"), F.sum((value < 0).cast("long")).alias("neg"))
    gs = per_group.select(F.sum("__s")).scalar()
    return total.select(gs.alias("sum_of_groups"), F.col("t").alias("total"),
                        (gs == F.col("t")).alias("consistent"), F.col("neg").alias("negatives"))


def dq_describe(df: DataFrame, bytes_per_row: int = 100) -> DataFrame:
    """Schema rows (position, column, type) with the row count and an estimate
    of rows * bytes_per_row; the count is one aggregate, not a collect."""
    spark = df.sparkSession
    cols = [(i, f.name, sql_type(f.dataType)) for i, f in enumerate(df.schema.fields)]
    schema = spark.createDataFrame(cols, "position int, column string, data_type string")
    n = df.select(F.count(F.lit(1))).scalar()
    return schema.select("position", "column", "data_type", n.alias("row_count"),
                         (n * bytes_per_row).alias("est_bytes"))
