"""Order-insensitive comparison of a Spark result with a DuckDB oracle."""
import math

import duckdb
import pandas as pd

from lakeline.plans.fixtures import TABLES


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        if v == int(v) and abs(v) < 2 ** 53:
            return str(int(v))
        return repr(round(v, 9))
    if isinstance(v, pd.Timestamp) or hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return str(v)


def canon(df: pd.DataFrame):
    cols = sorted(df.columns)
    rows = []
    for r in df[cols].itertuples(index=False, name=None):
        rows.append(tuple(_norm(None if (not isinstance(x, (list, dict)) and pd.isna(x)) else x) for x in r))
    return cols, sorted(rows)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con
