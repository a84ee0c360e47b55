"""Scalar column helpers (built-in expressions only, so they stay in codegen)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts) -> Column:
    """Microseconds since the epoch of a (zone-less) timestamp, read as UTC."""
    return F.unix_micros(col(ts).cast("timestamp"))


def from_micros(us) -> Column:
    """Zone-less timestamp from epoch microseconds."""
    return F.timestamp_micros(col(us)).cast("timestamp_ntz")


def seconds_between(later, earlier) -> Column:
    return (micros(later) - micros(earlier)) / 1e6


def safe_div(num, den) -> Column:
    """num / den; null when den is 0 or null (ANSI mode raises on / 0)."""
    return F.when(col(den) != 0, col(num) / col(den))


def ratio_or_zero(num, den) -> Column:
    """num / den, 0 when den is 0."""
    return F.when(col(den) != 0, col(num) / col(den)).otherwise(F.lit(0.0))


def max_of(df: DataFrame, c) -> Column:
    """max(c) of a DataFrame as a scalar-subquery Column (the query's own
    'now' for "last N minutes" operators -- never the wall clock)."""
    return df.select(F.max(col(c))).scalar()


def preview(text, n: int = 100) -> Column:
    """First ``n`` characters, with '...' appended when the text is longer."""
    t = col(text)
    return F.when(F.char_length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("..."))).otherwise(t)


def is_finite(c) -> Column:
    d = col(c).cast("double")
    return ~F.isnan(d) & (F.abs(d) < float("inf"))


# Units of the human-readable byte format.
BYTE_UNITS = ["Bytes", "KB", "MB", "GB", "TB"]


def format_bytes(b) -> Column:
    """Human size: unit = floor(log1024(b)) found by comparisons (no float log),
    value rounded to 2 decimals with trailing zeros dropped, '0 Bytes' for 0."""
    v = col(b).cast("long")
    idx = F.lit(0)
    for i in range(1, len(BYTE_UNITS)):
        idx = F.when(v >= F.lit(1024 ** i), F.lit(i)).otherwise(idx)
    scaled = v.cast("double") / F.pow(F.lit(1024.0), idx)
    s = F.round(scaled, 2).cast("decimal(38,2)").cast("string")
    s = F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")
    unit = F.element_at(F.array(*[F.lit(u) for u in BYTE_UNITS]), idx + 1)
    return F.when(v == 0, F.lit("0 Bytes")).otherwise(F.concat(s, F.lit(" "), unit))


def json_get(c, path: str, default=None) -> Column:
    """get_json_object with a default when the path is absent."""
    v = F.get_json_object(col(c), path)
    return v if default is None else F.coalesce(v, F.lit(default))


def uuid_like(c) -> Column:
    return col(c).rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")


def split_trim(c, sep: str = ",") -> Column:
    """Comma list -> trimmed, non-empty items."""
    parts = F.transform(F.split(col(c), sep), lambda x: F.trim(x))
    return F.filter(parts, lambda x: F.length(x) > 0)


# Exact aggregates of fixed-decimal values.  Summing doubles depends on the
# order of the additions (which differs between tasks, runs and engines);
# summing the scaled integers is exact, and one final division gives the same
# double everywhere.  ``scale`` = 10 ** (number of decimals).

def scaled(c, scale: int) -> Column:
    return F.round(col(c) * scale).cast("long")


def exact_sum(c, scale: int) -> Column:
    return F.sum(scaled(c, scale)) / float(scale)


def exact_avg(c, scale: int) -> Column:
    return F.sum(scaled(c, scale)) / F.count(col(c)) / float(scale)


def round_half_up_ratio(num, den, factor: int = 100, decimals: int = 2) -> Column:
    """round(factor * num / den, decimals) with integer arithmetic (half up),
    0 when den is 0 -- identical in every engine, unlike rounding a double."""
    k = 10 ** decimals
    n, d = col(num).cast("long"), col(den).cast("long")
    return F.when(d != 0, F.floor((n * (2 * factor * k) + d) / (d * 2)) / float(k)).otherwise(F.lit(0.0))
