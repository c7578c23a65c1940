"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """part / whole in double; null over nothing."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def rounded(x: Column, digits: int) -> Column:
    """Scale, round half to even, scale back: in double arithmetic throughout, as array libraries round."""
    scale = F.lit(float(10**digits))
    return F.rint(x * scale) / scale


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def min_max_or_half(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add each source column scaled to 0..1 over the whole frame, 0.5 where it is constant.

    The extremes come from one aggregate of one row, joined by broadcast: no window over a single partition.
    """
    lows = [F.min(c).alias(f"__lo_{c}") for c in columns]
    ends = df.agg(*lows, *[F.max(c).alias(f"__hi_{c}") for c in columns])
    out = df.join(F.broadcast(ends))  # one row
    for c, name in columns.items():
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        out = out.withColumn(name, F.when(hi == lo, F.lit(0.5)).otherwise((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0).cast("double"))))
    return out.drop(*[f"__{e}_{c}" for c in columns for e in ("lo", "hi")])
