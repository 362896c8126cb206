"""Data-quality expectations: each returns the violating rows (empty = pass)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running_totals


# Q1
def expect_grid(df: DataFrame, col: str, expected: Sequence) -> DataFrame:
    """Expected keys missing from ``df[col]`` (anti join against the small expected list)."""
    spark = df.sparkSession
    dtype = df.schema[col].dataType.simpleString()
    exp = spark.createDataFrame([(v,) for v in expected], f"{col} {dtype}")
    return exp.join(df.select(col).distinct(), col, "left_anti")


# Q2
def expect_monotone(df: DataFrame, order: str, value: str, increasing: bool = False, **prefix_kw) -> DataFrame:
    """Rows where ``value`` moves against the expected direction as ``order`` rises.

    The previous value is the ``next`` value in descending order, taken by the
    bucketed running-sum operator, so no window holds the whole table.
    Output: order, value, prev_value (``order`` values must be unique).
    """
    base = df.select(order, value)
    prev = running_totals(base, order, [], descending=True, next_cols=[value], **prefix_kw)
    out = prev.select(order, value, F.col(f"next_{value}").alias(f"prev_{value}"))
    bad = F.col(value) < F.col(f"prev_{value}") if increasing else F.col(value) > F.col(f"prev_{value}")
    return out.where(bad)


# Q3
def expect_range(df: DataFrame, cols: Sequence[str], lo: float, hi: float, hi_inclusive: bool = True) -> DataFrame:
    """Rows with a value of ``cols`` that is null or outside [lo, hi] (or [lo, hi))."""
    bad = F.lit(False)
    for c in cols:
        v = F.col(c)
        upper = v > F.lit(hi) if hi_inclusive else v >= F.lit(hi)
        bad = bad | v.isNull() | F.isnan(v) | (v < F.lit(lo)) | upper
    return df.where(bad)
