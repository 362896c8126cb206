"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATING = (T.DoubleType, T.FloatType)


def is_double(dtype: T.DataType) -> bool:
    return isinstance(dtype, _FLOATING)


def nan_to_null(c: Column | str) -> Column:
    """NaN is a value in Spark (it poisons avg/max); the library treats it as missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def nan_to_null_all(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column, keeping names and order."""
    cols = []
    for f in df.schema.fields:
        if is_double(f.dataType):
            cols.append(nan_to_null(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, null when den is 0 or null (no ANSI error)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    """num / den, 0.0 when undefined (the metric convention of the reference)."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def rnd(c: Column | str, digits: int) -> Column:
    """Round to ``digits`` by scaling first, then rounding half away from zero.

    SQL engines round a double like this (on the scaled binary value; NumPy
    does too, but takes ties to even). Spark's ``round`` instead rounds the
    shortest decimal text of the double, which differs on values like 5.855.
    """
    c = F.col(c) if isinstance(c, str) else c
    scale = F.lit(float(10 ** digits))
    return F.round(c * scale, 0) / scale


def r4(c: Column) -> Column:
    return rnd(c, 4)


def r6(c: Column) -> Column:
    return rnd(c, 6)


def typed_null(dtype: T.DataType | str) -> Column:
    return F.lit(None).cast(dtype)
