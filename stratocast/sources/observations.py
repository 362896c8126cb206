"""Observation tables from delimited text (S1) and the frozen drift reference (S2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text tokens pandas' CSV reader treats as missing by
# default (its documented ``na_values`` list), plus "NA", which the
# reference also passes explicitly.
PANDAS_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# The observation schema (daily station records).
OBSERVATION_SCHEMA = T.StructType([
    T.StructField("Date", T.DateType()),
    T.StructField("Location", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in ("MinTemp", "MaxTemp", "Rainfall", "Evaporation", "Sunshine")],
    T.StructField("WindGustDir", T.StringType()),
    T.StructField("WindGustSpeed", T.DoubleType()),
    T.StructField("WindDir9am", T.StringType()),
    T.StructField("WindDir3pm", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in (
        "WindSpeed9am", "WindSpeed3pm", "Humidity9am", "Humidity3pm", "Pressure9am", "Pressure3pm",
        "Cloud9am", "Cloud3pm", "Temp9am", "Temp3pm")],
    T.StructField("RainToday", T.StringType()),
    T.StructField("RainTomorrow", T.StringType()),
])
# The declared categorical features (in this order), the
# target, the columns dropped before training, and the nine columns tracked
# for drift.
CATEGORICAL_FEATURES = ["Location", "WindGustDir", "WindDir9am", "WindDir3pm", "RainToday", "Month"]
TARGET = "RainTomorrow"
DROP_COLS = ["Date", TARGET]
DRIFT_TRACKED = ["Humidity3pm", "Humidity9am", "Sunshine", "Cloud3pm", "Pressure3pm", "Temp3pm",
                 "Rainfall", "WindGustSpeed", "Location"]


def parse_text_columns(raw: DataFrame, schema: T.StructType, na_tokens: Sequence[str] = PANDAS_NA_TOKENS,
                       date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Typed columns from text columns: NA tokens and unparsable values become null.

    Numbers go through ``try_cast`` (a plain cast throws under ANSI), dates
    through ``try_to_date``; the text "NaN" is one of the NA tokens, so no
    NaN survives.
    """
    tokens = list(na_tokens)
    out = []
    have = set(raw.columns)
    for f in schema.fields:
        if f.name not in have:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        s = F.col(f.name).cast("string")
        v = F.when(s.isNull() | s.isin(tokens), F.lit(None)).otherwise(s)
        if isinstance(f.dataType, T.DateType):
            v = F.try_to_date(v, date_format)
        elif isinstance(f.dataType, T.TimestampType):
            v = F.try_to_timestamp(v)
        elif isinstance(f.dataType, T.StringType):
            pass
        else:
            v = v.try_cast(f.dataType)
        out.append(v.alias(f.name))
    return raw.select(*out)


def read_observations(spark: SparkSession, path: str, schema: T.StructType = OBSERVATION_SCHEMA,
                      na_tokens: Sequence[str] = PANDAS_NA_TOKENS, **csv_options) -> DataFrame:
    """CSV with a header, read as text (no inference) and typed by :func:`parse_text_columns`."""
    text_schema = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = (spark.read.option("header", True).option("mode", "PERMISSIVE").options(**csv_options)
           .schema(text_schema).csv(path))
    return parse_text_columns(raw, schema, na_tokens)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def load_reference(spark: SparkSession, path: str, fallback: DataFrame | None = None, n: int = 5000,
                   seed: int = 42, tracked: Sequence[str] = DRIFT_TRACKED,
                   key_cols: Sequence[str] | None = None, rank: Column | None = None) -> DataFrame:
    """The frozen reference snapshot if it exists, else an exact seeded sample
    of the tracked columns present in ``fallback`` (written back by
    :func:`freeze_reference` to keep comparisons stable over time)."""
    if path_exists(spark, path):
        return spark.read.parquet(path)
    if fallback is None:
        raise FileNotFoundError(path)
    from ..operators.sampling import sample_exact
    cols = [c for c in tracked if c in fallback.columns]
    return sample_exact(fallback, n, seed, key_cols=key_cols, rank=rank).select(*cols)


def freeze_reference(reference: DataFrame, path: str) -> None:
    reference.write.mode("overwrite").parquet(path)
