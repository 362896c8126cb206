"""Parquet tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ntz_to_utc(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Cast TIMESTAMP_NTZ columns to TIMESTAMP (session zone UTC).

    Watermarks reject TIMESTAMP_NTZ, so event-time operators call this first.
    """
    names = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    for c in names:
        if isinstance(df.schema[c].dataType, T.TimestampNTZType):
            df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df


def utc_to_ntz(df: DataFrame) -> DataFrame:
    """Cast TIMESTAMP columns back to TIMESTAMP_NTZ for zone-free output."""
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampType):
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp_ntz"))
    return df
