"""The prediction log: one JSON line per scored request (S3 read, S4 write).

Line layout: ts, request_id, model_version, threshold, proba (6 digits),
label, features (the scored record as a nested object). The reader keeps
lines that hold a ``features`` object and drops blank, cut, non-object or
feature-less lines; a badly typed field inside ``features`` becomes null and
the line is kept (the filter is on ``features``, never on the corrupt column).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..functions import rnd
from .observations import path_exists


def log_schema(features: T.StructType) -> T.StructType:
    return T.StructType([
        T.StructField("ts", T.TimestampType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("proba", T.DoubleType()),
        T.StructField("label", T.BooleanType()),
        T.StructField("features", features),
    ])


def _feature_columns(features: T.StructType, columns: Sequence[str] | None) -> list[Column]:
    names = list(columns) if columns else [f.name for f in features.fields]
    have = {f.name: f.dataType for f in features.fields}
    return [(F.col(f"features.{n}") if n in have else F.lit(None).cast("string")).alias(n) for n in names]


def parse_log_lines(lines: DataFrame, features: T.StructType, columns: Sequence[str] | None = None,
                    text_col: str = "value") -> DataFrame:
    """Feature rows of JSON log lines held in a text column (batch or stream)."""
    rec = F.from_json(F.col(text_col), log_schema(features), {"mode": "PERMISSIVE"})
    parsed = lines.select(rec.alias("r")).select("r.*")
    return parsed.where(F.col("features").isNotNull()).select(*_feature_columns(features, columns))


def read_prediction_log(spark: SparkSession, path: str, features: T.StructType,
                        columns: Sequence[str] | None = None) -> DataFrame:
    """Batch read; a missing path gives an empty frame with the asked columns."""
    names = list(columns) if columns else [f.name for f in features.fields]
    if not path_exists(spark, path):
        have = {f.name: f.dataType for f in features.fields}
        schema = T.StructType([T.StructField(n, have.get(n, T.StringType())) for n in names])
        return spark.createDataFrame([], schema)
    return parse_log_lines(spark.read.text(path), features, columns)


def read_prediction_log_stream(spark: SparkSession, path: str, features: T.StructType,
                               columns: Sequence[str] | None = None, with_meta: bool = False,
                               max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of a log folder (new files are picked up as they land)."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.load(path)
    if not with_meta:
        return parse_log_lines(lines, features, columns)
    rec = F.from_json(F.col("value"), log_schema(features), {"mode": "PERMISSIVE"})
    parsed = lines.select(rec.alias("r")).select("r.*").where(F.col("features").isNotNull())
    return parsed


def log_records(scored: DataFrame, feature_cols: Sequence[str], ts: str | Column | None = None,
                request_id: str | None = "request_id", proba: str = "proba", label: str = "decision",
                threshold: str | float = "threshold", version: str | None = "model_version") -> DataFrame:
    """Rows in log layout. A request id from the input is kept (replays then
    repeat ids instead of inventing new ones); without one, ``uuid()``."""
    def col_or_lit(v, dtype):
        if isinstance(v, str) and v in scored.columns:
            return F.col(v).cast(dtype)
        if isinstance(v, (int, float)):
            return F.lit(float(v)).cast(dtype)
        return F.lit(None).cast(dtype)

    ts_col = (F.col(ts) if isinstance(ts, str) else ts) if ts is not None else F.current_timestamp()
    rid = F.col(request_id).cast("string") if request_id and request_id in scored.columns else F.expr("uuid()")
    return scored.select(
        F.date_trunc("second", ts_col.cast("timestamp")).alias("ts"),
        rid.alias("request_id"),
        col_or_lit(version, "string").alias("model_version"),
        col_or_lit(threshold, "double").alias("threshold"),
        rnd(F.col(proba).cast("double"), 6).alias("proba"),
        F.col(label).cast("boolean").alias("label"),
        F.struct(*[F.col(c) for c in feature_cols]).alias("features"),
    )


def write_prediction_log(records: DataFrame, path: str, partition_by_day: bool = False) -> None:
    """Append log rows as JSON lines (batch). A failure fails the job: no silent loss.

    ``partition_by_day`` adds a ``day`` folder level, so a drift job over a
    date range reads only those folders (partition pruning).
    """
    if partition_by_day:
        records = records.withColumn("day", F.to_date("ts"))
    w = records.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX")
    if partition_by_day:
        w = w.partitionBy("day")
    w.json(path)


def write_prediction_log_stream(records: DataFrame, path: str, checkpoint: str,
                                trigger: dict | None = None) -> DataStreamWriter:
    """Streaming append to the log folder; the file sink's commit log makes
    replays after a failure idempotent."""
    w = (records.writeStream.format("json").outputMode("append")
         .option("path", path).option("checkpointLocation", checkpoint)
         .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    if trigger:
        w = w.trigger(**trigger)
    return w
