"""Scoring a stream of feature records (M12).

The fitted :class:`PipelineModel` applies to a streaming DataFrame as to a
batch one. Records are validated first (P7): valid rows are scored and
appended to the prediction log (S4), rejected rows go to a side table with
the names of the failed rules. One query reads each micro-batch once and writes
both sides under the batch's id, so a restart neither loses nor duplicates
output.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.rows import validate_records
from ..plans.models import score
from ..sources.prediction_log import log_records
from .upsert import BatchSides, sides_stream


def score_records(model: PipelineModel, records: DataFrame, schema: T.StructType | Sequence[tuple[str, str]],
                  rules: Mapping[str, Column], threshold: float = 0.5,
                  version: str | None = None, digits: int | None = 4) -> tuple[DataFrame, DataFrame]:
    """(scored valid rows, rejected rows) -- one plan, batch or stream."""
    checked = validate_records(records, rules)
    valid = checked.where("valid").drop("violations", "valid")
    rejected = checked.where(~checked["valid"]).drop("valid")
    return score(model, valid, schema, threshold, version, digits=digits), rejected


LOG_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}


def scoring_sink(log_path: str, rejected_path: str) -> BatchSides:
    """Where :func:`start_scoring` writes; its ``read`` gives committed batches only."""
    return BatchSides({"log": log_path, "rejected": rejected_path}, f"{log_path.rstrip('/')}/_commits", "json", LOG_OPTIONS)


def start_scoring(model: PipelineModel, records: DataFrame, schema: T.StructType | Sequence[tuple[str, str]],
                  rules: Mapping[str, Column], log_path: str, rejected_path: str, checkpoint: str,
                  threshold: float = 0.5, version: str | None = None, feature_cols: Sequence[str] | None = None,
                  ts: str | None = "ts", trigger: dict | None = None) -> StreamingQuery:
    """Start scoring: each micro-batch is read and validated once, and its log
    rows and rejected rows are written together (exactly once by batch id)."""
    names = list(feature_cols) if feature_cols else [n for n, _ in
                                                     ([(f.name, f.dataType) for f in schema.fields]
                                                      if isinstance(schema, T.StructType) else schema)]

    def split(batch: DataFrame) -> dict[str, DataFrame]:
        # the log keeps 6 digits of the score as computed
        scored, rejected = score_records(model, batch, schema, rules, threshold, version, digits=None)
        rec = log_records(scored, names, ts=ts if ts and ts in scored.columns else None, proba="proba", label="decision")
        return {"log": rec, "rejected": rejected}

    return sides_stream(records, split, scoring_sink(log_path, rejected_path), checkpoint, trigger).start()


def json_records_stream(spark, path: str, schema: T.StructType, max_files_per_trigger: int | None = None) -> DataFrame:
    """Feature records arriving as JSON lines in a folder: typed columns plus
    ``type_errors`` (use with ``feature_record_rules(..., "type_errors")``)."""
    from ..operators.rows import parse_json_records
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return parse_json_records(reader.load(path), schema)
