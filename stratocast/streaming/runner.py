"""Run a streaming query to the end of its available input into a file sink.

Used by checks and batch-style replays: ``availableNow`` processes what is
there (in several micro-batches if limits are set) and stops. Output goes to
Parquet under a checkpointed folder, never to the driver-resident memory sink.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path
from ..sources.observations import path_exists


def run_available(stream: DataFrame, name: str = "stream", output_mode: str = "append",
                  out_path: str | None = None, timeout_s: float | None = None) -> str:
    """Drain ``stream`` into Parquet; returns the output folder. Waits as long
    as it takes unless the caller sets ``timeout_s``."""
    spark = stream.sparkSession
    run = uuid.uuid4().hex
    path = out_path or scratch_path(spark, f"{name}-{run}/out")
    ckpt = scratch_path(spark, f"{name}-{run}/checkpoint")
    q = (stream.writeStream.format("parquet").outputMode(output_mode)
         .option("path", path).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    if timeout_s is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError(f"stream {name} did not finish in {timeout_s}s")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return path


def read_output(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read a sink folder written by :func:`run_available` (empty frame if the
    folder was never made; any other failure is raised)."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
