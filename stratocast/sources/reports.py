"""Result tables as JSON (S5). Only small, already aggregated results go here."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(df: DataFrame, path: str, single_file: bool = True) -> None:
    """Write a result table (one row per column, model, threshold...) as JSON lines.

    ``single_file`` brings the finished rows to one task by a shuffle, so the
    stage that computes them keeps its parallelism; callers pass only
    aggregated results, whose size does not grow with the data.
    """
    out = df.repartition(1) if single_file else df
    out.write.mode("overwrite").json(path)
