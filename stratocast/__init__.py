"""Tabular profiling, binary forecasting, evaluation and drift monitoring on Spark.

Every operator takes and returns DataFrames; data-sized work stays on the
executors, the driver only sees fitted statistics and bounded result rows.
"""

__version__ = "0.1.0"

__all__ = ["functions", "operators", "plans", "sources", "streaming", "session"]
