"""Driver tables shaped as the inputs of the operators.

Each stand-in exists twice: as a DataFrame builder and as the SQL text of the
same rows (a CTE for the DuckDB oracle). Both must stay in step.

- ``observations``: ``lineitem`` as a daily observation table with missing
  values injected by a fixed rule on the key, a station-like group
  (``l_suppkey``), four measurements, one category and two Yes/No flags.
- ``scored``: ``lineitem`` with a 0/1 label (``l_returnflag = 'R'``) and a
  pseudo-random score in [0, 1) from the keys.
- ``prediction_log``: ``events`` as a log of scored requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ntz_to_utc, table

def _k():
    return F.col("l_orderkey") + F.col("l_linenumber")


def _null_when(mod: int, c):
    return F.when((_k() % mod) == 0, F.lit(None)).otherwise(c)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        _null_when(23, F.col("l_suppkey")).alias("l_suppkey"),
        "l_partkey", "l_shipdate",
        _null_when(13, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice", "l_discount", "l_tax",
        _null_when(17, F.col("l_linestatus")).alias("l_linestatus"),
        "l_returnflag",
        F.when((_k() % 19) == 0, F.lit(None))
         .when(F.col("l_linestatus") == "F", F.lit("Yes")).otherwise(F.lit("No")).alias("today_flag"),
        F.when((_k() % 11) == 0, F.lit(None))
         .when(F.col("l_returnflag") == "R", F.lit("Yes")).otherwise(F.lit("No")).alias("target_flag"),
    )


OBSERVATIONS_SQL = """
obs AS (
  SELECT l_orderkey, l_linenumber,
    CASE WHEN (l_orderkey + l_linenumber) % 23 = 0 THEN NULL ELSE l_suppkey END AS l_suppkey,
    l_partkey, l_shipdate,
    CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
    l_extendedprice, l_discount, l_tax,
    CASE WHEN (l_orderkey + l_linenumber) % 17 = 0 THEN NULL ELSE l_linestatus END AS l_linestatus,
    l_returnflag,
    CASE WHEN (l_orderkey + l_linenumber) % 19 = 0 THEN NULL
         WHEN l_linestatus = 'F' THEN 'Yes' ELSE 'No' END AS today_flag,
    CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN NULL
         WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'No' END AS target_flag
  FROM lineitem)"""

# a rank of the lines that Spark and the oracle compute alike: a linear
# combination of the key, spread over 63 bits by a multiplication
LINE_RANK_SQL = """CAST((CAST(l_orderkey * 1000003 + l_linenumber * 7919 + l_partkey * 31 + l_suppkey AS HUGEINT)
       * 6364136223846793005) % 9223372036854775808 AS BIGINT)"""


def line_rank():
    k = F.col("l_orderkey") * 1000003 + F.col("l_linenumber") * 7919 + F.col("l_partkey") * 31 + F.col("l_suppkey")
    wide = k.cast("decimal(18,0)") * F.lit("6364136223846793005").cast("decimal(19,0)")
    return F.pmod(wide, F.lit("9223372036854775808").cast("decimal(19,0)")).cast("bigint")


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def score_expr():
    raw = (F.col("l_partkey") * 7919 + F.col("l_orderkey") * 104729) % 10007
    return raw.cast("double") / F.lit(10007.0)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate",
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        score_expr().alias("score"),
    )


SCORED_SQL = """
scored AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate,
    CAST(l_returnflag = 'R' AS INTEGER) AS label,
    CAST((l_partkey * 7919 + l_orderkey * 104729) % 10007 AS DOUBLE) / 10007.0 AS score
  FROM lineitem)"""


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_prediction_log(table(spark, sf_dir, "events"))


def events_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The events table as a file stream (the single driver file of the folder)."""
    schema = table(spark, sf_dir, "events").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(sf_dir)


def as_prediction_log(events: DataFrame) -> DataFrame:
    """Events (batch or stream) in prediction-log shape."""
    ev = ntz_to_utc(events, ["ts"])
    proba = F.col("value") / (F.col("value") + F.lit(50.0))
    return ev.select(
        "ts", F.col("event_id").cast("string").alias("request_id"), "event_id", "user_id",
        "event_type", "value", proba.alias("proba"), (proba >= 0.5).alias("label"),
        F.lit(0.5).alias("threshold"), F.lit("1").alias("model_version"), "props",
    )


PREDICTION_LOG_SQL = """
plog AS (
  SELECT ts, CAST(event_id AS VARCHAR) AS request_id, event_id, user_id, event_type, value,
    value / (value + 50.0) AS proba, value / (value + 50.0) >= 0.5 AS label,
    0.5 AS threshold, '1' AS model_version, props
  FROM events)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
