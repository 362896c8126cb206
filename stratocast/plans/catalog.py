"""Registered queries: one per operator, each with its DuckDB oracle SQL.

Every query reads whole driver tables (through :mod:`standins`) and returns a
DataFrame whose column names equal the oracle's. Computed doubles are
rounded to 6 digits on both sides; counts are BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rnd
from ..operators import profile as A
from ..operators import rows as P
from ..sources import table
from . import standins as S

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def r6(df: DataFrame, cols) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, rnd(F.col(c), 6))
    return df


OBS = S.with_ctes(S.OBSERVATIONS_SQL)
OBS_COLS = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_returnflag",
            "today_flag", "target_flag"]
NUM = S.NUMERIC


def _label_r(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("label"))


# --- A11 flagship -----------------------------------------------------------
@query("target_rate_by_supplier", """
SELECT l_suppkey, round(avg(CAST(l_returnflag = 'R' AS INTEGER)) * 100, 2) AS rate_pct,
       count(*) AS n
FROM lineitem GROUP BY l_suppkey""")
def q_target_rate_by_supplier(spark, sf_dir):
    return A.target_rate(_label_r(spark, sf_dir), "l_suppkey", "label")


@query("target_rate_with_nulls", OBS + """
SELECT l_suppkey, round(avg(y) * 100, 2) AS rate_pct, count(*) AS n
FROM (SELECT l_suppkey, CASE target_flag WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS y FROM obs)
WHERE l_suppkey IS NOT NULL AND y IS NOT NULL GROUP BY l_suppkey""")
def q_target_rate_with_nulls(spark, sf_dir):
    obs = P.map_label(S.observations(spark, sf_dir), "target_flag")
    return A.target_rate(obs, "l_suppkey", "label")


# --- A1 ---------------------------------------------------------------------
def _profile_sql():
    counts = ", ".join(f"count({c}) AS c{i}" for i, c in enumerate(OBS_COLS))
    parts = [f"SELECT {i} AS position, '{c}' AS \"column\", n AS n_rows, {len(OBS_COLS)} AS n_cols, "
             f"c{i} AS non_null, round(CAST(n - c{i} AS DOUBLE) / n * 100, 2) AS null_pct FROM agg"
             for i, c in enumerate(OBS_COLS)]
    return OBS.rstrip() + f",\nagg AS (SELECT count(*) AS n, {counts} FROM obs)\n" + "\nUNION ALL\n".join(parts)


@query("profile_columns", _profile_sql())
def q_profile_columns(spark, sf_dir):
    out = A.profile_columns(S.observations(spark, sf_dir))
    return out.select("position", "column", "n_rows", "n_cols", "non_null", "null_pct")


# --- A2 ---------------------------------------------------------------------
@query("count_duplicates", OBS + f"""
SELECT CAST(sum(c - 1) AS BIGINT) AS n_duplicates, count(*) AS n_distinct_rows
FROM (SELECT count(*) AS c FROM (SELECT * FROM obs UNION ALL SELECT * FROM obs WHERE l_quantity > 45)
      GROUP BY {', '.join(OBS_COLS)})""")
def q_count_duplicates(spark, sf_dir):
    """Whole rows; some are there twice."""
    obs = S.observations(spark, sf_dir)
    return A.count_duplicates(obs.unionByName(obs.where("l_quantity > 45")))


# --- A3 ---------------------------------------------------------------------
@query("date_coverage", """
SELECT CAST(min(o_orderdate) AS DATE) AS min_date, CAST(max(o_orderdate) AS DATE) AS max_date,
       count(DISTINCT CAST(o_orderdate AS DATE)) AS n_dates,
       count(DISTINCT year(o_orderdate)) AS n_years,
       (SELECT string_agg(CAST(y AS VARCHAR), ',' ORDER BY y)
          FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)) AS years
FROM orders""")
def q_date_coverage(spark, sf_dir):
    out = A.date_coverage(table(spark, sf_dir, "orders"), "o_orderdate")
    return out.withColumn("years", F.array_join(F.transform("years", lambda y: y.cast("string")), ","))


# --- A4 ---------------------------------------------------------------------
@query("group_size_stats", OBS + """,
s AS (SELECT l_suppkey AS k, count(*) AS c FROM obs WHERE l_suppkey IS NOT NULL GROUP BY 1)
SELECT count(*) AS n_groups, min(c) AS min_size, max(c) AS max_size, round(avg(c), 1) AS mean_size,
       (SELECT k FROM s ORDER BY c, k LIMIT 1) AS key_min,
       (SELECT k FROM s ORDER BY c DESC, k LIMIT 1) AS key_max
FROM s""")
def q_group_size_stats(spark, sf_dir):
    return A.group_size_stats(S.observations(spark, sf_dir), "l_suppkey")


# --- A5 ---------------------------------------------------------------------
@query("target_balance", OBS + """
SELECT n_yes, n_no, n_missing, n_rows,
       round(CAST(n_missing AS DOUBLE) / n_rows * 100, 2) AS pct_missing,
       round(CAST(n_yes AS DOUBLE) / (n_yes + n_no) * 100, 2) AS base_rate_pct,
       round(CAST(n_no AS DOUBLE) / (n_yes + n_no) * 100, 2) AS always_no_pct
FROM (SELECT CAST(count_if(target_flag = 'Yes') AS BIGINT) AS n_yes, CAST(count_if(target_flag = 'No') AS BIGINT) AS n_no,
             CAST(count_if(target_flag IS NULL) AS BIGINT) AS n_missing, count(*) AS n_rows FROM obs)""")
def q_target_balance(spark, sf_dir):
    return A.target_balance(S.observations(spark, sf_dir), "target_flag")


# --- A6 ---------------------------------------------------------------------
@query("persistence_baseline", OBS + """
SELECT round(CAST(eq AS DOUBLE) / n_rows * 100, 2) AS accuracy_pct, n_rows,
       round(CAST(ty_yy AS DOUBLE) / ty * 100, 2) AS p_yes_given_today_yes_pct,
       round(CAST(tn_yy AS DOUBLE) / tn * 100, 2) AS p_yes_given_today_no_pct,
       round(CAST(ty_yy AS DOUBLE) / ty * 100, 2) AS precision_pct,
       round(CAST(ty_yy AS DOUBLE) / yy * 100, 2) AS recall_pct
FROM (SELECT count(*) AS n_rows, CAST(count_if(today_flag = target_flag) AS BIGINT) AS eq,
             CAST(count_if(today_flag = 'Yes') AS BIGINT) AS ty,
             CAST(count_if(today_flag = 'Yes' AND target_flag = 'Yes') AS BIGINT) AS ty_yy,
             CAST(count_if(today_flag = 'No') AS BIGINT) AS tn,
             CAST(count_if(today_flag = 'No' AND target_flag = 'Yes') AS BIGINT) AS tn_yy,
             CAST(count_if(target_flag = 'Yes') AS BIGINT) AS yy
      FROM obs WHERE today_flag IS NOT NULL AND target_flag IS NOT NULL)""")
def q_persistence_baseline(spark, sf_dir):
    return A.persistence_baseline(S.observations(spark, sf_dir), "today_flag", "target_flag")


# --- A7 ---------------------------------------------------------------------
# The mean is the exact decimal sum over the count on both sides: a double sum
# depends on summation order (partitions, threads), and several driver means
# sit exactly on a 6th-digit tie.
def _describe_sql():
    parts = [f"SELECT {i} AS position, '{c}' AS \"column\", round(min({c}), 6) AS min, "
             f"round(max({c}), 6) AS max, "
             f"round(CAST(sum(CAST({c} AS DECIMAL(38, 9))) AS DOUBLE) / count({c}), 6) AS mean, "
             f"round(stddev_samp({c}), 6) AS std, count({c}) AS count FROM obs"
             for i, c in enumerate(NUM)]
    return OBS + "\nUNION ALL\n".join(parts)


@query("numeric_describe", _describe_sql())
def q_numeric_describe(spark, sf_dir):
    out = A.numeric_describe(S.observations(spark, sf_dir), NUM, exact_mean_scale=9)
    return r6(out, ["min", "max", "mean", "std"])


# --- A8 ---------------------------------------------------------------------
def _corr_sql():
    parts = []
    for i, c in enumerate(NUM):
        x = f"CASE WHEN y IS NOT NULL THEN CAST({c} AS DOUBLE) END"
        y = f"CASE WHEN {c} IS NOT NULL THEN y END"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", "
            f"round(CASE WHEN count({x}) >= 2 AND var_samp({x}) > 0 AND var_samp({y}) > 0 "
            f"THEN covar_samp({x}, {y}) / sqrt(var_samp({x}) * var_samp({y})) END, 6) AS corr, "
            f"count({x}) AS n_pairs FROM lab")
    return (OBS.rstrip() + ",\nlab AS (SELECT *, CAST(CASE target_flag WHEN 'Yes' THEN 1 "
            "WHEN 'No' THEN 0 END AS DOUBLE) AS y FROM obs)\n" + "\nUNION ALL\n".join(parts))


@query("target_correlations", _corr_sql())
def q_target_correlations(spark, sf_dir):
    obs = P.map_label(S.observations(spark, sf_dir), "target_flag")
    return r6(A.target_correlations(obs, NUM, "label"), ["corr"])


# --- A9 ---------------------------------------------------------------------
@query("class_means", OBS + "SELECT target_flag, " + ", ".join(
    f"round(avg({c}), 6) AS mean_{c}" for c in NUM) + " FROM obs WHERE target_flag IS NOT NULL GROUP BY target_flag")
def q_class_means(spark, sf_dir):
    return r6(A.class_means(S.observations(spark, sf_dir), NUM, "target_flag"), [f"mean_{c}" for c in NUM])


# --- A10 --------------------------------------------------------------------
@query("value_distribution", OBS + "SELECT l_linestatus, count(*) AS n FROM obs GROUP BY l_linestatus")
def q_value_distribution(spark, sf_dir):
    return A.value_distribution(S.observations(spark, sf_dir), "l_linestatus")


# --- A12 --------------------------------------------------------------------
@query("rate_extremes", """
WITH r AS (SELECT l_suppkey, round(avg(CAST(l_returnflag = 'R' AS INTEGER)) * 100, 2) AS rate_pct
           FROM lineitem GROUP BY l_suppkey)
(SELECT 'top' AS side, l_suppkey, rate_pct FROM r ORDER BY rate_pct DESC, l_suppkey LIMIT 5)
UNION ALL
(SELECT 'bottom' AS side, l_suppkey, rate_pct FROM r ORDER BY rate_pct ASC, l_suppkey DESC LIMIT 5)""")
def q_rate_extremes(spark, sf_dir):
    rates = A.target_rate(_label_r(spark, sf_dir), "l_suppkey", "label")
    return A.rate_extremes(rates, "l_suppkey", 5)


# --- A13 --------------------------------------------------------------------
_MONTH_RATE_SQL = """,
m AS (SELECT CAST(month(l_shipdate) AS INTEGER) AS month, round(avg(y) * 100, 2) AS rate_pct, count(*) AS n
      FROM (SELECT l_shipdate, CASE target_flag WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS y FROM obs)
      WHERE y IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY 1)
"""


@query("rate_by_month", OBS.rstrip() + _MONTH_RATE_SQL + "SELECT month, rate_pct, n FROM m")
def q_rate_by_month(spark, sf_dir):
    obs = P.map_label(S.observations(spark, sf_dir), "target_flag")
    return A.rate_by_month(obs, "l_shipdate", "label")


@query("month_extremes", OBS.rstrip() + _MONTH_RATE_SQL + """
SELECT (SELECT month FROM m ORDER BY rate_pct DESC, month LIMIT 1) AS wettest_month,
       max(rate_pct) AS wettest_pct,
       (SELECT month FROM m ORDER BY rate_pct ASC, month LIMIT 1) AS driest_month,
       min(rate_pct) AS driest_pct FROM m""")
def q_month_extremes(spark, sf_dir):
    obs = P.map_label(S.observations(spark, sf_dir), "target_flag")
    return A.month_extremes(A.rate_by_month(obs, "l_shipdate", "label"))


# --- A14 --------------------------------------------------------------------
def _class_quantiles_sql():
    parts = [f"SELECT target_flag, '{c}' AS \"column\", count({c}) AS n, round(min({c}), 6) AS min, "
             f"round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, "
             f"round(quantile_cont({c}, 0.75), 6) AS q3, round(max({c}), 6) AS max "
             f"FROM obs WHERE target_flag IS NOT NULL AND {c} IS NOT NULL GROUP BY target_flag"
             for c in NUM]
    return OBS + "\nUNION ALL\n".join(parts)


@query("class_quantiles", _class_quantiles_sql())
def q_class_quantiles(spark, sf_dir):
    out = A.class_quantiles(S.observations(spark, sf_dir), NUM, "target_flag")
    return r6(out, ["min", "q1", "median", "q3", "max"])


# --- A15 --------------------------------------------------------------------
_TRAIN_RULE = "l_shipdate < TIMESTAMP '1999-01-01 00:00:00'"


def _median_shift_sql():
    parts = [f"SELECT '{c}' AS \"column\", round(median({c}), 6) AS median_all, "
             f"round(median({c}) FILTER (WHERE {_TRAIN_RULE}), 6) AS median_train, "
             f"round(abs(median({c}) - median({c}) FILTER (WHERE {_TRAIN_RULE})), 6) AS abs_diff FROM obs"
             for c in NUM]
    return OBS + "\nUNION ALL\n".join(parts)


@query("median_shift", _median_shift_sql())
def q_median_shift(spark, sf_dir):
    obs = S.observations(spark, sf_dir).withColumn(
        "is_train", F.col("l_shipdate") < F.lit("1999-01-01 00:00:00").cast("timestamp_ntz"))
    return r6(A.median_shift(obs, NUM, "is_train"), ["median_all", "median_train", "abs_diff"])


# --- P1-P10 -----------------------------------------------------------------
@query("drop_unlabelled", OBS + "SELECT l_orderkey, l_linenumber, target_flag FROM obs WHERE target_flag IS NOT NULL")
def q_drop_unlabelled(spark, sf_dir):
    return P.drop_unlabelled(S.observations(spark, sf_dir), "target_flag").select(
        "l_orderkey", "l_linenumber", "target_flag")


@query("encode_label", OBS + """
SELECT l_orderkey, l_linenumber, CAST(target_flag = 'Yes' AS INTEGER) AS label
FROM obs WHERE target_flag IS NOT NULL""")
def q_encode_label(spark, sf_dir):
    return P.encode_label(S.observations(spark, sf_dir), "target_flag").select(
        "l_orderkey", "l_linenumber", "label")


@query("map_label", """
SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'N' THEN 0 END AS label
FROM lineitem""")
def q_map_label(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return P.map_label(li, "l_returnflag", yes="R", no="N").select("l_orderkey", "l_linenumber", "label")


@query("add_month", "SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders")
def q_add_month(spark, sf_dir):
    return P.add_month(table(spark, sf_dir, "orders"), "o_orderdate", out="month").select("o_orderkey", "month")


@query("align_columns", """
SELECT p_partkey, p_name, p_size, CAST(NULL AS VARCHAR) AS p_color, p_retailprice FROM part""")
def q_align_columns(spark, sf_dir):
    spec = [("p_partkey", "bigint"), ("p_name", "string"), ("p_size", "int"),
            ("p_color", "string"), ("p_retailprice", "double")]
    return P.align_columns(table(spark, sf_dir, "part"), spec)


@query("validate_records", """
SELECT event_id, (CASE WHEN NOT coalesce(k IS NULL OR k BETWEEN 1 AND 12, false) THEN 1 ELSE 0 END
                + CASE WHEN NOT coalesce(value IS NULL OR value > 0, false) THEN 1 ELSE 0 END) = 0 AS valid,
       concat_ws(',', CASE WHEN NOT coalesce(k IS NULL OR k BETWEEN 1 AND 12, false) THEN 'month_range' END,
                      CASE WHEN NOT coalesce(value IS NULL OR value > 0, false) THEN 'positive_value' END)
         AS violations
FROM (SELECT event_id, value, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def q_validate_records(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        "event_id", "value", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    rules = P.feature_record_rules("k")
    rules["positive_value"] = F.col("value").isNull() | (F.col("value") > 0)
    out = P.validate_records(ev, rules)
    return out.select("event_id", "valid", F.array_join("violations", ",").alias("violations"))


@query("filter_group", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_suppkey = 7")
def q_filter_group(spark, sf_dir):
    return P.filter_group(table(spark, sf_dir, "lineitem"), "l_suppkey", 7).select(
        "l_orderkey", "l_linenumber", "l_quantity")


@query("apply_threshold", S.with_ctes(S.SCORED_SQL) + """
SELECT l_orderkey, l_linenumber, score >= 0.5 AS decision FROM scored""")
def q_apply_threshold(spark, sf_dir):
    return P.apply_threshold(S.scored(spark, sf_dir), "score", 0.5).select(
        "l_orderkey", "l_linenumber", "decision")


@query("null_count_per_row", OBS + "SELECT l_orderkey, l_linenumber, " + " + ".join(
    f"CAST({c} IS NULL AS INTEGER)" for c in OBS_COLS) + " AS n_null FROM obs")
def q_null_count_per_row(spark, sf_dir):
    return P.null_count_per_row(S.observations(spark, sf_dir)).select("l_orderkey", "l_linenumber", "n_null")

