"""Registered drift queries (R1-R5, R8, S6): reference = lines shipped before 1998,
current = lines shipped from 1998 on, tracked = the four measurements and two flags."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import drift as R
from ..session import scratch_path
from . import standins as S
from .catalog import OBS, query, r6

CUT = "1998-01-01 00:00:00"
CAT = ["l_linestatus", "l_returnflag"]
NUM = S.NUMERIC
RULE = f"l_shipdate < TIMESTAMP '{CUT}'"


def _split(spark, sf_dir):
    obs = S.observations(spark, sf_dir)
    is_ref = F.col("l_shipdate") < F.lit(CUT).cast("timestamp_ntz")
    return obs.where(is_ref), obs.where(~is_ref)


def _num_long_sql():
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value, {RULE} AS is_ref FROM obs WHERE {c} IS NOT NULL"
        for c in NUM)


def _cat_long_sql():
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, {RULE} AS is_ref FROM obs WHERE {c} IS NOT NULL" for c in CAT)


_WASS_CTE = OBS.rstrip() + f""",
lng AS ({_num_long_sql()}),
cnt AS (SELECT "column", value, CAST(count_if(is_ref) AS BIGINT) AS n_ref, CAST(count_if(NOT is_ref) AS BIGINT) AS n_cur FROM lng GROUP BY ALL),
tot AS (SELECT "column", CAST(count_if(is_ref) AS BIGINT) AS t_ref, CAST(count_if(NOT is_ref) AS BIGINT) AS t_cur,
               stddev_pop(CASE WHEN is_ref THEN value END) AS sd FROM lng GROUP BY ALL),
cum AS (SELECT "column", value,
          sum(n_ref) OVER (PARTITION BY "column" ORDER BY value ROWS UNBOUNDED PRECEDING) AS cr,
          sum(n_cur) OVER (PARTITION BY "column" ORDER BY value ROWS UNBOUNDED PRECEDING) AS cc,
          lead(value) OVER (PARTITION BY "column" ORDER BY value) AS nv FROM cnt),
wass AS (SELECT t."column", t.t_ref AS n_ref, t.t_cur AS n_cur,
           sum(abs(CAST(cr AS DOUBLE) / t.t_ref - CAST(cc AS DOUBLE) / t.t_cur) * (nv - value))
             / greatest(coalesce(t.sd, 0.0), 0.001) AS distance
         FROM cum JOIN tot t USING ("column") WHERE nv IS NOT NULL
         GROUP BY t."column", t.t_ref, t.t_cur, t.sd)
"""

_JS_CTE = f""",
cat AS ({_cat_long_sql()}),
cc AS (SELECT "column", value, CAST(count_if(is_ref) AS BIGINT) AS c_ref, CAST(count_if(NOT is_ref) AS BIGINT) AS c_cur FROM cat GROUP BY ALL),
ct AS (SELECT "column", sum(c_ref) AS n_ref, sum(c_cur) AS n_cur FROM cc GROUP BY ALL),
pq AS (SELECT "column", n_ref, n_cur, CAST(c_ref AS DOUBLE) / n_ref AS p, CAST(c_cur AS DOUBLE) / n_cur AS q
       FROM cc JOIN ct USING ("column")),
js AS (SELECT "column", CAST(max(n_ref) AS BIGINT) AS n_ref, CAST(max(n_cur) AS BIGINT) AS n_cur,
         sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END)
                     + sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END), 0) / 2) AS distance
       FROM pq GROUP BY ALL)
"""

_COLS_CTE = """,
cols AS (SELECT "column", 'wasserstein_distance_norm' AS method, n_ref, n_cur, distance FROM wass
         UNION ALL SELECT "column", 'jensenshannon', n_ref, n_cur, distance FROM js),
verdict AS (SELECT "column", method, n_ref, n_cur, distance, CAST(0.1 AS DOUBLE) AS threshold,
              CASE WHEN n_cur = 0 THEN 'no_data' WHEN n_ref = 0 THEN 'no_reference' ELSE 'ok' END AS status,
              coalesce(distance >= 0.1, false) AS drifted FROM cols)
"""


@query("wasserstein_norm", _WASS_CTE + 'SELECT "column", n_ref, n_cur, round(distance, 6) AS distance FROM wass')
def q_wasserstein_norm(spark, sf_dir):
    ref, cur = _split(spark, sf_dir)
    return r6(R.wasserstein_norm(ref, cur, NUM), ["distance"])


@query("js_distance", OBS.rstrip() + _JS_CTE + 'SELECT "column", n_ref, n_cur, round(distance, 6) AS distance FROM js')
def q_js_distance(spark, sf_dir):
    ref, cur = _split(spark, sf_dir)
    return r6(R.js_distance(ref, cur, CAT), ["distance"])


@query("column_drift", _WASS_CTE.rstrip() + _JS_CTE.rstrip() + _COLS_CTE + """
SELECT "column", method, n_ref, n_cur, round(distance, 6) AS distance, threshold, status, drifted FROM verdict""")
def q_column_drift(spark, sf_dir):
    ref, cur = _split(spark, sf_dir)
    return r6(R.column_drift(ref, cur, NUM, CAT), ["distance"])


_DS_SQL = """,
ds AS (SELECT count(*) AS n_columns, CAST(count_if(status = 'ok') AS BIGINT) AS n_measured,
              CAST(count_if(status = 'ok' AND drifted) AS BIGINT) AS n_drifted,
              CAST(count_if(status = 'ok' AND drifted) AS DOUBLE) / CAST(count_if(status = 'ok') AS BIGINT) AS share FROM verdict)
"""


@query("dataset_drift", _WASS_CTE.rstrip() + _JS_CTE.rstrip() + _COLS_CTE.rstrip() + _DS_SQL
       + "SELECT n_columns, n_measured, n_drifted, round(share, 6) AS share FROM ds")
def q_dataset_drift(spark, sf_dir):
    ref, cur = _split(spark, sf_dir)
    return r6(R.dataset_drift(R.column_drift(ref, cur, NUM, CAT)), ["share"])


_SUMMARY_SQL = _WASS_CTE.rstrip() + _JS_CTE.rstrip() + _COLS_CTE.rstrip() + _DS_SQL.rstrip() + f""",
sizes AS (SELECT CAST(count_if({RULE}) AS BIGINT) AS n_reference, CAST(count_if(NOT ({RULE})) AS BIGINT) AS n_current FROM obs),
summary AS (
  SELECT TIMESTAMP '2024-01-31 06:00:00' AS ts,
         CASE WHEN n_current >= 400 THEN 'ok' ELSE 'insufficient' END AS status,
         n_reference, n_current,
         CASE WHEN n_current >= 400 THEN n_drifted END AS n_drifted,
         round(CASE WHEN n_current >= 400 THEN share END, 6) AS share,
         CAST(0.5 AS DOUBLE) AS threshold, 400 AS min_samples,
         coalesce(n_current >= 400 AND share >= 0.5, false) AS retrain
  FROM sizes, ds)
"""


def _summary(spark, sf_dir):
    ref, cur = _split(spark, sf_dir)
    ts = F.lit("2024-01-31 06:00:00").cast("timestamp_ntz")
    return R.drift_summary(ref, cur, NUM, CAT, min_samples=400, share_threshold=0.5, ts=ts)


@query("drift_summary", _SUMMARY_SQL + "SELECT * FROM summary")
def q_drift_summary(spark, sf_dir):
    return r6(_summary(spark, sf_dir), ["share"])


@query("drift_gauges", _SUMMARY_SQL + """
SELECT ts, 'dataset_drift' AS metric, CAST(retrain AS DOUBLE) AS value FROM summary
UNION ALL SELECT ts, 'n_drifted_columns', CAST(n_drifted AS DOUBLE) FROM summary
UNION ALL SELECT ts, 'share_drifted_columns', share FROM summary
UNION ALL SELECT ts, 'drift_samples', CAST(n_current AS DOUBLE) FROM summary
UNION ALL SELECT ts, 'drift_last_run_timestamp', CAST(epoch(ts) AS DOUBLE) FROM summary""")
def q_drift_gauges(spark, sf_dir):
    return R.drift_gauges(r6(_summary(spark, sf_dir), ["share"]))


@query("retrain_decision", _SUMMARY_SQL + """
SELECT CASE WHEN status = 'insufficient' THEN 'skip_insufficient'
            WHEN (epoch(TIMESTAMP '2024-02-01 12:00:00') - epoch(ts)) / 3600.0 > 36 THEN 'skip_stale'
            WHEN retrain THEN 'alert' ELSE 'nothing' END AS decision,
       ts, share, threshold, round((epoch(TIMESTAMP '2024-02-01 12:00:00') - epoch(ts)) / 3600.0, 6) AS age_hours
FROM summary""")
def q_retrain_decision(spark, sf_dir):
    now = F.lit("2024-02-01 12:00:00").cast("timestamp_ntz")
    out = R.retrain_decision(r6(_summary(spark, sf_dir), ["share"]), now, 36.0)
    return r6(out, ["age_hours"])


# R6 / R7 (rows-only: seeded draws are checked by properties in tests) -------
def _calibration(spark, sf_dir):
    from ..operators.sampling import sample_exact
    from ..sources import table
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key")
    cols = [key, *NUM, *CAT]
    normal = li.select(*cols)
    # shifted traffic: one atypical group (returned lines), as the reference shifts to one station
    shifted = li.where(F.col("l_returnflag") == "R").select(*cols)
    reference = sample_exact(normal, 5000, seed=42, key_cols=["row_key"]).drop("row_key")
    return R.calibrate(reference, normal, shifted, "row_key", NUM, CAT, sizes=(50, 100, 200, 400, 800, 1500),
                       draws_normal=8, draws_shifted=5, seed=42)


@query("calibrate")
def q_calibrate(spark, sf_dir):
    return r6(R.calibration_table(_calibration(spark, sf_dir)), ["min_share", "median_share", "max_share"])


@query("separating_interval", """
SELECT user_id % 8 AS size, max(value) FILTER (event_type != 'error') AS normal_max, min(value) FILTER (event_type = 'error') AS shifted_min,
       max(value) FILTER (event_type != 'error') < min(value) FILTER (event_type = 'error') AS separated FROM events GROUP BY 1""")
def q_separating_interval(spark, sf_dir):
    """Events as a calibration table: their values as shares, errors as shifted traffic."""
    from ..sources import table
    kind = F.when(F.col("event_type") == "error", "shifted").otherwise("normal")
    return R.separating_interval(table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("size"), kind.alias("kind"), F.col("value").alias("share")))


# S2 --------------------------------------------------------------------------
_REF_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_TRACKED = [*NUM, *CAT, "l_shipdate", "l_suppkey", "l_partkey"]


@query("load_reference", f"""
WITH r AS (SELECT {", ".join(_TRACKED)} FROM lineitem ORDER BY {S.LINE_RANK_SQL}, {", ".join(_REF_KEY)} LIMIT 500)
SELECT b AS branch, r.* FROM r, (VALUES ('sample'), ('frozen')) v(b)""")
def q_load_reference(spark, sf_dir):
    """Both ways to a reference: the sample of a table without a frozen one, and
    the frozen one read back."""
    from ..sources import table
    from ..sources.observations import freeze_reference, load_reference
    path = scratch_path(spark, f"reference-{uuid.uuid4().hex}")
    li = table(spark, sf_dir, "lineitem")
    rows = load_reference(spark, path, li, n=500, tracked=_TRACKED, key_cols=_REF_KEY, rank=S.line_rank())
    sample = rows.select(F.lit("sample").alias("branch"), "*")
    freeze_reference(rows, path)
    return sample.unionByName(load_reference(spark, path, li.limit(0), n=500).select(F.lit("frozen").alias("branch"), "*"))
