"""Registered monitoring, source and expectation queries (O1-O10, S1, S3/S4, Q1-Q3).

Stand-in log: ``events`` as scored requests (proba = value / (value + 50),
decision proba >= 0.5, request latency = value / 100 s, errors =
``event_type = 'error'``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import expect as Q
from ..operators import monitor as O
from ..session import scratch_path
from ..sources import table, utc_to_ntz
from ..sources.observations import parse_text_columns, read_observations
from ..sources.prediction_log import log_records, parse_log_lines, read_prediction_log, write_prediction_log
from . import standins as S
from .catalog import query, r6

PL = S.with_ctes(S.PREDICTION_LOG_SQL)


def _plog(spark, sf_dir):
    return S.prediction_log(spark, sf_dir)


# O1 -------------------------------------------------------------------------
@query("outcome_share", PL + """
SELECT count(*) AS n, CAST(count_if(label) AS BIGINT) AS n_positive,
       round(CAST(count_if(label) AS DOUBLE) / greatest(count(*), 1), 6) AS share FROM plog""")
def q_outcome_share(spark, sf_dir):
    return r6(O.outcome_share(_plog(spark, sf_dir)), ["share"])


@query("outcome_share_by_type", PL + """
SELECT event_type, count(*) AS n, CAST(count_if(label) AS BIGINT) AS n_positive,
       round(CAST(count_if(label) AS DOUBLE) / greatest(count(*), 1), 6) AS share FROM plog GROUP BY event_type""")
def q_outcome_share_by_type(spark, sf_dir):
    return r6(O.outcome_share(_plog(spark, sf_dir), group_cols=["event_type"]), ["share"])


# O2 / O3 --------------------------------------------------------------------
def _bounds_sql(bounds, name="b"):
    vals = ", ".join(f"({i}, CAST({b!r} AS DOUBLE))" for i, b in enumerate(bounds))
    return f"{name} AS (SELECT * FROM (VALUES {vals}, ({len(bounds)}, CAST(NULL AS DOUBLE))) t(bucket, le))"


_HIST_SQL = PL.rstrip() + ",\n" + _bounds_sql(O.PROBA_BOUNDS) + """,
hist AS (SELECT bucket, le, CAST(count_if(le IS NULL OR proba <= le) AS BIGINT) AS cum_count
         FROM b, plog GROUP BY bucket, le)
"""


@query("proba_histogram", _HIST_SQL + "SELECT bucket, le, cum_count FROM hist")
def q_proba_histogram(spark, sf_dir):
    return O.histogram(_plog(spark, sf_dir), "proba", O.PROBA_BOUNDS)


def _quantile_sql(hist: str, q: float, name: str, group: str = "") -> str:
    g = f"PARTITION BY {group}" if group else ""
    gsel = f"{group}, " if group else ""
    return f"""(SELECT {gsel}CASE WHEN total = 0 THEN NULL WHEN le IS NULL THEN prev_le
                       WHEN bucket = 0 AND le <= 0 THEN le
                       ELSE coalesce(prev_le, 0.0) + (le - coalesce(prev_le, 0.0))
                            * ((CAST({q!r} AS DOUBLE) * total - coalesce(prev_cum, 0)) / (cum_count - coalesce(prev_cum, 0)))
                  END AS {name}
  FROM (SELECT *, row_number() OVER ({g} ORDER BY bucket) AS rn FROM (
          SELECT *, lag(le) OVER ({g} ORDER BY bucket) AS prev_le, lag(cum_count) OVER ({g} ORDER BY bucket) AS prev_cum,
                 max(cum_count) OVER ({g}) AS total, max(bucket) OVER ({g}) AS last FROM {hist})
        WHERE cum_count >= CAST({q!r} AS DOUBLE) * total OR bucket = last)
  WHERE rn = 1)"""


@query("histogram_quantile", _HIST_SQL + f"""
SELECT round(a.p50, 6) AS p50, round(c.p90, 6) AS p90
FROM {_quantile_sql('hist', 0.5, 'p50')} a, {_quantile_sql('hist', 0.9, 'p90')} c""")
def q_histogram_quantile(spark, sf_dir):
    hist = O.histogram(_plog(spark, sf_dir), "proba", O.PROBA_BOUNDS)
    return r6(O.histogram_quantiles(hist, [0.5, 0.9]), ["p50", "p90"])


# O4 / O5 --------------------------------------------------------------------
_WIN_SQL = PL.rstrip() + """,
win AS (SELECT date_trunc('minute', ts) - to_minutes(k) AS window_start,
               date_trunc('minute', ts) - to_minutes(k) + INTERVAL 5 MINUTE AS window_end, plog.*
        FROM plog, range(0, 5) r(k))
"""


@query("sliding_rate", _WIN_SQL + """
SELECT window_start, window_end, event_type, count(*) AS n, round(count(*) / 300.0, 6) AS rate
FROM win GROUP BY ALL""")
def q_sliding_rate(spark, sf_dir):
    out = O.sliding_rate(_plog(spark, sf_dir), "5 minutes", "1 minute", by=["event_type"])
    return utc_to_ntz(r6(out, ["rate"]))


_ERR_SQL = _WIN_SQL.rstrip() + """,
err AS (SELECT window_start, window_end, count(*) AS n, CAST(count_if(event_type = 'error') AS BIGINT) AS n_error,
               CAST(count_if(event_type = 'error') AS DOUBLE) / greatest(count(*), 1) AS share
        FROM win GROUP BY ALL)
"""


@query("error_share", _ERR_SQL + "SELECT window_start, window_end, n, n_error, round(share, 6) AS share FROM err")
def q_error_share(spark, sf_dir):
    out = O.error_share(_plog(spark, sf_dir), F.col("event_type") == "error", "5 minutes", "1 minute")
    return utc_to_ntz(r6(out, ["share"]))


# O6 -------------------------------------------------------------------------
_LAT_BOUNDS = (0.05, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5)


@query("latency_quantiles", PL.rstrip() + ",\n" + _bounds_sql(_LAT_BOUNDS) + """,
w AS (SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
             value / 100.0 AS latency FROM plog),
hist AS (SELECT window_start, window_end, bucket, le,
                CAST(count_if(le IS NULL OR latency <= le) AS BIGINT) AS cum_count
         FROM b, w GROUP BY ALL)
SELECT a.window_start, a.window_end, round(a.p50, 6) AS p50, round(c.p95, 6) AS p95, round(d.p99, 6) AS p99
FROM """ + _quantile_sql("hist", 0.5, "p50", "window_start, window_end") + " a JOIN "
       + _quantile_sql("hist", 0.95, "p95", "window_start, window_end") + " c USING (window_start, window_end) JOIN "
       + _quantile_sql("hist", 0.99, "p99", "window_start, window_end") + " d USING (window_start, window_end)")
def q_latency_quantiles(spark, sf_dir):
    log = _plog(spark, sf_dir).withColumn("latency", F.col("value") / 100.0)
    out = O.latency_quantiles(log, "latency", "1 hour", None, _LAT_BOUNDS)
    return utc_to_ntz(r6(out, ["p50", "p95", "p99"]))


# O7 -------------------------------------------------------------------------
@query("sustained_alerts", _ERR_SQL.rstrip() + """,
t AS (SELECT window_start, CAST(epoch(window_start) / 60 AS BIGINT) AS idx FROM err WHERE share > 0.25),
isl AS (SELECT window_start, idx - row_number() OVER (ORDER BY idx) AS island FROM t),
g AS (SELECT min(window_start) AS start, max(window_start) AS "end", count(*) AS n_samples FROM isl GROUP BY island)
SELECT start, "end", n_samples, CAST(epoch("end") - epoch(start) AS DOUBLE) AS duration_s,
       start + INTERVAL 120 SECOND AS fires_at
FROM g WHERE epoch("end") - epoch(start) >= 120""")
def q_sustained_alerts(spark, sf_dir):
    es = O.error_share(_plog(spark, sf_dir), F.col("event_type") == "error", "5 minutes", "1 minute")
    out = O.sustained_alerts(es, F.col("share") > 0.25, hold_seconds=120, step_seconds=60, ts="window_start")
    return utc_to_ntz(out)


# O8 -------------------------------------------------------------------------
@query("stale_series", PL + """
SELECT user_id, max(ts) AS last_ts, CAST(epoch((SELECT max(ts) FROM plog)) - epoch(max(ts)) AS DOUBLE) AS age_s
FROM plog GROUP BY user_id
HAVING epoch((SELECT max(ts) FROM plog)) - epoch(max(ts)) > 172800""")
def q_stale_series(spark, sf_dir):
    log = _plog(spark, sf_dir)
    now_us = log.agg(F.max(F.unix_micros("ts"))).first()[0]
    out = O.stale_series(log, F.timestamp_micros(F.lit(now_us)), 172800.0, ["user_id"])
    return utc_to_ntz(r6(out, ["age_s"]))


# O9 -------------------------------------------------------------------------
@query("latest_gauge", PL + """
SELECT event_type, ts, value FROM (
  SELECT event_type, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) AS rn
  FROM plog) WHERE rn = 1""")
def q_latest_gauge(spark, sf_dir):
    return utc_to_ntz(O.latest_gauge(_plog(spark, sf_dir), ["event_type"], "ts", "value"))


# O10 ------------------------------------------------------------------------
def _alerts_df(spark, sf_dir):
    rate = O.sliding_rate(_plog(spark, sf_dir), "5 minutes", "1 minute", by=["event_type"])
    isl = O.sustained_alerts(rate, F.col("n") >= 3, hold_seconds=120, step_seconds=60,
                             series_cols=["event_type"], ts="window_start")
    return isl.select(
        F.concat_ws(":", F.col("event_type"), F.unix_seconds(F.col("start").cast("timestamp")).cast("string"))
         .alias("alert_id"),
        F.concat(F.lit("High_"), F.col("event_type")).alias("alertname"),
        F.when(F.col("event_type") == "error", F.lit("critical")).otherwise(F.lit("warning")).alias("severity"),
        F.lit("api").alias("job"), "start", "end")


@query("inhibit_alerts", _WIN_SQL.rstrip() + """,
rate AS (SELECT window_start, event_type, count(*) AS n FROM win GROUP BY ALL),
t AS (SELECT event_type, window_start, CAST(epoch(window_start) / 60 AS BIGINT) AS idx FROM rate WHERE n >= 3),
isl AS (SELECT *, idx - row_number() OVER (PARTITION BY event_type ORDER BY idx) AS island FROM t),
g AS (SELECT event_type, min(window_start) AS start, max(window_start) AS "end" FROM isl GROUP BY event_type, island
      HAVING epoch(max(window_start)) - epoch(min(window_start)) >= 120),
alerts AS (SELECT event_type || ':' || CAST(CAST(epoch(start) AS BIGINT) AS VARCHAR) AS alert_id,
                  'High_' || event_type AS alertname,
                  CASE WHEN event_type = 'error' THEN 'critical' ELSE 'warning' END AS severity,
                  'api' AS job, start, "end" FROM g)
SELECT alert_id, alertname, severity, job, start, "end" FROM alerts a
WHERE alertname = 'High_error' OR NOT EXISTS (
  SELECT 1 FROM alerts s WHERE s.alertname = 'High_error' AND s.job = a.job
    AND a.start <= s."end" AND s.start <= a."end")""")
def q_inhibit_alerts(spark, sf_dir):
    return utc_to_ntz(O.inhibit_alerts(_alerts_df(spark, sf_dir), "High_error"))


# S1 -------------------------------------------------------------------------
_K = "(l_orderkey + l_linenumber)"


_OBSERVATIONS_SQL = f"""
SELECT l_orderkey, l_linenumber, TRY_CAST(q AS DOUBLE) AS l_quantity, TRY_CAST(d AS DATE) AS l_shipdate,
       CASE WHEN f IN ('NA', 'n/a', '') THEN NULL ELSE f END AS l_linestatus
FROM (SELECT l_orderkey, l_linenumber,
        CASE WHEN {_K} % 13 = 0 THEN 'NA' WHEN {_K} % 29 = 0 THEN 'n/a' WHEN {_K} % 31 = 0 THEN 'abc'
             ELSE CAST(l_quantity AS VARCHAR) END AS q,
        CASE WHEN {_K} % 37 = 0 THEN '2001-13-45' WHEN {_K} % 41 = 0 THEN 'NA'
             ELSE strftime(l_shipdate, '%Y-%m-%d') END AS d,
        CASE WHEN {_K} % 43 = 0 THEN 'NA' ELSE l_linestatus END AS f
      FROM lineitem)"""
_OBSERVATIONS_SCHEMA = T.StructType([
    T.StructField("l_orderkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()), T.StructField("l_quantity", T.DoubleType()),
    T.StructField("l_shipdate", T.DateType()), T.StructField("l_linestatus", T.StringType())])


def _raw_observations(spark, sf_dir):
    """Text columns with missing-value tokens and unparsable values."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey") + F.col("l_linenumber")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(k % 13 == 0, "NA").when(k % 29 == 0, "n/a").when(k % 31 == 0, "abc")
         .otherwise(F.col("l_quantity").cast("string")).alias("l_quantity"),
        F.when(k % 37 == 0, "2001-13-45").when(k % 41 == 0, "NA")
         .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("l_shipdate"),
        F.when(k % 43 == 0, "NA").otherwise(F.col("l_linestatus")).alias("l_linestatus"))


@query("parse_observations", _OBSERVATIONS_SQL)
def q_parse_observations(spark, sf_dir):
    return parse_text_columns(_raw_observations(spark, sf_dir), _OBSERVATIONS_SCHEMA)


@query("read_observations", _OBSERVATIONS_SQL)
def q_read_observations(spark, sf_dir):
    """The same rows written as CSV files and read back by the source."""
    path = scratch_path(spark, f"observations-{uuid.uuid4().hex}")
    _raw_observations(spark, sf_dir).write.option("header", True).csv(path)
    return read_observations(spark, path, _OBSERVATIONS_SCHEMA)


# S3 + S4 --------------------------------------------------------------------
_FEATURES = T.StructType([T.StructField("k", T.LongType()), T.StructField("value", T.DoubleType()),
                          T.StructField("event_type", T.StringType())])


@query("prediction_log_roundtrip", """
SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value, event_type FROM events""")
def q_prediction_log_roundtrip(spark, sf_dir):
    log = _plog(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    rec = log_records(log, ["k", "value", "event_type"], ts="ts", proba="proba", label="label")
    path = scratch_path(spark, f"plog-{uuid.uuid4().hex}")
    write_prediction_log(rec, path)
    return read_prediction_log(spark, path, _FEATURES)


@query("parse_log_lines", """
SELECT CASE WHEN event_type = 'purchase' THEN NULL ELSE event_id END AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS absent
FROM events WHERE event_type NOT IN ('error', 'signup')""")
def q_parse_log_lines(spark, sf_dir):
    """Log lines by rule: cut, without features, with a badly typed field, whole."""
    ev = table(spark, sf_dir, "events")
    given = F.when(F.col("event_type") == "purchase", F.lit("none")).otherwise(F.col("event_id").cast("string"))
    record = F.to_json(F.struct(F.col("event_id").cast("string").alias("request_id"), F.struct(
        given.alias("id"), F.get_json_object("props", "$.k").alias("k")).alias("features")))
    whole = F.regexp_replace(record, '"(k|id)":"([0-9]+)"', '"$1":$2')
    line = (F.when(F.col("event_type") == "error", F.substring(whole, F.lit(1), F.length(whole) - 2))
             .when(F.col("event_type") == "signup", F.to_json(F.struct(F.col("event_id").cast("string").alias("request_id"))))
             .otherwise(whole))
    feats = T.StructType([T.StructField("id", T.LongType()), T.StructField("k", T.LongType())])
    return parse_log_lines(ev.select(line.alias("value")), feats, ["id", "k", "absent"])


# Q1-Q3 ----------------------------------------------------------------------
@query("expect_grid", S.with_ctes(S.SCORED_SQL).rstrip() + """,
g AS (SELECT CAST(i AS DOUBLE) / 100 AS threshold FROM range(5, 96) t(i))
SELECT threshold FROM g
EXCEPT
SELECT threshold FROM (SELECT threshold, CAST(count_if(score >= threshold) AS BIGINT) AS n FROM g, scored GROUP BY threshold) WHERE n % 5 != 0""")
def q_expect_grid(spark, sf_dir):
    from ..operators import evaluate as V
    # a damaged grid: some thresholds are missing
    grid = V.threshold_grid(S.scored(spark, sf_dir)).where((F.col("tp") + F.col("fp")) % 5 != 0)
    return Q.expect_grid(grid, "threshold", V.grid_thresholds())


@query("expect_monotone", S.with_ctes(S.SCORED_SQL).rstrip() + """,
g AS (SELECT CAST(i AS DOUBLE) / 100 AS threshold FROM range(5, 96) t(i)),
k AS (SELECT threshold, CAST(count_if(label = 1 AND score >= threshold) AS DOUBLE) / CAST(count_if(label = 1) AS BIGINT)
             + CASE WHEN count_if(score >= threshold) % 7 = 0 THEN 0.5 ELSE 0 END AS recall
      FROM g, scored GROUP BY threshold),
l AS (SELECT threshold, recall, lag(recall) OVER (ORDER BY threshold) AS prev_recall FROM k)
SELECT threshold, recall, prev_recall FROM l WHERE recall > prev_recall""")
def q_expect_monotone(spark, sf_dir):
    from ..operators import evaluate as V
    # a damaged grid: some recalls are too high
    bump = F.when((F.col("tp") + F.col("fp")) % 7 == 0, 0.5).otherwise(0.0)
    grid = V.threshold_grid(S.scored(spark, sf_dir)).withColumn("recall", F.col("recall") + bump)
    return Q.expect_monotone(grid, "threshold", "recall", increasing=False)


@query("expect_range", S.with_ctes(S.SCORED_SQL) + """
SELECT l_orderkey, l_linenumber, score FROM scored WHERE score IS NULL OR score < 0 OR score >= 0.999""")
def q_expect_range(spark, sf_dir):
    sc = S.scored(spark, sf_dir).select("l_orderkey", "l_linenumber", "score")
    return Q.expect_range(sc, ["score"], 0.0, 0.999, hi_inclusive=False)
