"""Registered streaming queries: the events file is read as a stream, drained
with ``availableNow`` into a Parquet sink, and read back.

Append mode emits a window once the watermark (latest event time minus 10
minutes) has passed its end, so the oracle is the batch result restricted to
windows that end by then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import rows as P
from ..session import scratch_path
from ..sources import table, utc_to_ntz
from ..streaming import monitor_stream as MS
from ..streaming.alerts import alert_states_stream, inhibit_alerts_stream, stale_series_stream
from ..streaming.runner import read_output, run_available
from ..streaming.scoring import score_records, scoring_sink, start_scoring
from ..streaming.upsert import UpsertTable, upsert_stream
from . import models as M
from . import standins as S
from .catalog import query, r6
from .catalog_monitor import _HIST_SQL, _WIN_SQL, _quantile_sql
from .catalog_prep import CAT, LI_KEY, NUM, _split


def _drain(df, name):
    path = run_available(df, name)
    return read_output(df.sparkSession, path, df.schema)


_CLOSED = "window_end <= (SELECT max(ts) FROM plog) - INTERVAL 10 MINUTE"


@query("stream_sliding_rate", _WIN_SQL + f"""
SELECT window_start, window_end, event_type, count(*) AS n, round(count(*) / 300.0, 6) AS rate
FROM win WHERE {_CLOSED} GROUP BY ALL""")
def q_stream_sliding_rate(spark, sf_dir):
    log = S.as_prediction_log(S.events_stream(spark, sf_dir))
    out = _drain(MS.sliding_rate_stream(log, "5 minutes", "1 minute", by=["event_type"]), "sliding_rate")
    return utc_to_ntz(r6(out, ["rate"]))


@query("stream_error_share", _WIN_SQL + f"""
SELECT window_start, window_end, count(*) AS n, CAST(count_if(event_type = 'error') AS BIGINT) AS n_error,
       round(CAST(count_if(event_type = 'error') AS DOUBLE) / greatest(count(*), 1), 6) AS share
FROM win WHERE {_CLOSED} GROUP BY ALL""")
def q_stream_error_share(spark, sf_dir):
    log = S.as_prediction_log(S.events_stream(spark, sf_dir))
    out = _drain(MS.error_share_stream(log, F.col("event_type") == "error", "5 minutes", "1 minute"), "error_share")
    return utc_to_ntz(r6(out, ["share"]))


@query("stream_outcome_share", S.with_ctes(S.PREDICTION_LOG_SQL).rstrip() + """,
w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, label FROM plog)
SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, count(*) AS n, CAST(count_if(label) AS BIGINT) AS n_positive,
       round(CAST(count_if(label) AS DOUBLE) / greatest(count(*), 1), 6) AS share
FROM w WHERE window_start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM plog) - INTERVAL 10 MINUTE
GROUP BY window_start""")
def q_stream_outcome_share(spark, sf_dir):
    log = S.as_prediction_log(S.events_stream(spark, sf_dir))
    out = _drain(MS.outcome_share_stream(log, "5 minutes"), "outcome_share")
    return utc_to_ntz(r6(out, ["share"]))


@query("stream_latency_quantiles", S.with_ctes(S.PREDICTION_LOG_SQL).rstrip() + """,
b AS (SELECT * FROM (VALUES (0, CAST(0.05 AS DOUBLE)), (1, CAST(0.1 AS DOUBLE)), (2, CAST(0.25 AS DOUBLE)),
        (3, CAST(0.5 AS DOUBLE)), (4, CAST(0.75 AS DOUBLE)), (5, CAST(1.0 AS DOUBLE)), (6, CAST(2.5 AS DOUBLE)),
        (7, CAST(NULL AS DOUBLE))) t(bucket, le)),
w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR
             AS window_end, value / 100.0 AS latency FROM plog),
hist AS (SELECT window_start, window_end, bucket, le,
                CAST(count_if(le IS NULL OR latency <= le) AS BIGINT) AS cum_count
         FROM b, w WHERE window_end <= (SELECT max(ts) FROM plog) - INTERVAL 10 MINUTE GROUP BY ALL)
SELECT a.window_start, a.window_end, round(a.p50, 6) AS p50, round(c.p95, 6) AS p95, round(d.p99, 6) AS p99
FROM """ + _quantile_sql("hist", 0.5, "p50", "window_start, window_end") + " a JOIN "
       + _quantile_sql("hist", 0.95, "p95", "window_start, window_end") + " c USING (window_start, window_end) JOIN "
       + _quantile_sql("hist", 0.99, "p99", "window_start, window_end") + " d USING (window_start, window_end)")
def q_stream_latency_quantiles(spark, sf_dir):
    log = S.as_prediction_log(S.events_stream(spark, sf_dir)).withColumn("latency", F.col("value") / 100.0)
    hist = _drain(MS.latency_histogram_stream(log, "latency", "1 hour", None, (0.05, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5)),
                  "latency_hist")
    return utc_to_ntz(r6(MS.quantiles_of_histograms(hist), ["p50", "p95", "p99"]))


@query("stream_sustained_sessions", S.with_ctes(S.PREDICTION_LOG_SQL).rstrip() + """,
s AS (SELECT event_type, ts FROM plog WHERE value > 20),
g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 900000000
                     THEN 1 ELSE 0 END AS brk
      FROM s WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
sess AS (SELECT event_type, min(ts) AS start, max(ts) AS "end", count(*) AS n_samples FROM i GROUP BY event_type, sid)
SELECT event_type, start, "end", n_samples, (epoch_us("end") - epoch_us(start)) / 1e6 AS duration_s FROM sess
WHERE epoch_us("end") - epoch_us(start) >= 300000000
  AND "end" + INTERVAL 900 SECOND <= (SELECT max(ts) FROM plog) - INTERVAL 10 MINUTE""")
def q_stream_sustained_sessions(spark, sf_dir):
    log = S.as_prediction_log(S.events_stream(spark, sf_dir))
    out = MS.sustained_sessions_stream(log, F.col("value") > 20, hold_seconds=300, step_seconds=600,
                                       series_cols=["event_type"])
    return utc_to_ntz(_drain(out, "sessions"))


# O7 with its state: panes of five minutes every minute, taken at their ends
_SAMPLES_SQL = _WIN_SQL.rstrip() + f""",
done AS (SELECT CAST(epoch_ms((SELECT max(ts) FROM plog)) - 600000 AS BIGINT) AS ms),
err AS (SELECT window_end, CAST(count_if(event_type = 'error') AS DOUBLE) / count(*) AS share FROM win WHERE {_CLOSED} GROUP BY ALL),
t AS (SELECT window_end, CAST(epoch(window_end) / 60 AS BIGINT) AS idx FROM err WHERE share > 0.25),
isl AS (SELECT *, idx - row_number() OVER (ORDER BY idx) AS island FROM t),
g AS (SELECT min(window_end) AS start, max(window_end) AS last, max(idx) AS last_idx, count(*) AS n FROM isl GROUP BY island
      HAVING epoch(max(window_end)) - epoch(min(window_end)) >= 120)
"""


@query("stream_alert_states", _SAMPLES_SQL + """
SELECT 'firing' AS state, start, start + INTERVAL 2 MINUTE AS "at", CAST(3 AS BIGINT) AS n_samples FROM g
UNION ALL
SELECT 'resolved', start, last, n FROM g, done WHERE (last_idx + 2) * 60000 <= ms""")
def q_stream_alert_states(spark, sf_dir):
    """Error share above a quarter for two minutes: told while it lasts, and when it ends."""
    log = S.as_prediction_log(S.events_stream(spark, sf_dir))
    shares = MS.error_share_stream(log, F.col("event_type") == "error", "5 minutes", "1 minute")
    out = alert_states_stream(shares, F.col("share") > 0.25, 120, 60, ts="window_end")
    return utc_to_ntz(_drain(out, "alert_states"))


@query("stream_stale_series", S.with_ctes(S.PREDICTION_LOG_SQL).rstrip() + """,
done AS (SELECT make_timestamp((epoch_ms(max(ts)) - 600000) * 1000) AS now FROM plog),
s AS (SELECT DISTINCT user_id, ts FROM plog, done WHERE ts <= now),
g AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM s)
SELECT user_id, 'stale' AS state, ts AS last_ts, ts + INTERVAL 48 HOUR AS "at" FROM g, done
WHERE coalesce(nxt, now) > ts + INTERVAL 48 HOUR
UNION ALL
SELECT user_id, 'back', ts, nxt FROM g WHERE nxt > ts + INTERVAL 48 HOUR""")
def q_stream_stale_series(spark, sf_dir):
    """Users without an event for 48 hours, and their return."""
    log = S.as_prediction_log(S.events_stream(spark, sf_dir))
    log = MS.with_event_time(log)
    return utc_to_ntz(_drain(stale_series_stream(log, 172800.0, ["user_id"]), "stale"))


@query("stream_inhibit_alerts", _WIN_SQL.rstrip() + """,
done AS (SELECT epoch_ms(max(ts)) - 600000 AS ms FROM plog),
rate AS (SELECT window_end, event_type, count(*) AS n FROM win WHERE """ + _CLOSED + """ GROUP BY ALL),
t AS (SELECT event_type, window_end, CAST(epoch(window_end) / 60 AS BIGINT) AS idx FROM rate WHERE n >= 3),
isl AS (SELECT *, idx - row_number() OVER (PARTITION BY event_type ORDER BY idx) AS island FROM t),
a AS (SELECT event_type || ':' || CAST(CAST(epoch(min(window_end)) AS BIGINT) AS VARCHAR) AS alert_id, event_type = 'error' AS source,
             min(window_end) AS start, max(window_end) AS fin
      FROM isl GROUP BY event_type, island HAVING epoch(max(window_end)) - epoch(min(window_end)) >= 120
        AND (max(idx) + 2) * 60000 <= (SELECT ms FROM done)),
tgt AS (SELECT alert_id, start, fin,
               EXISTS (SELECT 1 FROM a s WHERE s.source AND s.start <= t.start AND s.fin >= t.start) AS at_once,
               (SELECT min(s.start) FROM a s WHERE s.source AND s.start > t.start AND s.start <= t.fin) AS later
        FROM a t WHERE NOT source)
SELECT 'api' AS job, alert_id, 'notify' AS action, start, start AS "at" FROM tgt WHERE NOT at_once
UNION ALL SELECT 'api', alert_id, 'mute', start, later FROM tgt WHERE NOT at_once AND later IS NOT NULL
UNION ALL SELECT 'api', alert_id, CASE WHEN at_once OR later IS NOT NULL THEN 'inhibited' ELSE 'resolved' END, start, fin FROM tgt""")
def q_stream_inhibit_alerts(spark, sf_dir):
    """High request rates by event type, quiet while that of errors lasts: the
    alert states are written by one stream and read as a log by the next."""
    log = S.as_prediction_log(S.events_stream(spark, sf_dir))
    rates = MS.sliding_rate_stream(log, "5 minutes", "1 minute", by=["event_type"])
    states = _drain(alert_states_stream(rates, F.col("n") >= 3, 120, 60, ["event_type"], ts="window_end"), "rate_alerts")
    ended = states.where("state = 'resolved'").select(
        F.concat_ws(":", "event_type", F.unix_seconds("start").cast("string")).alias("alert_id"),
        F.concat(F.lit("High_"), F.col("event_type")).alias("alertname"),
        F.when(F.col("event_type") == "error", "critical").otherwise("warning").alias("severity"), F.lit("api").alias("job"), "start", F.col("at").alias("fin"))
    moment = F.explode(F.array(F.struct(F.lit(False).alias("ends"), F.col("start").alias("ts")), F.struct(F.lit(True).alias("ends"), F.col("fin").alias("ts"))))
    path = scratch_path(spark, f"alert-log-{uuid.uuid4().hex}")
    ended.select("alert_id", "alertname", "severity", "job", moment.alias("m")).select("alert_id", "alertname", "severity", "job", "m.*").write.parquet(path)
    events = spark.readStream.schema("alert_id string, alertname string, severity string, job string, ends boolean, ts timestamp").parquet(path)
    out = inhibit_alerts_stream(events.withWatermark("ts", "0 seconds"), "High_error")
    return utc_to_ntz(_drain(out, "inhibition"))


# O9 / O2 into upsert tables ----------------------------------------------------
def _upserted(df, name, keys, newest=()):
    folder = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    kept = UpsertTable(f"{folder}/table", df.schema, keys, newest)
    q = upsert_stream(df, kept, f"{folder}/checkpoint", {"availableNow": True}).start()
    q.awaitTermination()
    return kept.read(df.sparkSession)


@query("stream_latest_gauge", S.with_ctes(S.PREDICTION_LOG_SQL) + """
SELECT event_type, max(ts) AS ts, max_by(value, (ts, value)) AS value FROM plog GROUP BY event_type""")
def q_stream_latest_gauge(spark, sf_dir):
    log = S.as_prediction_log(S.events_stream(spark, sf_dir))
    return utc_to_ntz(_upserted(MS.latest_gauge_stream(log, ["event_type"]), "latest", ["event_type"], ["ts"]))


@query("stream_proba_histogram", _HIST_SQL.rstrip() + """,
h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, bucket, le, CAST(count_if(le IS NULL OR proba <= le) AS BIGINT) AS cum_count
      FROM b, plog GROUP BY ALL)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, bucket, le, cum_count FROM h""")
def q_stream_proba_histogram(spark, sf_dir):
    """Hourly histograms of the scores, the open hour included."""
    log = S.as_prediction_log(S.events_stream(spark, sf_dir))
    hist = MS.proba_histogram_stream(log, "proba", "1 hour")
    return utc_to_ntz(_upserted(hist, "proba_histogram", ["window_start", "window_end", "bucket"], ["cum_count"]))


def _feature_records(spark, sf_dir):
    """Lines as feature records on a stream, some of them faulty by rule."""
    stream = spark.readStream.schema(table(spark, sf_dir, "lineitem").schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    k = F.col("l_orderkey") + F.col("l_linenumber")
    return stream.select(
        F.concat_ws(":", *LI_KEY).alias("request_id"), F.col("l_shipdate").alias("ts"),
        F.when(k % 13 == 0, None).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice", "l_discount", "l_tax", "l_linestatus",
        F.when(F.col("l_linestatus") == "F", "Yes").otherwise("No").alias("today_flag"),
        F.when(k % 17 == 0, 13).otherwise(F.month("l_shipdate")).alias("month"))


_SCORE_SCHEMA = [*[(c, "double") for c in NUM], *[(c, "string") for c in CAT], ("month", "int")]


@query("stream_score_sides", """
WITH r AS (SELECT (l_orderkey + l_linenumber) % 17 = 0 AS bad_month, l_discount >= 0.1 AS bad_discount FROM lineitem)
SELECT 'rejected' AS side, 'month_range' AS rule, count(*) AS n FROM r WHERE bad_month
UNION ALL SELECT 'rejected', 'discount', count(*) FROM r WHERE bad_discount
UNION ALL SELECT 'rejected', 'any', count(*) FROM r WHERE bad_month OR bad_discount
UNION ALL SELECT 'log', 'none', count(*) FROM r WHERE NOT bad_month AND NOT bad_discount""")
def q_stream_score_sides(spark, sf_dir):
    """Scoring in one read: rows logged and rows rejected, by broken rule."""
    model = _stream_model(spark, sf_dir)
    folder = scratch_path(spark, f"score-{uuid.uuid4().hex}")
    rules = {**P.feature_record_rules("month"), "discount": F.col("l_discount") < 0.1}
    q = start_scoring(model, _feature_records(spark, sf_dir), _SCORE_SCHEMA, rules, f"{folder}/log", f"{folder}/rejected", f"{folder}/checkpoint",
                      0.5, "1", trigger={"availableNow": True})
    q.awaitTermination()
    sink = scoring_sink(f"{folder}/log", f"{folder}/rejected")
    logged = sink.read(spark, "log", "request_id string").agg(F.lit("log").alias("side"), F.lit("none").alias("rule"), F.count(F.lit(1)).alias("n"))
    rejected = sink.read(spark, "rejected", "request_id string, violations array<string>")
    by_rule = rejected.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    whole = rejected.agg(F.lit("rejected").alias("side"), F.lit("any").alias("rule"), F.count(F.lit(1)).alias("n"))
    return logged.unionByName(whole).unionByName(by_rule.select(F.lit("rejected").alias("side"), "rule", "n"))


def _stream_model(spark, sf_dir):
    tr, _ = _split(spark, sf_dir)
    return M.train(tr, NUM, CAT + ["month"], "logreg")


@query("stream_score")
def q_stream_score(spark, sf_dir):
    scored, _rejected = score_records(_stream_model(spark, sf_dir), _feature_records(spark, sf_dir),
                                      _SCORE_SCHEMA, P.feature_record_rules("month"), 0.5, "1")
    return _drain(scored.select("request_id", "proba", "decision", "threshold", "model_version"), "score")
