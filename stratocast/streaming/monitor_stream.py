"""Monitoring on a stream of logged requests (O1, O4-O7 with event time).

The batch operators of :mod:`stratocast.operators.monitor` are reused on a
streaming DataFrame after a watermark: late rows (older than the watermark)
are dropped, windows are emitted once closed (append mode), state is kept in
the checkpointed state store, so the job survives executor and driver loss.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import monitor as O
from ..sources import ntz_to_utc

DEFAULT_WATERMARK = "10 minutes"


def with_event_time(stream: DataFrame, ts: str = "ts", delay: str = DEFAULT_WATERMARK,
                    dedup_key: str | None = "request_id") -> DataFrame:
    """Event-time column as TIMESTAMP, watermark, and replayed requests removed.

    Rows without an id all stay: nulls count as equal, so each gets a key of its own.
    """
    s = ntz_to_utc(stream, [ts]).withWatermark(ts, delay)
    if dedup_key and dedup_key in s.columns:
        key = F.struct(F.col(dedup_key).alias("id"), F.when(F.col(dedup_key).isNull(), F.expr("uuid()")).alias("own"))
        s = s.withColumn("_dedup", key).dropDuplicatesWithinWatermark(["_dedup"]).drop("_dedup")
    return s


def sliding_rate_stream(stream: DataFrame, width: str = "5 minutes", slide: str | None = "1 minute",
                        by: Sequence[str] = (), ts: str = "ts", delay: str = DEFAULT_WATERMARK,
                         dedup_key: str | None = "request_id") -> DataFrame:
    return O.sliding_rate(with_event_time(stream, ts, delay, dedup_key), width, slide, by, ts)


def error_share_stream(stream: DataFrame, is_error: Column, width: str = "5 minutes",
                       slide: str | None = "1 minute", ts: str = "ts", delay: str = DEFAULT_WATERMARK,
                         dedup_key: str | None = "request_id") -> DataFrame:
    return O.error_share(with_event_time(stream, ts, delay, dedup_key), is_error, width, slide, ts)


def outcome_share_stream(stream: DataFrame, width: str = "5 minutes", label: str = "label", ts: str = "ts",
                         delay: str = DEFAULT_WATERMARK,
                         dedup_key: str | None = "request_id") -> DataFrame:
    s = with_event_time(stream, ts, delay, dedup_key)
    out = O.outcome_share(s, label, [F.window(F.col(ts), width).alias("w")])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "n", "n_positive", "share")


def sustained_sessions_stream(samples: DataFrame, predicate: Column, hold_seconds: float, step_seconds: float,
                              series_cols: Sequence[str] = (), ts: str = "ts",
                              delay: str = DEFAULT_WATERMARK) -> DataFrame:
    """O7 on a stream: sessions of true samples with a gap of 1.5 steps.

    A false or a missing sample ends the session (samples must be regular);
    closed sessions at least ``hold_seconds`` long are alerts.
    """
    # names the time column, or Spark would filter below the watermark and
    # time would stand still while no sample is true
    true = F.coalesce(F.when(F.col(ts).isNull(), F.lit(False)), predicate)
    s = ntz_to_utc(samples, [ts]).withWatermark(ts, delay).where(true)
    gap = f"{int(step_seconds * 1.5)} seconds"
    g = s.groupBy(*series_cols, F.session_window(F.col(ts), gap).alias("sess")).agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n_samples"))
    dur = (F.unix_micros(F.col("end")) - F.unix_micros(F.col("start"))) / 1e6
    return (g.select(*series_cols, "start", "end", "n_samples", dur.alias("duration_s"))
             .where(F.col("duration_s") >= F.lit(float(hold_seconds))))


def latency_histogram_stream(stream: DataFrame, value: str, width: str = "5 minutes",
                             slide: str | None = "1 minute", bounds: Sequence[float] = O.LATENCY_BOUNDS,
                             ts: str = "ts", delay: str = DEFAULT_WATERMARK,
                         dedup_key: str | None = "request_id") -> DataFrame:
    """Per-window cumulative bucket counts of ``value`` (O6, streaming half).

    Quantiles need an ordered look at the buckets of a closed window, which a
    streaming plan cannot do; the stream emits each window's histogram once
    the watermark passes its end, and :func:`quantiles_of_histograms` turns
    the emitted rows (a batch, or a micro-batch in ``foreachBatch``) into
    p50 / p95 / p99.
    """
    return O.window_histograms(with_event_time(stream, ts, delay, dedup_key), value, width, slide, bounds, ts)


def proba_histogram_stream(stream: DataFrame, value: str = "proba", width: str = "5 minutes",
                           bounds: Sequence[float] = O.PROBA_BOUNDS, ts: str = "ts", delay: str = DEFAULT_WATERMARK,
                           dedup_key: str | None = "request_id") -> DataFrame:
    """O2 on a stream: cumulative bucket counts of the scores per closed window."""
    return latency_histogram_stream(stream, value, width, None, bounds, ts, delay, dedup_key)


def latest_gauge_stream(gauges: DataFrame, series_cols: Sequence[str] = ("metric",), ts: str = "ts",
                        value: str = "value") -> DataFrame:
    """O9 on a stream (update mode): the newest value of each series that had a
    new sample. One row of state per series; :func:`stratocast.operators.monitor.stale_series`
    on the kept rows is the streaming half of O8."""
    return O.latest_gauge(ntz_to_utc(gauges, [ts]), series_cols, ts, value)


def quantiles_of_histograms(hist: DataFrame, qs: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    return O.histogram_quantiles(hist, qs, ["window_start", "window_end"])
