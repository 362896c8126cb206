"""Health metrics and alert rules over the prediction / request log (O1-O10).

The reference expresses these as PromQL over counters scraped every 15 s;
here they are DataFrame jobs over the logged rows, usable on a batch table
or (through :mod:`stratocast.streaming`) on a stream with a watermark. On raw
rows a rate is count / window width: counter resets and extrapolation do not
exist there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from .prefix import ROWS_PER_BUCKET, broadcast_if_small, cut_ranges, running_totals

# Bucket bounds of the probability histogram.
PROBA_BOUNDS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
# Default latency buckets (seconds) of common HTTP instrumentation.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
SAMPLE_STEP_SECONDS = 15


def _seconds(width: str) -> float:
    n, unit = width.split()
    mult = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
            "day": 86400, "days": 86400}[unit]
    return float(n) * mult


# O1 -------------------------------------------------------------------------
def outcome_share(log: DataFrame, label: str = "label", group_cols: Sequence[str | Column] = ()) -> DataFrame:
    """Share of positive decisions (0 when there is no row)."""
    return log.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label)).alias("n_positive")
    ).withColumn("share", F.col("n_positive") / F.greatest(F.col("n"), F.lit(1)).cast("double"))


# O2 -------------------------------------------------------------------------
def _bucket_index(v: Column, bounds: Sequence[float]) -> Column:
    """Index of the first bound >= v (le semantics); len(bounds) is +Inf."""
    e = F.when(v <= F.lit(float(bounds[0])), F.lit(0))
    for i, b in enumerate(bounds[1:], start=1):
        e = e.when(v <= F.lit(float(b)), F.lit(i))
    return e.otherwise(F.lit(len(bounds)))


def histogram(log: DataFrame, value: str = "proba", bounds: Sequence[float] = PROBA_BOUNDS,
              group_cols: Sequence[str | Column] = ()) -> DataFrame:
    """Cumulative counts at each bound and +Inf (``le`` null), per group.

    One aggregate: per group an array of bucket counts, unrolled with running
    sums over at most len(bounds) + 1 entries.
    """
    return _cumulative(log.where(F.col(value).isNotNull()).groupBy(*group_cols).agg(*_bucket_counts(value, bounds)), bounds)


def _bucket_counts(value: str, bounds: Sequence[float]) -> list[Column]:
    idx = _bucket_index(F.col(value), bounds)
    return [F.count_if(idx == i).alias(f"_h{i}") for i in range(len(bounds) + 1)]


def _cumulative(counts: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """Bucket counts ``_h0, _h1, ...`` of a row as cumulative rows."""
    keys = [c for c in counts.columns if not c.startswith("_h")]
    entries = []
    running = F.lit(0).cast("long")
    for i in range(len(bounds) + 1):
        running = running + F.col(f"_h{i}")
        le = F.lit(float(bounds[i])) if i < len(bounds) else F.lit(None).cast("double")
        entries.append(F.struct(F.lit(i).alias("bucket"), le.alias("le"), running.alias("cum_count")))
    return counts.select(*keys, F.inline(F.array(*entries)))


def window_sums(rows: DataFrame, width: str, slide: str | None, ts: str, by: Sequence[str], counts: Sequence[Column]) -> DataFrame:
    """``window_start, window_end, by...`` and the named ``counts`` (aggregates
    that can be added up) per sliding window.

    Raw rows are counted once, per pane (the largest step that both width and
    slide are made of); windows are sums of panes. On a stream (append mode)
    these are two chained aggregations, and the state holds panes, not rows
    times windows.
    """
    rows = rows.where(F.col(ts).isNotNull())
    if slide and _seconds(slide) != _seconds(width):
        step = math.gcd(round(_seconds(width) * 1e6), round(_seconds(slide) * 1e6))
        panes = rows.groupBy(F.window(F.col(ts), f"{step} microseconds").alias("_pane"), *by).agg(*counts)
        names = [c for c in panes.columns if c not in ("_pane", *by)]
        panes = panes.select(F.window_time("_pane").alias("_at"), *by, *names)
        out = panes.groupBy(F.window("_at", width, slide).alias("_w"), *by).agg(*[F.sum(c).alias(c) for c in names])
    else:
        out = rows.groupBy(F.window(F.col(ts), width).alias("_w"), *by).agg(*counts)
    names = [c for c in out.columns if c not in ("_w", *by)]
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *by, *names)


# O3 -------------------------------------------------------------------------
def histogram_quantiles(hist: DataFrame, qs: Sequence[float], group_cols: Sequence[str] = (),
                        names: Sequence[str] | None = None) -> DataFrame:
    """Linear interpolation inside the bucket that holds rank q x total, for
    several q in one aggregate.

    Same rules as the usual monitoring function: the +Inf bucket returns the
    highest finite bound, a first bucket with bound <= 0 returns that bound,
    no observation gives null. The window runs over at most len(bounds) + 1
    rows per group.
    """
    names = list(names or [f"p{int(round(q * 100))}" for q in qs])
    w = Window.partitionBy(*group_cols).orderBy("bucket")
    whole = Window.partitionBy(*group_cols)
    h = hist.select(*group_cols, "bucket", "le", "cum_count",
                    F.lag("le").over(w).alias("prev_le"), F.lag("cum_count").over(w).alias("prev_cum"),
                    F.max("cum_count").over(whole).alias("total"), F.max("bucket").over(whole).alias("last"))
    fields = F.struct(*[F.col(c) for c in ("bucket", "le", "cum_count", "prev_le", "prev_cum", "total")])
    aggs = []
    for q, name in zip(qs, names):
        hit = (F.col("cum_count") >= F.lit(float(q)) * F.col("total")) | (F.col("bucket") == F.col("last"))
        aggs.append(F.min_by(fields, F.when(hit, F.col("bucket"))).alias(f"_b_{name}"))
    first = h.groupBy(*group_cols).agg(*aggs)
    out = []
    for q, name in zip(qs, names):
        b = F.col(f"_b_{name}")
        rk = F.lit(float(q)) * b["total"]
        start = F.coalesce(b["prev_le"], F.lit(0.0))
        prev = F.coalesce(b["prev_cum"], F.lit(0))
        interp = start + (b["le"] - start) * ratio(rk - prev, b["cum_count"] - prev)
        val = (F.when(b["total"] == 0, F.lit(None).cast("double"))
                .when(b["le"].isNull(), b["prev_le"])
                .when((b["bucket"] == 0) & (b["le"] <= 0), b["le"])
                .otherwise(interp))
        out.append(val.alias(name))
    return first.select(*group_cols, *out)


def histogram_quantile(hist: DataFrame, q: float, group_cols: Sequence[str] = (), name: str = "quantile") -> DataFrame:
    """One quantile of a cumulative histogram (see :func:`histogram_quantiles`)."""
    return histogram_quantiles(hist, [q], group_cols, [name])


# O4 -------------------------------------------------------------------------
def sliding_rate(log: DataFrame, width: str = "5 minutes", slide: str | None = "1 minute",
                 by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Events per second in sliding (or tumbling, slide None) windows, per label."""
    out = window_sums(log, width, slide, ts, by, [F.count(F.lit(1)).alias("n")])
    return out.withColumn("rate", F.col("n") / F.lit(_seconds(width)))


# O5 -------------------------------------------------------------------------
def error_share(requests: DataFrame, is_error: Column, width: str = "5 minutes", slide: str | None = "1 minute",
                ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Errors over all requests per window; 0 without errors, denominator floored at 1."""
    out = window_sums(requests, width, slide, ts, by, [F.count(F.lit(1)).alias("n"), F.count_if(is_error).alias("n_error")])
    return out.withColumn("share", F.col("n_error") / F.greatest(F.col("n"), F.lit(1)).cast("double"))


# O6 -------------------------------------------------------------------------
def latency_quantiles(requests: DataFrame, value: str, width: str = "5 minutes", slide: str | None = "1 minute",
                      bounds: Sequence[float] = LATENCY_BOUNDS, qs: Sequence[float] = (0.5, 0.95, 0.99),
                      ts: str = "ts") -> DataFrame:
    """p50 / p95 / p99 per window from the bucketed histogram of each window."""
    return histogram_quantiles(window_histograms(requests, value, width, slide, bounds, ts), qs, ["window_start", "window_end"])


def window_histograms(requests: DataFrame, value: str, width: str = "5 minutes", slide: str | None = "1 minute",
                      bounds: Sequence[float] = LATENCY_BOUNDS, ts: str = "ts") -> DataFrame:
    """Cumulative bucket counts of ``value`` per window (nulls left out)."""
    known = requests.where(F.col(value).isNotNull())
    return _cumulative(window_sums(known, width, slide, ts, (), _bucket_counts(value, bounds)), bounds)


# O7 -------------------------------------------------------------------------
def sustained_alerts(series: DataFrame, predicate: Column, hold_seconds: float, step_seconds: float,
                     series_cols: Sequence[str] = (), ts: str = "ts", **prefix_kw) -> DataFrame:
    """Intervals where ``predicate`` held at every sample for at least ``hold_seconds``.

    Samples are on a regular grid of ``step_seconds``; a false sample or a
    missing one ends the interval. Gaps and islands: among true samples,
    grid index minus running count is constant inside an island. The running
    count is partitioned by series and bucketed (:mod:`prefix`), so a hot
    series is not one task.
    Output: series..., start, end, fires_at, n_samples, duration_s.
    """
    step = float(step_seconds)
    idx = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(step * 1e6)).cast("long")
    trues = (series.where(predicate).select(*series_cols, F.col(ts).alias("_ts"), idx.alias("_idx"))
                   .groupBy(*series_cols, "_idx").agg(F.min("_ts").alias("_ts"))
                   .withColumn("_one", F.lit(1).cast("long")))
    ranked = running_totals(trues, "_idx", ["_one"], partition_cols=list(series_cols), **prefix_kw)
    isl = ranked.withColumn("_island", F.col("_idx") - F.col("cum__one"))
    g = isl.groupBy(*series_cols, "_island").agg(F.min("_ts").alias("start"), F.max("_ts").alias("end"),
                                                 F.count(F.lit(1)).alias("n_samples"))
    dur = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1e6
    out = g.select(*series_cols, "start", "end", "n_samples", dur.alias("duration_s"))
    out = out.where(F.col("duration_s") >= F.lit(float(hold_seconds)))
    return out.withColumn("fires_at", F.col("start") + F.make_dt_interval(secs=F.lit(float(hold_seconds))))


# O8 -------------------------------------------------------------------------
def stale_series(gauges: DataFrame, now: Column, max_age_seconds: float = 172800.0,
                 series_cols: Sequence[str] = ("metric",), ts: str = "ts") -> DataFrame:
    """Series whose newest sample is older than ``max_age_seconds`` at ``now``."""
    last = gauges.groupBy(*series_cols).agg(F.max(ts).alias("last_ts"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / 1e6
    return last.withColumn("age_s", age).where(F.col("age_s") > F.lit(float(max_age_seconds)))


# O9 -------------------------------------------------------------------------
def latest_gauge(gauges: DataFrame, series_cols: Sequence[str] = ("metric",), ts: str = "ts",
                 value: str = "value") -> DataFrame:
    """Newest value per series (highest value among equal timestamps)."""
    return gauges.groupBy(*series_cols).agg(
        F.max(ts).alias("ts"), F.max_by(F.col(value), F.struct(F.col(ts), F.col(value))).alias("value"))


# O10 ------------------------------------------------------------------------
def inhibit_alerts(alerts: DataFrame, source: str, target_severities: Sequence[str] = ("critical", "warning"),
                   equal: Sequence[str] = ("job",), rows_per_range: int = ROWS_PER_BUCKET) -> DataFrame:
    """Drop alerts of the same ``equal`` labels while the source alert fires; the source stays.

    An alert without an end still fires. A target is dropped if, of the source
    alerts that begin by the target's end, the one that ends last ends at or
    after the target's start: one running maximum along the time line decides,
    nothing is joined on ranges. The time line is cut into ranges of about
    ``rows_per_range`` rows; each task sees one range of one label group, and
    what earlier ranges hold (one maximum each) is carried in. Labels must be
    equal and not null. Columns: alert_id, alertname, severity, equal...,
    start, end.
    """
    open_end = F.coalesce(F.col("end").cast("timestamp"), F.lit("9999-12-31 00:00:00").cast("timestamp"))
    begin = F.col("start").cast("timestamp")
    known = F.lit(True)
    for c in equal:
        known = known & F.col(c).isNotNull()
    never = F.lit(None).cast("timestamp")
    src = alerts.where((F.col("alertname") == source) & known)
    tgt = alerts.where((F.col("alertname") != source) & F.col("severity").isin(list(target_severities)) & known)
    # targets stand at their end, after sources that begin at that moment
    line = src.select(*equal, begin.alias("_at"), F.lit(0).alias("_kind"), open_end.alias("_until"), never.alias("_from"),
                      F.lit(None).cast(alerts.schema["alert_id"].dataType).alias("alert_id"))
    line = line.unionByName(tgt.select(*equal, open_end.alias("_at"), F.lit(1).alias("_kind"), never.alias("_until"), begin.alias("_from"), "alert_id"))
    line = cut_ranges(line.withColumn("_us", F.unix_micros("_at")), "_us", rows_per_range, "_range")
    ends = line.groupBy(*equal, "_range").agg(F.max("_until").alias("_e"))
    # per label group one entry a range: the latest end among the ranges before
    every = ends.groupBy(*equal).agg(F.array_sort(F.collect_list(F.struct("_range", "_e"))).alias("_all"))
    before = F.transform("_all", lambda x, i: F.struct(x["_range"].alias("_range"), F.array_max(F.transform(
        F.slice("_all", F.lit(1), i), lambda y: y["_e"])).alias("_carry")))
    carry = every.select(*equal, F.inline(before))
    line = line.join(broadcast_if_small(carry), [*equal, "_range"])
    w = Window.partitionBy(*equal, "_range").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.greatest(F.max("_until").over(w), F.col("_carry"))
    hit = line.withColumn("_last", last).where((F.col("_kind") == 1) & (F.col("_last") >= F.col("_from"))).select("alert_id").distinct()
    return alerts.join(broadcast_if_small(hit), "alert_id", "left_anti")
