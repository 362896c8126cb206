"""Distribution drift between a reference table and current traffic.

Per column, numeric columns use the Wasserstein distance divided by the
reference (population) standard deviation, floored at 0.001; categorical
columns use the Jensen-Shannon distance of category shares (natural log by
default). A column drifts when its distance reaches the per-column threshold
(0.1). The data set drifts when the share of drifted columns reaches the
data-set threshold (0.5), and no verdict is given below ``min_samples``
current rows.

Everything runs on a long form (group..., column, value, side): one shuffle
counts all columns at once, the distribution functions are running sums
partitioned by (group, column) through :mod:`prefix`. ``group_cols`` carries
extra keys (draw, kind, size) so that many comparisons are one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nan_to_null, ratio
from .prefix import attach_one_row, broadcast_if_small, keep, running_totals

NUMERIC_METHOD = "wasserstein_distance_norm"
CATEGORICAL_METHOD = "jensenshannon"


def _sides(ref: DataFrame, cur: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Union of both tables with an ``is_ref`` flag, tracked columns only.

    A tracked column missing from one table is added there as null.
    """
    def proj(df, flag):
        have = set(df.columns)
        return df.select(*keep, *[(F.col(c) if c in have else F.lit(None)).alias(c) for c in cols],
                         F.lit(flag).alias("is_ref"))
    return proj(ref, True).unionByName(proj(cur, False), allowMissingColumns=False)


def numeric_long(both: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("column"), nan_to_null(F.col(c).cast("double")).alias("value"))
             for c in cols]
    return (both.select(*keep, "is_ref", F.inline(F.array(*pairs)))
                .where(F.col("value").isNotNull()))


def categorical_long(both: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]
    return (both.select(*keep, "is_ref", F.inline(F.array(*pairs)))
                .where(F.col("value").isNotNull()))


# R1 -------------------------------------------------------------------------
def wasserstein_from_long(long: DataFrame, group_cols: Sequence[str] = (), std_floor: float = 0.001,
                          n_keys: int | None = None, **prefix_kw) -> DataFrame:
    """(group..., column, n_ref, n_cur, distance) from a numeric long form.

    ``n_keys`` bounds the number of (group, column) pairs when the caller
    knows it (tracked columns x groups); per-pair tables are then broadcast
    without a counting job.
    """
    keys = [*group_cols, "column"]
    ref = F.col("is_ref")
    counts = long.groupBy(*keys, "value").agg(F.count_if(ref).alias("n_ref"), F.count_if(~ref).alias("n_cur"))
    # everything else comes from the counts: one pass over the raw rows
    counts = keep(counts)
    mean = counts.groupBy(*keys).agg((F.sum(F.col("value") * F.col("n_ref")) / F.nullif(F.sum("n_ref"), F.lit(0))).alias("_mean"))
    mean = mean.select(*[F.col(k).alias(f"_m_{k}") for k in keys], "_mean")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_m_{k}"))
    dev = F.col("value") - F.col("_mean")
    totals = counts.join(broadcast_if_small(mean, known_rows=n_keys), same).groupBy(*keys).agg(
        F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"),
        F.sqrt(F.sum(dev * dev * F.col("n_ref")) / F.nullif(F.sum("n_ref"), F.lit(0))).alias("ref_std"))
    cum = running_totals(counts, "value", ["n_ref", "n_cur"], partition_cols=keys, with_next=True, **prefix_kw)
    t = totals.withColumnRenamed("n_ref", "t_ref").withColumnRenamed("n_cur", "t_cur")
    gap = F.abs(ratio(F.col("cum_n_ref"), F.col("t_ref")) - ratio(F.col("cum_n_cur"), F.col("t_cur")))
    area = (cum.join(broadcast_if_small(t, known_rows=n_keys), keys, "inner")
               .where(F.col("next_value").isNotNull())
               .groupBy(*keys).agg(F.sum(gap * (F.col("next_value") - F.col("value"))).alias("area")))
    out = totals.join(broadcast_if_small(area, known_rows=n_keys), keys, "left")
    measured = (F.col("n_ref") > 0) & (F.col("n_cur") > 0)
    dist = F.when(measured, F.coalesce(F.col("area"), F.lit(0.0))
                  / F.greatest(F.coalesce(F.col("ref_std"), F.lit(0.0)), F.lit(float(std_floor))))
    return out.select(*keys, "n_ref", "n_cur", dist.alias("distance"))


def wasserstein_norm(ref: DataFrame, cur: DataFrame, cols: Sequence[str], **kw) -> DataFrame:
    """Normalised Wasserstein distance per numeric column (nulls removed per column)."""
    return wasserstein_from_long(numeric_long(_sides(ref, cur, cols), cols), n_keys=len(cols), **kw)


# R2 -------------------------------------------------------------------------
def js_from_long(long: DataFrame, group_cols: Sequence[str] = (), base: float | None = None,
                 n_keys: int | None = None) -> DataFrame:
    """(group..., column, n_ref, n_cur, distance) from a categorical long form."""
    keys = [*group_cols, "column"]
    ref = F.col("is_ref")
    counts = long.groupBy(*keys, "value").agg(F.count_if(ref).alias("c_ref"), F.count_if(~ref).alias("c_cur"))
    totals = counts.groupBy(*keys).agg(F.sum("c_ref").alias("n_ref"), F.sum("c_cur").alias("n_cur"))
    j = counts.join(broadcast_if_small(totals, known_rows=n_keys), keys, "inner")
    p = ratio(F.col("c_ref"), F.col("n_ref"))
    q = ratio(F.col("c_cur"), F.col("n_cur"))
    m = (p + q) / 2

    def rel(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x / m)).otherwise(F.lit(0.0))

    agg = j.groupBy(*keys).agg(F.first("n_ref").alias("n_ref"), F.first("n_cur").alias("n_cur"),
                               F.sum(rel(p)).alias("_l"), F.sum(rel(q)).alias("_r"))
    js = F.col("_l") + F.col("_r")
    if base is not None:
        import math
        js = js / F.lit(math.log(base))
    measured = (F.col("n_ref") > 0) & (F.col("n_cur") > 0)
    return agg.select(*keys, "n_ref", "n_cur", F.when(measured, F.sqrt(F.greatest(js, F.lit(0.0)) / 2)).alias("distance"))


def js_distance(ref: DataFrame, cur: DataFrame, cols: Sequence[str], **kw) -> DataFrame:
    """Jensen-Shannon distance of category shares per categorical column."""
    return js_from_long(categorical_long(_sides(ref, cur, cols), cols), n_keys=len(cols), **kw)


# R3 -------------------------------------------------------------------------
def column_drift_from_long(num_long: DataFrame | None, cat_long: DataFrame | None,
                           tracked: DataFrame, group_cols: Sequence[str] = (),
                           threshold: float = 0.1, **kw) -> DataFrame:
    parts = []
    n_keys = kw.pop("n_keys", None)
    if num_long is not None:
        parts.append(wasserstein_from_long(num_long, group_cols, n_keys=n_keys,
                                           **{k: v for k, v in kw.items() if k != "base"})
                     .withColumn("method", F.lit(NUMERIC_METHOD)))
    if cat_long is not None:
        parts.append(js_from_long(cat_long, group_cols, base=kw.get("base"), n_keys=n_keys)
                     .withColumn("method", F.lit(CATEGORICAL_METHOD)))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    keys = [*group_cols, "column"]
    out = tracked.join(broadcast_if_small(res.drop("method"), known_rows=n_keys), keys, "left")
    status = F.when(F.coalesce(F.col("n_cur"), F.lit(0)) == 0, F.lit("no_data")) \
              .when(F.coalesce(F.col("n_ref"), F.lit(0)) == 0, F.lit("no_reference")).otherwise(F.lit("ok"))
    return out.select(
        *keys, "method", F.coalesce("n_ref", F.lit(0)).alias("n_ref"), F.coalesce("n_cur", F.lit(0)).alias("n_cur"),
        "distance", F.lit(float(threshold)).alias("threshold"), status.alias("status"),
        F.coalesce(F.col("distance") >= F.lit(float(threshold)), F.lit(False)).alias("drifted"))


def _tracked(spark, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    rows = [(c, NUMERIC_METHOD) for c in numeric] + [(c, CATEGORICAL_METHOD) for c in categorical]
    return spark.createDataFrame(rows, "column string, method string")


def column_drift(ref: DataFrame, cur: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                 threshold: float = 0.1, **kw) -> DataFrame:
    """One row per tracked column: method, distance, threshold, status, drifted.

    A column without current values is ``no_data`` and never flagged.
    """
    # the tracked columns of both tables, read once for each kind
    both = _sides(ref, cur, [*numeric, *categorical])
    nl = numeric_long(both, numeric) if numeric else None
    cl = categorical_long(both, categorical) if categorical else None
    return column_drift_from_long(nl, cl, _tracked(ref.sparkSession, numeric, categorical),
                                  threshold=threshold, n_keys=len(numeric) + len(categorical), **kw)


# R4 -------------------------------------------------------------------------
def dataset_drift(columns: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Measured columns, drifted columns and their share (null when none measured)."""
    measured = F.col("status") == "ok"
    agg = columns.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.count_if(measured).alias("n_measured"),
        F.count_if(measured & F.col("drifted")).alias("n_drifted"))
    return agg.withColumn("share", ratio(F.col("n_drifted"), F.col("n_measured")))


# R5 -------------------------------------------------------------------------
def drift_summary(ref: DataFrame, cur: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                  min_samples: int = 400, share_threshold: float = 0.5, column_threshold: float = 0.1,
                  ts: Column | None = None, **kw) -> DataFrame:
    """One-row verdict: ``ok`` with the share and the retrain advice,
    ``insufficient`` (never a verdict) when the current table is too small, or
    ``unmeasured`` when no tracked column could be compared (a broken log must
    not look healthy; :func:`retrain_decision` skips on it)."""
    sizes = attach_one_row(ref.agg(F.count(F.lit(1)).alias("n_reference")),
                           cur.agg(F.count(F.lit(1)).alias("n_current")))
    ds = dataset_drift(column_drift(ref, cur, numeric, categorical, column_threshold, **kw))
    j = attach_one_row(sizes, ds)
    large = F.col("n_current") >= F.lit(int(min_samples))
    enough = large & (F.col("n_measured") > 0)
    share = F.when(enough, F.col("share"))
    return j.select(
        (ts if ts is not None else F.current_timestamp()).alias("ts"),
        F.when(enough, F.lit("ok")).when(large, F.lit("unmeasured")).otherwise(F.lit("insufficient")).alias("status"),
        "n_reference", "n_current",
        F.when(enough, F.col("n_drifted")).alias("n_drifted"),
        share.alias("share"),
        F.lit(float(share_threshold)).alias("threshold"),
        F.lit(int(min_samples)).alias("min_samples"),
        F.coalesce(enough & (share >= F.lit(float(share_threshold))), F.lit(False)).alias("retrain"),
    )


# S6 -------------------------------------------------------------------------
def drift_gauges(summary: DataFrame) -> DataFrame:
    """The five gauges of a summary as (metric, value) rows."""
    rows = F.array(
        F.struct(F.lit("dataset_drift").alias("metric"), F.col("retrain").cast("double").alias("value")),
        F.struct(F.lit("n_drifted_columns").alias("metric"), F.col("n_drifted").cast("double").alias("value")),
        F.struct(F.lit("share_drifted_columns").alias("metric"), F.col("share").cast("double").alias("value")),
        F.struct(F.lit("drift_samples").alias("metric"), F.col("n_current").cast("double").alias("value")),
        F.struct(F.lit("drift_last_run_timestamp").alias("metric"),
                 (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6).alias("value")),
    )
    return summary.select(F.col("ts"), F.inline(rows))


# R6 -------------------------------------------------------------------------
def calibrate(reference: DataFrame, normal: DataFrame, shifted: DataFrame, key: str,
              numeric: Sequence[str], categorical: Sequence[str], sizes: Sequence[int] = (50, 100, 200, 400, 800, 1500),
              draws_normal: int = 8, draws_shifted: int = 5, seed: int = 42, column_threshold: float = 0.1,
              oversample: float = 3.0, **kw) -> DataFrame:
    """Share of drifted columns for repeated draws of traffic, per size and kind.

    Each draw keeps the rows of a seeded hash below about ``oversample`` x the
    largest size, ranks them inside the draw and takes the first n (nested
    samples of one draw). All (kind, draw, size) comparisons are one job with
    those keys as extra group columns; the reference side (a bounded sample)
    is repeated per group through an explode of the bounded key list.
    Output: kind, size, draw, share, n_current.
    """
    cols = [*numeric, *categorical]
    max_n = max(sizes)

    def draws(df, kind, n_draws):
        n_rows = df.count()
        frac = min(1.0, oversample * max_n / max(n_rows, 1))
        cut = F.lit(frac)
        d = df.select(key, *cols, F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw"))
        u = F.pmod(F.xxhash64(F.col(key), F.col("draw"), F.lit(seed), F.lit(kind)), F.lit(1 << 40)) \
            .cast("double") / float(1 << 40)
        if n_rows < max_n:
            raise ValueError(f"{kind}: {n_rows} rows cannot give draws of {max_n}")
        d = d.withColumn("_u", u).where(F.col("_u") < cut)
        short = d.groupBy("draw").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"), F.count(F.lit(1))).first()
        if short[1] < n_draws or short[0] < max_n:
            raise ValueError(f"{kind}: a draw holds fewer than {max_n} rows; raise oversample")
        from pyspark.sql import Window
        w = Window.partitionBy("draw").orderBy("_u", key)
        d = d.withColumn("_rank", F.row_number().over(w))
        d = d.withColumn("size", F.explode(F.array(*[F.lit(int(s)) for s in sizes]))).where(F.col("_rank") <= F.col("size"))
        return d.withColumn("kind", F.lit(kind)).drop("_u", "_rank", key)

    cur = draws(normal, "normal", draws_normal).unionByName(draws(shifted, "shifted", draws_shifted))
    groups = [(k, s, d) for k, nd in (("normal", draws_normal), ("shifted", draws_shifted))
              for s in sizes for d in range(nd)]
    gkeys = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(int(s)).alias("size"), F.lit(d).alias("draw"))
                      for k, s, d in groups])
    ref_rep = reference.select(*cols, F.inline(gkeys))
    gcols = ["kind", "size", "draw"]
    both = ref_rep.select(*gcols, *cols, F.lit(True).alias("is_ref")).unionByName(
        cur.select(*gcols, *cols, F.lit(False).alias("is_ref")))
    nl = numeric_long(both, numeric, keep=gcols) if numeric else None
    cl = categorical_long(both, categorical, keep=gcols) if categorical else None
    spark = reference.sparkSession
    tracked = spark.createDataFrame(
        [(k, s, d, c, m) for k, s, d in groups
         for c, m in [(c, NUMERIC_METHOD) for c in numeric] + [(c, CATEGORICAL_METHOD) for c in categorical]],
        "kind string, size int, draw int, column string, method string")
    cd = column_drift_from_long(nl, cl, tracked, gcols, column_threshold, n_keys=len(groups) * len(cols), **kw)
    ds = dataset_drift(cd, gcols)
    n_cur = cur.groupBy(*gcols).agg(F.count(F.lit(1)).alias("n_current"))
    return ds.join(n_cur, gcols, "left").select(*gcols, "share", "n_drifted", "n_measured",
                                                F.coalesce("n_current", F.lit(0)).alias("n_current"))


def calibration_table(calib: DataFrame) -> DataFrame:
    """min / median / max share per (kind, size)."""
    return calib.groupBy("kind", "size").agg(
        F.min("share").alias("min_share"), F.median("share").alias("median_share"),
        F.max("share").alias("max_share"), F.count(F.lit(1)).alias("n_draws"),
        F.min("n_current").alias("min_n_current"))


# R7 -------------------------------------------------------------------------
def separating_interval(calib: DataFrame) -> DataFrame:
    """Per size: worst normal share, best shifted share, and whether an open gap separates them."""
    agg = calib.groupBy("size").agg(
        F.max(F.when(F.col("kind") == "normal", F.col("share"))).alias("normal_max"),
        F.min(F.when(F.col("kind") == "shifted", F.col("share"))).alias("shifted_min"))
    return agg.withColumn("separated", F.col("normal_max") < F.col("shifted_min"))


# R8 -------------------------------------------------------------------------
def retrain_decision(summaries: DataFrame, now: Column, max_age_hours: float = 36.0) -> DataFrame:
    """Decision from the latest summary: skip (absent, insufficient, unmeasured, stale), alert or nothing."""
    latest = summaries.agg(F.max_by(F.struct(*[F.col(c) for c in summaries.columns]), F.col("ts")).alias("s"))
    s = F.col("s")
    age_h = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(s["ts"].cast("timestamp"))) / 3.6e9
    decision = (F.when(s.isNull(), F.lit("skip_absent"))
                 .when(s["status"] == "insufficient", F.lit("skip_insufficient"))
                 .when(s["status"] == "unmeasured", F.lit("skip_unmeasured"))
                 .when(age_h > F.lit(float(max_age_hours)), F.lit("skip_stale"))
                 .when(s["retrain"], F.lit("alert"))
                 .otherwise(F.lit("nothing")))
    return latest.select(decision.alias("decision"), s["ts"].alias("ts"), s["share"].alias("share"),
                         s["threshold"].alias("threshold"), age_h.alias("age_hours"))
