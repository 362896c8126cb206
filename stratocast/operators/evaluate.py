"""Evaluation of scores: confusion, metrics, ROC / PR curves, AUC, AP, threshold grid.

Scored rows are first collapsed to one row per distinct score with positive
and negative counts (a map-side-combined aggregate); curves are running sums
over that table through :mod:`prefix`, never a single-task window over rows.
Metric conventions follow the reference: a metric whose denominator is 0 is
0, thresholds predict positive when ``score >= threshold``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nan_to_null, ratio, ratio_or_zero, rnd
from .prefix import attach_one_row as _one_row_join
from .prefix import running_totals


# V1 -------------------------------------------------------------------------
def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """tp, fp, tn, fn of a 0/1 (or boolean) prediction against a 0/1 label."""
    y = F.col(label).cast("int") == 1
    p = F.col(pred).cast("int") == 1
    return df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                  F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))


def metrics_from_counts(tp: Column, fp: Column, tn: Column, fn: Column) -> list[Column]:
    n = tp + fp + tn + fn
    return [
        ratio_or_zero(tp + tn, n).alias("accuracy"),
        ratio_or_zero(tp, tp + fp).alias("precision"),
        ratio_or_zero(tp, tp + fn).alias("recall"),
        ratio_or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


# V2 -------------------------------------------------------------------------
def scores_at(df: DataFrame, label: str = "label", score: str = "score",
              threshold: float = 0.5) -> DataFrame:
    """accuracy, precision, recall, F1 when predicting ``score >= threshold``.

    Rows without a score (null or NaN) are left out, as in the curves.
    """
    s = nan_to_null(F.col(score).cast("double"))
    c = confusion(df.withColumn("_pred", s >= F.lit(float(threshold))), label, "_pred")
    return c.select(F.lit(float(threshold)).alias("threshold"), "tp", "fp", "tn", "fn",
                    *metrics_from_counts(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")))


# M6 (baseline) shares the metric code
def baseline_always_no(df: DataFrame, label: str = "label") -> DataFrame:
    c = confusion(df.withColumn("_pred", F.lit(0)), label, "_pred")
    return c.select("tp", "fp", "tn", "fn",
                    *metrics_from_counts(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")))


# V3 -------------------------------------------------------------------------
def classification_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Per class precision / recall / F1 / support, accuracy, macro and weighted means."""
    c = confusion(df, label, pred)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn

    def cls(name, t, f_p, f_n):
        p = ratio_or_zero(t, t + f_p)
        r = ratio_or_zero(t, t + f_n)
        return p, r, ratio_or_zero(2 * p * r, p + r), t + f_n

    p1, r1, f1, s1 = cls("1", tp, fp, fn)
    p0, r0, f0, s0 = cls("0", tn, fn, fp)
    rows = F.array(
        F.struct(F.lit("0").alias("class"), p0.alias("precision"), r0.alias("recall"), f0.alias("f1"),
                 s0.alias("support")),
        F.struct(F.lit("1").alias("class"), p1.alias("precision"), r1.alias("recall"), f1.alias("f1"),
                 s1.alias("support")),
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), ratio_or_zero(tp + tn, n).alias("f1"),
                 n.alias("support")),
        F.struct(F.lit("macro avg").alias("class"), ((p0 + p1) / 2).alias("precision"),
                 ((r0 + r1) / 2).alias("recall"), ((f0 + f1) / 2).alias("f1"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), ratio_or_zero(p0 * s0 + p1 * s1, n).alias("precision"),
                 ratio_or_zero(r0 * s0 + r1 * s1, n).alias("recall"),
                 ratio_or_zero(f0 * s0 + f1 * s1, n).alias("f1"), n.alias("support")),
    )
    return c.select(F.inline(rows))


# Score table shared by V4-V8 ------------------------------------------------
def score_table(df: DataFrame, label: str = "label", score: str = "score", ends: dict | None = None,
                **prefix_kw) -> DataFrame:
    """One row per distinct score: pos, neg, and counts of rows with a score >= it.

    ``ends`` receives the totals (``"n"``: distinct scores), for the end
    points of curves.

    Columns: score, pos, neg, tp (positives at or above), fp (negatives at or
    above), n_pos, n_neg (totals), rank_desc (1 for the highest score).
    """
    y = F.col(label).cast("int") == 1
    counts = (df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score)))
                .groupBy(F.col(score).cast("double").alias("score"))
                .agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
                .withColumn("one", F.lit(1).cast("long")))
    tot: dict = {}
    cum = running_totals(counts, "score", ["pos", "neg", "one"], totals=tot, **prefix_kw)
    if ends is not None:
        ends.update(tot)
    # grand totals come from the size check of the running sums (no extra job)
    t = cum.select("*", F.lit(tot.get("pos") or 0).cast("long").alias("n_pos"),
                   F.lit(tot.get("neg") or 0).cast("long").alias("n_neg"),
                   F.lit(tot.get("one") or 0).cast("long").alias("n_scores"))
    return t.select(
        "score", "pos", "neg",
        (F.col("n_pos") - F.col("cum_pos") + F.col("pos")).alias("tp"),
        (F.col("n_neg") - F.col("cum_neg") + F.col("neg")).alias("fp"),
        "cum_neg", "n_pos", "n_neg", "n_scores",
        (F.col("n_scores") - F.col("cum_one") + 1).alias("rank_desc"),
    )


# V4 -------------------------------------------------------------------------
def roc_auc(df: DataFrame, label: str = "label", score: str = "score", table: DataFrame | None = None,
            **prefix_kw) -> DataFrame:
    """Area under the ROC curve as the rank statistic; tied scores count one half."""
    t = table if table is not None else score_table(df, label, score, **prefix_kw)
    part = F.col("pos").cast("double") * (F.col("cum_neg") - F.col("neg") * 0.5)
    agg = t.agg(F.sum(part).alias("_s"), F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"))
    return agg.select(ratio(F.col("_s"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"),
                      F.coalesce("n_pos", F.lit(0)).alias("n_pos"), F.coalesce("n_neg", F.lit(0)).alias("n_neg"))


# V5 -------------------------------------------------------------------------
def roc_curve(df: DataFrame, label: str = "label", score: str = "score", table: DataFrame | None = None,
              **prefix_kw) -> DataFrame:
    """(point, threshold, fpr, tpr): origin first, then one point per distinct score descending."""
    t = table if table is not None else score_table(df, label, score, **prefix_kw)
    # the highest score also brings the origin: no second pass for one row
    first = F.col("rank_desc") == 1
    none = F.lit(None).cast("double")
    point = F.struct(F.col("rank_desc").cast("long").alias("point"), F.col("score").alias("threshold"),
                     ratio(F.col("fp"), F.col("n_neg")).alias("fpr"), ratio(F.col("tp"), F.col("n_pos")).alias("tpr"))
    origin = F.struct(F.lit(0).cast("long").alias("point"), none.alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return t.select(F.inline(F.when(first, F.array(origin, point)).otherwise(F.array(point))))


# V6 -------------------------------------------------------------------------
def pr_curve(df: DataFrame, label: str = "label", score: str = "score", table: DataFrame | None = None,
             **prefix_kw) -> DataFrame:
    """(point, threshold, precision, recall) at each distinct score ascending, then the (1, 0) end."""
    t = table if table is not None else score_table(df, label, score, **prefix_kw)
    # the highest score also brings the end: no second pass for one row
    last = F.col("rank_desc") == 1
    point = F.struct((F.col("n_scores") - F.col("rank_desc")).cast("long").alias("point"), F.col("score").alias("threshold"),
                     ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                     ratio(F.col("tp"), F.col("n_pos")).alias("recall"))
    end = F.struct(F.col("n_scores").cast("long").alias("point"), F.lit(None).cast("double").alias("threshold"),
                   F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return t.select(F.inline(F.when(last, F.array(point, end)).otherwise(F.array(point))))


# V7 -------------------------------------------------------------------------
def average_precision(df: DataFrame, label: str = "label", score: str = "score",
                      table: DataFrame | None = None, **prefix_kw) -> DataFrame:
    """Sum over thresholds of (recall step) x precision."""
    t = table if table is not None else score_table(df, label, score, **prefix_kw)
    part = F.col("pos").cast("double") * ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    agg = t.agg(F.sum(part).alias("_s"), F.first("n_pos").alias("n_pos"))
    return agg.select(ratio(F.col("_s"), F.col("n_pos")).alias("average_precision"))


# V8 -------------------------------------------------------------------------
def recommend_thresholds(df: DataFrame, label: str = "label", score: str = "score",
                         target_recall: float = 0.70, table: DataFrame | None = None,
                         **prefix_kw) -> DataFrame:
    """F1-optimal threshold (lowest among ties, F1 with a 1e-12 guard) with its
    recall and precision, and the highest threshold reaching ``target_recall``
    (0 when none does). Rounded to 4 digits as the reference reports them."""
    t = table if table is not None else score_table(df, label, score, **prefix_kw)
    p = F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(ratio(F.col("tp"), F.col("n_pos")), F.lit(0.0))
    f1 = 2 * p * r / (p + r + F.lit(1e-12))
    c = t.select(F.col("score").alias("thr"), p.alias("p"), r.alias("r"), f1.alias("f1"))
    best = F.max_by(F.struct("thr", "r", "p"), F.struct(F.col("f1"), -F.col("thr")))
    agg = c.agg(best.alias("b"), F.max(F.when(F.col("r") >= F.lit(float(target_recall)), F.col("thr"))).alias("t"))
    return agg.select(
        rnd(F.col("b.thr"), 4).alias("thr_f1opt"),
        rnd(F.col("b.r"), 4).alias("f1opt_recall"),
        rnd(F.col("b.p"), 4).alias("f1opt_precision"),
        rnd(F.coalesce(F.col("t"), F.lit(0.0)), 4).alias("thr_recall_target"),
    )


# V9 -------------------------------------------------------------------------
def grid_thresholds(start: float = 0.05, stop: float = 0.95, step: float = 0.01, digits: int = 2) -> list[float]:
    n = int(round((stop - start) / step)) + 1
    return [round(start + i * step, digits) for i in range(n)]


def threshold_grid(df: DataFrame, label: str = "label", score: str = "score",
                   thresholds: Sequence[float] | None = None) -> DataFrame:
    """Confusion counts and metrics at fixed thresholds (91 from 0.05 to 0.95 by default).

    One pass: every row falls in the bucket between two thresholds
    (binary search, a score equal to a bound goes up, as ``>=`` needs), the
    bucket counts are summed from the top. Rows are never crossed with the
    thresholds.
    """
    ts = list(thresholds or grid_thresholds())
    spark = df.sparkSession
    y = F.col(label).cast("int") == 1
    splits = [-float("inf"), *ts, float("inf")]
    b = Bucketizer(splits=splits, inputCol="_s", outputCol="_b", handleInvalid="skip")
    scored = df.select(F.col(score).cast("double").alias("_s"), y.alias("_y")).where(
        F.col("_s").isNotNull() & ~F.isnan("_s"))
    per_bucket = (b.transform(scored).groupBy(F.col("_b").cast("int").alias("bucket"))
                  .agg(F.count_if("_y").alias("pos"), F.count_if(~F.col("_y")).alias("neg")))
    # the grid itself: len(ts) + 1 buckets, a size fixed by the parameters
    grid = spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(ts)] + [(0, None)],
                                 "bucket int, threshold double")
    full = grid.join(F.broadcast(per_bucket), "bucket", "left").fillna(0, ["pos", "neg"])
    w = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tot = full.select("bucket", "threshold", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
                      F.sum("pos").over(Window.partitionBy()).alias("n_pos"),
                      F.sum("neg").over(Window.partitionBy()).alias("n_neg"))
    out = tot.where(F.col("threshold").isNotNull()).select(
        "threshold", "tp", "fp", (F.col("n_neg") - F.col("fp")).alias("tn"),
        (F.col("n_pos") - F.col("tp")).alias("fn"))
    return out.select("*", *metrics_from_counts(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")))


def round_grid(grid: DataFrame, digits: int = 4) -> DataFrame:
    """Metrics rounded as the reference exports them."""
    for c in ("precision", "recall", "f1", "accuracy"):
        grid = grid.withColumn(c, rnd(F.col(c), digits))
    return grid


# V10 ------------------------------------------------------------------------
def grid_choice(grid: DataFrame, target_recall: float = 0.70, around: float = 0.5) -> DataFrame:
    """Best-F1 threshold (lowest on ties) and the threshold reaching the recall
    target that is nearest to ``around`` (lowest on ties)."""
    dist = F.abs(F.col("threshold") - F.lit(float(around)))
    return grid.agg(
        F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).alias("f1_threshold"),
        F.max("f1").alias("f1_max"),
        F.min_by(F.when(F.col("recall") >= F.lit(float(target_recall)), F.col("threshold")),
                 F.when(F.col("recall") >= F.lit(float(target_recall)),
                        F.struct(dist.alias("d"), F.col("threshold").alias("t")))).alias("recall_threshold"),
    )


# V11 ------------------------------------------------------------------------
def thin_indices(m: int, n: int) -> list[int]:
    """Indices of about n points at equal steps over m rows, both ends kept."""
    if m <= n:
        return list(range(m))
    step = (m - 1) / (n - 1)
    idx = [int(i * step) for i in range(n - 1)] + [m - 1]
    return sorted(set(idx))


def thin_curve(curve: DataFrame, order_col: str = "point", n: int = 200,
               round_cols: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Keep about ``n`` points of a curve at equal index steps (ends kept), values rounded.

    ``order_col`` numbers the points 0, 1, ... without gaps, as the curves
    here do; the largest number is one scalar (only that column is computed)
    and the kept indices (at most n) are a literal list.
    """
    top = curve.agg(F.max(order_col)).first()[0]
    out = curve.where(F.col(order_col).isin(thin_indices(0 if top is None else int(top) + 1, n) or [-1]))
    for c in round_cols:
        out = out.withColumn(c, rnd(F.col(c), digits))
    return out


# V12 ------------------------------------------------------------------------
def compare_thresholds(df: DataFrame, label: str = "label", score: str = "score",
                       a: float = 0.5, b: float = 0.32) -> DataFrame:
    """Effect of moving the threshold from ``a`` to ``b``: metric deltas, missed
    events recovered, false alarms added and rows whose decision flips."""
    y = F.col(label).cast("int") == 1
    s = nan_to_null(F.col(score).cast("double"))
    lo, hi = min(a, b), max(a, b)
    agg = df.agg(
        F.count_if(y & (s >= a)).alias("tp_a"), F.count_if(~y & (s >= a)).alias("fp_a"),
        F.count_if(~y & (s < a)).alias("tn_a"), F.count_if(y & (s < a)).alias("fn_a"),
        F.count_if(y & (s >= b)).alias("tp_b"), F.count_if(~y & (s >= b)).alias("fp_b"),
        F.count_if(~y & (s < b)).alias("tn_b"), F.count_if(y & (s < b)).alias("fn_b"),
        F.count_if((s >= lo) & (s < hi)).alias("flipped_rows"),
    )
    m_a = metrics_from_counts(F.col("tp_a"), F.col("fp_a"), F.col("tn_a"), F.col("fn_a"))
    m_b = metrics_from_counts(F.col("tp_b"), F.col("fp_b"), F.col("tn_b"), F.col("fn_b"))
    names = ["accuracy", "precision", "recall", "f1"]
    return agg.select(
        F.lit(float(a)).alias("threshold_a"), F.lit(float(b)).alias("threshold_b"),
        *[(mb - ma_).alias(f"delta_{nm}") for nm, ma_, mb in zip(names, m_a, m_b)],
        (F.col("fn_a") - F.col("fn_b")).alias("recovered_events"),
        (F.col("fp_b") - F.col("fp_a")).alias("added_false_alarms"),
        "flipped_rows",
    )
