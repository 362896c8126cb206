"""Registered evaluation queries (V1-V12, M6) on the scored stand-in."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import evaluate as V
from ..session import scratch_path
from ..sources.reports import write_report
from . import standins as S
from .catalog import query, r6

SC = S.with_ctes(S.SCORED_SQL)


def _scored(spark, sf_dir):
    return S.scored(spark, sf_dir)


def _scored_price(spark, sf_dir):
    return S.scored(spark, sf_dir).withColumn("score", F.col("l_extendedprice"))


_CONF_SQL = """SELECT CAST(count_if(label = 1 AND score >= 0.5) AS BIGINT) AS tp, CAST(count_if(label = 0 AND score >= 0.5) AS BIGINT) AS fp,
       CAST(count_if(label = 0 AND score < 0.5) AS BIGINT) AS tn, CAST(count_if(label = 1 AND score < 0.5) AS BIGINT) AS fn FROM scored"""


@query("confusion", SC + _CONF_SQL)
def q_confusion(spark, sf_dir):
    d = _scored(spark, sf_dir).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return V.confusion(d, "label", "pred")


_METRICS_SQL = """
       round(CASE WHEN tp + fp + tn + fn > 0 THEN CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) ELSE 0 END, 6) AS accuracy,
       round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""
_MET = ["accuracy", "precision", "recall", "f1"]


@query("scores_at", SC + f"SELECT CAST(0.5 AS DOUBLE) AS threshold, tp, fp, tn, fn, {_METRICS_SQL} FROM ({_CONF_SQL})")
def q_scores_at(spark, sf_dir):
    return r6(V.scores_at(_scored(spark, sf_dir), "label", "score", 0.5), _MET)


@query("baseline_always_no", SC + """SELECT tp, fp, tn, fn, """ + _METRICS_SQL + """
FROM (SELECT CAST(0 AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp, CAST(count_if(label = 0) AS BIGINT) AS tn, CAST(count_if(label = 1) AS BIGINT) AS fn FROM scored)""")
def q_baseline_always_no(spark, sf_dir):
    return r6(V.baseline_always_no(_scored(spark, sf_dir), "label"), _MET)


@query("classification_report", SC + f"""
, c AS ({_CONF_SQL}),
k AS (SELECT *,
  CASE WHEN tn + fn > 0 THEN CAST(tn AS DOUBLE) / (tn + fn) ELSE 0 END AS p0,
  CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0 END AS r0,
  CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS p1,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS r1,
  tn + fp AS s0, tp + fn AS s1, tp + fp + tn + fn AS n FROM c),
f AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f0,
                CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END AS f1 FROM k)
SELECT '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, s0 AS support FROM f
UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(CAST(tp + tn AS DOUBLE) / n, 6), n FROM f
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n FROM f
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / n, 6), round((r0 * s0 + r1 * s1) / n, 6),
                 round((f0 * s0 + f1 * s1) / n, 6), n FROM f""")
def q_classification_report(spark, sf_dir):
    d = _scored(spark, sf_dir).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return r6(V.classification_report(d, "label", "pred"), ["precision", "recall", "f1"])


def _score_cte(score_expr: str) -> str:
    return SC.rstrip() + f""",
s AS (SELECT {score_expr} AS score, CAST(count_if(label = 1) AS BIGINT) AS pos, CAST(count_if(label = 0) AS BIGINT) AS neg
      FROM scored GROUP BY 1),
c AS (SELECT score, pos, neg,
        CAST(sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cum_neg,
        CAST(sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
        CAST(sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp,
        CAST(row_number() OVER (ORDER BY score DESC) AS BIGINT) AS rank_desc,
        (SELECT CAST(sum(pos) AS BIGINT) FROM s) AS n_pos, (SELECT CAST(sum(neg) AS BIGINT) FROM s) AS n_neg,
        (SELECT count(*) FROM s) AS n_scores
      FROM s)
"""


_AUC_SQL = """SELECT round(sum(CAST(pos AS DOUBLE) * (cum_neg - neg * 0.5)) / (CAST(max(n_pos) AS DOUBLE) * max(n_neg)), 6)
  AS auc, max(n_pos) AS n_pos, max(n_neg) AS n_neg FROM c"""


@query("roc_auc", _score_cte("score") + _AUC_SQL)
def q_roc_auc(spark, sf_dir):
    return r6(V.roc_auc(_scored(spark, sf_dir)), ["auc"])


@query("roc_auc_low_ties", _score_cte("l_extendedprice") + _AUC_SQL)
def q_roc_auc_low_ties(spark, sf_dir):
    return r6(V.roc_auc(_scored_price(spark, sf_dir)), ["auc"])


@query("roc_curve", _score_cte("score") + """
SELECT 0 AS point, CAST(NULL AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL
SELECT rank_desc, score, round(CAST(fp AS DOUBLE) / n_neg, 6), round(CAST(tp AS DOUBLE) / n_pos, 6) FROM c""")
def q_roc_curve(spark, sf_dir):
    return r6(V.roc_curve(_scored(spark, sf_dir)), ["fpr", "tpr"])


@query("pr_curve", _score_cte("score") + """
SELECT n_scores - rank_desc AS point, score AS threshold, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision,
       round(CAST(tp AS DOUBLE) / n_pos, 6) AS recall FROM c
UNION ALL SELECT (SELECT count(*) FROM s), NULL, 1.0, 0.0""")
def q_pr_curve(spark, sf_dir):
    return r6(V.pr_curve(_scored(spark, sf_dir)), ["precision", "recall"])


@query("average_precision", _score_cte("score") + """
SELECT round(sum(CAST(pos AS DOUBLE) * (CAST(tp AS DOUBLE) / (tp + fp))) / max(n_pos), 6) AS average_precision FROM c""")
def q_average_precision(spark, sf_dir):
    return r6(V.average_precision(_scored(spark, sf_dir)), ["average_precision"])


@query("recommend_thresholds", _score_cte("score").rstrip() + """,
m AS (SELECT score AS thr, CAST(tp AS DOUBLE) / (tp + fp) AS p, CAST(tp AS DOUBLE) / n_pos AS r FROM c),
f AS (SELECT *, 2 * p * r / (p + r + 1e-12) AS f1 FROM m)
SELECT round((SELECT thr FROM f ORDER BY f1 DESC, thr ASC LIMIT 1), 4) AS thr_f1opt,
       round((SELECT r FROM f ORDER BY f1 DESC, thr ASC LIMIT 1), 4) AS f1opt_recall,
       round((SELECT p FROM f ORDER BY f1 DESC, thr ASC LIMIT 1), 4) AS f1opt_precision,
       round(coalesce((SELECT max(thr) FROM f WHERE r >= 0.7), 0.0), 4) AS thr_recall_target""")
def q_recommend_thresholds(spark, sf_dir):
    return V.recommend_thresholds(_scored(spark, sf_dir), target_recall=0.70)


_GRID_SQL = SC.rstrip() + """,
g AS (SELECT CAST(i AS DOUBLE) / 100 AS threshold FROM range(5, 96) t(i)),
k AS (SELECT threshold, CAST(count_if(label = 1 AND score >= threshold) AS BIGINT) AS tp,
             CAST(count_if(label = 0 AND score >= threshold) AS BIGINT) AS fp,
             CAST(count_if(label = 0 AND score < threshold) AS BIGINT) AS tn,
             CAST(count_if(label = 1 AND score < threshold) AS BIGINT) AS fn
      FROM g, scored GROUP BY threshold),
grid AS (SELECT threshold, tp, fp, tn, fn,""" + _METRICS_SQL.replace(", 6)", ", 4)") + """ FROM k)
"""


@query("threshold_grid", _GRID_SQL + "SELECT * FROM grid")
def q_threshold_grid(spark, sf_dir):
    return V.round_grid(V.threshold_grid(_scored(spark, sf_dir)), 4)


@query("write_report", _GRID_SQL + "SELECT * FROM grid")
def q_write_report(spark, sf_dir):
    """The grid written as a JSON report and read back."""
    grid = V.round_grid(V.threshold_grid(_scored(spark, sf_dir)), 4)
    path = scratch_path(spark, f"report-{uuid.uuid4().hex}")
    write_report(grid, path)
    return spark.read.schema(grid.schema).json(path)


@query("grid_choice", _GRID_SQL + """
SELECT (SELECT threshold FROM grid ORDER BY f1 DESC, threshold LIMIT 1) AS f1_threshold, max(f1) AS f1_max,
       (SELECT threshold FROM grid WHERE recall >= 0.7 ORDER BY abs(threshold - 0.5), threshold LIMIT 1)
         AS recall_threshold
FROM grid""")
def q_grid_choice(spark, sf_dir):
    grid = V.round_grid(V.threshold_grid(_scored(spark, sf_dir)), 4)
    return V.grid_choice(grid, 0.70, 0.5)


@query("thin_curve", _score_cte("score").rstrip() + """,
roc AS (SELECT 0 AS point, CAST(NULL AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
        UNION ALL SELECT rank_desc, score, CAST(fp AS DOUBLE) / n_neg, CAST(tp AS DOUBLE) / n_pos FROM c),
m AS (SELECT count(*) AS m FROM roc),
keep AS (SELECT DISTINCT CASE WHEN i = 199 THEN m - 1
                             ELSE CAST(floor(i * (CAST(m - 1 AS DOUBLE) / 199)) AS BIGINT) END AS idx
         FROM range(0, 200) t(i), m)
SELECT point, threshold, round(fpr, 4) AS fpr, round(tpr, 4) AS tpr FROM roc WHERE point IN (SELECT idx FROM keep)""")
def q_thin_curve(spark, sf_dir):
    roc = V.roc_curve(_scored(spark, sf_dir))
    return V.thin_curve(roc, "point", 200, round_cols=["fpr", "tpr"], digits=4)


@query("compare_thresholds", SC + """
SELECT CAST(0.5 AS DOUBLE) AS threshold_a, CAST(0.32 AS DOUBLE) AS threshold_b,
  round((CAST(tp_b + tn_b AS DOUBLE) / n) - (CAST(tp_a + tn_a AS DOUBLE) / n), 6) AS delta_accuracy,
  round(CAST(tp_b AS DOUBLE) / (tp_b + fp_b) - CAST(tp_a AS DOUBLE) / (tp_a + fp_a), 6) AS delta_precision,
  round(CAST(tp_b AS DOUBLE) / (tp_b + fn_b) - CAST(tp_a AS DOUBLE) / (tp_a + fn_a), 6) AS delta_recall,
  round(CAST(2 * tp_b AS DOUBLE) / (2 * tp_b + fp_b + fn_b) - CAST(2 * tp_a AS DOUBLE) / (2 * tp_a + fp_a + fn_a), 6)
    AS delta_f1,
  fn_a - fn_b AS recovered_events, fp_b - fp_a AS added_false_alarms, flipped_rows
FROM (SELECT count(*) AS n,
  CAST(count_if(label = 1 AND score >= 0.5) AS BIGINT) AS tp_a, CAST(count_if(label = 0 AND score >= 0.5) AS BIGINT) AS fp_a,
  CAST(count_if(label = 0 AND score < 0.5) AS BIGINT) AS tn_a, CAST(count_if(label = 1 AND score < 0.5) AS BIGINT) AS fn_a,
  CAST(count_if(label = 1 AND score >= 0.32) AS BIGINT) AS tp_b, CAST(count_if(label = 0 AND score >= 0.32) AS BIGINT) AS fp_b,
  CAST(count_if(label = 0 AND score < 0.32) AS BIGINT) AS tn_b, CAST(count_if(label = 1 AND score < 0.32) AS BIGINT) AS fn_b,
  CAST(count_if(score >= 0.32 AND score < 0.5) AS BIGINT) AS flipped_rows FROM scored)""")
def q_compare_thresholds(spark, sf_dir):
    out = V.compare_thresholds(_scored(spark, sf_dir), a=0.5, b=0.32)
    return r6(out, ["delta_accuracy", "delta_precision", "delta_recall", "delta_f1"])
