import random

import numpy as np

from stratocast.operators import evaluate as V

from conftest import BUCKETED


def _scored(spark, n=400, seed=5, ties=True):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        y = 1 if rnd.random() < 0.3 else 0
        s = rnd.random() * 0.6 + 0.3 * y
        if ties:
            s = round(s, 2)
        rows.append((y, s))
    return rows, spark.createDataFrame(rows, "label int, score double")


def _auc_brute(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    tot = sum((1.0 if p > q else 0.5 if p == q else 0.0) for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def test_auc_matches_pairs_and_reverses(spark):
    rows, df = _scored(spark)
    for kw in ({}, BUCKETED):
        auc = V.roc_auc(df, **kw).first()["auc"]
        assert abs(auc - _auc_brute(rows)) < 1e-12
        rev = V.roc_auc(df.selectExpr("label", "-score AS score"), **kw).first()["auc"]
        assert abs(rev - (1 - auc)) < 1e-12


def test_roc_and_pr_curves_brute(spark):
    rows, df = _scored(spark)
    scores = sorted({s for _, s in rows})
    P = sum(y for y, _ in rows)
    N = len(rows) - P
    roc = {r["point"]: r for r in V.roc_curve(df, **BUCKETED).collect()}
    assert roc[0]["fpr"] == 0.0 and roc[0]["tpr"] == 0.0
    for i, t in enumerate(sorted(scores, reverse=True), start=1):
        tp = sum(1 for y, s in rows if y == 1 and s >= t)
        fp = sum(1 for y, s in rows if y == 0 and s >= t)
        assert roc[i]["threshold"] == t and abs(roc[i]["tpr"] - tp / P) < 1e-12 and abs(roc[i]["fpr"] - fp / N) < 1e-12
    pr = {r["point"]: r for r in V.pr_curve(df).collect()}
    for i, t in enumerate(scores):
        tp = sum(1 for y, s in rows if y == 1 and s >= t)
        fp = sum(1 for y, s in rows if y == 0 and s >= t)
        assert pr[i]["threshold"] == t and abs(pr[i]["precision"] - tp / (tp + fp)) < 1e-12
    assert (pr[len(scores)]["precision"], pr[len(scores)]["recall"]) == (1.0, 0.0)


def test_average_precision_and_recommendation(spark):
    rows, df = _scored(spark)
    P = sum(y for y, _ in rows)
    scores = sorted({s for _, s in rows})
    prec, rec = [], []
    for t in scores:
        tp = sum(1 for y, s in rows if y == 1 and s >= t)
        fp = sum(1 for y, s in rows if y == 0 and s >= t)
        prec.append(tp / (tp + fp))
        rec.append(tp / P)
    ap = sum((rec[i] - (rec[i + 1] if i + 1 < len(rec) else 0.0)) * prec[i] for i in range(len(rec)))
    assert abs(V.average_precision(df).first()["average_precision"] - ap) < 1e-12
    f1 = [2 * p * r / (p + r + 1e-12) for p, r in zip(prec, rec)]
    i = int(np.nanargmax(f1))
    ok = [j for j, r in enumerate(rec) if r >= 0.7]
    got = V.recommend_thresholds(df, target_recall=0.7).first()
    assert got["thr_f1opt"] == round(scores[i], 4)
    assert got["thr_recall_target"] == round(scores[max(ok)] if ok else 0.0, 4)


def test_grid_rows_equal_point_metrics(spark):
    rows, df = _scored(spark, ties=False)
    grid = {r["threshold"]: r for r in V.threshold_grid(df).collect()}
    assert len(grid) == 91
    for t in (0.05, 0.32, 0.5, 0.95):
        a = V.scores_at(df, threshold=t).first()
        g = grid[t]
        assert (g["tp"], g["fp"], g["tn"], g["fn"]) == (a["tp"], a["fp"], a["tn"], a["fn"])
        assert abs(g["f1"] - a["f1"]) < 1e-12


def test_score_on_bound_goes_up(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.49999), (1, 0.05)], "label int, score double")
    g = {r["threshold"]: r for r in V.threshold_grid(df).collect()}
    assert g[0.5]["tp"] == 1 and g[0.05]["tp"] == 2


def test_confusion_report_and_baseline(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (0, 0)], "label int, pred int")
    c = V.confusion(df).first()
    assert (c["tp"], c["fp"], c["tn"], c["fn"]) == (1, 1, 2, 1)
    rep = {r["class"]: r for r in V.classification_report(df).collect()}
    assert rep["1"]["precision"] == 0.5 and rep["0"]["recall"] == 2 / 3 and rep["accuracy"]["f1"] == 0.6
    b = V.baseline_always_no(df).first()
    assert b["accuracy"] == 0.6 and b["precision"] == 0.0 and b["f1"] == 0.0


def test_thin_indices_match_linspace():
    for m in (5, 199, 200, 201, 1000, 12345):
        exp = sorted(set(np.linspace(0, m - 1, 200).astype(int).tolist())) if m > 200 else list(range(m))
        assert V.thin_indices(m, 200) == exp


def test_grid_choice_and_compare(spark):
    rows, df = _scored(spark, ties=False)
    grid = V.round_grid(V.threshold_grid(df))
    ch = V.grid_choice(grid).first()
    g = sorted(((r["threshold"], r["f1"], r["recall"]) for r in grid.collect()))
    best = max(g, key=lambda t: t[1])
    assert ch["f1_threshold"] == best[0]
    cmp = V.compare_thresholds(df, a=0.5, b=0.32).first()
    flips = sum(1 for _, s in rows if 0.32 <= s < 0.5)
    assert cmp["flipped_rows"] == flips


def test_rows_without_a_score_are_left_out_everywhere(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (0, float("nan")), (1, None)], "label int, score double")
    at = V.scores_at(df, threshold=0.5).first()
    grid = V.threshold_grid(df, thresholds=[0.5]).first()
    assert all(at[k] == grid[k] for k in ("tp", "fp", "tn", "fn")) and (at["tp"], at["fp"], at["tn"], at["fn"]) == (1, 0, 1, 0)
    c = V.compare_thresholds(df, a=0.5, b=0.1).first()
    assert c["added_false_alarms"] == 1 and c["flipped_rows"] == 1


def test_curves_of_empty_tables_have_no_points(spark):
    df = spark.createDataFrame([], "label int, score double")
    assert V.roc_curve(df).count() == 0 and V.thin_curve(V.pr_curve(df)).count() == 0
