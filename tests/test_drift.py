import math
import random

import numpy as np
from pyspark.sql import functions as F

from stratocast.operators import drift as R

from conftest import BUCKETED


def _wass(u, v):
    allv = np.sort(np.concatenate([u, v]))
    d = np.diff(allv)
    cu = np.searchsorted(np.sort(u), allv[:-1], "right") / len(u)
    cv = np.searchsorted(np.sort(v), allv[:-1], "right") / len(v)
    return float(np.sum(np.abs(cu - cv) * d))


def _js(p_counts, q_counts):
    keys = sorted(set(p_counts) | set(q_counts))
    p = np.array([p_counts.get(k, 0) for k in keys], float)
    q = np.array([q_counts.get(k, 0) for k in keys], float)
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    kl = lambda a: np.sum(np.where(a > 0, a * np.log(np.where(a > 0, a, 1) / m), 0.0))
    return math.sqrt((kl(p) + kl(q)) / 2)


def _tables(spark, shift=0.0, seed=2):
    rnd = random.Random(seed)
    ref = [(round(rnd.gauss(10, 2), 1), rnd.choice("abc")) for _ in range(300)]
    cur = [(round(rnd.gauss(10 + shift, 2), 1) if i % 7 else None, rnd.choice("abcd" if shift else "abc"))
           for i in range(200)]
    schema = "x double, c string"
    return ref, cur, spark.createDataFrame(ref, schema), spark.createDataFrame(cur, schema)


def test_wasserstein_and_js_match_numpy(spark):
    ref, cur, r, c = _tables(spark, shift=1.0)
    u = np.array([x for x, _ in ref])
    v = np.array([x for x, _ in cur if x is not None])
    exp = _wass(u, v) / max(float(np.std(u)), 0.001)
    for kw in ({}, BUCKETED):
        got = R.wasserstein_norm(r, c, ["x"], **kw).first()["distance"]
        assert abs(got - exp) < 1e-9
    pc, qc = {}, {}
    for _, k in ref:
        pc[k] = pc.get(k, 0) + 1
    for _, k in cur:
        qc[k] = qc.get(k, 0) + 1
    assert abs(R.js_distance(r, c, ["c"]).first()["distance"] - _js(pc, qc)) < 1e-12


def test_distance_to_itself_is_zero(spark):
    _, _, r, _ = _tables(spark)
    cd = {x["column"]: x for x in R.column_drift(r, r, ["x"], ["c"]).collect()}
    assert cd["x"]["distance"] == 0.0 and abs(cd["c"]["distance"]) < 1e-9
    assert not cd["x"]["drifted"] and not cd["c"]["drifted"]


def test_missing_column_is_no_data(spark):
    _, _, r, c = _tables(spark)
    cur = c.drop("c")
    cd = {x["column"]: x for x in R.column_drift(r, cur, ["x"], ["c"]).collect()}
    assert cd["c"]["status"] == "no_data" and cd["c"]["drifted"] is False
    ds = R.dataset_drift(R.column_drift(r, cur, ["x"], ["c"])).first()
    assert ds["n_columns"] == 2 and ds["n_measured"] == 1


def test_summary_branches_and_decision(spark):
    _, _, r, c = _tables(spark, shift=3.0)
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp")
    small = R.drift_summary(r, c, ["x"], ["c"], min_samples=400, ts=ts).first()
    assert small["status"] == "insufficient" and small["share"] is None and small["retrain"] is False
    ok = R.drift_summary(r, c, ["x"], ["c"], min_samples=100, ts=ts)
    row = ok.first()
    assert row["status"] == "ok" and row["n_drifted"] == 2 and row["retrain"] is True
    g = {x["metric"]: x["value"] for x in R.drift_gauges(ok).collect()}
    assert g["dataset_drift"] == 1.0 and g["drift_samples"] == 200.0 and len(g) == 5
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    assert R.retrain_decision(ok, now).first()["decision"] == "alert"
    late = F.lit("2024-01-03 00:00:00").cast("timestamp")
    assert R.retrain_decision(ok, late).first()["decision"] == "skip_stale"
    assert R.retrain_decision(ok.limit(0), now).first()["decision"] == "skip_absent"
    ins = R.drift_summary(r, c, ["x"], ["c"], min_samples=400, ts=ts)
    assert R.retrain_decision(ins, now).first()["decision"] == "skip_insufficient"


def test_calibration_separates_shifted_traffic(spark):
    rnd = random.Random(9)
    pop = spark.createDataFrame([(i, rnd.gauss(10, 2), rnd.choice("abc")) for i in range(3000)],
                                "id long, x double, c string")
    shifted = spark.createDataFrame([(i, rnd.gauss(13, 2), rnd.choice("cd")) for i in range(3000)],
                                    "id long, x double, c string")
    reference = pop.limit(1000).select("x", "c")
    cal = R.calibrate(reference, pop, shifted, "id", ["x"], ["c"], sizes=(50, 200), draws_normal=3,
                      draws_shifted=2)
    rows = cal.collect()
    assert len(rows) == 2 * (3 + 2)
    assert all(r["n_current"] == r["size"] for r in rows)
    sep = {r["size"]: r for r in R.separating_interval(cal).collect()}
    assert sep[200]["separated"]
    tab = R.calibration_table(cal).collect()
    assert {(r["kind"], r["size"]) for r in tab} == {("normal", 50), ("normal", 200), ("shifted", 50), ("shifted", 200)}


def test_nothing_measured_is_no_verdict(spark):
    _, _, r, c = _tables(spark)
    broken = c.select(F.lit(None).cast("double").alias("x"), F.lit(None).cast("string").alias("c"))
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp")
    s = R.drift_summary(r, broken, ["x"], ["c"], min_samples=1, ts=ts)
    row = s.first()
    assert row["status"] == "unmeasured" and row["share"] is None and row["retrain"] is False
    assert R.retrain_decision(s, F.lit("2024-01-01 01:00:00").cast("timestamp")).first()["decision"] == "skip_unmeasured"


def test_short_draws_are_refused(spark):
    import pytest
    pop = spark.range(100).select("id", F.col("id").cast("double").alias("x"))
    with pytest.raises(ValueError, match="cannot give draws"):
        R.calibrate(pop.select("x"), pop, pop, "id", ["x"], [], sizes=(50, 200), draws_normal=1, draws_shifted=1)
