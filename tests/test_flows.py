import json
import os
import random
import tempfile

from pyspark.sql import functions as F

from stratocast.plans import flows
from stratocast.plans import models as M
from stratocast.sources.observations import OBSERVATION_SCHEMA


def _csv(n=400, seed=4):
    rnd = random.Random(seed)
    names = [f.name for f in OBSERVATION_SCHEMA.fields]
    lines = [",".join(names)]
    for i in range(n):
        hum = rnd.uniform(20, 100)
        rain = "Yes" if hum + rnd.gauss(0, 15) > 75 else "No"
        row = {c: f"{rnd.uniform(0, 30):.1f}" for c in names}
        row.update(Date=f"2010-{1 + i % 12:02d}-{1 + i % 28:02d}", Location=rnd.choice(["Sydney", "Perth", "Hobart"]),
                   WindGustDir=rnd.choice(["N", "S", "E", "W"]), WindDir9am=rnd.choice(["N", "S"]),
                   WindDir3pm=rnd.choice(["E", "W"]), Humidity3pm=f"{hum:.1f}",
                   RainToday=rnd.choice(["Yes", "No", "NA"]), RainTomorrow=rain if i % 50 else "NA")
        lines.append(",".join(row[c] for c in names))
    d = tempfile.mkdtemp(prefix="stratocast-flow-")
    p = os.path.join(d, "w.csv")
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    return d, p


def test_explore_train_drift(spark):
    d, p = _csv()
    obs = flows.read_observations(spark, p)
    res = flows.explore_report(obs, os.path.join(d, "eda"))
    assert res["target"].first()["n_missing"] == 8
    assert res["month_rates"].count() == 12
    table = flows.load_training_table(spark, p).withColumn("rid", F.monotonically_increasing_id())
    out = flows.train_and_promote(spark, table, os.path.join(d, "reg"), "logreg", key_cols=["rid"],
                                  overrides={"maxIter": 20}, gate=0.0)
    assert out["version"] == 1 and out["promoted"] and out["metrics"]["roc_auc"] > 0.7
    model = M.load(M.resolve_alias(spark, os.path.join(d, "reg"), "rain"))
    # log 300 scored requests, then run the drift job against a reference sample
    from stratocast.sources.prediction_log import log_records, write_prediction_log
    feats = [c for c in flows.DRIFT_TRACKED]
    sc = M.score(model, table.limit(300), None, 0.5, "1")
    write_prediction_log(log_records(sc, feats, ts=F.current_timestamp(), request_id="rid"), os.path.join(d, "log"))
    summ = flows.drift_job(spark, os.path.join(d, "no-ref"), os.path.join(d, "log"), os.path.join(d, "drift"),
                           fallback=table, min_samples=100).first()
    assert summ["status"] == "ok" and summ["n_current"] == 300 and summ["share"] <= 0.5
    lines = open(next(os.path.join(dp, f) for dp, _, fs in os.walk(os.path.join(d, "drift", "summaries"))
                      for f in fs if f.endswith(".json"))).read().splitlines()
    assert json.loads(lines[0])["status"] == "ok"


def test_evaluation_report(spark):
    d, p = _csv(n=300, seed=8)
    table = flows.load_training_table(spark, p).withColumn("rid", F.monotonically_increasing_id()).cache()
    from stratocast.operators import sampling as D
    from stratocast.operators import rows as P
    split = D.stratified_split(table, "label", 0.2, 42, ["rid"]).cache()
    tr, te = split.where("not is_test"), split.where("is_test")
    numeric, categorical = P.feature_lists(table, flows.CATEGORICAL_FEATURES, drop=[*flows.DROP_COLS, "label", "rid"])
    res = flows.evaluation_report(tr, te, numeric, categorical, os.path.join(d, "eval"),
                                  settings=("logreg", "rf", "gbt"))
    models = {r["model"]: r for r in res["models"].collect()}
    assert set(models) == {"baseline_always_no", "logreg", "rf", "gbt"} and models["baseline_always_no"]["roc_auc"] is None
    assert res["grid"].count() == 91 and res["importances"].count() <= 15
    assert res["roc_logreg"].count() <= 200 and res["auc_gbt"].first()["auc"] > 0.5
    assert os.path.isdir(os.path.join(d, "eval", "grid"))
