"""Registered sampling, preparation and model queries (D1-D2, F1-F7, M1-M11)."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..operators import rows as P
from ..operators import sampling as D
from ..session import scratch_path
from ..sources import table
from . import models as M
from . import prepare as FP
from . import standins as S
from .catalog import OBS, query, r6

NUM = S.NUMERIC
CAT = ["l_linestatus", "today_flag"]
TRAIN_CUT = "1999-01-01 00:00:00"
TRAIN_RULE = f"l_shipdate < TIMESTAMP '{TRAIN_CUT}'"
# (l_orderkey, l_linenumber) repeats in the driver data; with part and supplier it is unique
LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _labelled(spark, sf_dir):
    obs = P.encode_label(S.observations(spark, sf_dir), "target_flag")
    return P.add_month(obs, "l_shipdate", out="month")


def _train(spark, sf_dir):
    return _labelled(spark, sf_dir).where(F.col("l_shipdate") < F.lit(TRAIN_CUT).cast("timestamp_ntz"))


# D1 -------------------------------------------------------------------------
@query("stratified_split", OBS + """
SELECT label, 'test' AS split, CAST(round(count(*) * 0.2) AS BIGINT) AS n FROM
  (SELECT CAST(target_flag = 'Yes' AS INTEGER) AS label FROM obs WHERE target_flag IS NOT NULL) GROUP BY label
UNION ALL
SELECT label, 'train', count(*) - CAST(round(count(*) * 0.2) AS BIGINT) FROM
  (SELECT CAST(target_flag = 'Yes' AS INTEGER) AS label FROM obs WHERE target_flag IS NOT NULL) GROUP BY label""")
def q_stratified_split(spark, sf_dir):
    obs = P.encode_label(S.observations(spark, sf_dir), "target_flag")
    split = D.stratified_split(obs, "label", 0.2, seed=42, key_cols=LI_KEY)
    return D.split_counts(split, "label")


# D2 -------------------------------------------------------------------------
@query("sample_exact", f"""
SELECT {", ".join(LI_KEY)}, l_quantity FROM lineitem ORDER BY {S.LINE_RANK_SQL}, {", ".join(LI_KEY)} LIMIT 1000""")
def q_sample_exact(spark, sf_dir):
    """The chosen rows themselves, by a rank that the oracle computes too."""
    li = table(spark, sf_dir, "lineitem")
    return D.sample_exact(li, 1000, seed=7, key_cols=LI_KEY, rank=S.line_rank()).select(*LI_KEY, "l_quantity")


# F1 + F2 --------------------------------------------------------------------
def _numeric_fit_sql():
    parts = []
    for c in NUM:
        parts.append(
            f"SELECT '{c}' AS \"column\", round(med, 6) AS median, round(avg(coalesce({c}, med)), 6) AS mean, "
            f"round(stddev_pop(coalesce({c}, med)), 6) AS std "
            f"FROM tr, (SELECT median({c}) AS med FROM tr) GROUP BY med")
    return OBS.rstrip() + f""",
tr AS (SELECT * FROM obs WHERE target_flag IS NOT NULL AND {TRAIN_RULE})
""" + "\nUNION ALL\n".join(parts)


@query("impute_scale_fit", _numeric_fit_sql())
def q_impute_scale_fit(spark, sf_dir):
    stats = FP.fit_numeric(_train(spark, sf_dir), NUM)
    rows = [(c, s["median"], s["mean"], s["std"]) for c, s in stats.items()]
    out = spark.createDataFrame(rows, "column string, median double, mean double, std double")
    return r6(out, ["median", "mean", "std"])


@query("standardise", OBS.rstrip() + f""",
tr AS (SELECT * FROM obs WHERE target_flag IS NOT NULL AND {TRAIN_RULE}),
st AS (SELECT med, avg(coalesce(l_quantity, med)) AS mu, stddev_pop(coalesce(l_quantity, med)) AS sd
       FROM tr, (SELECT median(l_quantity) AS med FROM tr) GROUP BY med)
SELECT l_orderkey, l_linenumber, round((coalesce(l_quantity, med) - mu) / sd, 6) AS l_quantity_std
FROM obs, st""")
def q_standardise(spark, sf_dir):
    stats = FP.fit_numeric(_train(spark, sf_dir), ["l_quantity"])
    stage = FP.numeric_stage(stats)
    out = stage.transform(S.observations(spark, sf_dir))
    return r6(out.select("l_orderkey", "l_linenumber", F.col("l_quantity__num").alias("l_quantity_std")),
              ["l_quantity_std"])


# F3 -------------------------------------------------------------------------
@query("impute_mode", OBS.rstrip() + f""",
tr AS (SELECT * FROM obs WHERE target_flag IS NOT NULL AND {TRAIN_RULE}),
lng AS (SELECT 'l_linestatus' AS "column", l_linestatus AS value FROM tr WHERE l_linestatus IS NOT NULL
        UNION ALL SELECT 'today_flag', today_flag FROM tr WHERE today_flag IS NOT NULL),
cnt AS (SELECT "column", value, count(*) AS n FROM lng GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS r FROM cnt)
SELECT "column", value AS mode FROM rk WHERE r = 1""")
def q_impute_mode(spark, sf_dir):
    modes = FP.fit_modes(_train(spark, sf_dir), CAT)
    return spark.createDataFrame(list(modes.items()), "column string, mode string")


# F4 -------------------------------------------------------------------------
@query("one_hot", """
WITH tr AS (SELECT DISTINCT p_brand FROM part WHERE p_size <= 3)
SELECT p_partkey,
       CASE WHEN p_brand IN (SELECT p_brand FROM tr)
            THEN (SELECT count(*) FROM tr t WHERE t.p_brand < part.p_brand) END AS slot,
       (SELECT count(*) FROM tr) AS width
FROM part""")
def q_one_hot(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    model = FP.fit_preprocessor(part.where(F.col("p_size") <= 3), [], ["p_brand"])
    enc = model.transform(part)
    arr = F.col("_arr")
    return (enc.select("p_partkey", vector_to_array(F.col("features")).alias("_arr"))
               .select("p_partkey",
                       (F.array_position(arr, F.lit(1.0)) - 1).alias("_p"), F.size(arr).alias("width"))
               .select("p_partkey", F.when(F.col("_p") >= 0, F.col("_p")).alias("slot"),
                       F.col("width").cast("long").alias("width")))


# F6 -------------------------------------------------------------------------
_SLOTS = [*[(i, f"'{c}'", None) for i, c in enumerate(NUM)], *[(len(NUM) + i, f"'{c}_' || CAST({c} AS VARCHAR)", c) for i, c in enumerate([*CAT, "month"])]]


@query("feature_names", OBS.rstrip() + f""",
tr AS (SELECT *, month(l_shipdate) AS month FROM obs WHERE target_flag IS NOT NULL AND {TRAIN_RULE}),
names AS ({" UNION ALL ".join(f"SELECT DISTINCT {i} AS part, {name} AS name FROM tr" + (f" WHERE {c} IS NOT NULL" if c else "") for i, name, c in _SLOTS)})
SELECT CAST(row_number() OVER (ORDER BY part, name) - 1 AS INTEGER) AS slot, name FROM names""")
def q_feature_names(spark, sf_dir):
    tr = _train(spark, sf_dir)
    model = FP.fit_preprocessor(tr, NUM, CAT + ["month"])
    names = FP.feature_names(model.transform(tr))
    return spark.createDataFrame(list(enumerate(names)), "slot int, name string")


# F7 -------------------------------------------------------------------------
@query("check_complete", OBS + """
SELECT 'prepared' AS input, CAST(0 AS BIGINT) AS n_incomplete, count(*) AS n_rows FROM obs WHERE target_flag IS NOT NULL
UNION ALL
SELECT 'unprepared', count_if(l_quantity IS NULL), count(*) FROM obs WHERE target_flag IS NOT NULL""")
def q_check_complete(spark, sf_dir):
    """Vectors of the fitted preparation, and of the same columns without it."""
    lab = _labelled(spark, sf_dir)
    model = FP.fit_preprocessor(_train(spark, sf_dir), NUM, CAT + ["month"])
    raw = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in NUM])
    done = FP.check_complete(model.transform(lab)).select(F.lit("prepared").alias("input"), "*")
    return done.unionByName(FP.check_complete(lab.select(array_to_vector(raw).alias("features"))).select(F.lit("unprepared").alias("input"), "*"))


# M1-M8, M11 (rows-only: fitted models are not SQL) --------------------------
# The comparison fits the reference's settings (100 trees of depth 30 in each
# forest, 100 rounds of boosting), the defaults of ``train``; the importances
# come from a smaller forest.
_TREES = {"rf": {"numTrees": 20, "maxDepth": 8}}


def _split(spark, sf_dir):
    lab = _labelled(spark, sf_dir)
    # a filter on one scan: both sides read it anew, narrower than a kept copy of all columns
    sp = D.stratified_split(lab, "label", 0.2, seed=42, key_cols=LI_KEY)
    return sp.where(~F.col("is_test")), sp.where(F.col("is_test"))


@query("compare_models")
def q_compare_models(spark, sf_dir):
    tr, te = _split(spark, sf_dir)
    table_, _ = M.compare_models(tr, te, NUM, CAT + ["month"], settings=M.SETTINGS)
    return M.report(table_).drop("seconds")


@query("feature_importances")
def q_feature_importances(spark, sf_dir):
    tr, _ = _split(spark, sf_dir)
    m = M.train(tr, NUM, CAT + ["month"], "rf", overrides=_TREES["rf"])
    names = FP.feature_names(m.transform(tr))
    return M.feature_importances(m, names, 15)


@query("score")
def q_score(spark, sf_dir):
    tr, te = _split(spark, sf_dir)
    m = M.train(tr, NUM, CAT + ["month"], "logreg")
    schema = [("l_orderkey", "bigint"), ("l_linenumber", "int"), *[(c, "double") for c in NUM],
              *[(c, "string") for c in CAT], ("month", "int")]
    return M.score(m, te, schema, threshold=0.5, version="1").select(
        "l_orderkey", "l_linenumber", "proba", "decision", "threshold", "model_version")


# P5 -------------------------------------------------------------------------
_LAB = OBS.rstrip() + """,
lab AS (SELECT *, month(l_shipdate) AS month FROM obs WHERE target_flag IS NOT NULL)
"""


@query("feature_lists", _LAB + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS name, '{kind}' AS kind, {i} AS position, count({c}) AS n_values, count(DISTINCT {c}) AS n_distinct FROM lab"
    for kind, cols in (("numeric", NUM), ("categorical", CAT + ["month"])) for i, c in enumerate(cols)))
def q_feature_lists(spark, sf_dir):
    lab = _labelled(spark, sf_dir).select(*NUM, *CAT, "month", "l_shipdate", "target_flag", "label")
    nums, cats = P.feature_lists(lab, CAT + ["month"], drop=["l_shipdate", "target_flag", "label"])
    listed = [(c, "numeric", i) for i, c in enumerate(nums)] + [(c, "categorical", i) for i, c in enumerate(cats)]
    counts = lab.agg(*[F.count(c).alias(f"n_{c}") for c, _, _ in listed], *[F.count_distinct(c).alias(f"d_{c}") for c, _, _ in listed])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.lit(kind).alias("kind"), F.lit(i).alias("position"), F.col(f"n_{c}").alias("n_values"),
                 F.col(f"d_{c}").alias("n_distinct")) for c, kind, i in listed])))


# M9 + M10 -------------------------------------------------------------------
_GATE = 0.55


@query("registry", S.with_ctes(S.SCORED_SQL).rstrip() + f""",
r AS (SELECT i AS version, CAST(count_if(label = 1 AND score >= t) AS DOUBLE) / CAST(count_if(label = 1) AS BIGINT) AS recall
      FROM (VALUES (1, 0.5), (2, 0.3), (3, 0.8), (4, 0.4), (5, 0.9)) v(i, t), scored GROUP BY i)
SELECT CAST(version AS BIGINT) AS version, round(recall, 6) AS recall, recall >= {_GATE} AS promoted,
       version = (SELECT max(version) FROM r WHERE recall >= {_GATE}) AS champion, 'v' || version AS run FROM r""")
def q_registry(spark, sf_dir):
    """A model registered with the recall of five thresholds: those over the
    gate move the alias, the last of them keeps it; each run is logged."""
    from ..operators import evaluate as V
    root = scratch_path(spark, f"registry-{uuid.uuid4().hex}")
    scored = S.scored(spark, sf_dir)
    model = FP.fit_preprocessor(_train(spark, sf_dir), NUM, CAT)
    for i, t in enumerate((0.5, 0.3, 0.8, 0.4, 0.9), 1):
        recall = V.scores_at(scored, "label", "score", t).first()["recall"]
        M.log_run(spark, f"{root}/runs", {"run_id": f"v{i}", "model": "threshold", "params": {"t": t}, "metrics": {"recall": recall}})
        M.register(spark, model, root, "rain", recall, gate=_GATE)
    champion = M.resolve_alias(spark, root, "rain")
    runs = spark.read.schema("run_id string, metrics string").json(f"{root}/runs")
    logged = F.get_json_object("metrics", "$.recall").cast("double")
    found = M.versions(spark, root, "rain").join(runs.select(F.col("run_id").alias("run"), logged.alias("logged")), F.col("recall") == F.col("logged"))
    return r6(found.select("version", "recall", F.col("alias").isNotNull().alias("promoted"), (F.col("path") == F.lit(champion)).alias("champion"), "run"), ["recall"])
