"""End-to-end flows of the reference, composed from the operators.

- :func:`explore_report`: read once, persist, compute the exploration
  statistics as a few wide aggregates, write each result table (3.3);
- :func:`train_and_promote`: label, split exactly, fit preprocessing and a
  model, evaluate, log the run, register and gate the alias (3.1);
- :func:`drift_job`: reference snapshot vs. logged traffic, summary and
  gauges written for the retrain decision (3.2);
- :func:`evaluation_report`: model comparison, threshold grid, thinned
  curves and importances (the evaluation export).

Every data-sized step is a Spark job; the driver sees fitted statistics and
result rows whose size does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift as R
from ..operators import evaluate as V
from ..operators import profile as A
from ..operators import rows as P
from ..operators import sampling as D
from ..operators.prefix import attach_one_row, release_cached
from ..sources.observations import (freeze_reference, path_exists, CATEGORICAL_FEATURES, DRIFT_TRACKED, DROP_COLS, TARGET, load_reference,
                                    read_observations)
from ..sources.prediction_log import read_prediction_log
from ..sources.reports import write_report
from . import models as M
from . import prepare as FP


def explore_report(obs: DataFrame, out_dir: str | None = None, target: str = TARGET, today: str = "RainToday",
                   date: str = "Date", group: str = "Location", category: str = "WindGustDir",
                   class_cols: Sequence[str] = ("Humidity3pm", "Sunshine", "Pressure3pm", "Rainfall")
                   ) -> dict[str, DataFrame]:
    """The exploration statistics of an observation table, by name."""
    obs = obs.persist(StorageLevel.MEMORY_AND_DISK)
    numeric = [f.name for f in obs.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long")]
    lab = P.map_label(obs, target)
    res = {
        "profile": A.profile_columns(obs),
        "duplicates": A.count_duplicates(obs),
        "dates": A.date_coverage(obs, date),
        "groups": A.group_size_stats(obs, group),
        "target": A.target_balance(obs, target),
        "persistence": A.persistence_baseline(obs, today, target),
        "describe": A.numeric_describe(obs, numeric),
        "correlations": A.target_correlations(lab, numeric, "label"),
        "class_means": A.class_means(obs, [c for c in class_cols if c in obs.columns], target),
        "category_distribution": A.value_distribution(obs, category),
        "category_rates": A.target_rate(lab, category, "label"),
        "group_rates": A.target_rate(lab, group, "label"),
        "month_rates": A.rate_by_month(lab, date, "label"),
    }
    res["category_extremes"] = A.rate_extremes(res["category_rates"], category, 3)
    res["group_extremes"] = A.rate_extremes(res["group_rates"], group, 5)
    res["month_extremes"] = A.month_extremes(res["month_rates"])
    if out_dir:
        for name, df in res.items():
            write_report(df, f"{out_dir}/{name}")
        release_cached()
    return res


def load_training_table(spark: SparkSession, path: str) -> DataFrame:
    """Observations with rows without target removed, ``Month`` added, label 0/1."""
    obs = read_observations(spark, path)
    lab = P.encode_label(obs, TARGET)
    return P.add_month(lab, "Date")


def train_and_promote(spark: SparkSession, table: DataFrame, registry: str, setting: str = "rf",
                      name: str = "rain", alias: str = "champion", gate: float = 0.0, key_cols: Sequence[str] = (),
                      test_fraction: float = 0.2, seed: int = 42, overrides: Mapping | None = None,
                      target_recall: float = 0.70) -> dict:
    """Split, fit, evaluate, log, register; the alias moves only when recall >= gate."""
    numeric, categorical = P.feature_lists(table, CATEGORICAL_FEATURES, drop=[*DROP_COLS, "label", *key_cols])
    split = D.stratified_split(table, "label", test_fraction, seed, list(key_cols) or None)
    split = split.persist(StorageLevel.MEMORY_AND_DISK)
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    model = M.train(train, numeric, categorical, setting, seed, overrides)
    scored = M.probability(model.transform(test)).select("label", "proba").persist(StorageLevel.MEMORY_AND_DISK)
    met = V.scores_at(scored, "label", "proba", 0.5).first().asDict()
    met["roc_auc"] = V.roc_auc(scored, "label", "proba").first()["auc"]
    reco = V.recommend_thresholds(scored, "label", "proba", target_recall).first().asDict()
    n_train = train.count()
    M.log_run(spark, f"{registry}/runs", {"model": setting, "params": {"n_train": n_train, **(overrides or {})},
                                         "metrics": {**met, **reco}})
    reg = M.register(spark, model, registry, name, met["recall"], alias, gate)
    scored.unpersist()
    split.unpersist()
    release_cached()
    return {"metrics": met, "thresholds": reco, **reg}


def evaluation_report(train: DataFrame, test: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                      out_dir: str | None = None, reference_model: str = "gbt",
                      settings: Sequence[str] = ("logreg", "logreg_balanced", "rf", "gbt")) -> dict[str, DataFrame]:
    """Model comparison, threshold grid of one model, thinned curves, importances."""
    table, models = M.compare_models(train, test, numeric, categorical, settings)
    res = {"models": M.report(table)}
    scored = M.probability(models[reference_model].transform(test)).select("label", "proba") \
        .persist(StorageLevel.MEMORY_AND_DISK)
    grid = V.round_grid(V.threshold_grid(scored, "label", "proba"))
    res["grid"] = grid
    res["grid_choice"] = V.grid_choice(grid)
    for nm in settings:
        sc = M.probability(models[nm].transform(test)).select("label", "proba")
        tab = V.score_table(sc, "label", "proba")
        res[f"roc_{nm}"] = V.thin_curve(V.roc_curve(sc, table=tab), "point", 200, ["fpr", "tpr"])
        res[f"pr_{nm}"] = V.thin_curve(V.pr_curve(sc, table=tab), "point", 200, ["precision", "recall"])
        res[f"auc_{nm}"] = attach_one_row(V.roc_auc(sc, table=tab), V.average_precision(sc, table=tab))
    if "rf" in models:
        names = FP.feature_names(models["rf"].transform(train))
        res["importances"] = M.feature_importances(models["rf"], names, 15)
    if out_dir:
        for name, df in res.items():
            write_report(df, f"{out_dir}/{name}")
        release_cached()
    return res


def drift_job(spark: SparkSession, reference_path: str, log_path: str, out_dir: str,
              fallback: DataFrame | None = None, tracked: Sequence[str] = DRIFT_TRACKED,
              categorical: Sequence[str] = ("Location",), min_samples: int = 400,
              share_threshold: float = 0.5) -> DataFrame:
    """Compare logged traffic with the frozen reference; append summary and gauges.

    The first run freezes its sample of ``fallback`` at ``reference_path``, so
    that all later runs compare with the same rows.
    """
    from pyspark.sql import types as T
    if fallback is not None and not path_exists(spark, reference_path):
        freeze_reference(load_reference(spark, reference_path, fallback, tracked=tracked), reference_path)
    reference = load_reference(spark, reference_path, fallback, tracked=tracked)
    feats = T.StructType([T.StructField(c, T.StringType() if c in categorical else T.DoubleType())
                          for c in tracked])
    current = read_prediction_log(spark, log_path, feats, list(reference.columns))
    numeric = [c for c in reference.columns if c not in categorical]
    cats = [c for c in reference.columns if c in categorical]
    summary = R.drift_summary(reference, current, numeric, cats, min_samples, share_threshold)
    summary = summary.persist(StorageLevel.MEMORY_AND_DISK)
    summary.write.mode("append").json(f"{out_dir}/summaries")
    R.drift_gauges(summary).write.mode("append").json(f"{out_dir}/gauges")
    release_cached()
    return summary
