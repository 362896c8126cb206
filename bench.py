"""Benchmark of the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is planned and fully executed into the ``noop`` sink (nothing is
collected); the time includes the small driver-side actions some operators
take (row counts, quantile cut points). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from stratocast.plans import queries as catalog  # noqa: E402
from stratocast.plans import catalog_prep as CP  # noqa: E402
from stratocast.plans import models as M  # noqa: E402
from stratocast.operators.prefix import release_cached  # noqa: E402
from stratocast.session import get_spark  # noqa: E402

HEADLINE = [
    # exploration
    "target_rate_by_supplier", "profile_columns", "count_duplicates", "numeric_describe",
    "target_correlations", "class_quantiles", "median_shift", "rate_by_month",
    # evaluation
    "roc_auc", "roc_auc_low_ties", "pr_curve", "recommend_thresholds", "threshold_grid", "thin_curve",
    # split and preparation
    "stratified_split", "impute_scale_fit",
    # drift
    "column_drift", "drift_summary",
    # monitoring
    "sliding_rate", "latency_quantiles", "sustained_alerts", "inhibit_alerts",
    # sources and streams
    "parse_observations", "stream_error_share",
]


def _fit_query(setting):
    """Fit scope as the reference times it: preprocessing fit + model fit on
    the training rows (split and cached before the timer starts)."""
    def prepare(spark, sf_dir):
        tr, _ = CP._split(spark, sf_dir)
        tr = tr.persist()
        tr.count()
        return tr

    def run(tr):
        return M.train(tr, CP.NUM, CP.CAT + ["month"], setting)
    return prepare, run


# training with the reference settings (logistic: 1000 iterations, C = 1;
# boosting: 100 rounds, depth 5, 255 bins)
TRAINING = {"fit_logreg": _fit_query("logreg"), "fit_gbt": _fit_query("gbt")}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    extra = {"spark.driver.memory": "16g"}
    event_dir = os.environ.get("BENCH_EVENT_LOG_DIR")       # stage / task times, read offline
    if event_dir:
        os.makedirs(event_dir, exist_ok=True)
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_dir})
    spark = get_spark("stratocast-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, extra=extra)
    names = only or HEADLINE + list(TRAINING)
    times = {}
    # warm-up: JVM start, first parquet footer reads
    catalog.REGISTRY["target_rate_by_supplier"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        if name in TRAINING:
            prepare, run = TRAINING[name]
            tr = prepare(spark, sf_dir)
            t0 = time.perf_counter()
            run(tr)
            times[name] = round(time.perf_counter() - t0, 3)
            tr.unpersist()
        else:
            fn = catalog.REGISTRY[name][0]
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        release_cached()
        print(f"{name}: {times[name]}s", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
