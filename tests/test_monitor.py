import datetime as dt

from pyspark.sql import functions as F

from stratocast.operators import expect as Q
from stratocast.operators import monitor as O

from conftest import BUCKETED


def _prom_quantile(q, bounds, cums):
    """Reference algorithm of the monitoring system, on finite bounds + the +Inf count."""
    total = cums[-1]
    if total == 0:
        return None
    rank = q * total
    b = next((i for i in range(len(bounds)) if cums[i] >= rank), len(bounds))
    if b == len(bounds):
        return bounds[-1]
    if b == 0 and bounds[0] <= 0:
        return bounds[0]
    start = bounds[b - 1] if b > 0 else 0.0
    prev = cums[b - 1] if b > 0 else 0
    return start + (bounds[b] - start) * ((rank - prev) / (cums[b] - prev))


def test_histogram_and_quantile(spark):
    vals = [0.0, 0.05, 0.1, 0.15, 0.5, 0.55, 0.9, 0.95, 0.97, 1.0]
    df = spark.createDataFrame([(v,) for v in vals], "proba double")
    h = sorted((r["bucket"], r["le"], r["cum_count"]) for r in O.histogram(df).collect())
    cums = [c for _, _, c in h]
    assert cums[-1] == 10 and cums[0] == 1 and cums[1] == 3
    hg = O.histogram(df).withColumn("g", F.lit(1))
    for q in (0.5, 0.9, 0.95, 0.99):
        got = O.histogram_quantile(hg, q, ["g"]).first()["quantile"]
        assert abs(got - _prom_quantile(q, list(O.PROBA_BOUNDS), cums)) < 1e-12


def test_sliding_rate_and_error_share(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 30)
    rows = [(t0 + dt.timedelta(minutes=i), "error" if i % 3 == 0 else "ok") for i in range(10)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string")
    r = O.sliding_rate(df, "5 minutes", "1 minute").collect()
    assert max(x["n"] for x in r) == 5 and abs(max(x["rate"] for x in r) - 5 / 300) < 1e-12
    e = O.error_share(df, F.col("kind") == "error", "10 minutes", None).collect()
    assert len(e) == 1 and e[0]["n_error"] == 4 and e[0]["share"] == 0.4


def test_sustained_alerts_islands(spark):
    t0 = dt.datetime(2024, 1, 1)
    flags = [1, 1, 1, 0, 1, 1, None, 1, 1, 1, 1]           # None: missing sample
    rows = [(t0 + dt.timedelta(seconds=15 * i), float(f)) for i, f in enumerate(flags) if f is not None]
    df = spark.createDataFrame(rows, "ts timestamp, v double").withColumn("series", F.lit("s"))
    for kw in ({}, BUCKETED):
        out = sorted((r["start"], r["n_samples"]) for r in O.sustained_alerts(
            df, F.col("v") > 0, hold_seconds=30, step_seconds=15, series_cols=["series"], **kw).collect())
        assert [n for _, n in out] == [3, 4]


def test_stale_latest_and_inhibit(spark):
    t = dt.datetime(2024, 1, 10)
    g = spark.createDataFrame([("a", t - dt.timedelta(days=3), 1.0), ("a", t - dt.timedelta(days=4), 2.0),
                               ("b", t - dt.timedelta(hours=1), 5.0)], "metric string, ts timestamp, value double")
    assert [r["metric"] for r in O.stale_series(g, F.lit(t)).collect()] == ["a"]
    assert {r["metric"]: r["value"] for r in O.latest_gauge(g).collect()} == {"a": 1.0, "b": 5.0}
    al = spark.createDataFrame([
        ("1", "ApiDown", "critical", "api", t, t + dt.timedelta(minutes=30)),
        ("2", "ModelMissing", "critical", "api", t + dt.timedelta(minutes=10), t + dt.timedelta(minutes=20)),
        ("3", "Latency", "warning", "api", t + dt.timedelta(hours=2), t + dt.timedelta(hours=3)),
        ("4", "Latency", "warning", "other", t, t + dt.timedelta(minutes=5)),
    ], "alert_id string, alertname string, severity string, job string, start timestamp, end timestamp")
    kept = sorted(r["alert_id"] for r in O.inhibit_alerts(al, "ApiDown").collect())
    assert kept == ["1", "3", "4"]


def test_outcome_share_empty(spark):
    df = spark.createDataFrame([], "label boolean")
    r = O.outcome_share(df).first()
    assert r["n"] == 0 and r["share"] == 0.0


def test_expectations(spark):
    grid = spark.createDataFrame([(0.1, 0.9), (0.2, 0.95), (0.3, 0.5)], "threshold double, recall double")
    assert [r["threshold"] for r in Q.expect_monotone(grid, "threshold", "recall").collect()] == [0.2]
    assert [r["threshold"] for r in Q.expect_grid(grid, "threshold", [0.1, 0.2, 0.3, 0.4]).collect()] == [0.4]
    assert Q.expect_range(grid, ["recall"], 0.0, 0.9).count() == 1


def test_expect_monotone_bucketed(spark):
    grid = spark.createDataFrame([(i / 100, 1.0 - i / 100 + (0.5 if i == 40 else 0.0)) for i in range(100)],
                                 "threshold double, recall double")
    for kw in ({}, BUCKETED):
        assert [r["threshold"] for r in Q.expect_monotone(grid, "threshold", "recall", **kw).collect()] == [0.4]


def test_rows_without_time_belong_to_no_window(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 30)
    df = spark.createDataFrame([(t0, "ok"), (None, "error")], "ts timestamp, kind string")
    assert [r["n"] for r in O.sliding_rate(df, "5 minutes", None).collect()] == [1]
    assert O.error_share(df, F.col("kind") == "error", "5 minutes", None).first()["n_error"] == 0


def test_inhibition_by_brute_force(spark):
    """Open alerts, several jobs, touching and nested source intervals."""
    import random
    rnd, t0, rows = random.Random(5), dt.datetime(2024, 1, 1), []
    for i in range(120):
        a = t0 + dt.timedelta(minutes=rnd.randrange(300))
        b = None if rnd.random() < 0.1 else a + dt.timedelta(minutes=rnd.randrange(0, 25))
        name = "ApiDown" if rnd.random() < 0.2 else "Latency"
        rows.append((str(i), name, rnd.choice(["critical", "warning", "info"]), rnd.choice(["api", "etl", "web", None]), a, b))
    schema = "alert_id string, alertname string, severity string, job string, start timestamp, end timestamp"
    far = dt.datetime(9999, 1, 1)
    src = [r for r in rows if r[1] == "ApiDown"]
    hit = {r[0] for r in rows if r[1] != "ApiDown" and r[2] != "info" and r[3] is not None
           and any(s[3] == r[3] and r[4] <= (s[5] or far) and s[4] <= (r[5] or far) for s in src)}
    got = {r["alert_id"] for r in O.inhibit_alerts(spark.createDataFrame(rows, schema), "ApiDown").collect()}
    assert got == {r[0] for r in rows} - hit and hit


def test_null_series_keep_their_alerts(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(s, t0 + dt.timedelta(minutes=i), 1.0) for s in (None, "a") for i in range(20)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, v double")
    for kw in ({}, BUCKETED):
        got = {r["s"]: r["n_samples"] for r in O.sustained_alerts(df, F.col("v") > 0, 300, 60, ["s"], **kw).collect()}
        assert got == {None: 20, "a": 20}


def test_windows_are_sums_of_panes_and_rows_are_not_doubled(spark):
    from stratocast.streaming import monitor_stream as MS
    log = spark.range(10).select(F.timestamp_seconds(F.col("id") * 40).alias("ts"), (F.col("id") % 2 == 0).alias("e"), (F.col("id") / 10).alias("x"))
    for df in (O.sliding_rate(log), O.error_share(log, F.col("e")), O.latency_quantiles(log, "x")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        # below the expansion to windows stands an aggregate: it sees panes
        assert plan.count("Expand") == 1 and "Aggregate" in plan[plan.index("Expand"):]
    # any width and step, the step no divisor of the width
    got = {(r.window_start, r.n) for r in O.sliding_rate(log, "5 minutes", "2 minutes").collect()}
    want = {(r.s, r["count"]) for r in log.groupBy(F.window("ts", "5 minutes", "2 minutes").start.alias("s")).count().collect()}
    assert got == want and len(got) > 3
    assert MS is not None


def test_inhibition_is_split_in_time(spark):
    import random
    rng = random.Random(2)
    start = lambda: rng.randrange(0, 100_000)        # noqa: E731
    rows = [(f"a{i}", rng.choice(["Down", "Slow"]), "warning", "api", s := start(), s + rng.randrange(1, 60) if rng.random() < 0.95 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "alert_id string, alertname string, severity string, job string, s int, e int")
    df = df.select("alert_id", "alertname", "severity", "job", F.timestamp_seconds("s").alias("start"), F.timestamp_seconds("e").alias("end"))
    out = O.inhibit_alerts(df, "Down", rows_per_range=20)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    import re
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[", plan)
    assert windows and all("_range" in w for w in windows)
    big = 10 ** 9
    src = [(s, e or big) for _, n, _, _, s, e in rows if n == "Down"]
    want = {i for i, n, _, _, s, e in rows if n == "Down" or not any(a <= (e or big) and b >= s for a, b in src)}
    assert {r.alert_id for r in out.collect()} == want and 0 < len(want) < 400
