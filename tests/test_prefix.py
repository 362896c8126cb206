import random

import numpy as np

from stratocast.operators.prefix import collapse, row_index, running_totals
from stratocast.operators.quantiles import exact_quantiles

from conftest import BUCKETED


def _frame(spark, n=300, groups=3, seed=1):
    rnd = random.Random(seed)
    rows = {}
    for _ in range(n):
        g = rnd.randrange(groups)
        v = round(rnd.uniform(-50, 50), 1)
        rows[(g, v)] = rows.get((g, v), 0) + rnd.randrange(1, 4)
    return spark.createDataFrame([(g, v, c) for (g, v), c in rows.items()], "g int, v double, c long")


def _expected(rows, descending=False):
    out = {}
    by_g = {}
    for g, v, c in rows:
        by_g.setdefault(g, []).append((v, c))
    for g, items in by_g.items():
        items.sort(reverse=descending)
        run = 0
        for i, (v, c) in enumerate(items):
            run += c
            nxt = items[i + 1][0] if i + 1 < len(items) else None
            out[(g, v)] = (run, nxt)
    return out


def test_running_totals_plain_and_bucketed_agree(spark):
    df = _frame(spark)
    rows = [tuple(r) for r in df.collect()]
    for desc in (False, True):
        exp = _expected(rows, desc)
        for kw in ({}, BUCKETED):
            got = running_totals(df, "v", ["c"], ["g"], descending=desc, with_next=True, **kw).collect()
            assert len(got) == len(rows)
            for r in got:
                assert (r["cum_c"], r["next_v"]) == exp[(r["g"], r["v"])]


def test_running_totals_without_partition(spark):
    df = _frame(spark, groups=1)
    rows = [tuple(r) for r in df.collect()]
    exp = _expected(rows)
    got = running_totals(df, "v", ["c"], with_next=True, **BUCKETED).collect()
    for r in got:
        assert (r["cum_c"], r["next_v"]) == exp[(r["g"], r["v"])]


def test_row_index_is_a_permutation(spark):
    df = _frame(spark, groups=1).select("v")
    idx = sorted((r["v"], r["idx"]) for r in row_index(df, "v", **BUCKETED).collect())
    assert [i for _, i in idx] == list(range(len(idx)))


def test_collapse_sums(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (2, 5)], "k int, x int")
    assert sorted(tuple(r) for r in collapse(df, ["k"], ["x"]).collect()) == [(1, 5), (2, 5)]


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(3)
    data = [(rnd.randrange(2), float(rnd.randrange(40))) for _ in range(401)] + [(1, None)]
    df = spark.createDataFrame(data, "g int, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for kw in ({}, BUCKETED):
        got = {(r["g"], r["p"]): r["quantile"] for r in exact_quantiles(df, ["x"], probs, ["g"], **kw).collect()}
        for g in (0, 1):
            vals = np.array([x for gg, x in data if gg == g and x is not None])
            for p in probs:
                assert abs(got[(g, p)] - float(np.quantile(vals, p))) < 1e-9


def test_exact_median_of_four_is_interpolated(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    got = exact_quantiles(df, ["x"], [0.5]).first()["quantile"]
    assert got == 2.5


def test_next_cols_cross_buckets(spark):
    rows = [(float(i), i * 10) for i in range(50)]
    df = spark.createDataFrame(rows, "v double, x long")
    for kw in ({}, BUCKETED):
        got = {r["v"]: r["next_x"] for r in running_totals(df, "v", [], descending=True, next_cols=["x"], **kw).collect()}
        assert got[0.0] is None and all(got[float(i)] == (i - 1) * 10 for i in range(1, 50))


def test_null_order_values_are_kept_on_both_paths(spark):
    df = spark.createDataFrame([(None, 1), (1.0, 2), (2.0, 3), (3.0, 4)], "v double, c long")
    for desc in (False, True):
        plain = sorted((r["v"] is None, r["v"] or 0, r["cum_c"]) for r in running_totals(df, "v", ["c"], descending=desc).collect())
        bucketed = sorted((r["v"] is None, r["v"] or 0, r["cum_c"])
                          for r in running_totals(df, "v", ["c"], descending=desc, **BUCKETED).collect())
        assert plain == bucketed and len(plain) == 4


def test_null_partitions_are_kept_at_any_bucket_size(spark):
    """A null partition value is a partition like any other (against brute force)."""
    rows = [(None if i % 3 == 0 else i % 3, float(i * 7 % 100), i % 5) for i in range(100)]
    df = spark.createDataFrame(rows, "g int, v double, c long").groupBy("g", "v").sum("c").withColumnRenamed("sum(c)", "c")
    have = [tuple(r) for r in df.collect()]
    exp = _expected(have)
    for kw in ({}, BUCKETED):
        got = running_totals(df, "v", ["c"], ["g"], with_next=True, **kw).collect()
        assert {(r["g"], r["v"]): (r["cum_c"], r["next_v"]) for r in got} == exp and len(got) == len(have)
        med = {r["g"]: r["quantile"] for r in exact_quantiles(df, ["v"], [0.5], ["g"], **kw).collect()}
        assert med == {g: float(np.median([v for gg, v, _ in have if gg == g])) for g in (None, 1, 2)}
