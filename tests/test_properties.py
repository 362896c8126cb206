"""Randomised properties of the ordered-sum and quantile operators (forced bucketed path)."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stratocast.operators.prefix import running_totals
from stratocast.operators.quantiles import exact_quantiles

from conftest import BUCKETED

values = st.lists(st.tuples(st.integers(0, 2), st.integers(-20, 20)), min_size=1, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values)
def test_running_totals_equal_python(spark, rows):
    counts = {}
    for g, v in rows:
        counts[(g, float(v))] = counts.get((g, float(v)), 0) + 1
    df = spark.createDataFrame([(g, v, c) for (g, v), c in counts.items()], "g int, v double, c long")
    got = {(r["g"], r["v"]): (r["cum_c"], r["next_v"])
           for r in running_totals(df, "v", ["c"], ["g"], with_next=True, **BUCKETED).collect()}
    for g in {g for g, _ in counts}:
        vs = sorted(v for gg, v in counts if gg == g)
        run = 0
        for i, v in enumerate(vs):
            run += counts[(g, v)]
            assert got[(g, v)] == (run, vs[i + 1] if i + 1 < len(vs) else None)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values, st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]))
def test_exact_quantiles_equal_numpy(spark, rows, p):
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g int, x double")
    got = {r["g"]: r["quantile"] for r in exact_quantiles(df, ["x"], [p], ["g"], **BUCKETED).collect()}
    for g in {g for g, _ in rows}:
        exp = float(np.quantile(np.array([float(v) for gg, v in rows if gg == g]), p))
        assert abs(got[g] - exp) < 1e-9
