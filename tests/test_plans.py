"""Plan shape: pushdown and pruning reach the scan, no nested-loop or cartesian
joins, ordered sums never run as one window over all rows on the bucketed path."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from stratocast.operators import evaluate as V
from stratocast.plans import queries as catalog
from stratocast.plans import standins as S

from conftest import BUCKETED, SF_SMALL

STREAMS = {"stream_sliding_rate", "stream_error_share", "stream_outcome_share", "stream_sustained_sessions",
           "stream_score", "prediction_log_roundtrip", "compare_models", "feature_importances", "score"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.REGISTRY) - STREAMS))
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filter_and_projection_reach_the_scan(spark):
    plan = _plan(E.queries()["filter_group"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(l_suppkey), EqualTo(l_suppkey,7)]" in plan
    flag = _plan(E.entry(spark))
    assert "ReadSchema: struct<l_suppkey:bigint,l_returnflag:string>" in flag


def test_bucketed_curve_windows_are_partitioned(spark):
    t = V.score_table(S.scored(spark, SF_SMALL), **BUCKETED)
    plan = _plan(t)
    assert "_pfx_bucket" in plan
    for line in plan.splitlines():
        if line.strip().startswith("Window ") or " Window [" in line:
            assert "_pfx_bucket" in line or "SinglePartition" not in line


def test_small_side_is_broadcast(spark):
    assert "SortMergeJoin" not in _plan(V.roc_auc(S.scored(spark, SF_SMALL)))          # totals are literals
    assert "BroadcastHashJoin" in _plan(E.queries()["wasserstein_norm"](spark, SF_SMALL))
    assert "SortMergeJoin" not in _plan(E.queries()["stratified_split"](spark, SF_SMALL))
