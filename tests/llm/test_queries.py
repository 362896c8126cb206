"""The queries of this package against their DuckDB SQL, and their plans."""

import duckdb
import pytest

import __spark_entry__ as E
from stratocast.llm.catalog import REGISTRY
from stratocast.sources import TABLES

from conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in REGISTRY.items() if sql))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = E.queries()[name](spark, SF_SMALL)
    cols = sorted(got.columns)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = con.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({E.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(cols).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["op3_fixity", "op8_chats", "op9_decontaminate", "op10_simhash"])
def test_plans_cross_nothing_and_run_no_python_where_native(spark, name):
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name == "op9_decontaminate":
        assert "Python" not in plan and "Arrow" not in plan
