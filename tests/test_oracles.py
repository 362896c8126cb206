"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from stratocast.plans import queries as catalog
from stratocast.sources import TABLES

from conftest import SF_SMALL

# the training-data subpackage tests its own queries
LIBRARY = set(catalog.REGISTRY)
SLOW = {"compare_models", "feature_importances", "score", "stream_score"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["l_suppkey", "rate_pct", "n"]


@pytest.mark.parametrize("name", sorted(LIBRARY & set(E.oracle_sql())))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert _rows(sdf.columns, sdf.collect()) == _rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(LIBRARY - set(E.oracle_sql()) - SLOW))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SF_SMALL).count() >= 0
