import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from stratocast.llm import stages

from conftest import SF_SMALL
from llm_fixtures import docs  # noqa: F401
from test_decontaminate import brute as brute_hits
from test_pii import brute as brute_spans
from test_simhash import brute_components, brute_print


def test_stages_by_brute_force(spark, docs):
    """Each stage keeps, drops and rewrites what the plain versions say."""
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = d.orderBy("doc_id").collect()
    prints = [brute_print(r.text) for r in rows]
    comp = brute_components(prints)
    deduped = stages.drop_near_duplicates(spark, d, SF_SMALL)
    assert deduped.columns == d.columns
    assert {r.doc_id for r in deduped.collect()} == {rows[c].doc_id for c in comp}
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    clean = stages.drop_contaminated(spark, d, SF_SMALL)
    hits = brute_hits([r.text for r in rows], items)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r, h in zip(rows, hits) if not h[4]}
    red = {r.doc_id: r for r in stages.redact_pii(spark, d, SF_SMALL).collect()}
    assert len(red) == len(rows)
    for r in rows:
        new = red[r.doc_id]
        assert new.n_chars == len(new.text) and brute_spans(new.text) == ""
        assert bool(brute_spans(r.text)) <= (new.text != r.text)
        if new.text == r.text:
            assert new == r


def test_languages(spark, docs):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = docs([None, "", "12 34", "это другой язык и буквы", "漢字だけの文書"], extra=False).withColumn("doc_id", -1 - F.col("doc_id"))
    mixed = d.unionByName(odd)
    kept = stages.keep_known_languages(spark, mixed, SF_SMALL)
    assert kept.columns == d.columns and kept.exceptAll(d).isEmpty() and kept.count() == d.count()
    empty = docs([], extra=False)
    assert stages.keep_known_languages(spark, empty, SF_SMALL).count() == 0


def test_dedup_keeps_one_of_each_group_whatever_the_ids(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (7, "other words here now"), (7, "other words here now"), (7, "a b c d"), (None, "alone it stands"), (None, None), (3, "")]
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id bigint, text string, copies string")
    got = sorted(map(str, ((r.doc_id, r.text, r.copies) for r in stages.drop_near_duplicates(spark, df, SF_SMALL).collect())))
    assert got == sorted(map(str, [(7, "other words here now", "own"), (7, "a b c d", "own"), (None, "alone it stands", "own"), (3, "", "own")]))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_with_empty_and_odd_tables(spark, docs, name, stage):
    assert stage(spark, docs([]), SF_SMALL).count() == 0
    odd = docs([None, "", "a", "the same words again", "the same words again", "mail a@b.co " * 500])
    out = stage(spark, odd, SF_SMALL)
    out.collect()
    if name != "pack":
        assert out.columns == odd.columns
        assert all(r.words == "own words" and r.base == "own base" for r in out.collect())


def test_run_chains_the_stages(spark):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    pieces = E.queries()["pipeline"](spark, SF_SMALL).collect()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL)
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
    sizes = {}
    for r in pieces:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in sizes.values())


def test_queries_are_registered():
    names = [n for n in E.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11)) and "pipeline" in E.queries()
