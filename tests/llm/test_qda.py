import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from stratocast.llm import catalog, qda

from conftest import SF_MID
from llm_fixtures import docs  # noqa: F401


def plain_score(x, y, at):
    """Scores by the textbook formula, with explicit inverses."""
    k = x.shape[1]
    centre, var = x.mean(0), x.var(0)
    scale = np.sqrt(np.where(var > 1e-12, var, 1.0))
    x, at = (x - centre) / scale, (at - centre) / scale
    own = k * (k + 1) / 2
    cov = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    n = [(y == c).sum() for c in (0, 1)]
    shared = sum(n[c] * cov[c] for c in (0, 1)) / len(y)
    s = own / (own + len(y))
    shared = (1 - s) * shared + s * np.diag(np.diag(shared))
    logs = []
    for c in (0, 1):
        s = own / (own + n[c])
        m = (1 - s) * cov[c] + s * shared + qda.FLOOR * np.eye(k)
        z = at - x[y == c].mean(0)
        logs.append(math.log(n[c] / len(y)) - 0.5 * np.linalg.slogdet(m)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(m), z))
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def stats_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, stats array<double>, n0 bigint, n1 bigint")


def test_score_is_the_textbook_one(spark):
    rng = np.random.default_rng(0)
    k = len(qda.STATISTICS)
    x = np.concatenate([rng.normal(0, 1, (150, k)), rng.normal(1, 2, (60, k))])
    x[:, 3] = 7.0                                            # a constant statistic
    y = np.array([1] * 150 + [0] * 60)
    df = stats_of(spark, [(i, v, int(c == 0), int(c == 1)) for i, (v, c) in enumerate(zip(x.tolist(), y.tolist()))]).repartition(5)
    model = qda.fit(df)
    assert np.allclose(model.score(x), plain_score(x, y, x), atol=1e-9)
    got = qda.score(df.select("doc_id", "stats"), model).orderBy("doc_id").collect()
    assert np.allclose([r.score for r in got], model.score(x)) and ((model.score(x) >= 0.5) == y).mean() > 0.9
    assert model.shrinkage[0] > model.shrinkage[1]           # the smaller class is shrunk more


def test_repeated_labels_weigh_more(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(i % 2, 1, len(qda.STATISTICS)).tolist(), int(i % 2 == 0), int(i % 2)) for i in range(40)]
    a = qda.fit(stats_of(spark, rows + rows))
    b = qda.fit(stats_of(spark, [(i, v, 2 * x, 2 * y) for i, v, x, y in rows]))
    assert np.allclose(a.means, b.means) and np.allclose(a.factors, b.factors) and a.shares == b.shares


def test_one_class_or_none(spark, docs):        # noqa: F811
    d = docs(["some text", "", None, "MORE!!"])
    labels = lambda rows: spark.createDataFrame(rows, "doc_id bigint, quality int")     # noqa: E731
    assert {r.score for r in qda.classify(d, labels([])).collect()} == {0.5}
    free = [i for i in range(4) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert {(r.score, r.predicted) for r in qda.classify(d, labels([(free[0], 1), (None, 0), (free[1], None)])).collect()} == {(1.0, 1)}
    assert qda.classify(d.limit(0), labels([(0, 1)])).count() == 0


def test_statistics():
    at = dict(zip(qda.STATISTICS, qda.statistics("Ab ab ab\nAb ab ab\n\n9 $$ É.")))
    assert at["chars"] == math.log1p(26) and at["words"] == math.log1p(9) and at["lines"] == math.log1p(3)
    assert at["letters"] == math.asin(math.sqrt(13 / 26)) and at["upper"] == math.asin(math.sqrt(3 / 13))
    assert at["odd_marks"] == math.asin(math.sqrt(2 / 26)) and at["doubled_marks"] == math.asin(math.sqrt(1 / 26))
    assert at["repeated_lines"] == math.asin(math.sqrt(1 / 3)) and at["commonest_word"] == math.asin(math.sqrt(4 / 9))
    assert qda.statistics(None) == qda.statistics("") == [0.0] * len(qda.STATISTICS)
    assert all(map(math.isfinite, (v for t in (" ", "\n", "x" * 500_000, "\ud800", "1", "!" * 9, "一二三") for v in qda.statistics(t))))


def test_rows_without_ids_and_repeated_rows(spark, docs):        # noqa: F811
    texts = ["The plain words of a text, one after another. " * 5, "BUY!! $$$ NOW!! $$$"] * 30
    d = docs(texts)
    labels = spark.createDataFrame([(i, 1 - i % 2, None) for i in range(60)] + [(0, 1, 1)] * 5, "doc_id bigint, quality int, score int")
    twice = d.unionByName(d).unionByName(d.withColumn("doc_id", F.lit(None).cast("bigint")))
    got = qda.classify(twice, labels).collect()
    assert len(got) == 180 and sum(r.doc_id is None for r in got) == 60
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.held_out, r.score, r.predicted))
    assert all(len(v) == 1 for i, v in by.items() if i is not None) and {h for h, _, _ in by[None]} == {False}
    assert {(i % 2, p) for i, v in by.items() if i is not None for _, _, p in v} == {(0, 1), (1, 0)}


def test_held_out_accuracy(spark):
    got = catalog.op13_quality(spark, SF_MID)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert got.count() == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
