from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from stratocast.sources import commits
from stratocast.streaming import upsert as U
from stratocast.streaming.scoring import scoring_sink, start_scoring

SCHEMA = "k string, ts int, v int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: [(x is not None, x) for x in r])


def test_claims_and_records(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda i: commits.claim(spark, f"{tmp_path}/a/one"), range(8)))
    assert sum(got) == 1
    assert commits.commit(spark, f"{tmp_path}/c/1", {"x": "é", "n": [1]}) and not commits.commit(spark, f"{tmp_path}/c/1", {"x": 2})
    assert commits.read_record(spark, f"{tmp_path}/c/1") == {"x": "é", "n": [1]} and commits.read_record(spark, f"{tmp_path}/c/2") is None
    assert commits.record_names(spark, f"{tmp_path}/c") == ["1"] and commits.record_names(spark, f"{tmp_path}/none") == []


def test_upsert_keeps_the_newest_and_ignores_replays(spark, tmp_path):
    t = U.UpsertTable(f"{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema, ["k"], ["ts"], buckets=3)
    put = lambda data, i: t.upsert(spark.createDataFrame(data, SCHEMA), i)       # noqa: E731
    assert t.read(spark).count() == 0
    assert put([("a", 1, 10), ("b", 5, 50), (None, 1, 1), ("a", 2, 20)], 0)
    assert put([("b", 4, 40), ("c", 1, 1), (None, 2, 2)], 1)
    want = [(None, 2, 2), ("a", 2, 20), ("b", 5, 50), ("c", 1, 1)]
    assert rows(t.read(spark)) == want
    assert not put([("a", 9, 9)], 1) and not put([("a", 9, 9)], 0) and rows(t.read(spark)) == want
    assert put([("b", 5, 51)], 2) and rows(t.read(spark))[2] == ("b", 5, 51)          # equally new: the later batch
    assert put([], 3) and t.clean(spark) > 0 and t.clean(spark) == 0 and len(rows(t.read(spark))) == 4
    with pytest.raises(ValueError):
        U.UpsertTable(f"{tmp_path}/t", SCHEMA, ["k"], buckets=5).read(spark)


def test_crash_before_the_record_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    t = U.UpsertTable(f"{tmp_path}/t", SCHEMA, ["k"], ["ts"], buckets=2)
    t.upsert(spark.createDataFrame([("a", 1, 1)], SCHEMA), 0)

    def crash(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(U, "commit", crash)
    with pytest.raises(RuntimeError):
        t.upsert(spark.createDataFrame([("a", 2, 2), ("b", 2, 2)], SCHEMA), 1)
    assert rows(t.read(spark)) == [("a", 1, 1)]
    monkeypatch.undo()
    assert t.upsert(spark.createDataFrame([("a", 2, 2), ("b", 2, 2)], SCHEMA), 1)
    assert rows(t.read(spark)) == [("a", 2, 2), ("b", 2, 2)]


def test_update_stream_into_a_table_over_restarts(spark, tmp_path):
    src, ckpt = str(tmp_path / "in"), str(tmp_path / "ckpt")
    t = U.UpsertTable(f"{tmp_path}/t", "k string, n bigint", ["k"], ["n"])

    def run(data):
        spark.createDataFrame(data, "k string").coalesce(1).write.mode("append").parquet(src)
        counts = spark.readStream.schema("k string").option("maxFilesPerTrigger", 1).parquet(src).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        q = U.upsert_stream(counts, t, ckpt, {"availableNow": True}).start()
        q.awaitTermination(300)
        assert q.exception() is None

    run([("a",), ("b",), ("a",)])
    assert rows(t.read(spark)) == [("a", 2), ("b", 1)]
    run([("a",), ("c",)])
    assert rows(t.read(spark)) == [("a", 3), ("b", 1), ("c", 1)]


def test_scoring_crash_between_the_two_writes(spark, tmp_path, monkeypatch):
    from stratocast.operators import rows as P
    from stratocast.plans import models as M
    schema = "x double, c string, Month int, label int, request_id string"
    data = [(float(i % 17), "a" if i % 3 else "b", i % 14, i % 2, f"r{i}") for i in range(140)]
    src = str(tmp_path / "in")
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(src)
    model = M.train(spark.read.parquet(src).where("Month between 1 and 12"), ["x"], ["c"], "logreg", overrides={"maxIter": 5})
    log, rejected = f"{tmp_path}/log", f"{tmp_path}/rejected"

    def run():
        stream = spark.readStream.schema(schema).parquet(src).withColumn("ts", F.current_timestamp())
        q = start_scoring(model, stream, [("x", "double"), ("c", "string"), ("Month", "int")], P.feature_record_rules("Month"), log, rejected,
                          f"{tmp_path}/ckpt", 0.5, "1", trigger={"availableNow": True})
        try:
            q.awaitTermination(300)
        except Exception:
            pass
        return q.exception()

    real, sink = U.BatchSides.write, scoring_sink(log, rejected)

    def half(self, sides, batch_id):
        sides["log"].write.format("json").mode("overwrite").save(f"{self.folders['log']}/batch={batch_id}")
        raise RuntimeError("lost")

    monkeypatch.setattr(U.BatchSides, "write", half)
    assert run() is not None
    assert sink.read(spark, "log", "request_id string").count() == 0            # what is not committed is not read
    monkeypatch.setattr(U.BatchSides, "write", real)
    assert run() is None and run() is None
    bad = sum(not 1 <= r[2] <= 12 for r in data)
    ids = [r[0] for r in sink.read(spark, "log", "request_id string").collect()]
    assert len(ids) == len(set(ids)) == len(data) - bad and sink.read(spark, "rejected", "request_id string").count() == bad
