from pyspark.sql import functions as F

from stratocast.operators import monitor as O
from stratocast.plans import standins as S
from stratocast.sources import utc_to_ntz
from stratocast.streaming import monitor_stream as MS
from stratocast.streaming.runner import read_output, run_available

from conftest import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_equals_batch_on_closed_windows(spark):
    log_b = S.prediction_log(spark, SF_SMALL)
    max_ts = log_b.agg(F.max("ts")).first()[0]
    batch = O.sliding_rate(log_b, "5 minutes", "1 minute", by=["event_type"])
    closed = batch.where(F.col("window_end") <= F.lit(max_ts) - F.expr("INTERVAL 10 MINUTES"))
    stream = MS.sliding_rate_stream(S.as_prediction_log(S.events_stream(spark, SF_SMALL)), "5 minutes",
                                    "1 minute", by=["event_type"])
    got = read_output(spark, run_available(stream, "t_sliding"), stream.schema)
    assert _rows(utc_to_ntz(got)) == _rows(utc_to_ntz(closed))


def test_stream_dedup_of_replayed_requests(spark):
    ev = S.events_stream(spark, SF_SMALL)
    doubled = ev.unionByName(S.events_stream(spark, SF_SMALL))
    s = MS.with_event_time(S.as_prediction_log(doubled), dedup_key="request_id")
    out = read_output(spark, run_available(s.select("request_id"), "t_dedup"), "request_id string")
    n = S.prediction_log(spark, SF_SMALL).count()
    assert out.count() == n


def test_requests_without_an_id_stay(spark):
    def some_null(df):
        return df.withColumn("request_id", F.when(F.pmod(F.xxhash64("request_id"), F.lit(3)) > 0, F.col("request_id")))

    log = some_null(S.prediction_log(spark, SF_SMALL))
    n_null, n = log.where("request_id IS NULL").count(), log.count()
    ev = S.events_stream(spark, SF_SMALL)
    s = MS.with_event_time(some_null(S.as_prediction_log(ev.unionByName(S.events_stream(spark, SF_SMALL)))))
    out = read_output(spark, run_available(s.select("request_id"), "t_dedup_null"), "request_id string")
    assert n_null > 1 and out.where("request_id IS NULL").count() == 2 * n_null and out.count() == n + n_null


def test_streaming_scorer_writes_log_and_rejected(spark, tmp_path):
    from stratocast.operators import rows as P
    from stratocast.plans import models as M
    from stratocast.sources.prediction_log import read_prediction_log
    from stratocast.streaming.scoring import start_scoring
    from pyspark.sql import types as T
    import glob
    import json
    import os

    rows = [(float(i % 17), "a" if i % 3 else "b", (i % 14), i % 2, f"r{i}") for i in range(200)]
    schema = "x double, c string, Month int, label int, request_id string"
    src = tmp_path / "in"
    spark.createDataFrame(rows, schema).write.parquet(str(src))
    model = M.train(spark.read.parquet(str(src)).where("Month between 1 and 12"), ["x"], ["c"], "logreg",
                    overrides={"maxIter": 5})
    stream = spark.readStream.schema(schema).parquet(str(src)).withColumn("ts", F.current_timestamp())
    feats = [("x", "double"), ("c", "string"), ("Month", "int")]
    q = start_scoring(model, stream, feats, P.feature_record_rules("Month"), str(tmp_path / "log"),
                      str(tmp_path / "rejected"), str(tmp_path / "ckpt"), 0.5, "1",
                      trigger={"availableNow": True})
    q.awaitTermination(300)
    fs = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("c", T.StringType()),
                       T.StructField("Month", T.IntegerType())])
    logged = read_prediction_log(spark, str(tmp_path / "log"), fs)
    rejected = spark.read.json(str(tmp_path / "rejected"))
    n_bad = sum(1 for r in rows if not 1 <= r[2] <= 12)
    assert logged.count() == 200 - n_bad and rejected.count() == n_bad
    assert set(rejected.select("violations").first()[0]) == {"month_range"}
    line = next(open(f).readline() for f in glob.glob(str(tmp_path / "log" / "batch=*" / "*.json")) if os.path.getsize(f))
    assert set(json.loads(line)) == {"ts", "request_id", "model_version", "threshold", "proba", "label", "features"}


def test_restart_from_checkpoint_is_exactly_once(spark, tmp_path):
    from stratocast.operators import rows as P
    from stratocast.plans import models as M
    from stratocast.sources.prediction_log import log_schema
    from stratocast.streaming.scoring import start_scoring
    from pyspark.sql import types as T

    schema = "x double, c string, Month int, label int, request_id string"
    src = tmp_path / "in"

    def batch(lo, hi):
        rows = [(float(i % 17), "a" if i % 3 else "b", 1 + i % 12, i % 2, f"r{i}") for i in range(lo, hi)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))

    batch(0, 100)
    model = M.train(spark.read.parquet(str(src)), ["x"], ["c"], "logreg", overrides={"maxIter": 5})
    feats = [("x", "double"), ("c", "string"), ("Month", "int")]

    def run():
        stream = spark.readStream.schema(schema).parquet(str(src)).withColumn("ts", F.current_timestamp())
        q = start_scoring(model, stream, feats, P.feature_record_rules("Month"), str(tmp_path / "log"),
                           str(tmp_path / "rej"), str(tmp_path / "ckpt"), 0.5, "1", trigger={"availableNow": True})
        q.awaitTermination(300)
        assert q.exception() is None

    run()
    batch(100, 150)                      # new files arrive while the job is down
    run()                                # restart from the same checkpoint
    run()                                # a restart without new input adds nothing
    fs = T.StructType([T.StructField("x", T.DoubleType())])
    ids = [r["request_id"] for r in spark.read.schema(log_schema(fs)).json(str(tmp_path / "log")).collect()]
    assert len(ids) == 150 and len(set(ids)) == 150


def test_json_stream_records_are_typed_and_checked(spark, tmp_path):
    from stratocast.operators import rows as P
    from stratocast.streaming.scoring import json_records_stream
    from pyspark.sql import types as T
    src = tmp_path / "json"
    src.mkdir()
    (src / "a.jsonl").write_text('{"x": 1.5, "Month": 3}\n{"x": "bad", "Month": 4}\n{"Month": 0}\n')
    schema = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("Month", T.IntegerType())])
    s = P.validate_records(json_records_stream(spark, str(src), schema),
                           P.feature_record_rules("Month", "type_errors")).select("x", "Month", "valid")
    out = read_output(spark, run_available(s, "t_json"), s.schema).orderBy("Month").collect()
    assert [(r["Month"], r["valid"]) for r in out] == [(0, False), (3, True), (4, False)]
