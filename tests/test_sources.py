import json
import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocast.sources.observations import OBSERVATION_SCHEMA, load_reference, read_observations
from stratocast.sources.prediction_log import (log_records, read_prediction_log, read_prediction_log_stream,
                                               write_prediction_log)
from stratocast.streaming.runner import read_output, run_available

FEATS = T.StructType([T.StructField("Humidity3pm", T.DoubleType()), T.StructField("Sunshine", T.DoubleType()),
                      T.StructField("Location", T.StringType())])


def _write(lines, name="log.jsonl"):
    d = tempfile.mkdtemp(prefix="stratocast-src-")
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    return d, p


def test_read_observations_tokens_and_bad_values(spark):
    header = ",".join(f.name for f in OBSERVATION_SCHEMA.fields)
    n = len(OBSERVATION_SCHEMA.fields)

    def line(date, loc, mintemp, target):
        vals = ["NA"] * n
        vals[0], vals[1], vals[2], vals[-1] = date, loc, mintemp, target
        return ",".join(vals)
    _, p = _write([header, line("2010-01-01", "Sydney", "12.5", "No"), line("2010-13-01", "Perth", "abc", "NA"),
                   line("bad", "NaN", "NaN", "Yes"), line("2010-01-03", "", "", "")], "w.csv")
    df = read_observations(spark, p).collect()
    assert len(df) == 4
    assert str(df[0]["Date"]) == "2010-01-01" and df[0]["MinTemp"] == 12.5
    assert df[1]["Date"] is None and df[1]["MinTemp"] is None and df[1]["RainTomorrow"] is None
    assert df[2]["Location"] is None and df[2]["MinTemp"] is None      # NaN text is missing, not NaN
    assert df[3]["Location"] is None and df[3]["RainTomorrow"] is None


def test_damaged_log_keeps_two_rows(spark):
    good = json.dumps({"ts": "2024-01-01T00:00:00+00:00", "request_id": "a", "proba": 0.5, "label": True,
                       "features": {"Humidity3pm": 70.0, "Location": "Sydney"}})
    d, _ = _write([good, good[:30], "", json.dumps({"request_id": "x"}), "[1, 2]", good])
    out = read_prediction_log(spark, d, FEATS).collect()
    assert len(out) == 2
    assert out[0]["Sunshine"] is None and out[0]["Location"] == "Sydney"


def test_missing_columns_and_missing_file(spark):
    d, _ = _write([json.dumps({"features": {"Humidity3pm": 50.0}})])
    out = read_prediction_log(spark, d, FEATS, ["Humidity3pm", "Sunshine", "Location"]).collect()
    assert out[0]["Humidity3pm"] == 50.0 and out[0]["Sunshine"] is None and out[0]["Location"] is None
    empty = read_prediction_log(spark, "/nonexistent/stratocast/log", FEATS, ["Sunshine", "Location"])
    assert empty.count() == 0 and empty.columns == ["Sunshine", "Location"]


def test_writer_layout_and_roundtrip(spark):
    scored = spark.createDataFrame([(70.0, 3.0, "Sydney", 0.71234567, True, "r1")],
                                   "Humidity3pm double, Sunshine double, Location string, proba double, "
                                   "decision boolean, request_id string")
    rec = log_records(scored.withColumn("threshold", F.lit(0.5)).withColumn("model_version", F.lit("3")),
                      ["Humidity3pm", "Sunshine", "Location"])
    d = tempfile.mkdtemp(prefix="stratocast-log-")
    write_prediction_log(rec, d)
    raw = spark.read.text(d).collect()
    keys = set(json.loads(raw[0]["value"]).keys())
    assert keys == {"ts", "request_id", "model_version", "threshold", "proba", "label", "features"}
    assert json.loads(raw[0]["value"])["proba"] == 0.712346
    back = read_prediction_log(spark, d, FEATS).collect()
    assert back[0]["Location"] == "Sydney"
    # the same folder read as a stream
    stream = read_prediction_log_stream(spark, d, FEATS)
    got = read_output(spark, run_available(stream, "logstream"), stream.schema).collect()
    assert len(got) == 1 and got[0]["Humidity3pm"] == 70.0


def test_load_reference_snapshot_or_sample(spark):
    pop = spark.range(1000).select(F.col("id"), (F.col("id") * 1.0).alias("Humidity3pm"),
                                   F.lit("Sydney").alias("Location"))
    ref = load_reference(spark, "/nonexistent/stratocast/ref", pop, n=100, key_cols=["id"])
    assert ref.count() == 100 and ref.columns == ["Humidity3pm", "Location"]
