import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stratocast.operators import monitor as O
from stratocast.streaming.alerts import alert_states_stream, inhibit_alerts_stream, stale_series_stream

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def secs(ts):
    return (ts - T0).total_seconds()


class Feed:
    """A folder read as a stream: each call adds files, runs the query to their
    end and stops it, so every call after the first is a restart."""

    def __init__(self, spark, tmp_path, schema, build, delay="30 seconds"):
        self.spark, self.src, self.out, self.ckpt = spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
        self.schema, self.build, self.delay = schema, build, delay

    def __call__(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.src)
        stream = (self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.src)
                  .withWatermark("ts", self.delay))
        q = (self.build(stream).writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.ckpt)
             .trigger(availableNow=True).start())
        q.awaitTermination(300)
        assert q.exception() is None and not q.isActive
        return sorted((tuple(secs(v) if isinstance(v, dt.datetime) else v for v in r) for r in self.spark.read.parquet(self.out).collect()),
                      key=lambda r: [(v is not None, v) for v in r])


def test_alert_fires_while_open_and_survives_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path, "s string, ts timestamp, bad boolean",
                lambda d: alert_states_stream(d, F.col("bad"), 45, 15, ["s"]))
    rows = lambda s, *ts: [(s, at(t), True) for t in ts]      # noqa: E731
    # samples every 15 s; out of order inside one file and across files, within the delay
    got = feed(rows("a", 0, 30, 15) + [("b", at(0), False)], rows("a", 60, 45) + rows(None, 0, 15, 30, 45) + [("b", at(90), False)])
    assert got == [(None, "firing", 0.0, 45.0, 4), ("a", "firing", 0.0, 45.0, 4)]
    got = feed(rows("a", 75, 90), rows("a", 105) + [("b", at(180), None)])
    assert ("a", "firing", 0.0, 45.0, 4) in got and (None, "resolved", 0.0, 45.0, 4) in got
    assert ("a", "resolved", 0.0, 105.0, 8) in got and len(got) == 4
    assert feed([("b", at(181), True)]) == got


def test_alert_states_equal_the_batch_intervals(spark, tmp_path):
    rng = random.Random(3)
    rows = [(s, at(15 * i + rng.choice([0, 0, 3])), rng.random() < 0.8) for s in "abc" for i in range(120) if rng.random() < 0.95]
    schema = "s string, ts timestamp, bad boolean"
    batch = O.sustained_alerts(spark.createDataFrame(rows, schema), F.col("bad"), 60, 15, ["s"])
    want = {(r.s, secs(r.start), secs(r.end), r.n_samples) for r in batch.collect()}
    order = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.random() * 25))
    end = [("z", at(9999), False)]
    feed = Feed(spark, tmp_path, schema, lambda d: alert_states_stream(d, F.col("bad"), 60, 15, ["s"]))
    got = feed(*[order[i:i + 100] for i in range(0, len(order), 100)], end)
    assert {(s, a, b, n) for s, state, a, b, n in got if state == "resolved"} == want and len(want) > 5
    assert {(s, a, a + 60) for s, _, a, _, _ in got} == {(s, a, b) for s, state, a, b, _ in got if state == "firing"}


def test_stale_series_comes_and_goes(spark, tmp_path):
    feed = Feed(spark, tmp_path, "metric string, ts timestamp, value double",
                lambda d: stale_series_stream(d, 100, ["metric"], forget_seconds=1000))
    row = lambda m, *ts: [(m, at(t), 1.0) for t in ts]      # noqa: E731
    assert feed(row("a", 0, 90), row("b", 100), row("b", 200)) == []
    # the watermark is 270: nothing came from a since 90
    assert feed(row("b", 300)) == [("a", "stale", 90.0, 190.0)]
    gone = {("a", "stale", 90.0, 190.0), ("a", "back", 90.0, 300.0)}
    assert set(feed(row("a", 300), row("b", 390))) == gone
    gone |= {("a", "stale", 300.0, 400.0), ("b", "stale", 390.0, 490.0)}
    assert set(feed(row("c", 900))) == gone
    # a and b were last seen over 1000 s ago and are forgotten: their return is a new series
    feed(row("c", 2000))
    assert {r for r in feed(row("a", 2100), row("b", 2150)) if r[0] != "c"} == gone


def test_stale_needs_sense():
    with pytest.raises(ValueError):
        stale_series_stream(None, 100, forget_seconds=50)


ALERTS = "alert_id string, alertname string, severity string, job string, ends boolean, ts timestamp"


def test_inhibition_equals_the_batch(spark, tmp_path):
    rng = random.Random(9)
    alerts = []
    for i in range(60):
        s = rng.randrange(0, 600)
        alerts.append((f"x{i}", rng.choice(["Down", "Slow", "Errors"]), rng.choice(["critical", "warning", "info"]), rng.choice(["a", "b", None]),
                       at(s), at(s + rng.randrange(1, 25))))
    batch = O.inhibit_alerts(spark.createDataFrame(alerts, 'alert_id string, alertname string, severity string, job string, start timestamp, "end" timestamp'
                                                   .replace('"', "`")), "Down")
    kept = {r.alert_id for r in batch.collect()}
    events = [(i, n, v, j, False, s) for i, n, v, j, s, e in alerts] + [(i, n, v, j, True, e) for i, n, v, j, s, e in alerts]
    events.sort(key=lambda r: r[5] + dt.timedelta(seconds=rng.random() * 20))
    feed = Feed(spark, tmp_path, ALERTS, lambda d: inhibit_alerts_stream(d, "Down"))
    got = feed(*[events[i:i + 30] for i in range(0, len(events), 30)], [("z", "Slow", "warning", "z", False, at(9999))])
    targets = {i for i, n, v, j, _, _ in alerts if n != "Down" and v != "info" and j is not None}
    assert {r[1] for r in got if r[2] == "resolved"} == targets & kept
    assert {r[1] for r in got if r[2] == "inhibited"} == targets - kept and len(targets - kept) > 2
    told, muted = {r[1] for r in got if r[2] == "notify"}, {r[1] for r in got if r[2] == "mute"}
    assert (targets & kept) <= told | {"z"} and muted <= told and muted <= targets - kept
