"""Alert states, silent series and inhibition on a stream (O7, O8, O10).

Each operator is a keyed state machine (``transformWithStateInPandas``) that
sees the rows of a key in event-time order: rows wait in the state store until
the watermark has passed them, and an event-time timer wakes the key when a
waiting row or a deadline falls due. So an alert is reported while it still
fires, a series is reported because it sends nothing, and the output does not
depend on how the input was cut into micro-batches.

State per key: the rows of one watermark delay and a few numbers. A key's rows
are handled in order by one task, which is inherent in a state machine; its
input here is one row per sample or alert, never raw requests. State lives in
RocksDB under the query's checkpoint and survives restarts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Hands on each key's rows in event-time order as the watermark passes.

    A subclass names its row fields after ``at`` (microseconds) in ``fields``
    and its own state in ``memory``, and implements ``take`` (one row) and
    ``wake`` (the watermark has come this far; returns the next deadline).
    """

    fields = ""
    memory = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint" + (", " + self.fields if self.fields else ""))
        self.state = handle.getValueState("state", self.memory)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            if not len(part):           # an empty part has no columns either
                continue
            part = part[self.columns()].dropna(subset=["at_us"])
            if not len(part):
                continue
            values = [(int(v[0]), *v[1:]) for v in part.itertuples(index=False, name=None)]
            self.waiting.appendList(values)
            low = min(v[0] for v in values)
            first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()]
        due = sorted(r for r in rows if r[0] <= now)
        later = [r for r in rows if r[0] > now]
        out: list[tuple] = []
        state = _plain(self.state.get()) if self.state.exists() else None
        for r in due:
            state, _ = self.wake(state, r[0], out)      # a deadline that this row missed comes first
            state = self.take(state, r, out)
        state, deadline = self.wake(state, now, out)
        if due:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
        times = [r[0] for r in later] + ([deadline] if deadline is not None else [])
        if times:
            self.handle.registerTimer(max(-(-min(times) // 1000), now // 1000 + 1))
        if out:
            yield pd.DataFrame([(*key, *o) for o in out], columns=self.names)

    def columns(self) -> list[str]:
        return ["at_us"] + [f.split()[0] for f in self.fields.split(", ") if f]

    def take(self, state, row: tuple, out: list):
        raise NotImplementedError

    def wake(self, state, now: int, out: list):
        raise NotImplementedError

    def close(self) -> None:
        pass


def _plain(v: Any) -> Any:
    """Rows within a state as plain tuples, which can be stored again."""
    if isinstance(v, tuple):
        return tuple(_plain(x) for x in v)
    return [_plain(x) for x in v] if isinstance(v, list) else v


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _stamp(c: str) -> Column:
    return F.timestamp_micros(F.col(c)).alias(c)


def _run(stream: DataFrame, keys: Sequence[str], processor: InOrder, out: str, only: Column, ts: str = "ts") -> DataFrame:
    """Rows of ``stream`` (watermarked) for which ``only`` holds through a state
    machine per ``keys``. The others are left out behind the watermark, not by a
    filter: Spark would push that below it, and time would stand still while
    nothing is wrong."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # one text per label set: a null label is a value like any other
    labels = T.StructType([T.StructField(k, stream.schema[k].dataType) for k in keys])
    series = F.to_json(F.struct(*[F.col(k) for k in keys])) if keys else F.lit("{}")
    rows = stream.where(F.col(ts).isNotNull()).select(series.alias("series"), F.col(ts).alias("ts"), F.when(only, _micros(ts)).alias("at_us"),
                                                      *processor.columns()[1:])
    schema = T.StructType([T.StructField("series", T.StringType()), *T._parse_datatype_string(out).fields])
    processor.names = schema.names
    got = rows.groupBy("series").transformWithStateInPandas(processor, schema, "Append", "EventTime")
    if keys:
        got = got.withColumn("series", F.from_json("series", labels))
    return got.select(*[F.col("series").getField(k).alias(k) for k in keys], *schema.names[1:])


# O7 -------------------------------------------------------------------------
class _Alerts(InOrder):
    memory = "start bigint, last bigint, n bigint, fired boolean"

    def __init__(self, hold: int, step: int):
        self.hold, self.step = hold, step

    def take(self, state, row, out):
        at = row[0]
        if state is None:
            state = (at, at, 1, False)
        elif at // self.step > state[1] // self.step:       # a sample of its own
            state = (state[0], at, state[2] + 1, state[3])
        start, last, n, fired = state
        if not fired and last - start >= self.hold:
            out.append(("firing", start, start + self.hold, n))
            fired = True
        return start, last, n, fired

    def wake(self, state, now, out):
        if state is None:
            return None, None
        start, last, n, fired = state
        over = (last // self.step + 2) * self.step          # the next sample is due before
        if now < over:
            return state, over
        if fired:
            out.append(("resolved", start, last, n))
        return None, None


def alert_states_stream(samples: DataFrame, predicate: Column, hold_seconds: float, step_seconds: float,
                        series_cols: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """O7 on a watermarked stream: ``series..., state, start, at, n_samples``.

    A series is pending from its first true sample; it is reported as
    ``firing`` (``at`` = start + hold) as soon as the predicate has held for
    ``hold_seconds`` at every sample, and as ``resolved`` (``at`` = the last true
    sample) once a false or missing sample ended it. Samples lie on a grid of
    ``step_seconds``; the intervals are those of
    :func:`stratocast.operators.monitor.sustained_alerts`. A null predicate is
    false; rows without a time are left out; a null label is a series.
    """
    out = _run(samples, series_cols, _Alerts(int(hold_seconds * 1e6), int(step_seconds * 1e6)),
               "state string, start bigint, at bigint, n_samples bigint", predicate, ts)
    return out.select(*series_cols, "state", _stamp("start"), _stamp("at"), "n_samples")


# O8 -------------------------------------------------------------------------
class _Silence(InOrder):
    memory = "last bigint, silent boolean"

    def __init__(self, max_age: int, forget: int | None):
        self.max_age, self.forget = max_age, forget

    def take(self, state, row, out):
        if state is not None and state[1]:
            out.append(("back", state[0], row[0]))
        return row[0], False

    def wake(self, state, now, out):
        if state is None:
            return None, None
        last, silent = state
        if not silent:
            if now <= last + self.max_age:
                return state, last + self.max_age + 1
            out.append(("stale", last, last + self.max_age))
        if self.forget is None:
            return (last, True), None
        gone = last + self.forget
        return (None, None) if now >= gone else ((last, True), gone)


def stale_series_stream(gauges: DataFrame, max_age_seconds: float = 172800.0, series_cols: Sequence[str] = ("metric",),
                        ts: str = "ts", forget_seconds: float | None = None) -> DataFrame:
    """O8 on a watermarked stream: ``series..., state, last_ts, at``.

    A series without a sample for more than ``max_age_seconds`` is reported as
    ``stale`` (``at`` = when it became so) although no row arrives, and
    withdrawn as ``back`` (``at`` = the new sample). With ``forget_seconds`` the
    state of a series silent that long is dropped; its return is then a new
    series. Rows without a time are left out; a null label is a series.
    """
    if forget_seconds is not None and forget_seconds <= max_age_seconds:
        raise ValueError("a series must become stale before it is forgotten")
    forget = None if forget_seconds is None else int(forget_seconds * 1e6)
    out = _run(gauges, series_cols, _Silence(int(max_age_seconds * 1e6), forget), "state string, last_ts bigint, at bigint", F.lit(True), ts)
    return out.select(*series_cols, "state", _stamp("last_ts"), _stamp("at"))


# O10 ------------------------------------------------------------------------
class _Inhibition(InOrder):
    # at one moment begins come before ends and sources before targets, so that intervals hold both their ends
    fields = "ends boolean, is_target boolean, alert_id string"
    memory = "sources array<string>, targets array<struct<id:string,start:bigint,hit:boolean>>"

    def take(self, state, row, out):
        at, ends, is_target, alert_id = row
        sources, targets = state if state is not None else ([], [])
        if not is_target:
            sources = [s for s in sources if s != alert_id] + ([] if ends else [alert_id])
            if not ends:
                out += [(t, "mute", s, at) for t, s, hit in targets if not hit]
                targets = [(t, s, True) for t, s, _ in targets]
        elif not ends:
            if not sources:
                out.append((alert_id, "notify", at, at))
            targets.append((alert_id, at, bool(sources)))
        else:
            out += [(t, "inhibited" if hit else "resolved", s, at) for t, s, hit in targets if t == alert_id]
            targets = [t for t in targets if t[0] != alert_id]
        return (sources, targets) if sources or targets else None

    def wake(self, state, now, out):
        return state, None


def inhibit_alerts_stream(events: DataFrame, source: str, target_severities: Sequence[str] = ("critical", "warning"),
                          equal: Sequence[str] = ("job",), ts: str = "ts") -> DataFrame:
    """O10 on a watermarked stream: ``equal..., alert_id, action, start, at``.

    ``events``: one row when an alert begins (``ends`` false) and one when it
    ends, with ``alert_id, alertname, severity, equal..., ends`` and ``ts``. A
    target is told of (``notify``) when it begins while no source alert of its
    labels fires; ``mute`` withdraws it when a source begins during it. At its
    end it is ``resolved``, or ``inhibited`` if a source fired at any time
    during it (ends included): the kept alerts are those that
    :func:`stratocast.operators.monitor.inhibit_alerts` keeps. Labels must not
    be null; other severities are no targets.
    """
    only = (F.col("alertname") == source) | F.col("severity").isin(list(target_severities))
    for c in equal:
        only = only & F.col(c).isNotNull()
    rows = events.withColumn("is_target", F.col("alertname") != source).withColumn("alert_id", F.col("alert_id").cast("string"))
    out = _run(rows, equal, _Inhibition(), "alert_id string, action string, start bigint, at bigint", only, ts)
    return out.select(*equal, "alert_id", "action", _stamp("start"), _stamp("at"))
