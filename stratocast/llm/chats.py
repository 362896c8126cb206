"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: ``open`` (a message begins: role),
``delta`` (a streamed part), ``edit`` (the whole text anew) and ``regenerate``
(the message starts over). Events carry ``conv_id, msg, seq``; a message's
final text is what its last edit or regeneration leaves plus the deltas after
it. Final messages are rendered turn by turn in a chat template; control
strings inside texts are escaped reversibly, and assistant texts carry the
loss mask.

Scale: the fold is keyed by message, not by conversation, so a conversation
with a third of all events is spread over its messages; superseded events are
dropped before anything is gathered. Only the digest of a conversation needs
its turns in order: it reads them as a sorted stream and keeps no text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
DELTA = 200                 # code points in a streamed part, where a log is made from messages


def events_of(messages: DataFrame, size: int = DELTA) -> DataFrame:
    """The event log that streams ``conv_id, turn, role, text``: an ``open``
    and ``delta`` events of ``size`` code points for each row.

    Rows that repeat a turn follow each other by role and text and become
    messages of their own; a null text is empty, a null role stays null.
    """
    t = F.coalesce("text", F.lit(""))
    # rows of one turn that differ are told apart by a digest, equal rows by their number
    rows = (messages.groupBy("conv_id", "turn", "role", t.alias("text")).agg(F.count(F.lit(1)).alias("copies"))
            .select("conv_id", "turn", "role", "text", F.posexplode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy", "_")))
    msg = F.struct("turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "copy")
    parts = F.when(F.length("text") > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int")),
        lambda i: F.struct(F.lit("delta").alias("kind"), F.substring("text", i * size + 1, F.lit(size)).alias("text"))))
    opened = F.array(F.struct(F.lit("open").alias("kind"), F.lit(None).cast("string").alias("text")))
    events = F.concat(opened, F.coalesce(parts, F.array().cast("array<struct<kind:string,text:string>>")))
    return rows.withColumn("msg", msg).withColumn("events", events).select(
        "conv_id", "msg", F.col("role").alias("role"), F.posexplode("events").alias("seq", "event")).select(
        "conv_id", "msg", "seq", "event.kind", F.when(F.col("event.kind") == "open", F.col("role")).alias("role"), "event.text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, msg, role, text`` of a log with columns
    ``conv_id, msg, seq, kind, role, text``.

    ``seq`` orders a message's events (an event repeated by a retry counts
    once). Events of a message that was never opened still form a message
    with a null role; null texts are empty.
    """
    once = events.select("conv_id", "msg", "seq", "kind", "role", "text").distinct()
    start = F.max(F.when(F.col("kind").isin("edit", "regenerate", "open"), F.col("seq")))
    last = once.groupBy("conv_id", "msg").agg(start.alias("from"), F.max_by("role", F.when(F.col("kind") == "open", F.col("seq"))).alias("author"))
    key = [once["conv_id"].eqNullSafe(last["conv_id"]), once["msg"].eqNullSafe(last["msg"])]
    live = (once.join(last, key).drop(last["conv_id"]).drop(last["msg"])
            .where(F.col("from").isNull() | (F.col("seq") >= F.col("from"))))
    text = F.when(F.col("kind").isin("delta", "edit"), F.coalesce("text", F.lit("")))
    parts = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("seq", text.alias("text")))))
    return live.groupBy("conv_id", "msg").agg(
        F.first("author").alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def escape(text: Column) -> Column:
    r"""Make ``<|`` impossible: a backslash goes before the bar of ``<``,
    backslashes, bar."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(messages: DataFrame) -> DataFrame:
    """One row per turn: ``conv_id, msg, segment`` (the formatted turn) and
    ``loss_start, loss_end`` (code points of the segment under the loss mask;
    null for other roles). Segments in the order of ``msg`` make up the
    conversation. Line ends and backslashes in roles are escaped, too."""
    role = F.replace(F.replace(F.coalesce("role", F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), escape(role), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    mine = F.col("role") == "assistant"
    return messages.select(
        "conv_id", "msg", F.concat(head, body, F.lit(END + "\n")).alias("segment"),
        F.when(mine, F.length(head)).alias("loss_start"), F.when(mine, F.length(head) + F.length(body)).alias("loss_end"))


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    head, body = segment.removeprefix(START).removesuffix(END + "\n").split("\n", 1)
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head))
    return role, unescape(body)


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, from the formatted turns alone: ``conv_id, n_turns,
    turns_sha256`` (of role, line end, text, line end), ``loss_chars,
    loss_sha256`` (all text under the mask, unescaped) and ``formatted_chars``."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows = segments.repartition("conv_id").sortWithinPartitions("conv_id", "msg").select("conv_id", "segment", "loss_start", "loss_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, id_type = None, None, pa.null()

        def result(out: list[list]) -> None:
            if state:
                for c, v in zip(out, (conv, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"])):
                    c.append(v)

        def batch(out: list[list]) -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

        for b in batches:
            id_type, out = b.schema.field("conv_id").type, [[] for _ in names]
            for c, s, a, z in zip(*(b.column(i).to_pylist() for i in range(4))):
                if state is None or c != conv:
                    result(out)
                    conv, state = c, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
                role, text = parse(s)
                state["n"] += 1
                state["all"] += len(s)
                state["turns"].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    masked = unescape(s[a:z])
                    state["chars"] += len(masked)
                    state["loss"].update(masked.encode())
            yield batch(out)
        if state:
            out = [[] for _ in names]
            result(out)
            yield batch(out)

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
