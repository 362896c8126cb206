"""Document fingerprints from closed syncmers.

A ``K``-character substring is a closed syncmer if the smallest hash among its
``S``-character substrings lies at its first or last position. The choice
depends on the substring alone, so the same passage gives the same anchors in
any text. A fingerprint holds all distinct anchors of the whole text, each
with its first position; two fingerprints are alike in the share of anchors
that match in the same order.

Scale: fingerprints take one pass without a shuffle; their size grows with the
text (about 2 anchors in 13 characters, some 7 characters for each). Comparing each document with its neighbour in id order shuffles every text
once, into ranges of ids; a range also receives the one document that follows
it, and is then read as a stream.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, S = 16, 4
SLICE = 1 << 20             # code points hashed at a time
BATCH = 1 << 24             # characters of fingerprints given out at a time

Print = tuple[np.ndarray, np.ndarray]       # hashes in ascending order, positions
_NONE = (np.zeros(0, np.uint32), np.zeros(0, np.uint32))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _syncmers(cp: np.ndarray) -> Print:
    """32-bit hashes and positions of the closed syncmers of code points."""
    m = len(cp) - S + 1
    h = np.zeros(m, np.uint64)
    for j in range(S):
        h = h * np.uint64(0x100000001B3) + cp[j:j + m]
    h = _mix(h)
    w = K - S + 1
    low, have = h, 1
    while have < w:
        step = min(have, w - have)
        low, have = np.minimum(low[:-step], low[step:]), have + step
    at = np.flatnonzero((h[:len(low)] == low) | (h[w - 1:] == low))
    key = np.zeros(len(at), np.uint64)
    for j in range(0, K, S):
        key = key * np.uint64(0xD6E8FEB86659FD93) + h[at + j]
    return (_mix(key) >> np.uint64(32)).astype(np.uint32), at


def fingerprint_of(text: str | None) -> Print:
    """Anchors of a whole text. A text without a syncmer (shorter than ``K``,
    mostly) has one anchor, its own hash; an empty or null text has none."""
    if not text:
        return _NONE
    parts = []
    for a in range(0, max(1, len(text) - K + 1), SLICE):
        cp = np.frombuffer(text[a:a + SLICE + K - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(cp) >= K:
            h, at = _syncmers(cp)
            parts.append((h, (at + a).astype(np.uint32)))
    if any(len(h) for h, _ in parts):
        hashes, first = np.unique(np.concatenate([h for h, _ in parts]), return_index=True)
        return hashes, np.concatenate([at for _, at in parts])[first]
    digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
    return np.frombuffer(digest[:4], ">u4").astype(np.uint32), np.zeros(1, np.uint32)


def to_text(p: Print) -> str:
    """Base64 of the number of anchors, their hashes by position (4 bytes
    each) and the steps from position to position (7 bits in a byte, the
    lowest first, the top bit set if more follow); empty without anchors."""
    if not len(p[0]):
        return ""
    order = np.argsort(p[1], kind="stable")
    steps = np.diff(p[1][order].astype(np.int64), prepend=0)
    size = 1 + sum((steps >= 1 << b).astype(np.int64) for b in (7, 14, 21, 28))
    start = np.cumsum(size) - size
    coded = np.zeros(int(size.sum()), np.uint8)
    for j in range(int(size.max())):
        has = size > j
        coded[start[has] + j] = steps[has] >> 7 * j & 127 | (size[has] > j + 1) << 7
    return base64.b64encode(np.concatenate([[len(order)], p[0][order]]).astype(">u4").tobytes() + coded.tobytes()).decode()


def from_text(s: str) -> Print:
    raw = base64.b64decode(s)
    if not raw:
        return _NONE
    n = int.from_bytes(raw[:4], "big")
    hashes = np.frombuffer(raw, ">u4", n, 4).astype(np.uint32)
    coded = np.frombuffer(raw, np.uint8, offset=4 + 4 * n).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], coded[:-1] < 128]))
    at = np.arange(len(coded)) - np.repeat(start, np.diff(start, append=len(coded)))
    order = np.argsort(hashes)
    return hashes[order], np.cumsum(np.add.reduceat((coded & 127) << 7 * at, start))[order].astype(np.uint32)


def likeness(a: Print, b: Print) -> float:
    """Share (0 to 1) of the two texts' anchors that occur in both in the same
    order."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    union = len(a[0]) + len(b[0]) - len(shared)
    order = np.argsort(a[1][i], kind="stable")
    row = b[1][j][order]
    n = len(row) if (row[1:] > row[:-1]).all() else _longest_rise(row.tolist())
    same = n / union
    return 2 * same / (1 + same)


def _longest_rise(values: list[int]) -> int:
    tails: list[int] = []
    for v in values:
        i = bisect_left(tails, v)
        tails[i:i + 1] = [v]
    return len(tails)


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` for every row; equal texts have equal ones."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [to_text(fingerprint_of(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.string())], ["doc_id", "fingerprint"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """1 + how many of the sorted bounds lie below an id; 0 for a null id.
    Two levels, so that a row meets about twice the root of their number."""
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)] or [[]]
    longs = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs]).cast("array<bigint>")       # noqa: E731
    below = lambda xs: F.size(F.filter(xs, lambda x: x < doc_id))       # noqa: E731
    whole = F.greatest(below(longs([g[-1] for g in groups[:-1]])), F.lit(0))
    return F.when(doc_id.isNull(), F.lit(0)).otherwise(
        1 + whole * step + below(F.get(F.array(*[longs(g) for g in groups]), whole)))


def in_ranges(documents: DataFrame, ranges: int) -> DataFrame:
    """Deal ``doc_id, text`` to partitions by descending id and sort them.

    Columns ``_range`` and ``_extra``: each range ends with a copy (extra) of
    the document that follows its last one; after the smallest id comes the
    largest. Equal ids follow each other by text; null ids come last.
    """
    docs = documents.select("doc_id", "text")
    cut = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges).alias("cut")).first()["cut"]
    bounds = sorted(set(cut or []))
    dealt = docs.withColumn("_range", _range_of(F.col("doc_id"), bounds))
    tops = {r["_range"]: r["top"] for r in dealt.groupBy("_range").agg(F.max("doc_id").alias("top")).collect()}     # a row per range
    used = sorted(tops)
    # the first document of each range also goes to the end of the range before it in the order
    goes = {r: used[(i + 1) % len(used)] for i, r in enumerate(used)}
    n = len(bounds) + 2
    top = F.get(F.array(*[F.lit(tops.get(i)).cast("bigint") for i in range(n)]), F.col("_range"))
    to = F.get(F.array(*[F.lit(goes.get(i, 0)) for i in range(n)]), F.col("_range"))
    here = F.struct(F.col("_range").alias("_range"), F.lit(False).alias("_extra"))
    also = F.when(F.col("doc_id").eqNullSafe(top), F.array(here, F.struct(to.alias("_range"), F.lit(True).alias("_extra")))).otherwise(F.array(here))
    rows = dealt.withColumn("_to", also).select("doc_id", "text", F.inline("_to"))
    return rows.repartitionById(n, F.col("_range")).sortWithinPartitions("_range", "_extra", F.desc_nulls_last("doc_id"), "text")


def with_next(documents: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of an edited text (its last third
    replaced by the start of the next document in descending id order), and
    their likeness; see :func:`in_ranges` for the order.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. A null text is empty; a single document is its
    own next; an empty table gives no rows. ``doc_id`` must be a whole number.
    """
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None                     # the document that waits for its next
        for b in batches:
            out: list[list] = [[] for _ in names]
            size = 0
            types = [b.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            for doc_id, text, extra, rng in zip(*(b.column(c) for c in ("doc_id", "text", "_extra", "_range"))):
                extra = extra.as_py()
                if extra and last is None:
                    continue            # a further copy of the same id
                text = text.as_py() or ""
                mine = fingerprint_of(text)
                if last is not None:
                    prev_id, prev, prev_print = last
                    n = len(prev) // 3
                    edited = prev[:len(prev) - n] + text[:n]
                    e = prev_print if edited == prev else fingerprint_of(edited)
                    row = (prev_id, len(prev), hashlib.sha256(edited.encode("utf-8")).hexdigest(), to_text(prev_print), to_text(e),
                           likeness(prev_print, e), likeness(prev_print, mine))
                    for c, v in zip(out, row):
                        c.append(v)
                    size += len(row[3]) + len(row[4])
                    if size >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
                        out, size = [[] for _ in names], 0
                last = None if extra else (doc_id.as_py(), text, mine)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    rows = in_ranges(documents, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.mapInArrow(run, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
                                "edited_fingerprint string, near_edited double, near_next double")
