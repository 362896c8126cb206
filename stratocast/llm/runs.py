"""Periodic runs of words: online square detection with dyadic catchers.

A run is a longest stretch of words in which words ``period`` apart are
identical (``period`` the smallest such number), at least ``max(shortest,
exponent * period)`` words long.

``Catchers`` reads a sequence as it is appended. For each power of two ``m``
every completed block of ``m`` words becomes a catcher of the periods ``m`` to
``2m - 1``: each appended word completes one suffix of ``m`` words per level,
and that suffix is compared, by fingerprint, with the one catcher that lies
``m`` to ``2m - 1`` words before it. Two successive catchers caught at the same
distance make a square (a stretch longer than twice the period); squares that
follow each other merge into a run, whose ends are found word by word. A run
of four periods always holds such a square, so none is missed. Squares inside
a known run whose period divides theirs are no new runs and are let go first,
which keeps the work at about ``n log n`` for any text. What fingerprints
suggest is confirmed on the words themselves.

Scale: one pass over the documents without a shuffle. Texts of a batch are
read one after another as one sequence with a word of its own between two
texts, so short texts cost no loop of their own; a group is bounded by
``GROUP`` words, only a longer single text exceeds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

SHORTEST, EXPONENT = 6, 4
GROUP = 1 << 19          # words read as one sequence
RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    return x ^ (x >> np.uint64(27))


class Catchers:
    """Runs of a sequence of word numbers that grows by ``append``.

    ``runs()`` gives ``(start, length, period)`` of all runs so far, by start,
    then period. ``longest`` bounds the length of a run where the caller knows
    one (the longest text of a group); it only saves work.
    """

    def __init__(self, shortest: int = SHORTEST, exponent: int = EXPONENT, longest: int | None = None):
        if exponent < 4:
            raise ValueError("a run of fewer than four periods may hold no pair of caught blocks")
        self.shortest, self.exponent, self.longest = shortest, exponent, longest
        self.words = np.empty(0, np.int64)
        self.levels: list[np.ndarray] = []      # fingerprints of m words by start, m = 1, 2, 4, ...
        self.squares: list[list[np.ndarray]] = []       # ends of the second catcher's match, by level

    def append(self, words: np.ndarray) -> None:
        self.words = np.concatenate([self.words, np.asarray(words, np.int64)])
        n, k = len(self.words), 0
        while self.exponent << k <= (n if self.longest is None else min(n, self.longest)):
            m = 1 << k
            if k == len(self.levels):
                self.levels.append(np.empty(0, np.uint64))
                self.squares.append([])
            old, below = len(self.levels[k]), self.levels[k - 1] if k else None
            if k == 0:
                new = _mix(self.words[old:].astype(np.uint64) + _A)
            else:
                half = m >> 1
                new = _mix(below[old:n - m + 1] * _C + below[old + half:n - m + 1 + half])
            mine = self.levels[k] = np.concatenate([self.levels[k], new])
            # the suffix that starts at t meets the catcher of the last whole block before it
            t = np.arange(max(old - m, m), len(mine))
            caught = np.zeros(0, bool)
            if len(t):
                caught = mine[t] == mine[(t // m - 1) * m]
            # the second of two successive catchers caught at one distance
            second = t[m:][caught[m:] & caught[:-m]]
            second = second[second >= old]
            if len(second):
                self.squares[k].append(second)
            k += 1

    def runs(self) -> list[tuple[int, int, int]]:
        found: list[tuple[int, int, int]] = []
        for k, parts in enumerate(self.squares):
            if parts:
                found += self._merge(1 << k, np.concatenate(parts), found)
        best: dict[tuple[int, int], int] = {}
        for s, e, q in found:               # a multiple of a period at the same place is none of its own
            best[s, e] = min(q, best.get((s, e), q))
        return sorted((s, e - s, q) for (s, e), q in best.items())

    def _merge(self, m: int, t: np.ndarray, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Runs ``(start, end, period)`` of the squares of one level."""
        block = (t // m - 1) * m
        q = t - block
        # a square reaches from the first catcher to the end of the second match
        a, z = block - m, t + m
        if known:
            # of the known runs with room for two blocks no two overlap that far
            wide = sorted(r for r in known if r[1] - r[0] >= 2 * m)
            if wide:
                s, e, p = (np.array(x, np.int64) for x in zip(*wide))
                at = np.searchsorted(s, a, "right") - 1
                inside = (at >= 0) & (e[at] >= z) & (q % p[at] == 0)
                t, q, a, z = t[~inside], q[~inside], a[~inside], z[~inside]
        if not len(t):
            return []
        # squares that follow each other, one block on at the same distance, are one stretch
        o = np.lexsort((a, q))
        q, a, z = q[o], a[o], z[o]
        first = np.ones(len(q), bool)
        first[1:] = (q[1:] != q[:-1]) | (a[1:] != a[:-1] + m)
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(q)) - 1
        out, w = {}, self.words
        for s, e, p in zip(a[at].tolist(), z[last].tolist(), q[at].tolist()):
            if not np.array_equal(w[s:e - p], w[s + p:e]):
                out.update({r: None for r in _stretches(w, s, e, p)})       # fingerprints that agree by chance
                continue
            out[(s - _back(w, s, p, s), e + _ahead(w, e, p), p)] = None
        return [r for r in out if r[1] - r[0] >= max(self.shortest, self.exponent * r[2])]


def _equal_ahead(x: np.ndarray, y: np.ndarray) -> int:
    """Number of leading places at which two arrays agree."""
    n, a, step = min(len(x), len(y)), 0, 16
    while a < n:
        b = min(n, a + step)
        bad = np.flatnonzero(x[a:b] != y[a:b])
        if len(bad):
            return a + int(bad[0])
        a, step = b, step * 4
    return n


def _ahead(w: np.ndarray, e: int, p: int) -> int:
    return _equal_ahead(w[e - p:], w[e:])


def _back(w: np.ndarray, s: int, p: int, room: int) -> int:
    return _equal_ahead(w[:s][::-1][:room], w[:s + p][::-1][:room])


def _stretches(w: np.ndarray, s: int, e: int, p: int) -> list[tuple[int, int, int]]:
    """Stretches of period ``p`` that touch ``s`` to ``e``, each to its ends."""
    same = np.concatenate([[False], w[s:e - p] == w[s + p:e], [False]])
    turns = np.flatnonzero(same[1:] != same[:-1])
    spans = [(s + int(x), s + int(y) + p) for x, y in zip(turns[::2], turns[1::2])]
    return [(x - _back(w, x, p, x), y + _ahead(w, y, p), p) for x, y in spans if y - x >= 2 * p]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Mask of the words that lie in no run, or only in runs' first periods."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def _groups(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    group, size = [], 0
    for t in texts:
        # bytes.split parts at blank, tab, line feed, vertical tab, form feed and carriage return only
        w = t.encode("utf-8", "surrogatepass").split() if t else []
        if group and size + len(w) > GROUP:
            yield group
            group, size = [], 0
        group.append(w)
        size += len(w) + 1
    if group:
        yield group


def _read(group: list[list[bytes]], shortest: int, exponent: int) -> Iterator[tuple[list, str]]:
    """Runs and the text without repeated periods, for each text of a group."""
    number: dict[bytes, int] = {}
    ids, starts, at = [], [], 0
    for i, w in enumerate(group):
        starts.append(at)
        ids.append(np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, len(w)))
        ids.append(np.array([-1 - i], np.int64))        # stands between two texts, equals nothing
        at += len(w) + 1
    catchers = Catchers(shortest, exponent, longest=max(map(len, group)))
    catchers.append(np.concatenate(ids))
    mine: list[list[tuple[int, int, int]]] = [[] for _ in group]
    found = catchers.runs()
    if found:
        owner = np.searchsorted(starts, [r[0] for r in found], "right") - 1
        for i, (s, length, q) in zip(owner.tolist(), found):
            mine[i].append((s - starts[i], length, q))
    for w, runs in zip(group, mine):
        if runs:
            keep = kept_words(len(w), runs)
            w = [x for x, k in zip(w, keep.tolist()) if k]
        yield runs, b" ".join(w).decode("utf-8", "surrogatepass")


def find_runs(documents: DataFrame, text: str = "text", shortest: int = SHORTEST, exponent: int = EXPONENT,
              names: tuple[str, str] = ("runs", "collapsed")) -> DataFrame:
    """Append to every row its ``runs`` (``start, length, period`` in words, by
    start, then period) and ``collapsed``: its words joined by one blank,
    without those that a run repeats after its first period.

    Words are separated by ASCII white space and compared as they are. A null
    or empty text has no runs and collapses to the empty string. All columns
    are kept, except that those with the new names are replaced; repeated rows
    stay separate.
    """
    documents = documents.drop(*names)
    schema = StructType([*documents.schema.fields, StructField(names[0], ArrayType(RUN)), StructField(names[1], StringType())])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs, left = [], []
            for group in _groups(b.column(text).to_pylist()):
                for r, c in _read(group, shortest, exponent):
                    runs.append([dict(zip(("start", "length", "period"), x)) for x in r])
                    left.append(c)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(runs, kind), pa.array(left, pa.string())], [*b.schema.names, *names])

    return documents.mapInArrow(run, schema)


def longest_run(runs: Column) -> Column:
    """The longest run as a struct (ties: smallest start, then period); null if none."""
    first = F.get(F.array_sort(F.transform(runs, lambda r: F.struct(
        (-r["length"]).alias("rank"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), F.lit(0))
    return first


def run_lines(runs: Column) -> Column:
    """Every run as a line ``start,length,period``."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                                         r["period"].cast("string")), F.lit("\n"))), "")


def repeat_tails(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with a rewritten ``text`` where the id's checksum says so.

    With ``h = crc32(id)``, ``g = h div 10``: if 10 divides ``h`` and the text
    has ``n > 0`` words, each word from number ``a = g mod n`` on repeats the
    first ``p = 1 + (n - a) div (3 + g mod 8)`` words from there. A null id
    changes nothing.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    w = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, g = F.size("_w").cast("long"), F.floor(F.col("_h") / 10)
    at = F.pmod(g, n)
    again = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("_w", F.when(
        i < F.col("_a"), i).otherwise(F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p"))).cast("int")))
    d = documents.withColumn("_h", h).withColumn("_w", F.when(F.col("_h") % 10 == 0, w))
    d = d.withColumn("_w", F.when(F.size("_w") > 0, F.col("_w"))).withColumn("_a", F.when(F.col("_w").isNotNull(), at))
    d = d.withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.pmod(g, F.lit(8)))))
    return d.withColumn(text, F.when(F.col("_w").isNull(), F.col(text)).otherwise(F.array_join(again, " "))).drop("_h", "_w", "_a", "_p")
