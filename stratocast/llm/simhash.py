"""SimHash near-dedup with BK-trees.

A text's fingerprint has 64 bits; a bit is set if it is set in over half of
the hashes of its word shingles. Two fingerprints are linked when at most
``radius`` bits differ; documents of linked fingerprints form components.

The search runs over distinct fingerprints (copies share one). Fingerprints
are dealt to shards by every choice of ``BLOCKS - radius`` out of ``BLOCKS``
bit blocks: two fingerprints with at most ``radius`` differing bits agree on
at least that many blocks, so they meet in a shard. In each shard a BK-tree
(children keyed by their integer Hamming distance to the parent) answers each
member's query, following only edges within the radius. A shard's members
agree on all but ``radius`` blocks (21 or 22 bits for radius 2), which bounds
its size whatever the data; nearly all shards hold one fingerprint and need no
tree. Trees live in the tasks that hold the shards: broadcasting them would
pass the fingerprints of all documents through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocast.llm.components import connected_components
from stratocast.session import ensure_checkpoint_dir

SHINGLE, RADIUS = 3, 2
BLOCKS = 6
CHUNK = 1 << 16          # shingle hashes expanded to bits at a time


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text (no words or null: 0)."""
    # bytes.lower and bytes.split treat ASCII letters and ASCII white space only
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, np.int64)
    for a in range(0, n, CHUNK):
        h = np.fromiter((digest(join(words[i:i + shingle]), 42) for i in range(a, min(n, a + CHUNK))), np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, key, fp`` for every row: a hash of the text and its fingerprint
    (signed 64-bit), from the whole text."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(fps.view(np.int64))], ["doc_id", "key", "fp"])

    return documents.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key bigint, fp bigint")


class BKTree:
    """Hamming-distance BK-tree over integers."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near_then_add(self, x: int, radius: int) -> list[int]:
        """Positions of earlier values within ``radius`` of ``x``; then add ``x``."""
        found: list[int] = []
        if self.values:
            todo = [0]
            values, children = self.values, self.children
            while todo:
                i = todo.pop()
                d = (values[i] ^ x).bit_count()
                if d <= radius:
                    found.append(i)
                kids = children[i]
                for e in range(d - radius, d + radius + 1):
                    k = kids.get(e)
                    if k is not None:
                        todo.append(k)
            at = 0
            while True:
                d = (values[at] ^ x).bit_count()
                nxt = children[at].get(d)
                if nxt is None:
                    children[at][d] = len(values)
                    break
                at = nxt
        self.values.append(x)
        self.children.append({})
        return found


def _shard_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect everything within ``radius`` in one shard: a spanning
    forest of them (at most one fewer than the values)."""
    tree, parent, out = BKTree(), [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, x in enumerate(values.tolist()):
        parent.append(i)
        for j in tree.near_then_add(x, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((j, i))
    return out


def _shards(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``shard, key, fp``: each distinct fingerprint once for each choice of blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        m = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        masks.append(m - (1 << 64) if m >> 63 else m)
    keys = F.array(*[F.struct(F.lit(i).alias("shard"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("key"))
                     for i, m in enumerate(masks)])
    return fps.select("fp", F.inline(keys)).select("shard", "key", "fp")


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``a, b``: links between the distinct fingerprints of column ``fp`` that
    connect whatever differs in at most ``radius`` bits. Nulls are ignored."""
    if blocks <= radius:
        raise ValueError("blocks must exceed radius")
    dealt = _shards(fps.select("fp").where("fp IS NOT NULL").distinct(), radius, blocks)
    dealt = dealt.repartition("shard", "key").sortWithinPartitions("shard", "key", "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def emit(groups):
            for v in groups:
                got = _shard_links(v, radius)
                if got:
                    at = np.array(got)
                    signed = v.view(np.int64)
                    yield pd.DataFrame({"a": signed[at[:, 0]], "b": signed[at[:, 1]]})

        open_key, open_values = None, []
        for b in batches:
            if not len(b):
                continue
            s, k, f = b["shard"].to_numpy(), b["key"].to_numpy(), b["fp"].to_numpy(np.int64).view(np.uint64)
            cut = np.flatnonzero((s[1:] != s[:-1]) | (k[1:] != k[:-1])) + 1
            starts = np.concatenate([[0], cut, [len(b)]])
            done = []
            if open_key != (s[0], k[0]):
                done.append(open_values)
                open_values = []
            for g in np.flatnonzero(np.diff(starts) > 1).tolist() if len(starts) > 2 else []:
                if 0 < g < len(starts) - 2:      # first and last groups may continue elsewhere
                    done.append([f[starts[g]:starts[g + 1]]])
            open_values.append(f[:starts[1]])
            if len(starts) > 2:
                done.append(open_values)
                open_values = [f[starts[-2]:]]
            open_key = (s[-1], k[-1])
            yield from emit(np.concatenate(v) for v in done if sum(map(len, v)) > 1)
        if sum(map(len, open_values)) > 1:
            yield from emit([np.concatenate(open_values)])

    return dealt.mapInPandas(run, "a bigint, b bigint").distinct()


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id`` (the smallest
    ``doc_id`` reachable over links), ``key`` (a hash of the text) and
    ``group_fp`` (the component's smallest fingerprint) for every row.

    Null and empty texts have fingerprint zero and are linked like any other.
    Rows that repeat a ``doc_id`` stay separate rows; null ids never become a
    component's id unless it has no other. Extra columns are ignored.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    docs = fingerprints(documents, shingle).checkpoint()          # texts are hashed once
    per_fp = docs.groupBy("fp").agg(F.min("doc_id").alias("low")).checkpoint()
    comp = connected_components(links(per_fp, radius))
    roots = per_fp.join(comp, per_fp["fp"] == comp["node"]).select("fp", "low", "root")
    lows = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = roots.join(lows, "root").select("fp", "component_id", "root")
    names = per_fp.join(linked, "fp", "left").select(
        "fp", F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("root", "fp").alias("group_fp"))
    return docs.join(names, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "key", "group_fp")
