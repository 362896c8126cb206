"""Hierarchical multi-length packing.

Each partition packs its documents in groups of bounded size. Full windows of
the largest size are cut off first; every remainder is routed to the smallest
context size that holds it. Longest first, a remainder opens a window of its
tier and the gap is filled from shorter ones: whole documents that fit best,
then a piece of the shortest. What is left at a group's end is cut into powers
of two, so no window needs padding. Windows are then dealt, longest first, to
step groups of equal token counts.

Scale: one map-only pass; a task holds one group of documents at a time. Ids
derive from the partition's number, so a retried task gives the same rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from stratocast.llm.tokens import chunk_tokenizer

TIERS = (512, 1024, 2048, 4096)
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
GROUP_TOKENS = 4 << 20
STEP_WINDOWS = 8            # a step group holds as many tokens as 8 of the longest windows

Piece = tuple[int, int, int]            # document in the group, start, length


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """Windows ``(size, pieces)`` that hold every token of documents of these
    lengths exactly once. Every window is full; sizes are tiers, and smaller
    powers of two for what is left over."""
    top, windows, short = tiers[-1], [], []
    for doc, n in enumerate(lengths):
        full = n // top
        windows += [(top, [(doc, i * top, top)]) for i in range(full)]
        if n % top:
            short.append((n % top, doc, full * top))
    short.sort()
    while short:
        n, doc, start = short.pop()
        size = tiers[bisect_right(tiers, n - 1)]
        pieces, gap = [(doc, start, n)], size - n
        while gap and short:
            i = bisect_right(short, gap, key=lambda x: x[0]) - 1
            if i >= 0:
                n, doc, start = short.pop(i)
                pieces.append((doc, start, n))
            else:
                m, doc, start = short.pop(0)
                n = gap
                pieces.append((doc, start, n))
                insort(short, (m - n, doc, start + n))
            gap -= n
        windows += [(size, pieces)] if not gap else _powers(pieces, size - gap)
    windows.sort(key=lambda w: -w[0])
    return windows


def _powers(pieces: list[Piece], total: int) -> list[tuple[int, list[Piece]]]:
    """Cut the last, unfilled window into windows of powers of two."""
    out, left = [], list(pieces)
    for bit in reversed(range(total.bit_length())):
        size = 1 << bit
        if total & size:
            need, mine = size, []
            while need:
                doc, start, n = left.pop(0)
                take = min(n, need)
                mine.append((doc, start, take))
                need -= take
                if n > take:
                    left.insert(0, (doc, start + take, n - take))
            out.append((size, mine))
    return out


def pack(documents: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, tiers: tuple[int, ...] = TIERS,
         with_ids: bool = False, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, tier`` (the window's size), ``step_group`` and, on
    request, ``ids`` (the piece's tokens).

    A null or empty text is just its end id. Rows that repeat an id are packed
    as documents of their own. Extra columns are ignored; an empty table gives
    no rows. ``vocabulary`` is a file that every executor has.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    end = int(end_id).to_bytes(4, "little")
    step_tokens = STEP_WINDOWS * tiers[-1]

    def group_rows(ids: list, bodies: list[bytes], base: int, steps: int, id_type: pa.DataType) -> tuple[pa.RecordBatch, int, int]:
        cols: list[list] = [[] for _ in names]
        tokens: list[bytes] = []
        windows, dealt = pack_lengths([len(b) // 4 for b in bodies], tiers), 0
        for s, (size, pieces) in enumerate(windows):
            offset = 0
            for doc, start, n in pieces:
                body = memoryview(bodies[doc])[4 * start:4 * (start + n)]
                for c, v in zip(cols, (ids[doc], start, n, zlib.crc32(body), len(bodies[doc]) // 4, base + s, offset, size, steps + dealt // step_tokens)):
                    c.append(v)
                if with_ids:
                    tokens.append(bytes(body))
                offset += n
            dealt += size
        arrays = [pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:]]]
        if with_ids:
            ends = [0]
            for t in tokens:
                ends.append(ends[-1] + len(t) // 4)
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(tokens))])
            arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
        return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids), base + len(windows), steps + -(-dealt // step_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_tokenizer(vocabulary).encode
        base = steps = TaskContext.get().partitionId() << 40
        ids, bodies, size, id_type = [], [], 0, None
        for b in batches:
            id_type = b.schema.field("doc_id").type
            for doc_id, text in zip(b.column("doc_id"), b.column("text")):
                body = encode(text.as_py() or "") + end
                ids.append(doc_id.as_py())
                bodies.append(body)
                size += len(body) // 4
                if size >= group_tokens:
                    out, base, steps = group_rows(ids, bodies, base, steps, id_type)
                    yield out
                    ids, bodies, size = [], [], 0
        if ids:
            yield group_rows(ids, bodies, base, steps, id_type)[0]

    schema = ", ".join([f"doc_id {kind}", *[f"`{n}` bigint" for n in names[1:]], *["ids array<int>"] * with_ids])
    return documents.select("doc_id", "text").mapInArrow(run, schema)
