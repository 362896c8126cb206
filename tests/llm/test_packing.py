import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratocast.llm import packing as P
from stratocast.llm.tokens import ChunkTokenizer, chunk_tokenizer

from conftest import SF_SMALL
from llm_fixtures import docs  # noqa: F401


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(P.VOCABULARY)


def ids(plain, text):
    return np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text("aBÉßİǅ '.,sStTlL\n\t\x1c\x85Σ<|endofx>0²", max_size=60))
def test_chunked_ids_equal_the_tokenizers(text):
    t = chunk_tokenizer(P.VOCABULARY)
    assert t.encode(text) == np.array(t.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_memo_is_bounded(monkeypatch):
    from stratocast.llm import tokens
    monkeypatch.setattr(tokens, "MEMO", 10)
    t = ChunkTokenizer(P.VOCABULARY)
    for i in range(50):
        t.encode(f"word{i} again{i}")
    assert len(t.memo) < 20


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=40))
def test_windows_are_full_and_hold_everything_once(lengths):
    seen = {}
    for size, pieces in P.pack_lengths(lengths):
        assert size & (size - 1) == 0 and size <= 4096 and sum(n for _, _, n in pieces) == size
        for doc, start, n in pieces:
            seen.setdefault(doc, []).append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, m in sorted(seen[doc]):
            assert start == at
            at += m
        assert at == n


def check(rows, texts, plain):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        want, at = ids(plain, t), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want)
            part = want[at:at + r.length].tobytes()
            assert r.ids_crc32 == zlib.crc32(part) and np.array(r.ids, "<u4").tobytes() == part
            at += r.length
        assert at == len(want)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].tier <= 4096


def test_round_trip(spark, docs, plain):
    texts = [None, "", "one", "<|endoftext|> in text", "w " * 30_000, "café 日本", "a" * 3000] + ["some words to pack"] * 50
    check(P.pack(docs(texts), with_ids=True, group_tokens=2000).collect(), texts, plain)
    assert P.pack(docs([])).count() == 0


def test_whole_table(spark, plain):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = [r.text for r in d.orderBy("doc_id").collect()]
    check(P.pack(d.repartition(3, "doc_id"), with_ids=True).collect(), texts, plain)


def test_step_groups_hold_equal_token_counts(spark, docs):
    rows = P.pack(docs(["word " * n for n in (5000, 9000, 300, 77) * 20]), group_tokens=1 << 30).groupBy("step_group").sum("length").collect()
    full = [r[1] for r in rows if r[1] == P.STEP_WINDOWS * 4096]
    assert len(full) >= len(rows) - 4
