import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stratocast.llm import syncmers as S

from conftest import SF_SMALL


def brute(rows):
    """Expected id, n_chars, edited text and next text, in descending id order."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        n = len(t) // 3
        yield i, len(t), t[:len(t) - n] + nxt[:n], t, nxt


def check(spark, rows, ranges="4"):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = S.with_next(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])      # noqa: E731
    want = sorted(((i, n, hashlib.sha256(e.encode()).hexdigest(), t, nxt, e) for i, n, e, t, nxt in brute(rows)), key=key)
    got = sorted(got, key=key)
    assert [tuple(r)[:3] for r in got] == [w[:3] for w in want]
    for r, (_, _, _, t, nxt, e) in zip(got, want):
        a, b, c = (S.fingerprint_of(x) for x in (t, nxt, e))
        assert r.fingerprint == S.to_text(a) and r.edited_fingerprint == S.to_text(c)
        assert r.near_next == S.likeness(a, b) and r.near_edited == S.likeness(a, c)


def test_order_edits_and_likeness(spark):
    texts = ["", None, "é" * 5, "short", "a longer text " * 30, "another text, quite different from the others. " * 20, "x" * 400]
    check(spark, [(i * 10, texts[i % len(texts)] and texts[i % len(texts)] + str(i)) for i in range(40)])
    check(spark, [(5, "only one document here")])
    check(spark, [(-3, "negative"), (2**62, "large " * 9), (0, "zero")], "9")
    check(spark, [(1, "b"), (1, "a"), (1, "a"), (None, "z"), (None, None), (2, "q")])
    assert S.with_next(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_range_of_matches_a_plain_count(spark):
    from pyspark.sql import functions as F
    bounds = [3, 4, 9, 10, 11, 40, 41]
    got = [r[1] for r in spark.range(50).select("id", S._range_of(F.col("id"), bounds)).collect()]
    assert got == [1 + sum(b < i for b in bounds) for i in range(50)]
    assert spark.range(1).select(S._range_of(F.col("id"), [])).first()[0] == 1


@settings(max_examples=50, deadline=None)
@given(st.text("abcdé ", max_size=300), st.integers(1, 40))
def test_syncmers_are_context_free(text, shift):
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(cp) < S.K:
        return
    h, at = S._syncmers(cp)
    smer = {}
    for p in range(len(text) - S.K + 1):                 # by definition, from the k-mer alone
        one = S._syncmers(cp[p:p + S.K])
        smer[p] = int(one[0][0]) if len(one[0]) else None
    assert {p: int(x) for p, x in zip(at.tolist(), h.tolist())} == {p: x for p, x in smer.items() if x is not None}


def test_long_texts_and_text_form(monkeypatch):
    text = "".join(chr(97 + i * i % 23) + " " * (i % 7 == 0) for i in range(30_000))
    whole = S.fingerprint_of(text)
    monkeypatch.setattr(S, "SLICE", 1000)
    cut = S.fingerprint_of(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    back = S.from_text(S.to_text(whole))
    assert (back[0] == whole[0]).all() and (back[1] == whole[1]).all()
    assert S.likeness(whole, cut) == 1.0 and S.likeness(S.fingerprint_of(""), whole) == 0.0 and S.likeness(S.fingerprint_of(None), S.fingerprint_of("")) == 1.0


def test_shared_passage_in_long_texts(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 10)))      # noqa: E731
    text = lambda n: " ".join(word() for _ in range(n))      # noqa: E731
    passage = text(50)
    a, b = (f"{text(8000)} {passage} {text(8000)}" for _ in range(2))
    shared = set(S.fingerprint_of(a)[0].tolist()) & set(S.fingerprint_of(b)[0].tolist())
    own = set(S.fingerprint_of(passage)[0].tolist())
    assert len(a) > 90_000 and len(own) > 20 and own <= shared
    r = S.with_next(spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")).where("doc_id = 2").first()
    assert r.near_next >= len(own) / (2 * len(S.from_text(r.fingerprint)[0])) > 0 and abs(r.near_edited - 2 / 3) < 0.02


def test_text_form_keeps_long_steps():
    p = (np.array([1, 5, 2**32 - 1, 2**32 - 2], np.uint32)[[0, 1, 3, 2]], np.array([2**31, 0, 127, 70_000], np.uint32))
    back = S.from_text(S.to_text(p))
    assert (back[0] == p[0]).all() and (back[1] == p[1]).all() and len(S.from_text("")[0]) == 0


def test_edited_texts_are_near_and_others_far(spark):
    rows = S.with_next(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).where("n_chars > 600").collect()
    near, other = np.array([r.near_edited for r in rows]), np.array([r.near_next for r in rows])
    assert abs(np.median(near) - 2 / 3) < 0.1 and near.min() > 0.3 and np.median(other) < 0.1
    assert all(0 <= x <= 1 for x in (*near, *other))
