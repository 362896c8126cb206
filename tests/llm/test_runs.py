import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from stratocast.llm import catalog, runs

from conftest import SF_SMALL
from llm_fixtures import docs  # noqa: F401


def brute(w, shortest=6, exponent=4):
    """All runs by comparing words at every distance."""
    out, seen = [], set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, exponent * q) and not any((i, j + q, p) in seen for p in range(1, q) if q % p == 0):
                out.append((i, j + q - i, q))
                seen.add((i, j + q, q))
            i = max(j, i + 1)
    return sorted(out)


def sample(rng):
    w = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randint(0, 90))]
    if w and rng.random() < 0.7:
        p, a = rng.randint(1, max(1, len(w) // 4)), rng.randrange(len(w))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        if rng.random() < 0.3:
            w[rng.randrange(len(w))] = 9
    return w * rng.choice([1, 1, 1, 4, 5])


def test_catchers_against_brute_force_in_any_portions():
    rng = random.Random(1)
    for _ in range(1500):
        w = sample(rng)
        whole, parts, i = runs.Catchers(), runs.Catchers(), 0
        whole.append(np.array(w, np.int64))
        while i < len(w):
            n = rng.randint(1, 9)
            parts.append(np.array(w[i:i + n], np.int64))
            i += n
        assert whole.runs() == parts.runs() == brute(w)


def test_other_limits():
    rng = random.Random(3)
    for _ in range(300):
        w = sample(rng)
        c = runs.Catchers(9, 5)
        c.append(np.array(w, np.int64))
        assert c.runs() == brute(w, 9, 5)
    with pytest.raises(ValueError):
        runs.Catchers(exponent=3)


def test_fingerprints_that_always_agree(monkeypatch):
    monkeypatch.setattr(runs, "_mix", lambda x: np.zeros_like(x))
    rng = random.Random(4)
    for _ in range(200):
        w = sample(rng)
        c = runs.Catchers()
        c.append(np.array(w, np.int64))
        # every place is suggested; the words decide
        assert c.runs() == brute(w)


def test_work_grows_with_the_text():
    a, b = [0], [0, 1]
    while len(b) < 200_000:
        a, b = b, b + a
    for w in (np.zeros(200_000, int), np.tile(np.arange(10), 20_000), np.array(b), np.tile(np.r_[np.zeros(999, int), 1], 200)):
        t = time.time()
        c = runs.Catchers()
        c.append(w)
        c.runs()
        assert time.time() - t < 30


def test_rows(spark, docs, monkeypatch):        # noqa: F811
    monkeypatch.setattr(runs, "GROUP", 40)
    texts = [None, "", " \t\n", "a a a a a", "a a a a a a", "x a b\ta b a b\x0ba b y", "é é é É", "la " * 3000, "a a a", "a a a"]
    d = docs(texts).withColumnRenamed("key", "runs").withColumnRenamed("words", "collapsed").coalesce(1)
    got = sorted(runs.find_runs(d).collect(), key=lambda r: r.doc_id)
    assert [[tuple(x) for x in r.runs] for r in got] == [[], [], [], [], [(0, 6, 1)], [(1, 8, 2)], [], [(0, 3000, 1)], [], []]
    assert [r.collapsed for r in got] == ["", "", "", "a a a a a", "a", "x a b y", "é é é É", "la", "a a a", "a a a"]
    assert runs.find_runs(d.limit(0)).count() == 0 and got[0].row == "own row"


def test_kept_words_of_overlapping_runs():
    rng = random.Random(6)
    for _ in range(300):
        w = sample(rng)
        r = brute(w)
        want = [not any(s + q <= i < s + n for s, n, q in r) for i in range(len(w))]
        assert runs.kept_words(len(w), r).tolist() == want


def words_of(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
    return w


def expected(i, text):
    w = words_of(i, text)
    r = brute(w)
    best = min(r, key=lambda x: (-x[1], x[0], x[2]), default=None)
    keep = [x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in r)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()      # noqa: E731
    return (i, len(r), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in r)), sha(" ".join(keep)))


def test_query_against_brute_force(spark):
    rows = [r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r) for r in catalog.op12_runs(spark, SF_SMALL).collect()}
    small = [r for r in rows if len(r.text or "") < 4000]
    assert len(got) == len(rows) and len(small) > 100
    assert [got[r.doc_id] for r in small] == [expected(*r) for r in small]
    assert sum(got[r.doc_id][1] > 0 for r in small) > 5


def test_repeated_tails(spark, docs):        # noqa: F811
    hit = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, t) for i in hit[:8] for t in (" one  two\tthree four\nfive " * 9, "single", "", None)] + [(None, "a b c d e f g")]
    got = runs.repeat_tails(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    for (i, t), r in zip(rows, got):
        assert (r.text or "").split() == words_of(i, t) and r.doc_id == i
