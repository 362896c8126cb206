import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratocast.llm import decontaminate as D

from conftest import SF_SMALL
from llm_fixtures import docs  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items):
    runs = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            runs.setdefault(tuple(w[i:i + 10]), set()).add(str(item))
    out = []
    for text in texts:
        w, hit, ids = words(text), set(), set()
        for run, found in runs.items():
            for i in range(len(w) - len(run) + 1):
                if tuple(w[i:i + len(run)]) == run:
                    hit.update(range(i, i + len(run)))
                    ids |= found
        listed = ",".join(sorted(ids))
        out.append((len(w), len(hit), len(ids), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out


def result(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = D.decontaminate(docs, bench).orderBy("doc_id").collect()
    return [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows]


LONG = " ".join(f"w{i}" for i in range(25))
ITEMS = [(10, LONG), (2, "Only three words"), (3, None), (4, ""), (5, "..."), (6, LONG), (7, "A b a b a b a b a b a b")]


def test_brute_force_with_nulls_short_items_ties_and_copies(spark, docs):
    texts = [None, "", "!!", "W0 w1-W2 w3 w4 w5 w6 w7 w8 w9", " ".join(LONG.split()[:9]), f"x {LONG.upper()} y", f"x {LONG.upper()} y",
             "so only THREE words only three words", "a b a b a b a b a b a b a b", "é " + LONG.replace(" ", "é "), "clean text here"]
    assert result(spark, docs(texts), ITEMS) == brute(texts, ITEMS)


def test_empty_tables(spark, docs):
    assert result(spark, docs([]), ITEMS) == []
    assert result(spark, docs(["a b"]), []) == brute(["a b"], [])


def test_blocks_of_fingerprints_give_the_same(spark, docs, monkeypatch):
    texts = [f"{LONG} and more", "w3 w4", "other"]
    monkeypatch.setattr(D, "BLOCK", 3)
    assert result(spark, docs(texts), ITEMS) == brute(texts, ITEMS)


def test_very_long_text(spark, docs):
    texts = [("z " * 200_000) + LONG + (" q" * 100_000)]
    assert result(spark, docs(texts), ITEMS) == brute(texts, [(10, LONG), (6, LONG)])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30).map(" ".join), min_size=1, max_size=4),
       st.lists(st.lists(st.sampled_from("abc"), max_size=14).map(" ".join), min_size=1, max_size=3))
def test_random_texts(spark, texts, items):
    items = list(enumerate(items))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert result(spark, d, items) == brute(texts, items)


@pytest.mark.parametrize("k", [2, 10])
def test_any_k_finds_every_run(spark, k):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    cols = ["doc_id", "n_hit", "items_sha256"]
    assert D.decontaminate(docs, bench, k=k).select(cols).exceptAll(D.decontaminate(docs, bench).select(cols)).isEmpty()
