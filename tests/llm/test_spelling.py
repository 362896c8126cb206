import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from stratocast.llm import catalog, spelling

from conftest import SF_SMALL
from llm_fixtures import docs  # noqa: F401


def one_edit(word, letters):
    """All texts one inserted, deleted or replaced code point away."""
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
            if i < len(word):
                yield word[:i] + c + word[i + 1:]
        if i < len(word):
            yield word[:i] + word[i + 1:]


def expected(n, ratio=2):
    letters = sorted({c for w in n for c in w})
    form, near = {}, {}
    for w in n:
        found = {x for x in one_edit(w, letters) if x in n and x != w}
        near[w] = len(found)
        best = min(found, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], near[w], n[form[w]] if w in form else None))
    return out


def check(spark, n, ratio=2):
    df = spark.createDataFrame(list(n.items()), "word string, n bigint")
    got = spelling.variants(df, ratio).collect()
    assert len(got) == len(n) and set(map(tuple, got)) == expected(n, ratio)
    return got


def test_random_words_against_brute_force(spark):
    rng = random.Random(5)
    for letters, lengths, size in (("ab", (1, 7), 120), ("abcé", (2, 9), 300), ("aÀ", (3, 12), 200)):
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))) for _ in range(size)}
        check(spark, {w: rng.choice([3, 3, 5, 6, 10, 24, 50, 100]) for w in sorted(words)})


def test_chains_ties_and_repeats(spark):
    got = {r.word: r for r in check(spark, {"aaaaa": 3, "aaaa": 6, "aaaaaa": 6, "aaa": 12, "aa": 24, "a": 48, "": 96, "bbbbb": 5, "bbbbc": 9})}
    assert got["aaaaa"].form == "aaaa" and got["aaaaa"].root == "" and got["bbbbb"].form is None and got["bbbbb"].n_near == 1


def test_long_words_take_few_rounds(spark):
    x = "".join(chr(97 + i * i % 23) for i in range(20_000))
    got = {r.word: r for r in check_long(spark, {x: 100, x[:9000] + "#" + x[9000:]: 10, x[:3] + x[4:]: 4, x[:-1] + "!": 3, "alone": 9})}
    assert got[x].n_near == 3 and got["alone"].n_near == 0
    assert {r.root for w, r in got.items() if w != "alone"} == {x}


def check_long(spark, n):
    return spelling.variants(spark.createDataFrame(list(n.items()), "word string, n bigint")).collect()


def test_hot_prefix(spark):
    rng = random.Random(2)
    words = {"pre" + "".join(rng.choice("xyz") for _ in range(4)) for _ in range(200)}
    check(spark, {w: rng.randint(3, 60) for w in sorted(words)}, 3)


def test_words_of_documents(spark, docs):        # noqa: F811
    d = docs(["Été ÉTÉ été a1b×c÷d KKelvin", None, "", "!!", "WORD word Wörd straße", "x" * 50_000])
    got = [(r.doc_id, r.word) for r in spelling.letter_runs(d).collect()]
    assert Counter(got) == Counter([(0, "Été"), (0, "ÉtÉ"), (0, "été"), (0, "a"), (0, "b×c÷d"), (0, "k"), (0, "elvin"),
                                    (4, "word"), (4, "word"), (4, "wörd"), (4, "straße"), (5, "x" * 50_000)])


def test_empty_and_null(spark):
    empty = spark.createDataFrame([], "word string, n bigint")
    assert spelling.variants(empty).count() == 0
    assert [tuple(r) for r in spelling.variants(spark.createDataFrame([(None, 4), ("alone", 3)], "word string, n bigint")).collect()] == [
        ("alone", None, "alone", 3, 0, None)]
    w = spark.createDataFrame([(None, "worded"), (1, None)] * 3, "doc_id bigint, word string")
    assert [tuple(r) for r in spelling.vocabulary(spelling.misspell(w)).collect()] == [("worded", 3)]


def test_query_against_brute_force(spark):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    n = Counter()
    for i, text in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: k for w, k in n.items() if k >= 3 and len(w) >= 5}
    got = catalog.op11_spelling(spark, SF_SMALL)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert set(map(tuple, got.collect())) == expected(n) and got.count() == len(n) > 500


def test_no_pairs_within_a_group(spark):
    plan = spelling.neighbours(spark.range(5).select(F.concat(F.lit("word"), "id").alias("word"), "id")
                               .withColumnRenamed("id", "n"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_words_of_a_text_are_counted_before_they_are_rows(spark, docs):        # noqa: F811
    d = docs(["word " * 5000 + "WORD wordy wor", "word", None, "Été été"])
    got = spelling.letter_runs(d, 4, counted=True)
    assert sorted(map(tuple, got.collect())) == [(0, "word", 5001), (0, "wordy", 1), (1, "word", 1)]
    found = spelling.vocabulary(spelling.misspell(got), 4, 1)
    plain = spelling.vocabulary(spelling.misspell(spelling.letter_runs(d)), 4, 1)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    # the checksum of a word is in the plan once, not in a pushed-down filter too
    assert found._jdf.queryExecution().optimizedPlan().toString().count("crc32(") == 1
