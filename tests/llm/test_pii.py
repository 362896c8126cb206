import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratocast.llm import pii as P

from llm_fixtures import docs  # noqa: F401

BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(s):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) \
                    or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TEXTS = [None, "", "a@b.c_d@e.f+g@h.i", "x@y", "a@b..c a@b.c. .@a.b", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255", "é\U0001F600 me@mail.example.com ü",
         "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111", "+1 (017) 555-7713 +123 +1..2 +49 30 1234567", " a@b.de ",
         "+1 4111111111111111", "a" * 50_000 + "@" + "b." * 20_000 + "c", "1" * 30_000, "7 " * 30_000, "+1" + " " * 20_000 + "2 345678901",
         "a@b.co " * 3_000, "%@-.-"]


@pytest.fixture(scope="module")
def model():
    """Hand-made trees: proposals with 10 digits and no ``+`` are phones."""
    n_digits = len(P.KINDS) + 11 + len(P.KINDS) + 1
    return P.Model([(1.0, (3, 0.5, -2.0, (n_digits, 9.5, -2.0, (n_digits, 10.5, 2.0, -2.0))))], [0.9] * 4)


def spans(df, model, column="spans"):
    return [r[0] for r in P.find_pii(df, model).orderBy("doc_id").select(P.span_text(column)).collect()]


def test_base_spans_by_brute_force(spark, docs):
    assert spans(docs(TEXTS), None) == [brute(t) for t in TEXTS]


def test_empty_table_and_clashing_names(spark, docs):
    assert P.find_pii(docs([]), None).count() == 0
    row = P.find_pii(docs(["a@b.co"]), None).first()
    assert row.words == "own words" and len(row.base) == 1


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("a1.@+- (9é%_", max_size=60), min_size=1, max_size=30))
def test_random_texts(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert spans(d, None) == [brute(t) for t in texts]


def test_proposals_are_added_beside_base_spans(spark, docs, model):
    texts = ["call 974 555-3436 now", "call +1 974 555-3436 now", "no 123 45", None]
    assert spans(docs(texts), model) == ["phone:5:17", "phone:5:20", "", ""]
    assert spans(docs(texts), model, "base") == ["", "phone:5:20", "", ""]


def test_redaction(spark, docs, model):
    d = P.find_pii(docs(["a@b.co, call 974 555-3436", "é 1.2.3.4", "none", None, "card 4111111111111111"]), model)
    got = [r[0] for r in d.orderBy("doc_id").select(P.redact(d)).collect()]
    assert got == ["[EMAIL], call [PHONE]", "é [IP]", "none", None, "card [CARD]"]


def test_trained_trees_match_spark_and_find_rewritten_forms(spark, docs):
    lines = []
    for i in range(300):
        a = f"{100 + i}"
        lines.append([f"mail user{i}@host{i % 7}.example.com please", f"call +1 ({a}) 555-{1000 + i} today", f"order number {i * 7919 + 20_000_000} shipped",
                      f"host {i % 200}.{i % 250}.3.4 is up", f"version 7.{i}.0 of {i}"][i % 5])
    model = P.train(docs(lines))
    assert len(model.trees) == P.ROUNDS and all(0.5 <= t <= 2 for t in model.thresholds)
    got = spans(docs(["call (974) 555-3436 today", "order number 40114000 shipped"]), model)
    assert got[1] == "" and got[0] in ("", "phone:5:19")


def test_common_bare_phones_and_written_out_addresses_are_found(spark, docs):
    lines = []
    for i in range(800):
        a = f"{200 + i}"
        lines.append([f"write to user{i}@host{i % 7}.example.com please", f"seen +1 ({a}) 555-{1000 + i} today", f"order number {i * 7919 + 2_000_000_000} shipped",
                      f"node {i % 200}.{i % 250}.3.4 is up", f"seen ({a}) 555-{2000 + i} today", f"write to user{i} [at] host{i % 7} [dot] example [dot] com please",
                      f"seen {a} 555-{3000 + i} today", f"paid 4111 1111 1111 {1000 + i} there"][i % 8])
    model = P.train(docs(lines))
    got = spans(docs(["seen (974) 555-3436 today", "write to ann [at] mail [dot] example [dot] com please", "order number 4011400012 shipped",
                      "paid 4111 1111 1111 1112 there", "seen 2024-05-12 today", "build 10.20.3.4.5"]), model)
    assert got == ["phone:5:19", "email:9:46", "", "", "", brute("build 10.20.3.4.5")]


def test_no_label_for_plausible_proposals(spark, docs):
    texts = ["seen (974) 555-3436", "a [at] b [dot] com", "at 10[.]2[.]3[.]4", "paid 4111.1111.1111.1111",
             "order number 9745553430", "x [at] y", "version 1[.]2[.]3[.]5", "2024-05-12"]
    rows = P._training_rows(P._found(docs(texts)).persist()).collect()
    wrong_kind = {("card", "(974) 555-3436"), ("phone", "4111.1111.1111.1111")}
    clear = {("phone", "9745553430"), ("card", "9745553430"), ("email", "x [at] y"), ("ip", "1[.]2[.]3[.]5"), ("phone", "2024-05-12"), ("card", "2024-05-12")}
    assert {(P.KINDS[r.kind], r.value) for r in rows} == wrong_kind | clear and all(r.label == 0.0 for r in rows)


def test_nothing_to_train_on(spark, docs):
    assert P.train(docs([])) is None and P.train(docs(["plain words", None])) is None


def test_every_document_teaches(spark, monkeypatch):
    class Stop(Exception):
        pass

    def stop(found):
        raise Stop(found.count())

    monkeypatch.setattr(P, "_training_rows", stop)
    d = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("write to a@b.co "), "id").alias("text"))
    with pytest.raises(Stop, match="^30000$"):
        P.train(d)
