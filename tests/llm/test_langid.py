import numpy as np
from pyspark.sql import functions as F

from stratocast.llm import catalog
from stratocast.llm import langid as L

from conftest import SF_MID
from llm_fixtures import docs  # noqa: F401


def test_held_out_accuracy(spark):
    rows = catalog.op1_language_id(spark, SF_MID)
    truth = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang")
    r = rows.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert r.n > 100 and r.a >= 0.98
    assert rows.count() == truth.count() and rows.where("score NOT BETWEEN 0 AND 1").isEmpty()


def test_nulls_letters_long_texts_and_clashing_names(spark, docs):
    train = docs(["le chat est dans la maison"] * 20, "fr").unionByName(docs(["the cat is in the house"] * 30, "en")).unionByName(docs([None, "x"], None))
    model = L.learn(train)
    assert model.langs == ["en", "fr"]
    texts = [None, "", "123 !!", "the house", "la maison", "the cat " * 140_000, "日本", "THE HOUSE"]
    rows = L.predict(docs(texts), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows] == ["und", "und", "und", "en", "fr", "en", "en", "en"]
    assert rows[0].score == 0 and rows[6].score == 0 and rows[3].score > 0.9 and rows[3].words == "own words"


def test_nothing_to_learn_from(spark, docs):
    model = L.learn(docs([]))
    assert [r.lang_pred for r in L.predict(docs(["abc"]), model).collect()] == ["und"]
    assert L.predict(docs([]), model).count() == 0


def test_false_positives_are_corrected():
    f = L.Filter(["a", "b"], np.zeros((1, 1 << L.SLOT_BITS), np.int64))
    f.slots[0] |= np.random.default_rng(1).random(1 << L.SLOT_BITS) < 0.97       # "a" seems to contain nearly everything
    for h, _ in L._grams(*L._join(["hello"], [0])):
        for j in range(L.HASHES):
            f.slots[0, ((h >> np.uint64(L.SLOT_BITS * j)) & np.uint64((1 << L.SLOT_BITS) - 1)).astype(int)] |= 2
    assert f.predict(["hello"])[0] == ["b"]


def test_more_languages_than_one_mask(spark):
    rows = [(i, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3}", f"l{i:03}") for i in range(70)]
    model = L.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.predict([t for _, t, _ in rows])[0] == [lang for _, _, lang in rows]


def test_long_text_is_cut_at_blanks(monkeypatch):
    monkeypatch.setattr(L, "SLICE", 50)
    text = "some words of a text " * 40
    assert "".join(L._slices(text)) == text
