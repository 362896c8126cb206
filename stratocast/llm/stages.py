"""Stages of the corpus pipeline: ``(spark, docs, sf_dir) -> DataFrame``.

Each takes documents (``doc_id, text, lang, source, n_chars``), applies one
operator of this package and returns documents again; packing, the last,
returns pieces of packed windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocast.llm import decontaminate, langid, packing, pii, simhash
from stratocast.sources import table

MIN_SCORE = 0.2         # share of a text's n-grams that its language must hold


def _carried(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of a document) and ``text``: operators add columns
    beside them without clashing with the documents' own."""
    return docs.select(F.struct("*").alias("row"), "text")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: drop documents in no learned language (no letter, or too
    few of their n-grams belong to any). Learned from the labels in ``docs``;
    when there is none, nothing is dropped."""
    model = langid.learn(docs)
    if not model.langs:
        return docs
    out = langid.predict(_carried(docs), model)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash: one document of each component stays, the one with the smallest
    id (null ids last; then the smaller hash of the text). Of rows that repeat
    both id and text, one stays."""
    groups = simhash.near_duplicates(docs, shingle=3, radius=2).select("doc_id", "key", "group_fp").checkpoint()
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("best")
    kept = groups.groupBy("group_fp").agg(best).select("best.doc_id", "best.key")
    same = groups.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("copies"))
    kept = _same_id(kept, same).select(kept["doc_id"].alias("id"), kept["key"].alias("k"), "copies").checkpoint()
    d = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("key"))
    out = d.join(kept, d["doc_id"].eqNullSafe(kept["id"]) & (d["key"] == kept["k"]))
    once = out.where("copies = 1").select("row.*")
    if kept.where("copies > 1").isEmpty():
        return once
    return once.unionByName(out.where("copies > 1").dropDuplicates(["doc_id", "key"]).select("row.*"))


def _same_id(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: drop documents that share a run with the benchmark."""
    _, hits = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    d = docs.select(F.struct("*").alias("row"), F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    return d.join(hits.select("key").distinct(), "key", "left_anti").select("row.*")


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: replace every span by its kind; ``n_chars`` follows the new text."""
    found = pii.find_pii(_carried(docs), pii.train(docs.select("doc_id", "text")))
    found = found.withColumn("new", pii.redact(found))
    new = {"text": F.col("new"), "n_chars": F.when(F.size("spans") > 0, F.length("new").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: token pieces of all documents, with their ids."""
    return packing.pack(docs, with_ids=True)
