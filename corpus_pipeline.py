"""Corpus pipeline: documents to packed training windows.

``STAGES`` lists (name, function); each function takes ``(spark, docs,
sf_dir)``. ``run`` writes each stage's result as Parquet in the shared
checkpoint folder and reads it back as the next stage's documents, so a lost
executor never repeats more than one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stratocast.llm import stages
from stratocast.session import scratch_path
from stratocast.sources import table

STAGES = [
    ("language_id", stages.keep_known_languages),
    ("simhash_dedup", stages.drop_near_duplicates),
    ("decontaminate", stages.drop_contaminated),
    ("redact_pii", stages.redact_pii),
    ("pack", stages.pack_documents),
]

# learned models and tokenizers decide these rows: SQL can't express them
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; one row per packed piece."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
