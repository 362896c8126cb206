"""Fixtures of these tests (imported by name: two conftest modules would clash)."""

import pytest
from pyspark.sql import functions as F


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from texts (ids 0, 1, ...), with columns that clash with the
    operators' own names."""
    def make(texts, lang=None, extra=True):
        rows = [(i, t, lang, "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            for c in ("key", "words", "h", "fp", "base", "spans", "row", "score", "lang_pred", "new", "segment", "_range", "hit", "copies"):
                df = df.withColumn(c, F.lit(f"own {c}"))
        return df
    return make

