"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics (lengths, shares of
character kinds, repetition, lines, sentences). Per class a mean and a
covariance are estimated, shrunk towards the covariance that the classes share
and, with it, towards its diagonal; the strength follows from the number of
documents. A score is the probability of the better class: the difference of
the two Gaussian log densities (Mahalanobis distances by triangular solves with
cached Cholesky factors, log determinants, class shares) through a logistic
curve.

Scale: texts are read once, in Arrow batches; their statistics (a few numbers a
document) are written to the shared checkpoint folder. Fitting adds up sums and
products per task before anything is shuffled, and only these sums, whose
number depends on neither documents nor classes' sizes, reach the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from stratocast.llm.joins import salted_left_join
from stratocast.session import ensure_checkpoint_dir

STATISTICS = ("chars", "words", "word_length", "longest_word", "distinct_words", "commonest_word", "wordless", "letters", "upper", "digits",
              "marks", "blank", "doubled_marks", "odd_marks", "lines", "line_length", "repeated_lines", "sentence_length")
THRESHOLD = 0.7
FLOOR = 1e-3            # of a statistic's variance (in units of all documents' variance)
_SENTENCE = re.compile(r"[.!?](?=\s|\Z)")
_ORDINARY = frozenset(".,;:!?'\"()-")


def _share(part: float, whole: float) -> float:
    """A share on a scale that spreads the ends: arcsine of the root."""
    return math.asin(math.sqrt(min(1.0, part / whole))) if whole > 0 else 0.0


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one whole text, in the order of ``STATISTICS``
    (null and empty texts: all zero)."""
    if not text:
        return [0.0] * len(STATISTICS)
    n = len(text)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = cp < 128
    kind = np.where(low, _KIND[np.where(low, cp, 0)], 0)
    if not low.all():
        # beyond ASCII: one look at each distinct character
        chars, at = np.unique(cp[~low], return_inverse=True)
        kind[~low] = np.array([_kind(chr(c)) for c in chars.tolist()])[at]
    count = np.bincount(kind, minlength=6)
    letters, upper = int(count[_LETTER] + count[_UPPER]), int(count[_UPPER])
    marks = int(count[_MARK] + count[_ODD])
    is_mark = kind >= _MARK
    doubled = int(np.count_nonzero(is_mark[1:] & (cp[1:] == cp[:-1])))
    words = text.split()
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    sentences = len(_SENTENCE.findall(text))
    wordless = sum(k for w, k in seen.items() if not any(map(str.isalpha, w)))
    return [math.log1p(n), math.log1p(len(words)), math.log1p(letters / max(1, len(words))), math.log1p(max(map(len, seen), default=0)),
            math.log1p(len(seen)) / math.log1p(max(1, len(words))), _share(max(seen.values(), default=0), len(words)), _share(wordless, len(words)),
            _share(letters, n), _share(upper, letters), _share(int(count[_DIGIT]), n), _share(marks, n), _share(int(count[_BLANK]), n),
            _share(doubled, n), _share(int(count[_ODD]), n), math.log1p(len(lines)), math.log1p(n / max(1, len(lines))),
            _share(len(lines) - len(set(lines)), len(lines)), math.log1p(len(words) / max(1, sentences))]


_BLANK, _LETTER, _UPPER, _DIGIT, _MARK, _ODD = range(6)


def _kind(c: str) -> int:
    if c.isspace():
        return _BLANK
    if c.isalpha():
        return _UPPER if c.isupper() else _LETTER
    if c.isdigit():
        return _DIGIT
    return _MARK if c in _ORDINARY else _ODD


_KIND = np.array([_kind(chr(i)) for i in range(128)])


def with_statistics(documents: DataFrame, text: str = "text", name: str = "stats") -> DataFrame:
    """Replace ``text`` by its statistics (an array of doubles); other columns stay."""
    kept = documents.drop(name)
    schema = StructType([f for f in kept.schema.fields if f.name != text] + [StructField(name, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([statistics(t) for t in b.column(text).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in schema.fields[:-1]), got], schema.names)

    return kept.mapInArrow(run, schema)


@dataclass
class Discriminant:
    """Class shares, means and Cholesky factors, all in units of ``scale``
    around ``centre``. With fewer than two classes ``factors`` is empty and
    every score is ``prior``."""

    prior: float
    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    shares: list[float]
    shrinkage: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of statistics."""
        if not self.factors:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        d = []
        for mean, chol, share in zip(self.means, self.factors, self.shares):
            y = np.linalg.solve(chol, (z - mean).T)
            d.append(math.log(share) - np.log(np.diag(chol)).sum() - 0.5 * (y * y).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(d[0] - d[1], -700, 700)))


def _sums(rows: DataFrame) -> tuple[list[float], list[np.ndarray], list[np.ndarray]]:
    """Weight, sum and sum of products of ``stats`` for each class (0 and 1)."""
    k = len(STATISTICS)
    at = np.triu_indices(k)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + k + len(at[0])))
        for b in batches:
            x = np.array(b.column("stats").to_pylist(), float).reshape(-1, k)
            for c in (0, 1):
                w = np.array(b.column(f"n{c}").to_pylist(), float)
                total[c] += np.concatenate([[w.sum()], w @ x, ((x * w[:, None]).T @ x)[at]])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], total.shape[1]), pa.int32()), pa.array(np.tile(np.arange(total.shape[1]), 2), pa.int32()),
                                          pa.array(total.ravel())], ["c", "i", "v"])

    got = rows.select("stats", "n0", "n1").mapInArrow(add, "c int, i int, v double").groupBy("c", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + k + len(at[0])))        # a fixed number of sums
    for r in got:
        total[r["c"], r["i"]] = r["v"]
    squares = []
    for c in (0, 1):
        s = np.zeros((k, k))
        s[at] = total[c, 1 + k:]
        squares.append(s + np.triu(s, 1).T)
    return [float(total[c, 0]) for c in (0, 1)], [total[c, 1:1 + k] for c in (0, 1)], squares


def fit(rows: DataFrame) -> Discriminant:
    """Fit to ``stats, n0, n1`` (how often the row is labelled 0 and 1).

    Rows with neither add nothing. One class alone, or none, gives a constant
    score: that class's share, or one half.
    """
    n, sums, squares = _sums(rows)
    k = len(STATISTICS)
    total = n[0] + n[1]
    if min(n) == 0:
        return Discriminant(n[1] / total if total else 0.5, np.zeros(k), np.ones(k), [], [], [], [])
    centre = (sums[0] + sums[1]) / total
    variance = np.diag(squares[0] + squares[1]) / total - centre ** 2
    scale = np.sqrt(np.where(variance > 1e-12, variance, 1.0))
    means, spread = [], []
    for c in (0, 1):
        mean = sums[c] / n[c]
        means.append((mean - centre) / scale)
        spread.append((squares[c] / n[c] - np.outer(mean, mean)) / np.outer(scale, scale))
    shared = (n[0] * spread[0] + n[1] * spread[1]) / total
    shared = _towards(shared, np.diag(np.diag(shared)), total)[0]
    factors, strength = [], []
    for c in (0, 1):
        cov, s = _towards(spread[c], shared, n[c])
        strength.append(s)
        factors.append(np.linalg.cholesky(cov + FLOOR * np.eye(k)))
    return Discriminant(n[1] / total, centre, scale, means, factors, [n[0] / total, n[1] / total], strength)


def _towards(cov: np.ndarray, target: np.ndarray, n: float) -> tuple[np.ndarray, float]:
    """Covariance shrunk towards ``target``: with as many documents as it has
    entries of its own the two count alike, with more the covariance does."""
    own = len(cov) * (len(cov) + 1) / 2
    s = own / (own + n)
    return (1 - s) * cov + s * target, s


def score(documents: DataFrame, model: Discriminant, name: str = "score") -> DataFrame:
    """Replace ``stats`` by the score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)     # a few hundred numbers
    schema = StructType([f for f in documents.schema.fields if f.name not in ("stats", name)] + [StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("stats").to_pylist(), float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in schema.fields[:-1]), pa.array(shared.value.score(x))], schema.names)

    return documents.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the ids that is never learned from (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents``.

    ``labels`` (``doc_id, quality``) teach the model, except those of held-out
    ids and rows with a null in either; an id labelled several times counts as
    often, for each document that bears it. A document with a null id is
    scored and never learned from. Repeated rows stay separate; other columns
    are not read. Without documents the result is empty.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    stats = with_statistics(documents.select("doc_id", "text")).withColumn("held_out", held_out(F.col("doc_id"))).checkpoint()
    taught = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
    taught = taught.groupBy("doc_id").agg(F.count_if(F.col("quality") == 0).alias("n0"), F.count_if(F.col("quality") == 1).alias("n1"))
    rows = salted_left_join(stats.where(~F.col("held_out") & F.col("doc_id").isNotNull()), taught, "doc_id", "stats").where("n0 IS NOT NULL")
    out = score(stats, fit(rows))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast(IntegerType()).alias("predicted"))
