"""Language identification with bit-sliced Bloom filters of letter n-grams.

Training counts, per language, the documents of a labelled sample that hold
each n-gram of letters, and keeps an n-gram for a language when it is about as
common there as anywhere. One Bloom filter serves all languages: a slot holds
a bit mask of languages, and the AND of an n-gram's slots is the mask of all
languages that (seem to) contain it. A text's n-grams are looked up, hits are
counted per language, and each count is corrected for the false positives that
the filter's fill predicts; the largest corrected count decides.

Scale: the filter has a fixed number of slots (8 MB), whatever the corpus;
it is built by one aggregation and broadcast. Prediction is one pass without
a shuffle; texts are handled in slices of bounded length.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

SIZES = (2, 3, 4)          # n-gram lengths; a blank marks a word's start and end
SLOT_BITS = 20             # 2^20 slots
HASHES = 3
MAX_DOCS = 3000            # labelled documents per language (expected size of the sample)
MIN_SHARE, MIN_RATIO = 0.004, 0.4
SLICE = 1 << 20            # code points handled at a time
PER_WORD = 63              # languages in one mask


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _slices(text: str) -> Iterator[str]:
    """Cut a lower-cased text at blanks into slices of about ``SLICE``."""
    a = 0
    while len(text) - a > SLICE:
        b = text.rfind(" ", a, a + SLICE)
        b = a + SLICE if b <= a else b
        yield text[a:b]
        a = b
    yield text[a:] if a else text


def _batches(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of several texts with blanks between, and the text of each."""
    parts, owners, size = [], [], 0
    for i, t in enumerate(texts):
        for s in _slices((t or "").lower()):
            parts.append(s)
            owners.append(i)
            size += len(s)
            if size >= SLICE:
                yield _join(parts, owners)
                parts, owners, size = [], [], 0
    if parts:
        yield _join(parts, owners)


def _join(parts: list[str], owners: list[int]) -> tuple[np.ndarray, np.ndarray]:
    cp = np.frombuffer((" " + " ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.repeat(np.array(owners, np.int64), [len(p) + 1 for p in parts])
    return cp, np.concatenate([own[:1], own])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _grams(cp: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all n-grams and the text each belongs to, one length at a time.

    Runs of other characters count as one blank; no n-gram spans two words.
    """
    letter = _letters()[cp]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    c = np.where(letter, cp, 32)[keep].astype(np.uint64)
    own, blank = own[keep], ~letter[keep]
    for n in SIZES:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        ok = np.ones(m, bool)
        for j in range(n):
            h = (h << np.uint64(16)) ^ c[j:j + m] ^ (h >> np.uint64(45))
            if 0 < j < n - 1:
                ok &= ~blank[j:j + m]
        if n == 2:
            ok &= ~(blank[:m] & blank[1:1 + m])
        yield _mix(h[ok]), own[n - 1:][ok]


@dataclass
class Filter:
    """``slots[s, i]``: mask of the languages ``s * PER_WORD ...`` at slot ``i``."""

    langs: list[str]
    slots: np.ndarray

    def false_positive(self) -> np.ndarray:
        """Chance that an absent n-gram seems present, per language."""
        fill = [np.mean((self.slots[i // PER_WORD] >> (i % PER_WORD)) & 1) for i in range(len(self.langs))]
        return np.array(fill) ** HASHES

    def masks(self, h: np.ndarray) -> np.ndarray:
        """Languages that contain each n-gram, as masks."""
        low = np.uint64((1 << SLOT_BITS) - 1)
        out = self.slots[:, (h & low).astype(np.int64)]
        for j in range(1, HASHES):
            out = out & self.slots[:, ((h >> np.uint64(SLOT_BITS * j)) & low).astype(np.int64)]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and score of each text.

        Score: corrected share of the text's n-grams that the language holds.
        ``und`` and 0 for texts without a letter (and null) or when nothing
        was learned; ties go to the language with more training documents.
        """
        n = len(texts)
        total, hits = np.zeros(n), np.zeros((len(self.langs), n))
        for cp, own in _batches(texts):
            for h, at in _grams(cp, own):
                total += np.bincount(at, minlength=n)
                masks = self.masks(h)
                for i in range(len(self.langs)):
                    has = (masks[i // PER_WORD] >> (i % PER_WORD)) & 1
                    hits[i] += np.bincount(at[has.astype(bool)], minlength=n)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        fp = np.minimum(self.false_positive(), 0.999)[:, None]
        real = np.clip((hits - fp * total) / (1 - fp), 0, total)
        best = real.argmax(axis=0)
        score = np.where(total > 0, real.max(axis=0) / np.maximum(total, 1), 0.0)
        return [self.langs[b] if t else "und" for b, t in zip(best, total)], score


def _bounded(labelled: DataFrame, counts: dict[str, int], max_docs: int) -> DataFrame:
    """About ``max_docs`` documents of each language, chosen by a hash of the row."""
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, max_docs / n))).otherwise(share)
    return labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share * (1 << 20))


def learn(labelled: DataFrame, max_docs: int = MAX_DOCS) -> Filter:
    """Build the filter from ``doc_id, text, lang``; rows with a null text or
    label are ignored. An empty table gives a filter without languages."""
    spark = labelled.sparkSession
    data = labelled.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in data.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts, key=lambda x: (-counts[x], x))
    slots = np.zeros((max(1, -(-len(langs) // PER_WORD)), 1 << SLOT_BITS), np.int64)
    if not langs:
        return Filter([], slots)
    sample = _bounded(data, counts, max_docs)
    index = {lang: i for i, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial document counts of each (language, n-gram)."""
        for b in batches:
            texts, lang = b.column("text").to_pylist(), np.array([index[x] for x in b.column("lang").to_pylist()], np.int64)
            for cp, own in _batches(texts):
                got = [_once(h, at) for h, at in _grams(cp, own)]
                if not got:
                    continue
                h, at = np.concatenate([g[0] for g in got]), lang[np.concatenate([g[1] for g in got]).astype(np.int64)]
                for i in np.unique(at):
                    u, n = np.unique(h[at == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), i)), pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    grams = sample.select("text", "lang").mapInArrow(count, "lang bigint, gram bigint, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    docs = F.array(*[F.lit(float(max(1, min(max_docs, counts[x])))) for x in langs])
    grams = grams.withColumn("p", F.col("n") / F.get(docs, F.col("lang").cast("int")))
    kept = (grams.groupBy("gram").agg(F.collect_list(F.struct("lang", "p")).alias("by"), F.max("p").alias("top"))   # one entry per language
            .select("gram", "top", F.inline("by"))
            .where((F.col("p") >= MIN_SHARE) & (F.col("p") >= F.col("top") * MIN_RATIO)))
    at = F.array(*[F.shiftrightunsigned("gram", SLOT_BITS * j).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)) for j in range(HASHES)])
    bit = F.expr(f"shiftleft(1L, cast(pmod(lang, {PER_WORD}) as int))")
    filled = (kept.select((F.col("lang") / PER_WORD).cast("int").alias("word"), bit.alias("bit"), F.explode(at).alias("slot"))
              .groupBy("word", "slot").agg(F.bit_or("bit").alias("mask")).toPandas())        # at most 2^20 rows per 63 languages
    slots[filled["word"].to_numpy(np.int64), filled["slot"].to_numpy(np.int64)] = filled["mask"].to_numpy(np.int64)
    return Filter(langs, slots)


def _once(h: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Distinct (n-gram, text) pairs."""
    o = np.lexsort((h, own))
    h, own = h[o], own[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return np.stack([h[new], own[new].astype(np.uint64)])


def predict(documents: DataFrame, model: Filter, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Append the predicted language and score to every row. All columns are
    kept, except that those with the new names are replaced."""
    documents = documents.drop(*names)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            lang, score = model.predict(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, *names])

    return documents.mapInArrow(run, StructType([*schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that is never learned from (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
