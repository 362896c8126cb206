"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every run of ``window`` consecutive words holds ``window - k + 1`` overlapping
``k``-grams; the smallest of their hashes is the run's fingerprint. Equal runs
have equal fingerprints, so every shared span of ``window`` words is found by
joining the fingerprints of documents and benchmark. A hit is then extended
to the words of its whole run and compared with the benchmark's words, so a
shared ``k``-gram or a hash collision alone is no hit.

Scale: documents are read once. Hashing and the sliding minimum work inside
the row; the exploded fingerprints meet a broadcast set of benchmark
fingerprints (8 bytes each) in the same stage, so only hits and one narrow
header row per document are ever shuffled. A benchmark with more than
``BLOCK`` distinct fingerprints is processed in blocks of that size, one pass
over the documents for each block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratocast.llm.joins import salted_left_join
from stratocast.llm.words import words
from stratocast.session import ensure_checkpoint_dir

WINDOW, K = 10, 5
BLOCK = 1_000_000       # fingerprints in one broadcast: about 24 MB as a hash table


def _windows(n: int, at: Column, size: Column, make) -> Column:
    """``make(i)`` for each start ``i`` (0-based) of ``n`` consecutive elements."""
    return F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), make)).otherwise(F.array().cast("array<bigint>"))


def _run_hash(n: int):
    return lambda i: F.xxhash64(F.slice("h", i + 1, F.lit(n)))


def _add_hashes(df: DataFrame, window: int, k: int) -> DataFrame:
    """Columns ``words``, ``h`` (a hash of each word) and ``fp`` (the
    fingerprint of each run of ``window`` words, by its start)."""
    df = df.withColumn("words", words(F.col("text")))
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("g", _windows(k, F.col("h"), F.size("h"), lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(k)])))
    # sliding minimum over window - k + 1 k-grams: minima of runs that double
    # in length, then two overlapping runs
    span, have, m = window - k + 1, 1, "g"
    while have < span:
        step = min(have, span - have)
        df = df.withColumn(f"m{have + step}", F.when(
            F.size(m) > step,
            F.zip_with(F.slice(m, F.lit(1), F.size(m) - step), F.slice(m, F.lit(step + 1), F.size(m) - step),
                       lambda a, b: F.least(a, b))).otherwise(F.array().cast("array<bigint>")))
        have, m = have + step, f"m{have + step}"
    return df.withColumn("fp", F.col(m))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Runs of ``window`` words of each item (an item of fewer words is one run):
    ``item_id, len, run`` (the words, space-joined), ``hash`` (of the run) and
    ``fp``. Items without words have no run."""
    b = _add_hashes(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text"), window, k)
    n = F.size("words")
    # posexplode_outer: for posexplode, the optimizer would copy the expression
    # of "fp" into a filter below
    full = b.where(n >= window).select("item_id", "words", "h", F.posexplode_outer("fp").alias("at", "fp")).select(
        "item_id", F.lit(window).alias("len"), F.array_join(F.slice("words", F.col("at") + 1, F.lit(window)), " ").alias("run"),
        F.xxhash64(F.slice("h", F.col("at") + 1, F.lit(window))).alias("hash"), "fp")
    short = b.where((n > 0) & (n < window)).select(
        "item_id", n.alias("len"), F.array_join("words", " ").alias("run"), F.xxhash64("h").alias("hash"),
        F.xxhash64("h").alias("fp"))
    return full.unionByName(short)


def _candidates(docs: DataFrame, fps: DataFrame, n: int) -> DataFrame:
    """Rows of ``docs`` (``key, doc_id, words, h, fp`` as an array) as one
    header row each (``at`` null) and one row for each run whose fingerprint
    is in ``fps`` (broadcast; at most ``BLOCK`` rows)."""
    # a negative position marks the header row
    rows = docs.select("doc_id", "key", "words", "h", F.posexplode(F.concat(F.array(F.lit(0).cast("bigint")), "fp")).alias("p", "fp"))
    hit = rows.join(F.broadcast(fps.select("fp", F.lit(True).alias("hit"))), "fp", "left").where(F.col("hit") | (F.col("p") == 0))
    real = F.col("p") > 0
    return hit.select(
        "doc_id", "key", F.size("words").cast("long").alias("n_words"), real.alias("is_hit"),
        F.when(real, F.col("p")).alias("at"), F.when(real, F.lit(n)).alias("len"),
        F.when(real, F.array_join(F.slice("words", F.col("p"), F.lit(n)), " ")).alias("run"),
        F.when(real, F.xxhash64(F.slice("h", F.col("p"), F.lit(n)))).alias("hash"))


def find_overlaps(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame]:
    """Return ``(headers, hits)``.

    ``headers``: ``doc_id, key, n_words`` for every row of ``documents``
    (``key`` is the text's digest, so equal texts share it). ``hits``:
    distinct ``key, at, len, hash, run`` of runs that occur in the benchmark;
    ``at`` is the 1-based word position. Both come from one pass, held in the
    checkpoint folder.

    A null text has no words; empty tables give empty results; repeated rows
    and repeated ids stay separate headers.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    runs = benchmark_windows(benchmark.select("item_id", "text"), window, k)
    runs = runs.select("len", "run", "hash", "fp").distinct().checkpoint()
    lengths = {r["len"]: r["n"] for r in runs.groupBy("len").agg(F.count_distinct("fp").alias("n")).collect()}
    d = documents.select("doc_id", "text")
    d = _add_hashes(d.withColumn("key", F.md5(F.coalesce("text", F.lit("")))), window, k)
    parts = []
    for n in sorted({window, *lengths}, reverse=True):
        mine = runs.where(F.col("len") == n).select("fp").distinct()
        rows = d if n == window else d.withColumn("fp", _windows(n, F.col("h"), F.size("h"), _run_hash(n)))
        blocks = max(1, -(-lengths.get(n, 0) // BLOCK))
        for b in range(blocks):
            one = mine if blocks == 1 else mine.where(F.pmod(F.xxhash64("fp"), F.lit(blocks)) == b)
            part = _candidates(rows.select("doc_id", "key", "words", "h", "fp"), one, n)
            parts.append(part if not parts else part.where("is_hit"))
    found = reduce(DataFrame.unionByName, parts).checkpoint()
    headers = found.where(~F.col("is_hit")).select("doc_id", "key", "n_words")
    got = found.where("is_hit").select("key", "at", "len", "hash", "run").distinct()
    hits = got.join(runs.select("len", "hash", "run").distinct(), ["len", "hash", "run"], "left_semi")
    return headers, hits


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit`` (words inside any shared run),
    ``n_items, items_sha256`` (items with shared runs, sorted as strings),
    ``contaminated`` and ``item_ids`` (the sorted list itself).

    Runs shorter than ``window`` words count only for benchmark items that are
    themselves shorter. Null texts have no words and are clean.
    """
    headers, hits = find_overlaps(documents, benchmark, window, k)
    hits = hits.checkpoint()
    # words covered by the union of the runs, per text
    spans = F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("len")).alias("end"))))
    covered = F.aggregate(
        spans, F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["upto"], x["end"]).alias("upto"),
                              (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["upto"], x["at"]))).cast("long").alias("n")),
        lambda s: s["n"])
    per_text = hits.groupBy("key").agg(covered.alias("n_hit"))
    runs = benchmark_windows(benchmark.select("item_id", "text"), window, k).select("item_id", "len", "hash", "run").distinct()
    items = (hits.select("key", "len", "hash", "run").distinct().join(runs, ["len", "hash", "run"])
             .groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")))
    got = per_text.join(items, "key", "left")
    none = F.array().cast("array<string>")
    # copies of a contaminated text share its key
    out = salted_left_join(headers, got, "key", "doc_id").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", none).alias("item_ids"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.array_join("item_ids", ",").alias("item_ids"))
