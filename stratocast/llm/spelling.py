"""Spelling variants: one-edit neighbours by a relational trie frontier.

The vocabulary becomes a table of trie edges, and a table of states (word,
position, node, edits) is joined with it level by level, one depth of the trie
after another; a state that reaches the end of its word and of another with one
edit is a pair of neighbours. Each edge takes part in one join only.

- A state without edits spends its edit where its word and the other first
  differ: another character for one of the word's (replaced), one more
  (inserted), or one fewer (deleted). So a pair is reached in one way.
- Near the root nearly everything follows nearly everything. Of two words one
  edit apart, either the first half of a word is a prefix of the other, or the
  rest of it is a suffix. One trie reads words forwards and one backwards, and a
  state starts with the first half (backwards: the rest) already read, so that
  neither has hot nodes near a root.
- An edge knows signatures (a 64-bit set of hashes) of what may follow it; a
  state whose rest is not among them is not made.
- Beyond ``DEEP`` characters edges are path-compressed, so that very long words
  cost one round a branching, not one a character.

Nodes are named by 64-bit hashes of their prefix; a chance agreement can only
add a pair, and each pair is confirmed on the words.

Scale: words are counted per text, then per task before the shuffle, so a
frequent word is one row a task. All else works on distinct words. Tables that later steps read
again are written to the shared checkpoint folder.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocast.session import ensure_checkpoint_dir, scratch_path

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 5, 3
RATIO = 2
SLICE = 1 << 20          # characters and prefixes handled at a time
DEEP = 40                # from here on an edge carries all characters up to the next node
AHEAD = 16               # characters behind an edge that its signature covers


def letter_runs(documents: DataFrame, least_length: int = 1, counted: bool = False) -> DataFrame:
    """``doc_id, word``: every maximal run of letters (``LETTERS``) of at least
    ``least_length`` code points of every text, A-Z lower-cased. Null and empty
    texts have none. ``counted``: one row a different word of a row, and how
    often (``n``) it occurs there."""
    schema = T.StructType([documents.schema["doc_id"], T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    texts = documents.select("doc_id", F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    runs = texts.mapInArrow(partial(_count_runs, least_length), schema)
    return runs if counted else runs.select("doc_id", "word", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).drop("col")


def _count_runs(least_length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text, counted; bytes are lowered before they are read
    as text, which changes A-Z only."""
    find = re.compile(f"[{LETTERS}]{{{max(1, least_length)},}}").findall
    for b in batches:
        ids, owner, words, n = b.column("doc_id"), [], [], []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids.take(pa.array(owner, pa.int32())), pa.array(words, pa.string()), pa.array(n, pa.int64())], ["doc_id", "word", "n"])

        for i, text in enumerate(b.column("text")):
            found = Counter(find(text.as_py().lower().decode("utf-8", "replace")))
            owner += [i] * len(found)
            words += found.keys()
            n += found.values()
            if len(words) >= SLICE // 16:
                yield rows()
                owner, words, n = [], [], []
        if words:
            yield rows()


def misspell(words: DataFrame, every: int = 97) -> DataFrame:
    """Delete one code point of each word whose checksum ``h`` with its document
    (crc32 of ``doc_id:word``) is a multiple of ``every``: that with number
    ``h mod length``. A null id changes nothing."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")).cast("binary"))
    cut = F.pmod(F.col("_h"), F.length("word").cast("long")).cast("int")
    less = F.concat(F.substring("word", F.lit(1), cut), F.substring("word", cut + 2, F.length("word")))
    # a filter on the result stays above the generator: no checksum is computed twice
    made = F.explode(F.array(F.when(F.col("_h") % every == 0, less).otherwise(F.col("word")))).alias("_made")
    out = words.withColumn("_h", h).select(*words.columns, made)
    return out.select(*[F.col("_made").alias("word") if c == "word" else F.col(c) for c in words.columns])


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough; null words
    are ignored. A column ``n`` says for how many occurrences a row stands (else one)."""
    n = F.sum("n") if "n" in words.columns else F.count(F.lit(1))
    return (words.where(F.length("word") >= least_length).groupBy("word").agg(n.alias("n"))
            .where(F.col("n") >= least_count))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _first_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, n, back, text, wid, start, depth, node, next, to, bit`` for each prefix
    (backwards: suffix) that a state of this word or of a neighbour may reach:
    ``next`` is the code point after it (0 at the word's end), ``to`` the prefix
    with it, ``bit`` the signature of what then remains."""
    for b in batches:
        words = b.column("word").to_pylist()
        a = 0
        while a < len(words):
            z, size = a, 0
            while z < len(words) and (z == a or size + len(words[z]) < SLICE):
                size += len(words[z])
                z += 1
            for back in (0, 1):
                texts = [t[::-1] for t in words[a:z]] if back else words[a:z]
                length = np.array([len(t) for t in texts], np.int64)
                cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
                first = np.concatenate([[0], np.cumsum(length)[:-1]])
                place = np.arange(len(cp)) - np.repeat(first, length)
                power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(length.max()), 0x9E3779B97F4A7C15, np.uint64)]))
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(cp.astype(np.uint64) + np.uint64(1)) * power[place])])
                # a neighbour has a character more or fewer: start where the shorter one would
                low = length // 2 if back else (length - 1) // 2
                n = length - low + 1
                owner = np.repeat(np.arange(len(length)), n)
                depth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + low[owner]
                at = first[owner] + depth
                node = _mix(total[at] - total[first[owner]] + depth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(back)).view(np.int64)
                end = depth == length[owner]
                follows = np.where(end, 0, cp[np.where(end, 0, at)]).astype(np.int32)
                bit = [_signature(texts[o][d + 1:d + 1 + AHEAD]) for o, d in zip(owner.tolist(), depth.tolist())]
                # beyond DEEP a prefix names its word by digest: long words are not repeated for each
                named, below = pa.array(owner.astype(np.int32), mask=(depth >= DEEP) & ~end), pa.array(owner.astype(np.int32), mask=depth < DEEP)
                ids = pa.array([hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() if len(t) >= DEEP else None for t in texts], pa.binary())
                start = (length - length // 2 if back else length // 2).astype(np.int32)
                columns = [pa.array(words[a:z]), b.column("n").slice(a, z - a), pa.array(texts)]
                to = np.where(end, 0, np.append(node[1:], 0))
                for i in range(0, len(owner), SLICE):
                    j = slice(i, i + SLICE)
                    yield pa.RecordBatch.from_arrays(
                        [columns[0].take(named[j]), columns[1].take(named[j]), pa.array(np.full(len(depth[j]), bool(back))), columns[2].take(named[j]),
                         ids.take(below[j]), pa.array(start[owner[j]]), pa.array(depth[j].astype(np.int32)), pa.array(node[j]), pa.array(follows[j]),
                         pa.array(to[j]), pa.array(bit[j], pa.int32())], ["word", "n", "back", "text", "wid", "start", "depth", "node", "next", "to", "bit"])
            a = z


def _signature(rest: str) -> int:
    return xxhash.xxh64_intdigest(rest.encode("utf-8", "surrogatepass"), seed=42) & 63


def _bit(text: Column, pos: Column) -> Column:
    """The signature of the text from ``pos`` on, as in :func:`_signature`."""
    return F.pmod(F.xxhash64(F.substring(text, pos + 1, F.lit(AHEAD))), F.lit(64)).cast("int")


STEP = "word string, n bigint, back boolean, text string, wid binary, start int, depth int, node bigint, next int, to bigint, bit int"


def _deep(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and first states beyond ``DEEP`` characters, where a trie is mostly
    single threads: nodes are only the prefixes after which words differ or
    end, an edge carries all characters up to the next node."""
    deep = steps.where(F.col("depth") >= DEEP)
    node = deep.groupBy("node").agg(F.min("next").alias("low"), F.max("next").alias("high"), F.max(F.col("depth") == DEEP).alias("top"))
    node = node.where("low != high OR low = 0 OR top").select("node")
    at = (deep.select("wid", "back", "depth", "node").join(node, "node").groupBy("wid", "back")
          .agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("at")))        # a word's own prefixes
    long = deep.where("next = 0").select("wid", "back", "text", "start", "n")
    at = at.join(long, ["wid", "back"])
    pairs = F.transform(F.slice("at", F.lit(2), F.size("at")), lambda x, i: F.struct(F.get("at", i).alias("a"), x.alias("z")))
    edge = at.select("text", F.explode(pairs).alias("x"))
    edge = edge.select(F.col("x.a.node").alias("node"), F.col("x.a.depth").alias("depth"), F.col("x.z.node").alias("to"),
                       F.substring("text", F.col("x.a.depth") + 1, F.col("x.z.depth") - F.col("x.a.depth")).alias("label"),
                       _bit(F.col("text"), F.col("x.z.depth")).alias("bit"))
    states = at.select("text", "back", "start", "n", F.explode("at").alias("x")).where(F.col("x.depth") >= F.col("start"))
    return edge, states.select("text", "back", F.col("x.depth").alias("pos"), F.col("x.node").alias("node"), F.col("x.depth").alias("depth"),
                               F.when(F.col("x.depth") == F.length("text"), F.col("n")).alias("n"))


def _tables(words: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Edges and states without edits, written by depth; a state at the end of
    its word also says how often (``n``) the word occurs."""
    spark = words.sparkSession
    words = words.select("word", "n")
    steps = words.mapInArrow(_first_characters, STEP)
    deep_edges, deep_states = _deep(words.where(F.length("word") >= DEEP).mapInArrow(_first_characters, STEP))
    edges = steps.where((F.col("depth") < DEEP) & (F.col("next") > 0)).select(
        "node", "depth", "to", _character(F.col("next")).alias("label"), "bit")
    edges = edges.unionByName(deep_edges).groupBy("node", "depth", "to", "label").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("ahead"))
    edges.write.partitionBy("depth").parquet(f"{folder}/edges")
    states = steps.where((F.col("depth") < DEEP) & (F.col("depth") >= F.col("start"))).select(
        "text", "back", F.col("depth").alias("pos"), "node", "depth", F.when(F.col("next") == 0, F.col("n")).alias("n"))
    states.unionByName(deep_states).write.partitionBy("depth").parquet(f"{folder}/states")
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")       # noqa: E731
    return (read("edges", "node bigint, to bigint, label string, ahead bigint, depth int"),
            read("states", "text string, back boolean, pos int, node bigint, n bigint, depth int"))


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def neighbours(words: DataFrame) -> DataFrame:
    """``word, near, near_n`` for all pairs of different words of ``word, n``
    (distinct words) that are one inserted, deleted or replaced code point
    apart, each in both directions. An empty table gives an empty result; null
    words are ignored."""
    spark = words.sparkSession
    words = words.where("word IS NOT NULL")
    edges, states = _tables(words, scratch_path(spark, f"spelling-{uuid.uuid4().hex}"))
    whole = F.when(F.col("back"), F.reverse("text")).otherwise(F.col("text"))
    ends = states.where("n IS NOT NULL").select("node", whole.alias("near"), F.col("n").alias("near_n"))
    fresh = states.drop("n")
    text, pos, length = F.col("text"), F.col("pos"), F.length("text")
    label, size = F.col("label"), F.length("label")
    part = lambda at, n: F.substring(text, at + 1, n)                                       # noqa: E731
    mine, after, c, tail = part(pos, F.lit(1)), part(pos + 1, F.lit(1)), F.substring("label", 1, 1), F.substring(label, F.lit(2), size)

    def move(fits: Column, to: Column, bit: Column | None = None) -> Column:
        """The state at position ``to`` if what remains may lie below the edge."""
        return F.when(fits & (F.getbit("ahead", _bit(text, to) if bit is None else bit) == 1), to)

    # an edge of one character: the three signatures in question are computed once a state, not once an edge
    bits = [F.shiftright("bits", 8 * i).bitwiseAND(F.lit(63)) for i in range(3)]
    packed = _bit(text, pos) + F.shiftleft(_bit(text, pos + 1), 8) + F.shiftleft(_bit(text, pos + 2), 16)
    plain = F.array(
        move((F.col("edits") == 1) & (c == mine), pos + 1, bits[1]),
        move((F.col("edits") == 0) & (c != mine) & (pos < length), pos + 1, bits[1]),
        move((F.col("edits") == 0) & (c != mine), pos, bits[0]),
        move((F.col("edits") == 0) & (c != mine) & (pos + 1 < length) & (c == after), pos + 2, bits[2]))
    moves = F.array(
        move((F.col("edits") == 1) & (label == part(pos, size)), pos + size),
        move((F.col("edits") == 0) & (c != mine) & (pos < length) & (tail == part(pos + 1, size - 1)), pos + size),           # replaced
        move((F.col("edits") == 0) & (c != mine) & (tail == part(pos, size - 1)), pos + size - 1),                            # inserted
        move((F.col("edits") == 0) & (c != mine) & (pos + 1 < length) & (label == part(pos + 1, size)), pos + size + 1))      # deleted
    # a word that ends one before this one's end
    done = [fresh.where(pos + 1 == length).select("text", "back", "node")]
    waiting = None
    depths = sorted(r["depth"] for r in edges.select("depth").distinct().collect())         # one number a level
    for d in depths:
        now = fresh.where(F.col("depth") == d).withColumn("edits", F.lit(0))
        if waiting is not None:
            now = now.unionByName(waiting.where(F.col("depth") == d).withColumn("edits", F.lit(1)))
        level = edges.where(F.col("depth") == d).select("node", "to", "label", "ahead")
        if d < DEEP:
            now = now.withColumn("bits", packed)
        met = now.drop("depth").join(level, "node")
        moved = met.where((F.col("edits") == 0) | (c == mine)).select("text", "back", "to", (F.lit(d) + size).alias("depth"), F.explode(F.array_compact(plain if d < DEEP else moves)).alias("pos"))
        moved = moved.select("text", "back", "pos", F.col("to").alias("node"), "depth")
        later = waiting.where(F.col("depth") > d) if waiting is not None and d >= DEEP else None
        waiting = (moved if later is None else moved.unionByName(later)).checkpoint()
        done.append(waiting.where((pos == length) & (F.col("depth") > d)).select("text", "back", "node"))
        waiting = waiting.where(pos < length)
    out = done[0]
    for f in done[1:]:
        out = out.unionByName(f)
    out = out.join(ends, "node").withColumn("word", whole)
    half = F.floor(F.length("word") / 2).cast("int")
    # pairs that agree on the first half were found forwards
    once = ~F.col("back") | (F.substring("word", F.lit(1), half) != F.substring("near", F.lit(1), half))
    return out.where(once & (F.levenshtein("word", "near", 1) == 1)).select("word", "near", "near_n")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per word of ``word, n``: ``word, form, root, n, n_near, form_n``.

    ``form`` is the most frequent near word (ties: the smallest) if it occurs
    at least ``ratio`` times as often as the word, else null; ``root`` is the
    last of the forms that follow from the word (itself if it has none).
    """
    if ratio < 2:
        raise ValueError("forms must become more frequent, or roots may run in circles")
    ensure_checkpoint_dir(words.sparkSession)
    words = words.where("word IS NOT NULL").select("word", "n").checkpoint()
    near = neighbours(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    sure = -F.col("best.rank") >= ratio * F.col("n")
    out = words.join(near, "word", "left").select(
        "word", F.when(sure, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(sure, -F.col("best.rank")).alias("form_n")).checkpoint()
    roots = _last(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _last(links: DataFrame) -> DataFrame:
    """The end of the chain that starts at each ``word`` (``word, root``: each
    word's next). Every round doubles the distance looked ahead; counts at least
    double along a chain, so there are at most six rounds."""
    while True:
        ahead = links.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        new = links.join(ahead, F.col("root") == F.col("_w"), "left")
        new = new.select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")).checkpoint()
        links = new.select("word", "root")
        if new.where("moved").isEmpty():
            return links
