"""Merkle fixity audit of WARC replicas.

Records lie in segments (files) at byte offsets. Each record's SHA-256 is a
leaf; a node covers an offset range of its segment and hashes its children in
order, up to one root per segment. Two replicas are compared root by root, and
only children of mismatching nodes are looked at on the way down, until the
damaged records are found.

Scale: every level is one aggregation keyed by (segment, range), so a segment
with a third of all records is spread over its ranges; a node gathers at most
the digests of ``RANGE`` bytes of records or of ``FAN`` children. Payloads are
hashed where they are read and never shuffled; trees are a few bytes per
record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratocast.session import ensure_checkpoint_dir

RANGE = 1 << 16            # bytes of a segment under one lowest node
FAN = 16                   # children of a higher node
SEGMENT_IDS = 256          # page ids in one segment


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """Bytes of a WARC response record; null url and html are empty."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def manifest(pages: DataFrame, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Lay pages out as WARC segments: ``page_id, segment, offset, length,
    digest``. ``segment_ids`` consecutive ids share a segment; rows lie in the
    order of id and digest (rows that repeat an id lie one after another).
    Null ids form the segment with a null number."""
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select("page_id", F.floor(F.col("page_id") / segment_ids).cast("bigint").alias("segment"),
                        F.octet_length(record).cast("bigint").alias("length"), F.sha2(record, 256).alias("digest"))
    w = Window.partitionBy("segment").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0).cast("bigint")))


def tree(leaves: DataFrame, depth: int, range_bytes: int = RANGE, fan: int = FAN) -> list[DataFrame]:
    """Levels of nodes ``segment, node, hash``, lowest first; the last one
    (after ``depth`` levels) holds the roots. ``leaves``: ``segment, offset,
    digest``; two records at one offset are ordered by digest."""
    rows = leaves.select("segment", F.floor(F.col("offset") / range_bytes).cast("bigint").alias("node"), F.col("offset").alias("at"), F.col("digest").alias("hash"))
    levels = []
    for _ in range(depth):
        listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: F.concat_ws(":", x["at"].cast("string"), x["hash"]))
        level = rows.groupBy("segment", "node").agg(F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("hash")).checkpoint()
        levels.append(level)
        rows = level.select("segment", F.floor(F.col("node") / fan).cast("bigint").alias("node"), F.col("node").alias("at"), "hash")
    return levels


def _depth(tables: list[DataFrame], range_bytes: int, fan: int) -> int:
    """Levels until one node covers the longest segment of any table."""
    ranges = 1 + max((t.agg(F.max("offset")).first()[0] or 0) // range_bytes for t in tables)
    depth = 1
    while ranges > 1:
        ranges, depth = -(-ranges // fan), depth + 1
    return depth


def _differing(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose values differ or that one side lacks."""
    both = a.select(*keys, F.col(value).alias("_x"), F.lit(0).alias("_side")).unionByName(b.select(*keys, F.col(value).alias("_x"), F.lit(1).alias("_side")))
    # at most a few rows per key: one of each side, or records at one offset
    sides = [F.array_sort(F.collect_list(F.when(F.col("_side") == i, F.col("_x")))) for i in (0, 1)]
    return both.groupBy(*keys).agg(sides[0].alias("_a"), sides[1].alias("_b")).where("_a != _b").select(*keys)


def _within(rows: DataFrame, parents: DataFrame, node: Column) -> DataFrame:
    """Rows whose (segment, node) is in ``parents``."""
    p = parents.select(F.col("segment").alias("_s"), F.col("node").alias("_n"))
    r = rows.withColumn("_node", node)
    return r.join(p, r["segment"].eqNullSafe(p["_s"]) & (r["_node"] == p["_n"]), "left_semi").drop("_node")


def audit(original: DataFrame, replica: DataFrame, range_bytes: int = RANGE, fan: int = FAN) -> DataFrame:
    """Damaged places ``segment, offset, page_id, length, status``.

    Inputs hold ``segment, offset, length, digest, page_id`` (a manifest of the
    original; the same places as read from the replica). Status: ``missing``
    (only in the original), ``extra`` (only in the replica), ``resized`` or
    ``changed``. Equal replicas and empty tables give no rows; a row repeated
    at one place counts as damage when its number differs.
    """
    ensure_checkpoint_dir(original.sparkSession)
    cols = ["segment", "offset", "length", "digest", "page_id"]
    a, b = original.select(cols).checkpoint(), replica.select(cols).checkpoint()
    depth = _depth([a, b], range_bytes, fan)
    trees = tree(a, depth, range_bytes, fan), tree(b, depth, range_bytes, fan)
    bad = _differing(trees[0][-1], trees[1][-1], ["segment", "node"], "hash")
    for level in reversed(range(depth - 1)):
        parent = F.floor(F.col("node") / fan).cast("bigint")
        bad = _differing(*[_within(t[level], bad, parent) for t in trees], ["segment", "node"], "hash").checkpoint()
    x, y = (_within(t, bad, F.floor(F.col("offset") / range_bytes).cast("bigint")) for t in (a, b))
    places = [t.groupBy("segment", "offset").agg(F.array_sort(F.collect_list("digest")).alias("d"), F.sum("length").alias("length"), F.min("page_id").alias("page_id"))
              for t in (x, y)]
    l, r = (p.select(F.col("segment").alias(f"s{i}"), F.col("offset").alias(f"o{i}"), F.col("d").alias(f"d{i}"), F.col("length").alias(f"l{i}"), F.col("page_id").alias(f"p{i}"))
            for i, p in enumerate(places))
    j = l.join(r, l["s0"].eqNullSafe(r["s1"]) & (l["o0"] == r["o1"]), "full")
    status = (F.when(F.col("o1").isNull(), "missing").when(F.col("o0").isNull(), "extra")
              .when(F.col("d0") == F.col("d1"), None).when(F.col("l0") != F.col("l1"), "resized").otherwise("changed"))
    has = F.col("o0").isNotNull()
    return j.select(F.when(has, F.col("s0")).otherwise(F.col("s1")).alias("segment"), F.coalesce("o0", "o1").alias("offset"),
                    F.when(has, F.col("p0")).otherwise(F.col("p1")).alias("page_id"),
                    F.coalesce("l0", "l1").alias("length"), status.alias("status")).where("status IS NOT NULL")
