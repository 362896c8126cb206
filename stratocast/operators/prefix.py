"""Ordered running sums without a single-task window.

A window without ``partitionBy`` sends every row to one task. That is fine
for up to about a million small rows and fatal at cluster scale, where the
ordered input (distinct scores, distinct values of a measured column) can
hold billions of rows, and one partition key may hold a third of them.

The plan, the same for every size:

1. cut the order column at approximate quantiles (``approxQuantile``; the
   driver receives one double per bucket), so the bucket is a
   deterministic function of the value and survives recomputation;
2. sum each (partition, bucket) -- a table of at most groups x buckets rows;
3. running sum over that small table gives each bucket's offset;
4. the final window is partitioned by (partition, bucket), so each task sorts
   about ``rows_per_bucket`` rows, and the offset is added back.

The same plan gives ``next`` (the following order value), crossing bucket
borders through the first value of the next non-empty bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 250_000
# The driver and the plan hold one bound a bucket; beyond this many buckets
# these grow instead, and their tasks sort with spill.
MAX_BUCKETS = 20_000
# A side of at most this many rows is broadcast; above it AQE picks the join.
BROADCAST_ROWS = 1_000_000

_BKT = "_pfx_bucket"

# intermediates persisted by the operators of this package (released by release_cached)
_CACHED: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist an intermediate that several jobs read, and remember it."""
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    _CACHED.append(out)
    return out


def cached_count() -> int:
    """How many intermediates are kept now."""
    return len(_CACHED)


def release_cached(since: int = 0) -> int:
    """Unpersist the intermediates kept so far (call when a flow is done), or
    those kept after the first ``since``."""
    n = max(0, len(_CACHED) - since)
    while len(_CACHED) > since:
        _CACHED.pop().unpersist()
    return n


def attach_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the values of a one-row frame (totals, counts) to every row.

    The single row is fetched (a bounded scalar action) and its values become
    typed literals: no join, no shuffle of ``df``. An empty frame gives nulls.
    """
    row = one.first()
    cols = [F.lit(None if row is None else row[f.name]).cast(f.dataType).alias(f.name)
            for f in one.schema.fields]
    return df.select("*", *cols)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, known_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when its row count is at most ``max_rows``;
    otherwise leave the join strategy to AQE.

    ``known_rows`` is an upper bound the caller knows from its parameters
    (one row per tracked column, say); then no counting job is needed.
    """
    if known_rows is not None and known_rows <= max_rows:
        return F.broadcast(df)
    kept = keep(df)
    return F.broadcast(kept) if kept.count() <= max_rows else kept


def collapse(df: DataFrame, keys: Sequence[str], sum_cols: Sequence[str | Column],
             names: Sequence[str] | None = None) -> DataFrame:
    """One row per distinct key tuple with the sums of ``sum_cols``.

    This is the map-side-combined shuffle that makes the ordered step small:
    its output is bounded by the number of distinct keys, not by rows.
    """
    exprs = []
    for i, c in enumerate(sum_cols):
        col = F.col(c) if isinstance(c, str) else c
        name = names[i] if names else (c if isinstance(c, str) else f"s{i}")
        exprs.append(F.sum(col).alias(name))
    return df.groupBy(*keys).agg(*exprs)


def _order(c: str, descending: bool) -> Column:
    return F.col(c).desc() if descending else F.col(c).asc()


def running_totals(df: DataFrame, order_col: str, sum_cols: Sequence[str],
                   partition_cols: Sequence[str] = (), descending: bool = False,
                   with_next: bool = False, prefix: str = "cum_",
                   rows_per_bucket: int = ROWS_PER_BUCKET, next_cols: Sequence[str] = (),
                   totals: dict | None = None) -> DataFrame:
    """Add inclusive running sums ``{prefix}{c}`` of ``sum_cols`` in ``order_col`` order.

    Rows should be unique per (``partition_cols``, ``order_col``) and the
    order column numeric; use :func:`collapse` first. Null order values sort
    first ascending and last descending; a null partition value is a partition
    of its own. With
    ``with_next`` a column ``next_{order_col}`` holds the following order value
    within the partition (null for the last one); ``next_cols`` does the same
    for other columns (a ``lead`` that crosses bucket borders). A ``totals``
    dict receives the row count (``"n"``) and the grand total of each sum
    column, taken in the same job as the size check.
    """
    partition_cols = list(partition_cols)
    nexts = list(dict.fromkeys(([order_col] if with_next else []) + list(next_cols)))
    base = keep(df)
    row = base.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{c}") for c in sum_cols]).first()
    n = row["_n"]
    if totals is not None:
        totals["n"] = n
        totals.update({c: row[f"_t_{c}"] for c in sum_cols})
    nb = max(1, min(MAX_BUCKETS, math.ceil(n / rows_per_bucket)))
    probs = [i / nb for i in range(1, nb)]
    bounds = sorted(set(base.approxQuantile(order_col, probs, 1.0 / (4 * nb)))) if probs else []
    bucketed = _bucketize(base, order_col, bounds)

    # (2) per-bucket sums and (3) offsets over the small table.
    bkt_order = F.col(_BKT).desc() if descending else F.col(_BKT).asc()
    first_row = F.struct(*[F.col(c).alias(c) for c in nexts]) if nexts else F.lit(None)
    pick = F.max_by if descending else F.min_by
    per_bucket = bucketed.groupBy(*partition_cols, _BKT).agg(
        *[F.sum(c).alias(f"_pfx_b_{c}") for c in sum_cols],
        pick(first_row, F.col(order_col)).alias("_pfx_first"),
    )
    wb = Window.partitionBy(*partition_cols).orderBy(bkt_order)
    wprev = wb.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *partition_cols, _BKT,
        *[F.coalesce(F.sum(f"_pfx_b_{c}").over(wprev), F.lit(0)).alias(f"_pfx_o_{c}") for c in sum_cols],
        F.lead("_pfx_first").over(wb).alias("_pfx_next_first"),
    )
    # groups x buckets rows: broadcast after a size check (without partition
    # columns there is one row per bucket); null keys must meet null keys
    offsets = offsets.select(*[F.col(c).alias(f"_pfx_k_{c}") for c in [*partition_cols, _BKT]],
                             *[F.col(f"_pfx_o_{c}") for c in sum_cols], "_pfx_next_first")
    offsets = broadcast_if_small(offsets, known_rows=None if partition_cols else nb + 1)
    same = F.lit(True)
    for c in [*partition_cols, _BKT]:
        same = same & F.col(c).eqNullSafe(F.col(f"_pfx_k_{c}"))
    joined = bucketed.join(offsets, same, "inner")

    # (4) window inside each (partition, bucket)
    w = Window.partitionBy(*partition_cols, _BKT).orderBy(_order(order_col, descending))
    wrun = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out_cols = [F.col(c) for c in df.columns]
    out_cols += [(F.sum(c).over(wrun) + F.col(f"_pfx_o_{c}")).alias(f"{prefix}{c}") for c in sum_cols]
    for c in nexts:
        # within the bucket, lead; on its last row, the first row of the next bucket
        last = F.lead(F.lit(1)).over(w).isNull()
        out_cols.append(F.when(last, F.col("_pfx_next_first")[c]).otherwise(F.lead(c).over(w))
                        .alias(f"next_{c}"))
    return joined.select(*out_cols)


def _bucketize(df: DataFrame, order_col: str, bounds: list[float]) -> DataFrame:
    # a null order value gets bucket -1: first in ascending order and last in
    # descending order, as the window's default null ordering puts it
    if not bounds:
        return df.withColumn(_BKT, F.when(F.col(order_col).isNull(), F.lit(-1)).otherwise(F.lit(0)))
    tmp = "_pfx_v"
    b = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol=tmp, outputCol=_BKT, handleInvalid="keep")
    out = b.transform(df.withColumn(tmp, F.col(order_col).cast("double")))
    return out.withColumn(_BKT, F.coalesce(F.col(_BKT).cast("int"), F.lit(-1))).drop(tmp)


def cut_ranges(df: DataFrame, order_col: str, rows_per_range: int = ROWS_PER_BUCKET, name: str = "range") -> DataFrame:
    """Add the number of the range of ``order_col`` (numeric) a row lies in:
    ranges follow each other, hold about ``rows_per_range`` rows, and equal
    values share one. Nulls are range -1."""
    base = keep(df)
    nb = max(1, min(MAX_BUCKETS, math.ceil(base.count() / rows_per_range)))
    bounds = sorted(set(base.approxQuantile(order_col, [i / nb for i in range(1, nb)], 1.0 / (4 * nb)))) if nb > 1 else []
    return _bucketize(base, order_col, bounds).withColumnRenamed(_BKT, name)


def row_index(df: DataFrame, order_col: str, partition_cols: Sequence[str] = (),
              descending: bool = False, name: str = "idx", **kw) -> DataFrame:
    """0-based position of each row in ``order_col`` order (values unique)."""
    one = df.withColumn("_pfx_one", F.lit(1).cast("long"))
    out = running_totals(one, order_col, ["_pfx_one"], partition_cols, descending, prefix="_c", **kw)
    return out.withColumn(name, F.col("_c_pfx_one") - 1).drop("_pfx_one", "_c_pfx_one")
