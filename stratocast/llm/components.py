"""Connected components of an edge table, as joins and aggregates.

Alternating star contraction: each round hangs every node on the smallest
node it knows, from both sides, until nothing changes. The number of rounds
grows with the logarithm of the longest path. Edges stay on the executors;
each round is written to the shared checkpoint folder, so a lost executor
costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. ``edges`` has ``u > v``.

    Large: each node hangs its larger neighbours on its smallest neighbour.
    Small: each node hangs its smaller neighbours and itself on the smallest.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    j = both.join(low, "u")
    if large:
        out = j.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (j.select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(low.select("u", F.col("m").alias("v"))))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (two columns of one orderable
    type); ``root`` is the smallest node it is connected with.

    Self loops, repeated edges and both directions are allowed; rows with a
    null end are ignored. An empty table gives an empty result. Raises if
    ``max_rounds`` rounds do not suffice (never returns a partial answer).
    """
    a, b = edges.columns[:2]
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("x"), F.col(b).alias("y"))
    e = e.where("x IS NOT NULL AND y IS NOT NULL AND u != v").select("u", "v").distinct().checkpoint()

    def state(x: DataFrame):
        return x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    last = state(e)
    for _ in range(max_rounds):
        if last[0] == 0:
            break
        e = _star(_star(e, large=True), large=False).checkpoint()
        now = state(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
