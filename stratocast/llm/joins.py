"""A left join whose left side may hold one key very often."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread_by: str, salts: int = SALTS) -> DataFrame:
    """``left`` left-joined with ``right`` (one row per ``key``).

    Rows of a key are dealt to ``salts`` tasks by a hash of ``spread_by``, and
    each row of ``right``, the smaller side, is repeated for each of them. A
    null key joins nothing.
    """
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    copies = right.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("_salt"))
    return dealt.join(copies, [key, "_salt"], "left").drop("_salt")
