"""Positions of regular-expression matches, as JVM expressions.

A match is wrapped in a private-use character and the text is split there, so
pieces and matches alternate and their lengths give all positions in one
linear pass. Every step is its own column: inside a lambda, the optimizer
would otherwise evaluate an inlined array once per element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, STAND_IN = "", ""
_BLOCK = 256


def markable(text: Column) -> Column:
    """The text with the marking character replaced (one code point each);
    null becomes empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(STAND_IN))


def add_spans(df: DataFrame, text: str, pattern: str, name: str, context: int = 0) -> DataFrame:
    """Add array ``name`` of ``start, end, value, before, after`` for the
    leftmost non-overlapping matches of ``pattern`` in column ``text`` (made
    with :func:`markable`). Offsets are code points, end exclusive; ``before``
    and ``after`` hold up to ``context`` characters up to the next match.
    """
    parts, lens, blocks, starts = (f"_{name}_{x}" for x in ("parts", "lens", "blocks", "starts"))
    df = df.withColumn(parts, F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK))
    df = df.withColumn(lens, F.transform(parts, F.length))
    # running sum in blocks, so that appending stays cheap for many matches
    df = df.withColumn(blocks, F.when(F.size(lens) > 1, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / _BLOCK).cast("int")),
        lambda b: F.slice(lens, b * _BLOCK + 1, F.lit(_BLOCK)))))
    upto = F.aggregate(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n)), F.array(F.lit(0)),
                       lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))
    empty = F.array().cast("array<int>")
    df = df.withColumn(f"{blocks}_at", F.when(F.col(blocks).isNotNull(), upto))
    df = df.withColumn(starts, F.when(F.col(blocks).isNotNull(), F.flatten(F.zip_with(
        blocks, F.slice(f"{blocks}_at", F.lit(1), F.size(blocks)),
        lambda x, o: F.aggregate(x, F.struct(o.alias("at"), empty.alias("out")),
                                 lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
                                 lambda a: a["out"])))))
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    df = df.withColumn(name, F.when(F.size(parts) > 1, F.transform(
        F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)),
        lambda i: F.struct(
            F.get(starts, i).alias("start"), (F.get(starts, i) + F.get(lens, i)).alias("end"), F.get(parts, i).alias("value"),
            F.right(F.get(parts, i - 1), F.lit(context)).alias("before"),
            F.left(F.get(parts, i + 1), F.lit(context)).alias("after")))).otherwise(none))
    return df.drop(parts, lens, blocks, f"{blocks}_at", starts)
