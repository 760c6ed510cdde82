"""Points that lie in intervals, without comparing each with all.

An interval [low, high) of whole numbers is the union of a few blocks of a power of two, two of each size at most; a point
lies in one block of each size. Both are written as rows of (size, block) and joined there, so a point meets an interval
exactly once, however long the intervals are, and an interval without end is as cheap as a short one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers are below two to this power.
BITS = 40


def _blocks(low: Column, high: Column) -> Column:
    """The blocks (size, block) of an interval, from small ones at its ends to large ones inside."""
    kind = "array<struct<size:int,block:long>>"
    none = F.array().cast(kind)
    start = F.struct(low.cast("long").alias("a"), high.cast("long").alias("b"), none.alias("out"))
    one = lambda size, block: F.array(F.struct(size.alias("size"), block.alias("block"))).cast(kind)

    def step(s: Column, size: Column) -> Column:
        more = s["a"] < s["b"]
        left, right = more & (s["a"] % 2 == 1), more & (s["b"] % 2 == 1)
        found = F.concat(s["out"], F.when(left, one(size, s["a"])).otherwise(none), F.when(right & (~left | (s["a"] + 1 < s["b"])), one(size, s["b"] - 1)).otherwise(none))
        return F.struct(F.floor((s["a"] + left.cast("long")) / 2).alias("a"), F.floor((s["b"] - right.cast("long")) / 2).alias("b"), found.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS)), start, step, lambda s: s["out"])


def points_in(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str) -> DataFrame:
    """Every point (column ``at``) with every interval from ``low`` up to ``high`` (null: without end) that it lies in.

    The columns of both, which must differ. Points and borders below 0 or from two to the power of 40 on are refused by
    the caller's choice of units; null points and null ``low`` lie nowhere.
    """
    top = F.lit(1 << BITS)
    cut = intervals.where(F.col(low).isNotNull()).withColumn("_b", F.explode(_blocks(F.col(low), F.least(F.coalesce(F.col(high), top), top))))
    blocks = cut.select(*intervals.columns, F.col("_b.size").alias("_size"), F.col("_b.block").alias("_block"))
    sizes = F.transform(F.sequence(F.lit(0), F.lit(BITS)), lambda k: F.struct(k.alias("size"), F.call_function("shiftright", F.col(at).cast("long"), k).alias("block")))
    placed = points.where(F.col(at).isNotNull()).withColumn("_p", F.explode(sizes)).select(*points.columns, F.col("_p.size").alias("_size"), F.col("_p.block").alias("_block"))
    return placed.join(blocks, ["_size", "_block"]).drop("_size", "_block")
