"""Exact statistics of large groups without gathering one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.sources.shared import written

#: Ranges that values are cut into at a time, and the distinct values that one task may put in order.
RANGES, MOST = 64, 200_000


def _fullest(now: DataFrame) -> int:
    """Distinct values of the fullest slot."""
    return now.groupBy("_key", "slot").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0] or 0


def exact_percentiles(rows: DataFrame, key: str, value: str, wanted: dict[str, float], most: int = MOST) -> DataFrame:
    """key, n and, for each name in ``wanted``, the interpolated percentile of the group's values; nulls don't count.

    Equal values are counted first. A mergeable sketch of a group's distinct values gives borders between which about
    equally many lie, whatever their distances; counts are summed over these ranges, and only ranges that hold a wanted
    rank are looked into: cut again while they have more than ``most`` distinct values, then put in order. So no task
    holds a group's values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    now = written(counts.withColumn("slot", F.lit("")), "value-counts")
    sizes = now.groupBy("_key").agg(F.sum("c").alias("n"))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q")) for name, q in wanted.items()])
    asked = sizes.select("_key", "n", F.explode(ranks).alias("a")).select("_key", "n", "a.name", (F.col("a.q") * (F.col("n") - 1)).alias("at"))
    # each rank needs the values at its floor and at its ceiling; ``k`` counts from the start of their slot
    places = asked.select("_key", "n", "name", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("place")).distinct()
    places = written(places.select("*", F.lit("").alias("slot"), F.col("place").alias("k")), "places")
    while _fullest(now) > most:
        cuts = now.groupBy("_key", "slot").agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 10_000).alias("cuts"))
        cut = now.join(cuts, ["_key", "slot"]).withColumn("r", F.size(F.filter("cuts", lambda x: x < F.col("v"))))
        placed = cut.select("_key", "v", "c", "r", F.col("slot").alias("before"), F.concat_ws(".", "slot", F.col("r").cast("string")).alias("slot"))
        ranges = placed.groupBy("_key", "before", "slot", "r").agg(F.sum("c").alias("c"))
        along = W.partitionBy("_key", "before").orderBy("r").rowsBetween(W.unboundedPreceding, -1)
        ranges = ranges.withColumn("first", F.coalesce(F.sum("c").over(along), F.lit(0)))
        inside = (F.col("k") >= F.col("first")) & (F.col("k") < F.col("first") + F.col("c"))
        met = places.withColumnRenamed("slot", "before").join(ranges, ["_key", "before"]).where(inside)
        places = written(met.select("_key", "n", "name", "at", "place", "slot", (F.col("k") - F.col("first")).alias("k")), "places")
        now = written(placed.select("_key", "slot", "v", "c").join(places.select("_key", "slot").distinct(), ["_key", "slot"], "left_semi"), "value-ranges")
    order = W.partitionBy("_key", "slot").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    inner = now.withColumn("first", F.coalesce(F.sum("c").over(order), F.lit(0)))
    met = places.join(inner, ["_key", "slot"]).where((F.col("k") >= F.col("first")) & (F.col("k") < F.col("first") + F.col("c")))
    picked = met.groupBy("_key", "name", "n", "at").agg(F.max(F.when(F.col("place") == F.floor("at"), F.col("v"))).alias("a"), F.max(F.when(F.col("place") == F.ceil("at"), F.col("v"))).alias("b"))
    found = picked.withColumn("p", F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at")))
    return found.groupBy(F.col("_key").alias(key), "n").agg(*[F.max(F.when(F.col("name") == name, F.col("p"))).alias(name) for name in wanted])
