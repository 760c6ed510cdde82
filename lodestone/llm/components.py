"""Connected components by alternating large-star and small-star, on tables of links.

Every round is two aggregations and joins on node ids; no node's neighbours are ever gathered. A round's links are
written to the shared folder, so the lineage stays short and lost executors cost one round at most.

Defined results: links with a null end, and from a node to itself, are left out; repeated links count once, in either
direction; nodes without a link are in no component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(links: DataFrame) -> DataFrame:
    """Links every node's larger neighbours to the least of the node and its neighbours."""
    pairs = _both_ways(links)
    least = pairs.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    return pairs.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Links every node and its smaller neighbours to the least of these."""
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.min("b").alias("least"))
    joined = pairs.join(least, "a")
    own = least.select("a", F.col("least").alias("b"))
    others = joined.where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return own.unionByName(others).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())


def connected_components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component (the least node that can be reached) of every node in ``links`` (a long, b long)."""
    now = stored(links.where("a is not null and b is not null and a != b").select("a", "b").distinct(), "links")
    mark = _mark(now)
    for _ in range(rounds):
        new = stored(small_star(large_star(now)), "links")
        new_mark = _mark(new)
        if new_mark == mark:
            break
        now, mark = new, new_mark
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
