"""What goes into a prompt: instructions without conflicts, history that fits, providers, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECURITY = 1


def resolved_instructions(rows: DataFrame, key: str) -> DataFrame:
    """Keeps every security instruction and, of each other subject, the latest of the highest level; adds the label.

    rows: key, id, category, level, subject, stated_at, is_correction. A subject that security claims drops the others.
    """
    guarded = F.max((F.col("category") == SECURITY).cast("int")).over(W.partitionBy(key, "subject")) == 1
    best = W.partitionBy(key, "subject").orderBy(F.desc("level"), F.desc_nulls_last("stated_at"), F.desc("is_correction"), F.desc("id"))
    ranked = rows.withColumn("_guarded", guarded).withColumn("_n", F.row_number().over(best))
    kept = ranked.where(F.when(F.col("category") == SECURITY, True).otherwise(~F.col("_guarded") & (F.col("_n") == 1)))
    order = W.partitionBy(key).orderBy("category", "id")
    return kept.withColumn("label", F.concat(F.lit("R"), F.row_number().over(order))).drop("_guarded", "_n")


def newest_that_fit(turns: DataFrame, key: str, order: str, cost: str, budget: int, most: int) -> DataFrame:
    """The newest turns, at most ``most``, while their costs together stay within the budget."""
    back = W.partitionBy(key).orderBy(F.desc(order))
    counted = turns.withColumns({"_n": F.row_number().over(back), "spent": F.sum(cost).over(back.rowsBetween(W.unboundedPreceding, 0))})
    return counted.where((F.col("_n") <= most) & (F.col("spent") <= budget)).drop("_n")


def version(*parts: Column) -> Column:
    """The version of a prompt: a short digest of its parts."""
    return F.concat(F.lit("answer-"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 12))


def turn_outcome(cancelled: Column, failed: Column) -> Column:
    """Cancelled before failed before completed."""
    return F.when(cancelled, "CANCELLED").when(failed, "FAILED").otherwise("COMPLETED")
