"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens to the power of an exponent, normalised. The exponent is bisected between 0
(all sources alike) and 1 (as they are) to reach a target evenness (entropy as a part of its maximum), and raised, if
need be, until no source is repeated more than ``most_epochs`` times in the budget that is really used; each job evaluates the fifteen exponents of four
halvings as sums over the sources. The weights are realised within a token budget: a source's documents are dealt into
blocks by hash, every epoch permutes the blocks anew, and the last, partial epoch takes whole blocks in its order and,
of the block where the budget ends, the documents with the least hashes (equal ones together). ``position`` runs from 0 to 1 through the
run, so that sorting by it interleaves the sources at their weights all the way.

A source has at most ``MOST_BLOCKS`` blocks; windows hold the blocks of a source or the documents of one block, so a
source with a third of all rows stays spread.

Defined results: a null or empty text has no tokens and follows its block; a null source is a source of its own; rows that repeat a doc_id are taken each; an empty table gives an empty result; a corpus
without tokens is taken once, whole; a very long text is taken whole, or not at all; rows with equal hashes are taken
together; a budget or limit that can't be kept raises an error; columns named like the five that are added give way to them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, small, stored

MOST_BLOCKS = 4096


def words(text: str = "text") -> Column:
    """The default count: white-space separated words, as tokens."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def exponent(totals: DataFrame, evenness: float, most_epochs: float, budget: float | None, whole: bool = False) -> float:
    """The exponent for totals (source, tokens): bisected, four halvings a job.

    With ``whole`` the budget gives the source that is repeated least one epoch, so the others' epochs are the ratios of
    theirs to its own; at an exponent of 1 all are one, so a limit of 1 or more can always be kept.
    """
    p = totals.where("tokens > 0")
    total, n = p.agg(F.sum("tokens"), F.count("*")).first()
    if not total or n < 2:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))
    low, high = 0.0, 1.0
    for _ in range(8):
        points = [low + (high - low) * i / 16 for i in range(1, 16)]
        sums = []
        for a in points:
            sums += [F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share)), F.max(F.pow(share, F.lit(a)) / F.col("tokens")), F.min(F.pow(share, F.lit(a)) / F.col("tokens"))]
        row = p.agg(*[s.alias(f"c{i}") for i, s in enumerate(sums)]).first()
        below = 0  # points at which the weights are still too even or a source repeats too often
        for i, a in enumerate(points):
            z, slope, ratio, least = row[4 * i : 4 * i + 4]
            entropy = math.log(z) - a * slope / z
            epochs = ratio / least if whole else ratio / z * (total if budget is None else budget)
            if entropy > evenness * math.log(n) or epochs > most_epochs:
                below = i + 1
        low, high = (points[below - 1] if below else low), (points[below] if below < 15 else high)
    return high  # the side on which the limits hold


def counted(docs: DataFrame, tokens: Column | None, seed: int) -> DataFrame:
    """What the plan needs of every row: its source, tokens and hash."""
    return docs.select(_source(), (words() if tokens is None else tokens).alias("_tokens"), _hash(seed))


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("_source")


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("_hash")


def weights(rows: DataFrame, evenness: float, most_epochs: float, budget: float | None = None, whole: bool = False) -> DataFrame:
    """_source, tokens, weight, epochs, blocks of every source of counted rows.

    budget: tokens of the result; without one, as many as the corpus has, or with ``whole`` as many as give each source
    one epoch at least.
    """
    totals = stored(rows.groupBy("_source").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("rows")), "source-totals")
    if whole and budget is not None:
        raise ValueError("a budget of tokens and every document at least once can't both be asked for")
    if whole and most_epochs < 1:
        raise ValueError("with every document at least once, most_epochs is 1 or more")
    a = exponent(totals.select("tokens"), evenness, most_epochs, budget, whole)
    raised = totals.withColumn("raised", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(a))).otherwise(0.0))
    z, total, least = raised.agg(F.sum("raised"), F.sum("tokens"), F.min(F.when(F.col("tokens") > 0, F.col("raised") / F.col("tokens")))).first()
    z, total = z or 1.0, total or 0
    if budget is not None and total and budget > most_epochs * total:
        raise ValueError(f"a budget of {budget} repeats {total} tokens more than {most_epochs} times")
    wanted = budget if budget is not None else (z / least if whole and least else float(total))
    weight = F.col("raised") / F.lit(float(z))
    epochs = F.when(F.col("tokens") > 0, weight * F.lit(float(wanted)) / F.col("tokens")).otherwise(1.0)
    return raised.select("_source", "tokens", weight.alias("_weight"), F.round(epochs, 9).alias("_epochs"), F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("rows") / 256)).cast("int").alias("_blocks"))


def mixed(docs: DataFrame, evenness: float = 0.95, most_epochs: float = 4.0, budget: float | None = None, whole: bool = False, tokens: Column | None = None, seed: int = 17) -> DataFrame:
    """The documents' rows, each as often as it is taken, with n_tokens, epoch, block, weight and position.

    Only counts and hashes are gathered by source and block; the plan of blocks then meets the documents in a join, and
    no text is shuffled while the plan has a size that can be broadcast.
    """
    rows = stored(counted(docs, tokens, seed), "counted")
    plan = small(weights(rows, evenness, most_epochs, budget, whole), "source-weights")
    block = F.pmod("_hash", F.col("_blocks")).cast("int").alias("_block")
    dealt = rows.join(plan.select("_source", "_blocks"), "_source").select("_source", block, "_tokens", "_hash")
    sizes = dealt.groupBy("_source", "_block").agg(F.sum("_tokens").alias("size")).join(plan, "_source")
    turns = sizes.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil("_epochs").cast("int") - 1))))
    order = W.partitionBy("_source", "epoch").orderBy(F.xxhash64(F.lit(seed), "_source", "_block", "epoch"), "_block")
    ranked = turns.withColumns({"rank": F.row_number().over(order) - 1, "upto": F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))})
    share = F.col("_epochs") - F.col("epoch")  # of an epoch that is still due
    room = F.when(share >= 1, F.lit(float("inf"))).otherwise(F.round(share * F.col("tokens"), 3) - (F.col("upto") - F.col("size")))
    taken = stored(ranked.withColumn("room", room).where("room > 0 or size = 0 and epoch = 0"), "turns")
    entire = taken.where("room >= size").withColumn("_upper", F.lit((1 << 63) - 1))
    inside = W.partitionBy("_source", "_block", "epoch").orderBy("_hash").rangeBetween(W.unboundedPreceding, 0)
    open_blocks = dealt.join(taken.where("room < size").select("_source", "_block", "epoch", "room"), ["_source", "_block"])
    upper = open_blocks.withColumn("upto", F.sum("_tokens").over(inside)).where("upto <= room").groupBy("_source", "_block", "epoch").agg(F.max("_hash").alias("_upper"))
    split = taken.where("room < size").join(upper, ["_source", "_block", "epoch"])
    names = ["_source", "_block", F.col("epoch").alias("_epoch"), "rank", "_weight", "_epochs", "_blocks", "_upper"]
    schedule = small(entire.select(*names).unionByName(split.select(*names)), "schedule")
    base = [c for c in docs.columns if c not in ("n_tokens", "epoch", "block", "weight", "position")]
    helpers = ["_source", "_block", "_tokens", "_hash", "_epoch", "rank", "_weight", "_epochs", "_blocks", "_upper"]
    h = dict(zip(helpers, fresh(docs.select(*base), *helpers)))
    n_tokens = words() if tokens is None else tokens
    keyed = docs.select(*base, n_tokens.alias(h["_tokens"]), _source().alias(h["_source"]), _hash(seed).alias(h["_hash"]))
    keyed = keyed.join(plan.select("_source", "_blocks").withColumnsRenamed(h), h["_source"])
    keyed = keyed.withColumn(h["_block"], F.pmod(h["_hash"], h["_blocks"]).cast("int")).drop(h["_blocks"])
    out = keyed.join(schedule.withColumnsRenamed(h), [h["_source"], h["_block"]]).where(F.col(h["_hash"]) <= F.col(h["_upper"]))
    within = F.pmod(h["_hash"], F.lit(1 << 20)) / F.lit(float(1 << 20))
    position = (F.col(h["_epoch"]) + (F.col(h["rank"]) + within) / F.col(h["_blocks"])) / F.greatest(F.ceil(F.col(h["_epochs"])), F.lit(1))
    return out.select(*base, F.col(h["_tokens"]).alias("n_tokens"), F.col(h["_epoch"]).alias("epoch"), F.col(h["_block"]).alias("block"), F.col(h["_weight"]).alias("weight"), position.alias("position"))
