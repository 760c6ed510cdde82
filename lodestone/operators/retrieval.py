"""Retrieval for all queries at once: dense and keyword top-k, rank fusion, selection within a budget."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import CLASS_COUNTS, terms
from lodestone.sources.shared import written


def top_ranked(scored: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each key by falling score, with rank from 0; ties by rising id."""
    order = W.partitionBy(key).orderBy(F.col(score).desc(), tie)
    # the bound is on the window's own column, so that Spark leaves out the rest before it shuffles
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


#: Vectors that travel in one row, and meet so many queries at once.
PACK = 1000
_PACKED = "block string, ids binary, vectors binary"


def _packs(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Rows of an id and a vector, ``PACK`` in a row: ids and vectors of length 1 end to end."""
    for batch in batches:
        for at in range(0, batch.num_rows, PACK):
            some = batch.slice(at, PACK)
            ids = some[name].to_numpy(zero_copy_only=False).astype(np.int64)
            flat = some["embedding"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
            unit = flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)
            yield pa.record_batch([pa.array([uuid.uuid4().hex]), pa.array([ids.tobytes()], pa.binary()), pa.array([unit.tobytes()], pa.binary())], names=["block", "ids", "vectors"])


def _nearest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of a task's vectors for every query that comes with them."""
    best: dict[str, list[np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            own, asked = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)
            vectors, wanted = (np.frombuffer(row[c], float).reshape(len(n), -1) for c, n in (("vectors", own), ("query_vectors", asked)))
            held = best.setdefault(row["block"], [asked, np.full((len(asked), 0), -2.0), np.zeros((len(asked), 0), np.int64)])
            cosine = np.hstack([held[1], np.round(wanted @ vectors.T, 9)])
            ids = np.hstack([held[2], np.broadcast_to(own, (len(asked), len(own)))])
            if cosine.shape[1] > k:
                # all that are no worse than the k-th, so that ties go by id
                edge = -np.partition(-cosine, k - 1, axis=1)[:, k - 1, None]
                width = int((cosine >= edge).sum(axis=1).max())
                at = np.argpartition(-cosine, width - 1, axis=1)[:, :width]
                cosine, ids = np.take_along_axis(cosine, at, 1), np.take_along_axis(ids, at, 1)
                at = np.lexsort((ids, -cosine), axis=1)[:, :k]
                cosine, ids = np.take_along_axis(cosine, at, 1), np.take_along_axis(ids, at, 1)
            held[1], held[2] = cosine, ids
    for asked, cosine, ids in best.values():
        yield pa.record_batch([pa.array(np.repeat(asked, ids.shape[1])), pa.array(ids.ravel()), pa.array(cosine.ravel())], names=["query_id", "vec_id", "cosine"])


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int = 30) -> DataFrame:
    """query_id, vec_id, cosine, rank of the k nearest vectors (vec_id, embedding) of each query (query_id, embedding).

    Both sides are packed into rows of a thousand and written once, and every pack of vectors meets every pack of queries
    where it is read: nothing passes through the driver. A task keeps its own k best of each query, so what is shuffled is k rows for
    each query and task, never a row for each pair.
    """
    with_vector = lambda d, name: d.where(F.col("embedding").isNotNull() & F.col(name).isNotNull()).select(F.col(name).cast("long").alias(name), F.col("embedding").cast("array<double>").alias("embedding"))
    packed = written(with_vector(vectors, "vec_id").mapInArrow(functools.partial(_packs, name="vec_id"), _PACKED), "packs").select("ids", "vectors")
    asked = written(with_vector(queries, "query_id").mapInArrow(functools.partial(_packs, name="query_id"), _PACKED), "packs").select("block", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"))
    met = packed.crossJoin(asked.hint("shuffle_replicate_nl"))
    found = met.mapInArrow(functools.partial(_nearest, k=k), "query_id long, vec_id long, cosine double")
    return top_ranked(found, "query_id", "cosine", "vec_id", k)


def dense_pairs(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, k: int = 30) -> DataFrame:
    """query_id, vec_id, cosine, rank of the k nearest of the vectors that each query may see (pairs of query_id and vec_id)."""
    given = lambda d, name, to: d.where(F.col("embedding").isNotNull()).select(name, F.col("embedding").cast("array<double>").alias(to))
    # pairs are many more rows than their files' size says, so they must not be broadcast
    met = pairs.hint("merge").join(given(queries, "query_id", "_asked"), "query_id").join(given(vectors, "vec_id", "_own"), "vec_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    asked, own = F.col("_asked"), F.col("_own")
    length = F.sqrt(dot(asked, asked) * dot(own, own))
    cosine = F.when(length > 0, dot(asked, own) / length).otherwise(0.0)
    return top_ranked(met.select("query_id", "vec_id", F.round(cosine, 9).alias("cosine")), "query_id", "cosine", "vec_id", k)


def inverted_index(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """term, key, tf of every document: lower-cased letters and digits."""
    return docs.select(key, F.explode(terms(F.col("text"))).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def fuse(lists: DataFrame, constant: int = 60, payload: str | None = None) -> DataFrame:
    """query_id, doc_id, score, retrievers, rank from ranked lists (query_id, list_idx, retriever, doc_id, rank).

    ``payload``: a column that is kept as the first list had it.
    """
    first = [F.min_by(payload, F.struct("list_idx", "rank")).alias(payload)] if payload else []
    part = lists.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"), F.array_sort(F.collect_set("retriever")).alias("retrievers"), F.min(F.struct("list_idx", "rank")).alias("seen"), *first
    )
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "seen")
    return part.withColumn("rank", F.row_number().over(order) - 1).drop("seen")


def select_evidence(ranked: DataFrame, budget: int = 6000, margin: float = 0.35, floor: int = 1, ceiling: int = 8) -> DataFrame:
    """The prefix of each query's ranked rows (query_id, query_class, rank, score, cost) that is worth sending, with label.

    Reading stops at the class's largest count, where the budget would be passed, and where the score falls too far
    behind the best once the class's least count is reached.
    """
    counts = F.create_map(*[x for name, (low, high) in CLASS_COUNTS.items() for x in (F.lit(name), F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")))])
    bounds = F.coalesce(F.try_element_at(counts, F.col("query_class")), F.struct(F.lit(1).alias("low"), F.lit(3).alias("high")))
    high = F.least(bounds["high"], F.lit(ceiling))
    low = F.least(F.greatest(bounds["low"], F.lit(floor)), high)
    order = W.partitionBy("query_id").orderBy("rank")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    n = F.row_number().over(order) - 1
    top = F.first("score").over(upto)
    stop = (n >= high) | ((n > 0) & (F.sum("cost").over(upto) > budget)) | ((F.col("score") < top - F.abs(top) * margin) & (n >= low))
    marked = ranked.withColumns({"n": n, "stop": stop.cast("int")})
    kept = marked.withColumn("stopped", F.max("stop").over(upto)).where("stopped = 0")
    return kept.withColumn("label", F.concat(F.lit("S"), (F.col("n") + 1).cast("string"))).drop("n", "stop", "stopped")


def ranking_metrics(ranked: DataFrame, k: int = 10) -> DataFrame:
    """query_id with recall, precision, reciprocal rank and normalised discounted gain at k of ranked rows (query_id, rank, gold)."""
    gold, near = F.col("gold"), F.col("gold") & (F.col("rank") < k)
    gain = F.lit(1.0) / F.log2(F.col("rank") + 2)
    rows = ranked.groupBy("query_id").agg(
        F.count_if(gold).alias("n"), F.count_if(near).alias("hit"), F.min(F.when(gold, F.col("rank"))).alias("first"), F.sum(F.when(near, gain).otherwise(0.0)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1))
    some = F.col("n") > 0
    return rows.select(
        "query_id", F.round(F.when(some, F.col("hit") / F.col("n")).otherwise(0.0), 9).alias(f"recall_at_{k}"), F.round(F.col("hit") / k, 9).alias(f"precision_at_{k}"),
        F.round(F.coalesce(1.0 / (1 + F.col("first")), F.lit(0.0)), 9).alias("reciprocal_rank"), F.round(F.when(some, F.col("dcg") / ideal).otherwise(0.0), 9).alias(f"ndcg_at_{k}"), some.alias("covered"),
    )


def coverage_rounds(parts: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """Parts of questions (keys, status): how many, how many still open, rounds of search they need, and whether sources conflict.

    An unsupported part asks for two more rounds, a partly supported one for one; ``most`` rounds are made at most.
    """
    open_ = F.col("status").isin("UNSUPPORTED", "PARTIALLY_SUPPORTED")
    more = F.max(F.when(F.col("status") == "UNSUPPORTED", 2).when(F.col("status") == "PARTIALLY_SUPPORTED", 1).otherwise(0))
    return parts.groupBy(*keys).agg(F.count("*").alias("questions"), F.count_if(open_).alias("open"), F.least(F.lit(most), 1 + more).alias("rounds"), F.bool_or(F.col("status") == "CONFLICTING").alias("conflict"))
