"""Exact nearest vectors by an index of centroids.

Vectors are dealt to the nearest of a few centroids and written once, those of a cell side by side in the order of their
distance to its centroid, ``PACK`` in a row. A question looks first where its nearest centroids are, until it has k
neighbours; by the triangle inequality, no vector can be nearer than the k-th of these whose own distance to its centroid
differs from the question's by more than that. So only the packs that may hold one are compared, and the result is that of
comparing all. How much is left out depends on the vectors: nearly all where they form clusters, nothing where all lie as
far from each other as from any centre; ``compared`` says how many pairs remain.

Centroids are fitted on a sample of bounded size; every vector is in the index. Vectors without a value or an id are left
out. All vectors have one length.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.retrieval import top_ranked
from lodestone.sources.shared import bounded_batches, written

#: Vectors, or questions, that travel in one row.
PACK = 1000
#: Packs of a cell that one task compares; a cell with more is dealt to several.
PACKS_TO_A_TASK = 8
#: Cosines are rounded to nine places, so distances are held apart only beyond this.
SLACK = 1e-6
_UNIT = "id long, vector binary"


def _usable(vectors: DataFrame, name: str) -> DataFrame:
    return vectors.where(F.col("embedding").isNotNull() & F.col(name).isNotNull()).select(F.col(name).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and vectors of length 1, of a batch."""
    ids = batch["id"].to_numpy(zero_copy_only=False)
    flat = batch["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    return ids, flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of each row of a to each row of b."""
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def fitted(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids of a sample: means of the vectors nearest to them, improved a few times."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = distances(sample, centres).argmin(axis=1)
        n = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclasses.dataclass(frozen=True)
class DenseIndex:
    """packs: cell, slot, n, near, far (distances to the centroid), ids, vectors. Of each cell: its number of vectors, its slots, and the range of their distances."""

    packs: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    slots: np.ndarray
    near: np.ndarray
    far: np.ndarray


def build_index(vectors: DataFrame, cells: int | None = None, sample: int = 10_000) -> DenseIndex:
    """The index of vectors (vec_id, embedding): about a quarter of the square root of their number of cells, at most 1024."""
    bounded_batches(vectors.sparkSession)
    held = _usable(vectors, "vec_id")
    n = held.count()
    step = max(1, n // sample)
    drawn = held.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).limit(2 * sample).toArrow()
    if not drawn.num_rows:
        drawn = held.limit(2 * sample).toArrow()
    found = [_arrays(b)[1] for b in drawn.to_batches() if b.num_rows]
    centres = fitted(np.concatenate(found), cells or min(1024, max(1, int(n**0.5) // 4))) if found else np.zeros((1, 1))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, unit = _arrays(batch)
            far = distances(unit, centres)
            cell = far.argmin(axis=1)
            yield pa.record_batch([pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(ids)), cell]), pa.array(ids), pa.array([v.tobytes() for v in unit], pa.binary())], names=["cell", "away", "id", "vector"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            cell, away, ids, rows = zip(*held)
            held.clear()
            return pa.record_batch(
                [pa.array([cell[0]], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([min(away)]), pa.array([max(away)]), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([b"".join(rows)], pa.binary())], names=["cell", "n", "near", "far", "ids", "vectors"]
            )

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("cell", "away", "id", "vector"))):
                if held and (held[0][0] != row[0] or len(held) == PACK):
                    yield close()
                held.append(row)
        if held:
            yield close()

    rows = held.mapInArrow(dealt, "cell int, away double, id long, vector binary")
    order = ["cell", "away", "id"]
    packs = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(packed, "cell int, n int, near double, far double, ids binary, vectors binary"), "dense-packs")
    sizes, slots, near, far = np.zeros(len(centres), np.int64), np.ones(len(centres), np.int64), np.full(len(centres), np.inf), np.full(len(centres), -np.inf)
    for r in packs.groupBy("cell").agg(F.sum("n").alias("n"), F.count("*").alias("packs"), F.min("near").alias("near"), F.max("far").alias("far")).collect():  # a row for each cell
        sizes[r.cell], slots[r.cell], near[r.cell], far[r.cell] = r.n, -(-r.packs // PACKS_TO_A_TASK), r.near, r.far
    slot = F.pmod(F.xxhash64("ids"), F.element_at(F.array(*[F.lit(int(s)) for s in slots]), F.col("cell") + 1).cast("long")).cast("int")
    return DenseIndex(packs.withColumn("slot", slot), centres, sizes, slots, near, far)


def _first_cells(away: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Which cells a question looks at first: the nearest, until they hold k vectors."""
    order = np.argsort(np.where(sizes > 0, away, np.inf), kind="stable")
    before = np.cumsum(sizes[order]) - sizes[order]
    return order[(before < k) & (sizes[order] > 0)]


def _visits(batches: Iterator[pa.RecordBatch], index: tuple, k: int, second: bool) -> Iterator[pa.RecordBatch]:
    """A row for each cell, and slot of it, that a question looks at: at first, or once the distance of its k-th neighbour is known."""
    centres, sizes, slots, near, far = index
    for batch in batches:
        out = []
        if not sizes.any():
            continue
        for at, (query, vector) in enumerate(zip(batch["id"].to_pylist(), batch["vector"].to_pylist())):
            away = distances(np.frombuffer(vector)[None], centres)[0]
            first = _first_cells(away, sizes, k)
            reach = np.inf
            if second:
                reach = batch["reach"][at].as_py()
                cells = np.flatnonzero((sizes > 0) & (away - reach <= far) & (away + reach >= near))
                cells = cells[~np.isin(cells, first)]
            else:
                cells = first
            out += [(int(c), s, query, vector, float(away[c]), reach) for c in cells for s in range(slots[c])]
        if out:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.float64(), pa.float64()))], names=["cell", "slot", "query_id", "vector", "away", "reach"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Questions of one cell and slot, up to ``PACK`` in a row."""
    held: list[tuple] = []

    def close() -> pa.RecordBatch:
        cell, slot, ids, vectors, away, reach = zip(*held)
        held.clear()
        data = [np.array(ids, np.int64).tobytes(), b"".join(vectors), np.array(away).tobytes(), np.array(reach).tobytes()]
        return pa.record_batch([pa.array([cell[0]], pa.int32()), pa.array([slot[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], names=["cell", "slot", "query_ids", "query_vectors", "query_away", "query_reach"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (held[0][:2] != row[:2] or len(held) == PACK):
                yield close()
            held.append(row)
    if held:
        yield close()


def _best(cosine: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row: by falling cosine, then by rising id."""
    if cosine.shape[1] > k:
        edge = -np.partition(-cosine, k - 1, axis=1)[:, k - 1, None]
        width = int((cosine >= edge).sum(axis=1).max())
        at = np.argpartition(-cosine, width - 1, axis=1)[:, :width]
    else:
        at = np.broadcast_to(np.arange(cosine.shape[1]), cosine.shape)
    order = np.lexsort((ids[at], -np.take_along_axis(cosine, at, 1)), axis=1)[:, :k]
    return np.take_along_axis(at, order, 1)


def _k_best(query: np.ndarray, vec: np.ndarray, cosine: np.ndarray, k: int) -> list[np.ndarray]:
    """Of rows of (query, vec, cosine), the k best of each query."""
    order = np.lexsort((vec, -cosine, query))
    query = query[order]
    starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    kept = order[rank < k]
    return [query[rank < k], vec[kept], cosine[kept]]


def _compared(batches: Iterator[pa.RecordBatch], k: int, held: int = 1_000_000, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Compares packs with the packs of questions that meet them; of a task's rows, the k best of each question that may find one.

    Where these are more than half of ``most``, they are passed on and forgotten, so that memory does not grow with the
    questions: a question then has k rows for each time, of which the best are taken where all come together.
    """
    best, pairs = [[], [], []], [[], []]

    def shrink() -> None:
        found = _k_best(*map(np.concatenate, best), k)
        best[:] = [[x] for x in found]
        asked, at = np.unique(np.concatenate(pairs[0]), return_inverse=True)
        pairs[:] = [[asked], [np.bincount(at, np.concatenate(pairs[1])).astype(np.int64)]]

    def passed_on() -> pa.RecordBatch:
        query, vec, cosine = (x[0] for x in best)
        first = np.concatenate([[True], query[1:] != query[:-1]])
        counts = np.where(first, pairs[1][0][np.searchsorted(pairs[0][0], query)], 0)
        return pa.record_batch([pa.array(x) for x in (query, vec, cosine, counts)], names=["query_id", "vec_id", "cosine", "pairs"])

    size = 0
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            away, reach = np.frombuffer(row["query_away"]), np.frombuffer(row["query_reach"])
            may = np.flatnonzero((away - reach <= row["far"]) & (away + reach >= row["near"]))
            if not len(may):
                continue
            ids, asked = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)[may]
            vectors, wanted = np.frombuffer(row["vectors"]).reshape(len(ids), -1), np.frombuffer(row["query_vectors"]).reshape(len(away), -1)[may]
            cosine = np.round(wanted @ vectors.T, 9)
            at = _best(cosine, ids, k)
            for x, new in zip(best, (np.repeat(asked, at.shape[1]), ids[at].ravel(), np.take_along_axis(cosine, at, 1).ravel())):
                x.append(new)
            pairs[0].append(asked)
            pairs[1].append(np.full(len(asked), len(ids)))
            size += at.size
            if size > held:
                shrink()
                size = len(best[0][0])
                held = min(most, max(held, 2 * size))
                if 2 * size > most:
                    yield passed_on()
                    best[:], pairs[:], size = [[], [], []], [[], []], 0
    if pairs[0]:
        shrink()
        yield passed_on()


def _met(questions: DataFrame, index: DenseIndex, k: int, second: bool) -> DataFrame:
    """query_id, vec_id, cosine and pairs (vectors compared, noted once for each task) of the cells that questions look at, k rows at most for a question and task."""
    about = (index.centres, index.sizes, index.slots, index.near, index.far)
    visits = questions.mapInArrow(functools.partial(_visits, index=about, k=k, second=second), "cell int, slot int, query_id long, vector binary, away double, reach double")
    asked = visits.repartition("cell", "slot").sortWithinPartitions("cell", "slot").mapInArrow(_asked, "cell int, slot int, query_ids binary, query_vectors binary, query_away binary, query_reach binary")
    return index.packs.join(asked.hint("shuffle_hash"), ["cell", "slot"]).mapInArrow(functools.partial(_compared, k=k), "query_id long, vec_id long, cosine double, pairs long")


def indexed_top_k(queries: DataFrame, index: DenseIndex, k: int = 30) -> tuple[DataFrame, DataFrame]:
    """query_id, vec_id, cosine, rank of the k nearest vectors of each query (query_id, embedding); and query_id, compared: the vectors it was compared with."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, rows = _arrays(batch)
                yield pa.record_batch([pa.array(ids), pa.array([v.tobytes() for v in rows], pa.binary())], names=["id", "vector"])

    questions = written(_usable(queries, "query_id").mapInArrow(unit, _UNIT), "dense-questions")
    near = written(_met(questions, index, k, False), "dense-near")
    kth = F.when(F.count("*") >= k, F.sqrt(F.greatest(2 - 2 * F.min("cosine"), F.lit(0.0))) + SLACK).otherwise(float("inf"))
    reach = top_ranked(near, "query_id", "cosine", "vec_id", k).groupBy(F.col("query_id").alias("id")).agg(kth.alias("reach"))
    further = questions.join(reach, "id")
    both = written(near.unionByName(_met(further, index, k, True)), "dense-both")
    found = top_ranked(both.drop("pairs"), "query_id", "cosine", "vec_id", k)
    return found, both.groupBy("query_id").agg(F.sum("pairs").alias("compared"))
