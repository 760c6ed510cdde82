"""Near-duplicate removal by MinHash: universal hash minima, bands, verification, connected components.

1. One pass over the texts hashes words and shingles in numpy and keeps, for each document, the size of its shingle set,
   a 128-bit digest of the set, and one hash for each band of minima. That table is written to the shared folder.
2. Documents with equal sets become one class (the least id stands for it), so thousands of copies cost one row.
3. In each band bucket the members are linked with the bucket's least member only: no pairs within a group.
4. Links are verified on the full sets, which are hashed anew from the texts of the documents concerned.
5. Links become components (see components.py). A bucket that still holds several components after that had members
   that are not like its least one; all its members are then compared with one another in blocks of ``block``
   members, or fewer if their sets are large, block by block, in numpy: only links that hold and join different components leave the task. This goes on
   over all such buckets, so no candidate pair is dropped; sizes that rule a pair out are skipped.

With 32 bands of 5 minima a pair at the threshold of 0.8 meets in no bucket with probability 3e-6, and one at 0.9 with
probability 2e-13. Hashes of words and shingles have 64 bits.

Defined results: null text, or text without words, has an empty set and is linked with nothing; fewer words than
``size`` are one shingle; of equal documents the least id stays; rows that repeat a doc_id share its component, and
where their texts differ, each text's links count for the id; a null doc_id gets a row of its own, with no component
but itself (null), and is kept; a very long text has a set like any other, and blocks are cut by the size of sets; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, flat_utf8, mix64, small, stored, texts, word_hashes
from .components import connected_components

_SIGNED = np.int64
#: A bucket with more members meets its totals without a shuffle by its key.
HOT = 512
#: Shingles of the members of a block that are compared in one task, about: 8 bytes each.
BLOCK_SHINGLES = 1_000_000


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a column without nulls."""
    hashes, counts = word_hashes(*flat_utf8(column))
    factors = np.random.default_rng(size).integers(1, 1 << 63, size, dtype=np.uint64) | np.uint64(1)
    n = len(hashes) - size + 1
    runs = np.zeros(max(n, 0), np.uint64)
    for i in range(size):
        runs += hashes[i : i + len(runs)] * factors[i]
    runs = mix64(runs)
    out, at = [], 0
    for count in counts.tolist():
        if count >= size:
            out.append(np.unique(runs[at : at + count - size + 1]))
        elif count:
            out.append(mix64(np.sum(hashes[at : at + count] * factors[:count], dtype=np.uint64, keepdims=True) + np.uint64(count)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out


def hash_family(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and summands of ``count`` multiply-add hashes on 64 bits."""
    make = np.random.default_rng(seed)
    return make.integers(1, 1 << 63, count, dtype=np.uint64) | np.uint64(1), make.integers(0, 1 << 63, count, dtype=np.uint64)


def minima(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of each hash over a set, on its upper 32 bits."""
    out = np.full(len(family[0]), np.uint64(1 << 32))
    for at in range(0, len(shingles), 1024):  # pieces that stay in the processor's cache
        part = (shingles[at : at + 1024] >> np.uint64(1))[None, :]
        np.minimum(out, ((part * family[0][:, None] + family[1][:, None]) >> np.uint64(32)).min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, the set's digest in two halves, and the hashes of its bands (null for an empty set)."""
    bound_batches(docs.sparkSession)
    family = hash_family(bands * rows)
    mixers = np.random.default_rng(2).integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
    numbers = np.arange(bands, dtype=np.uint64) << np.uint64(48)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                some = batch.slice(at, 100)
                sets = shingle_sets(some["text"], size)
                digests = [(int(np.bitwise_xor.reduce(mix64(s)).astype(_SIGNED)), int(np.sum(mix64(s ^ np.uint64(0xA5A5)), dtype=np.uint64).astype(_SIGNED))) for s in sets]
                keys = [mix64((minima(s, family).reshape(bands, rows) * mixers).sum(axis=1, dtype=np.uint64) ^ numbers).astype(_SIGNED) if len(s) else None for s in sets]
                yield pa.record_batch(
                    [some["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests]), pa.array([d[1] for d in digests]), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "digest2", "keys"],
                )

    return texts(docs).mapInArrow(sign, "doc_id long, n_shingles long, digest long, digest2 long, keys array<long>")


def _sets_of(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """Class and set (sorted 64-bit hashes as bytes) of the documents that stand for the given classes."""
    bound_batches(docs.sparkSession)
    rows = texts(docs).withColumnRenamed("doc_id", "id").join(members, "id").select("id", "digest", "digest2", "node", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                some = batch.slice(at, 100)
                sets = shingle_sets(some["text"], size)
                right = [int(np.bitwise_xor.reduce(mix64(s)).astype(_SIGNED)) == d and int(np.sum(mix64(s ^ np.uint64(0xA5A5)), dtype=np.uint64).astype(_SIGNED)) == e for s, d, e in zip(sets, some["digest"].to_pylist(), some["digest2"].to_pylist())]
                nodes = [n for n, ok in zip(some["node"].to_pylist(), right) if ok]
                yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([s.tobytes() for s, ok in zip(sets, right) if ok], pa.binary())], names=["node", "shingles"])

    found = rows.mapInArrow(read, "node long, shingles binary")
    return found.groupBy("node").agg(F.max("shingles").alias("shingles"))  # rows that repeat an id and its text


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    common = int(np.isin(a, b, assume_unique=True, kind="sort").sum()) if len(a) <= len(b) else int(np.isin(b, a, assume_unique=True, kind="sort").sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    second = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    return pairs.join(first, "b").join(second, "a").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


class _Union:
    """Components within one task."""

    def __init__(self, of: list[int]):
        self.root = {x: x for x in of}

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = x = self.root[self.root[x]]
        return x

    def join(self, a: int, b: int) -> None:
        self.root[max(a, b)] = min(a, b)


def _with_totals(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows (key, ...) with what totals (key, total, ...; a written table) say of their keys.

    Keys with many rows are few, as each has more than ``HOT`` of them: they go to every task, while that table is small
    enough to be sent, and their rows stay where they are. Only the other keys' rows are shuffled.
    """
    hot = small(totals.where(F.col("total") > HOT), "hot-keys")
    cold = totals.where(F.col("total") <= HOT)
    return rows.join(hot, "key").unionByName(rows.join(hot.select("key"), "key", "left_anti").join(cold, "key"))


def _rest(buckets: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between components that meet in a bucket (key, node, n_shingles, component), found block by block.

    In each bucket, the members outside its most frequent component are compared with all members: blocks of the former
    by blocks of the latter, so a row travels once for each block of the other side. A block has about ``block`` members,
    or fewer if their sets are large.
    """
    tallies = buckets.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    main = F.max(F.struct("n", "component", "weight"))
    mains = tallies.groupBy("key").agg(main.alias("main"), F.sum("n").alias("total"), F.sum("weight").alias("weight"), F.count("*").alias("kinds")).where("kinds > 1")
    mains = stored(mains.select("key", "total", "weight", F.col("main.component").alias("main"), F.col("main.n").alias("most"), F.col("main.weight").alias("heaviest")), "open-buckets")
    blocks = lambda n, weight: F.greatest(F.ceil(n / block), F.ceil(weight / BLOCK_SHINGLES)).cast("int")
    few = blocks(F.col("total") - F.col("most"), F.col("weight") - F.col("heaviest"))
    rows = _with_totals(buckets, mains).withColumns({"few": few, "all": blocks(F.col("total"), F.col("weight"))})
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.where("component != main").withColumns({"i": own(F.col("few")), "side": F.lit(0)}).withColumn("j", each(F.col("all")))
    right = rows.withColumns({"j": own(F.col("all")), "side": F.lit(1)}).withColumn("i", each(F.col("few")))
    names = ["key", "i", "j", "side", "node", "component"]
    cells = left.select(names).unionByName(right.select(names)).join(sets, "node")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        at = _Union(rows["component"].unique().tolist())
        held: list[list[tuple]] = [[], []]
        for side, node, component, shingles in zip(rows["side"], rows["node"], rows["component"], rows["shingles"]):
            held[side].append((int(node), int(component), np.frombuffer(shingles, np.uint64)))
        found = []
        for node, component, shingles in held[0]:
            for other, component2, shingles2 in held[1]:
                if at.find(component) != at.find(component2) and alike(shingles, shingles2, percent):
                    at.join(at.find(component), at.find(component2))
                    found.append((node, other))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return cells.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, block: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links reach), kept (doc_id = component_id) of every document."""
    signed = stored(signatures(docs, size, bands, rows), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy("digest", "digest2", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys")).withColumn("node", F.xxhash64("id", "digest", "digest2")), "classes")
    members = classes.select("id", "digest", "digest2", "node")
    buckets = classes.select("node", "n_shingles", F.explode("keys").alias("key"))
    leaders = stored(buckets.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("total")).where("total > 1"), "leaders")
    shared = stored(_with_totals(buckets, leaders), "buckets")
    pairs = shared.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    met = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stored(_sets_of(docs, members.join(met, "node", "left_semi"), size), "sets")
    links = stored(_verified(pairs, sets, percent), "verified")
    found = connected_components(links)
    open_buckets = shared.where("total > 2").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = stored(_rest(open_buckets.select("key", "node", "n_shingles", "component"), sets, percent, block), "rest")
    same_id = classes.groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("n > 1")
    twice = classes.join(same_id, "id").where("node != low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    other_ids = full.join(classes.select("digest", "digest2", "n_shingles", "node"), ["digest", "digest2", "n_shingles"]).select("doc_id", "n_shingles", "node")
    spread = other_ids.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high")
    tied = other_ids.join(spread, "doc_id").where("node != low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    final = connected_components(links.unionByName(more).unionByName(twice).unionByName(tied))
    placed = classes.select("node", "id").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    of_class = stored(placed.join(least, "component").select("node", "component_id"), "components")
    linked = full.join(members.select("digest", "digest2", "node"), ["digest", "digest2"]).join(of_class, "node").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_duplicates(docs: DataFrame, **how: int) -> DataFrame:
    """The documents that stay: one of each component, and one row of each of those ids."""
    found = near_duplicates(docs, **how)
    ids = found.where("kept and doc_id is not null").select("doc_id").distinct()
    once = docs.where("doc_id is not null").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(docs.where("doc_id is null"))
