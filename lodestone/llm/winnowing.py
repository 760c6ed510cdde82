"""Document fingerprints by winnowing.

Every run of ``k`` code points is hashed by a rolling polynomial; of every window of ``w`` consecutive hashes the least
is kept, the rightmost of equal ones, with its position. Any passage of at least w + k - 1 code points that two texts
share therefore gives both a common hash, and the kept positions say where.

``neighbours`` hands each document the one that follows it in falling order of doc_id without sorting the table in one
task: ids are cut at quantiles into ranges, each range is one sorted group, and the first document of a range is copied
to the range before it.

Defined results: a null text is empty and has no fingerprint; a text shorter than k is one run; shorter than a window,
one window; a very long text takes time and memory in proportion to its length; equal hashes in a window: the rightmost;
of rows with one doc_id, the order is that of their texts; a null doc_id comes after all others; a single
row is its own neighbour; likeness of two texts without fingerprint is 1, of one without and one with, 0; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, mix64, texts

#: A shared passage of 31 code points is enough, so texts from 62 on keep a likeness to their edited text.
K, W = 16, 16
#: A kept hash has 40 bits, a place within a stretch of text 24.
_PLACE_BITS = 24
_PLACES = 1 << _PLACE_BITS
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def run_hashes(points: np.ndarray, k: int, powers: np.ndarray, inverses: np.ndarray) -> np.ndarray:
    """A 40-bit hash of every run of k code points: differences of the prefix sums of a polynomial, brought to one power."""
    n = len(points)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points + np.uint64(1)) * powers[:n], out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * inverses[: n - k + 1]) >> np.uint64(_PLACE_BITS)


def kept(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least hash of each window, rightmost on ties, each once.

    A hash and its distance from the text's end share one integer, so the least integer of a window is its choice.
    Running minima from both ends of blocks of w give every window's least in a few passes, whatever w is.
    """
    out = [np.zeros(0, np.int64)]
    n = len(hashes)
    w = min(w, n)
    step = _PLACES - w
    for base in range(0, n - w + 1 if n else 0, step):
        part = hashes[base : base + step + w - 1]
        keys = (part << np.uint64(_PLACE_BITS)) | np.arange(_PLACES - 1, _PLACES - 1 - len(part), -1).astype(np.uint64)
        filled = np.full(-(-len(part) // w) * w, np.iinfo(np.uint64).max)
        filled[: len(part)] = keys
        grid = filled.reshape(-1, w)
        before = np.minimum.accumulate(grid, axis=1).ravel()
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = len(part) - w + 1
        least = np.minimum(after[:windows], before[w - 1 : w - 1 + windows])
        out.append(base + (_PLACES - 1) - (least & np.uint64(_PLACES - 1)).astype(np.int64))
    at = np.concatenate(out)
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sets of hashes: intersection by union."""
    if not len(a) and not len(b):
        return 1.0
    a, b = np.unique(a), np.unique(b)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


class Winnower:
    """Fingerprints of texts; holds powers up to the longest text so far."""

    def __init__(self, k: int = K, w: int = W):
        self.k, self.w = k, w
        self.powers = self.inverses = np.zeros(0, np.uint64)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Kept hashes and their positions."""
        points = code_points(text)
        if len(points) > len(self.powers):
            n = max(len(points), 1 << 15)
            self.powers, self.inverses = _powers(_BASE, n), _powers(_INVERSE, n)
        hashes = run_hashes(points, self.k, self.powers, self.inverses)
        at = kept(hashes, self.w)
        return hashes[at], at


def written(hashes: np.ndarray, positions: np.ndarray) -> str:
    """A fingerprint as text: hexadecimal hash and decimal position of each kept run."""
    return " ".join([f"{h:010x}@{p}" for h, p in zip(hashes.tolist(), positions.tolist())])


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id with the kept hashes and positions of every text."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnower = Winnower(k, w)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                found = [winnower.of(t) for t in some["text"].to_pylist()]
                yield pa.record_batch([some["doc_id"], pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int64()))], names=["doc_id", "hashes", "positions"])

    return texts(docs).mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


def edited(text: str, following: str) -> str:
    """A text whose last half is replaced by as many first code points of another text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range_of(cuts: list[int]) -> Column:
    """The range of doc_id between rising cuts, by a tree of comparisons; range 0 holds the largest ids, nulls come last."""

    def below(low: int, high: int) -> Column:  # how many cuts are at most the id
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("doc_id") < cuts[middle], below(low, middle)).otherwise(below(middle + 1, high))

    return F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(len(cuts) - below(0, len(cuts)))


def neighbours(docs: DataFrame) -> DataFrame:
    """Rows (place, extra, doc_id, text), sorted within tasks so that each row's next one follows it.

    Rows marked ``extra`` close a range: they only serve the row before.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts(docs)
    marks = rows.select(F.percentile_approx("doc_id", [i / (2 * tasks) for i in range(1, 2 * tasks)], 10_000)).first()[0] or []
    placed = rows.withColumn("place", _range_of(sorted(set(marks))))
    heads = dict(placed.groupBy("place").agg(F.max("doc_id")).collect())  # a row for each range
    found = sorted(heads)
    first = placed.where(F.col("doc_id").isin([v for v in heads.values() if v is not None]) | F.col("doc_id").isNull())
    first = first.groupBy("place", "doc_id").agg(F.min("text").alias("text"))
    before = {p: found[i - 1] for i, p in enumerate(found)}
    target = F.get(F.array(*[F.lit(before.get(p, 0)) for p in range(max(found, default=0) + 1)]), F.col("place"))
    extra = first.select("doc_id", "text", target.alias("place"), F.lit(1).alias("extra"))
    both = placed.withColumn("extra", F.lit(0)).unionByName(extra)
    # two ranges to each task, by number: hashed, some tasks would get several and some none
    return both.repartitionById(tasks, F.pmod("place", F.lit(tasks)).cast("int")).sortWithinPartitions("place", "extra", F.col("doc_id").desc_nulls_last(), "text").select("place", "extra", "doc_id", "text")


def edited_fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses to the edited and to the next text."""
    bound_batches(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnower = Winnower(k, w)
        held = None  # the row that waits for its next one
        out: list[tuple] = []
        for batch in batches:
            for place, extra, doc, text in zip(*(batch[c].to_pylist() for c in ("place", "extra", "doc_id", "text"))):
                if extra and (held is None or held[0] != place):
                    continue
                own = winnower.of(text)
                if held is not None and held[0] == place:
                    _, before, whole, (hashes, positions) = held
                    changed = edited(whole, text)
                    hashes2, positions2 = winnower.of(changed)
                    out.append(
                        (before, len(whole), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), written(hashes, positions), written(hashes2, positions2), likeness(hashes, hashes2), likeness(hashes, own[0]))
                    )
                held = None if extra else (place, doc, text, own)
                if len(out) >= 500:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)
                    out = []
        if out:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbours(docs).mapInArrow(run, ddl)

