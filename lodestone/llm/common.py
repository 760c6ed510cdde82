"""What the operators of this subpackage share: tables, shared storage, word caches, hashes."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: whole texts travel in them, so it is far below Spark's own default.
BATCH_ROWS = 250
#: Bytes of an Arrow batch, where the Spark version has such a setting.
BATCH_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keeps the Arrow batches that carry whole texts small: a setting of the session, as no operator has one of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage and outlives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, name: str, most: int = 32 << 20) -> DataFrame:
    """A stored table, marked for broadcast if its values take at most ``most`` bytes; beyond that Spark joins it by shuffle."""
    kept = stored(df, name)
    row = F.lit(8 * len(df.columns))
    for field in df.schema:
        if field.dataType.typeName() in ("string", "binary"):
            row = row + F.coalesce(F.octet_length(field.name), F.lit(0))
    size = kept.agg(F.sum(row.cast("long"))).first()[0] or 0
    return F.broadcast(kept) if size <= most else kept


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of the table has, whatever their case."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def texts(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, text (null: empty) and further columns, whatever else the table has."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *also
    )


def fold(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of an id as text, modulo the number of folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], rows: int = 250) -> Callable:
    """Turns a function of small record batches into one for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                if (out := f(batch.slice(at, rows))) is not None:
                    yield out

    return run


_KEPT: dict[str, object] = {}


def once_per_worker(key: str, build: Callable[[], object]) -> object:
    """What ``build`` made in this Python worker for this key; only the newest key's is kept, from task to task."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


class WordTable:
    """Values of words, each computed once for many batches.

    ``fill`` gets a list of new words and returns an array with one row for each.
    At ``limit`` words it drops those that it got last but the older half: words that come back early in a corpus are
    its frequent ones. So its memory is bounded whatever the corpus holds.
    """

    def __init__(self, fill: Callable[[list[str]], np.ndarray], limit: int = 200_000):
        self.fill, self.limit = fill, limit
        self.index: dict[str, int] = {}
        self.values: np.ndarray | None = None

    def rows(self, words: list[str]) -> np.ndarray:
        """The values of words, one row for each."""
        if len(self.index) > self.limit:
            self.index = dict(itertools.islice(self.index.items(), self.limit // 2))
        index = self.index
        new = [w for w in dict.fromkeys(words) if w not in index]
        if new or self.values is None:
            got = self.fill(new)
            used = len(index)
            if self.values is None:
                self.values = np.zeros((max(1 << 16, len(new)), *got.shape[1:]), got.dtype)
            if used + len(new) > len(self.values):
                grown = np.zeros((max(2 * len(self.values), used + len(new)), *got.shape[1:]), got.dtype)
                grown[:used] = self.values[:used]
                self.values = grown
            self.values[used : used + len(new)] = got
            index.update(zip(new, range(used, used + len(new))))
        return self.values[np.fromiter(map(index.__getitem__, words), np.int64, len(words))]


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments of rows; empty segments give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (multiply and xor-shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


#: A random odd multiplier and a random 64-bit value for each byte: the word hash is a polynomial over them.
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(data: np.ndarray, lengths: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, as UTF-8 bytes laid end to end, with A-Z lower-cased.

    Words are runs of bytes that ``apart`` doesn't mark: other than space, tab, line feed, vertical tab, form feed and
    carriage return, unless it says otherwise; none reaches over the end of a text. Returns the hashes in order and the number of words of each text.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(lengths), np.int64)
    low = _LOWER[data]
    word = ~apart[low]
    first = np.zeros(n + 1, bool)
    ends = np.cumsum(lengths)
    first[ends - lengths] = True
    first = first[:n]
    opens = word.copy()
    opens[1:] &= ~word[:-1] | first[1:]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(lengths), np.int64)
    shuts = np.empty(n, bool)
    shuts[-1] = word[-1]
    shuts[:-1] = word[:-1] & (~word[1:] | first[1:])
    stops = np.flatnonzero(shuts) + 1
    size = stops - starts
    value = _BYTES[low]
    hashes = np.zeros(len(starts), np.uint64)
    base = np.uint64(_BASE)
    for i in range(min(int(size.max()), 24)):  # the usual words: one step for each byte position, over all words
        live = np.flatnonzero(size > i) if i else slice(None)
        hashes[live] = hashes[live] * base + value[starts[live] + i]
    for j in np.flatnonzero(size > 24):  # long ones: a power series over the rest of the word
        rest = value[starts[j] + 24 : stops[j]]
        power = np.full(len(rest) + 1, base)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        hashes[j : j + 1] = hashes[j : j + 1] * power[-1:] + np.sum(rest * power[-2::-1], dtype=np.uint64, keepdims=True)
    hashes = mix64(hashes ^ (size.astype(np.uint64) << np.uint64(40)))
    return hashes, np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))


def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, end to end, and their lengths."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, np.diff(offsets)
