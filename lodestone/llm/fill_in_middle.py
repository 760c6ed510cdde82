"""Fill-in-middle by seekable compressed frames.

A text is kept as independent zstandard frames of ``units`` code points, with the cumulative number of code points before
each. To cut it at a code point only the frame that holds the cut is decompressed; its two sides are compressed anew, every
other frame is taken over as it is. The transformed text is again a list of such frames, in output order, so digests,
texts and the way back stream frame by frame and hold one frame at a time.

A document takes its cuts and its form from the SHA-256 of its id, so every run gives the same output. Without a shuffle,
each document is one row of its own in all steps.

Defined results: a null text is empty; an empty text, one that holds a marker, and one without a doc_id are plain; a cut may
fall at either end or both on one place, so any part may be empty; very long texts are many frames; repeated rows are
transformed alike, each; an empty table gives no rows; bytes that aren't valid UTF-8 count with the code point before them;
other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, texts

#: Code points of a frame.
UNITS = 16_384
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FRAMED = "doc_id long, n long, marked boolean, starts array<long>, frames array<binary>"
MOVED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, starts array<long>, frames array<binary>"
_FRAMES = [pa.list_(pa.int64()), pa.list_(pa.binary())]


@functools.lru_cache(1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def compress(data: bytes) -> bytes:
    return _zstd()[0].compress(data)


def decompress(frame: bytes) -> bytes:
    return _zstd()[1].decompress(frame)


def unit_starts(data: bytes) -> np.ndarray | None:
    """The byte at which each code point starts; None where every byte is one."""
    if data.isascii():
        return None
    found = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return found if len(found) and not found[0] else np.concatenate([[0], found])


def to_frames(data: bytes, units: int = UNITS) -> tuple[list[int], list[bytes]]:
    """The frames of a text, and the number of code points before each and, last, of all."""
    at = unit_starts(data)
    n = len(data) if at is None else len(at)
    cuts = [*range(0, n, units), n]
    bounds = cuts if at is None else [*at[cuts[:-1]].tolist(), len(data)]
    return cuts if n else [0], [compress(data[a:b]) for a, b in zip(bounds, bounds[1:])] if n else []


class Seekable:
    """Parts of a text that is kept as frames; a frame is decompressed at most once, and only if a part begins or ends inside it."""

    def __init__(self, starts: list[int], frames: list[bytes]):
        self.starts, self.frames = starts, frames
        self.opened: dict[int, tuple[bytes, np.ndarray | None]] = {}

    def _inside(self, j: int, first: int, end: int) -> bytes:
        if j not in self.opened:
            data = decompress(self.frames[j])
            self.opened[j] = data, unit_starts(data)
        data, at = self.opened[j]
        if at is None:
            return data[first:end]
        return data[at[first] : at[end] if end < len(at) else len(data)]

    def part(self, first: int, end: int) -> Iterator[tuple[int, bytes]]:
        """Number of code points and frame of each piece of the part [first, end)."""
        j = int(np.searchsorted(self.starts, first, "right")) - 1
        while first < end:
            low, high = self.starts[j], self.starts[j + 1]
            stop = min(high, end)
            whole = first == low and stop == high
            yield stop - first, self.frames[j] if whole else compress(self._inside(j, first - low, stop - low))
            first, j = stop, j + 1


def arranged(starts: list[int], frames: list[bytes], form: str, prefix: int, middle: int) -> tuple[list[int], list[bytes]]:
    """The frames of the transformed text, with cumulative code points."""
    if form == "plain":
        return starts, frames
    text, n = Seekable(starts, frames), starts[-1]
    parts = {PREFIX: (0, prefix), SUFFIX: (prefix + middle, n), MIDDLE: (prefix, prefix + middle)}
    out, count = [], [0]
    for marker in (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE):
        for units, frame in ((len(marker), compress(marker)), *text.part(*parts[marker])):
            out.append(frame)
            count.append(count[-1] + units)
    return count, out


def _hash_range(digest, frames: list[bytes], ends: list[int], first: int, end: int) -> None:
    """Feeds the bytes [first, end) of a text to a digest; only frames that hold some of them are opened."""
    j = int(np.searchsorted(ends, first, "right"))
    while first < end:
        low = ends[j - 1] if j else 0
        stop = min(ends[j], end)
        digest.update(memoryview(decompress(frames[j]))[first - low : stop - low])
        first, j = stop, j + 1


def digests(form: str, frames: Iterable[bytes]) -> tuple[str, str]:
    """SHA-256 of a transformed text, and of the text that is rebuilt from it and its form alone.

    One pass over the frames finds the markers, wherever frames begin; the parts are then read in the order of the text.
    """
    frames, whole, ends, size = list(frames), hashlib.sha256(), [], 0
    wanted = [] if form == "plain" else [PREFIX, SUFFIX, MIDDLE] if form == "psm" else [SUFFIX, PREFIX, MIDDLE]
    at: dict[bytes, int] = {}
    tail = b""
    for frame in frames:
        data = decompress(frame)
        whole.update(data)
        seen, low, place = tail + data, size - len(tail), 0
        while len(at) < len(wanted) and (place := seen.find(wanted[len(at)], place)) >= 0:
            at[wanted[len(at)]] = low + place
            place += 3
        tail = seen[max(place, len(seen) - 2) :] if place >= 0 else seen[-2:]
        size += len(data)
        ends.append(size)
    if form == "plain":
        return whole.hexdigest(), whole.hexdigest()
    stops = dict(zip(wanted, [*(at[m] for m in wanted[1:]), size]))
    back = hashlib.sha256()
    for marker in (PREFIX, MIDDLE, SUFFIX):
        _hash_range(back, frames, ends, at[marker] + 3, stops[marker])
    return whole.hexdigest(), back.hexdigest()


def framed(docs: DataFrame, units: int = UNITS) -> DataFrame:
    """Every document's text as frames: doc_id, n (code points), marked (holds a marker), starts, frames."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(to_frames(x, units), any(m in x for m in (PREFIX, SUFFIX, MIDDLE))) for x in batch["text"].to_pylist()]
            starts, frames = [s for (s, _), _ in rows], [f for (_, f), _ in rows]
            columns = [batch["doc_id"], pa.array([s[-1] for s in starts], pa.int64()), pa.array([m for _, m in rows], pa.bool_())]
            yield pa.record_batch([*columns, pa.array(starts, _FRAMES[0]), pa.array(frames, _FRAMES[1])], names=[f.split()[0] for f in FRAMED.split(", ")])

    return texts(docs).withColumn("text", F.col("text").cast("binary")).mapInArrow(run, FRAMED)


def cuts(seed: int = 1, plain: int = 10, spm: int = 20) -> dict[str, Column]:
    """form, prefix_chars and middle_chars of framed rows: ``plain`` percent stay as they are, ``spm`` percent of the rest put the suffix first."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256)
    h = [F.conv(F.substring(drawn, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    a, b = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    stays = (F.col("n") == 0) | F.col("marked") | F.col("doc_id").isNull() | (h[2] % 100 >= 100 - plain)
    form = F.when(stays, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    return {"form": form, "prefix_chars": F.when(~stays, F.least(a, b)), "middle_chars": F.when(~stays, F.greatest(a, b) - F.least(a, b))}


def fill_in_middle(frames: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """Framed rows transformed: doc_id, n (of the text), form, prefix_chars, middle_chars, and the output's starts and frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [arranged(*x) for x in zip(*(batch[c].to_pylist() for c in ("starts", "frames", "form", "prefix_chars", "middle_chars")))]
            kept = [batch[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")]
            yield pa.record_batch([*kept, pa.array([s for s, _ in rows], _FRAMES[0]), pa.array([f for _, f in rows], _FRAMES[1])], names=[f.split()[0] for f in MOVED.split(", ")])

    return frames.withColumns(cuts(seed, plain, spm)).mapInArrow(run, MOVED)


def with_text(moved: DataFrame, name: str = "output") -> DataFrame:
    """Transformed rows with their text instead of frames."""
    kept = [c for c in moved.columns if c not in ("starts", "frames")]
    kinds = ", ".join(f"{c} {moved.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [b"".join(map(decompress, x)) for x in batch["frames"].to_pylist()]
            yield pa.record_batch([*(batch[c] for c in kept), pa.array(made, pa.binary())], names=[*kept, name])

    return moved.mapInArrow(run, f"{kinds}, {name} binary").withColumn(name, F.col(name).cast("string"))


def with_digests(moved: DataFrame) -> DataFrame:
    """Transformed rows with output_sha256 and restored_sha256 instead of frames."""
    kept = [c for c in moved.columns if c not in ("starts", "frames")]
    kinds = ", ".join(f"{c} {moved.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [digests(*x) for x in zip(batch["form"].to_pylist(), batch["frames"].to_pylist())]
            hashes = [pa.array([x[i] for x in made], pa.string()) for i in (0, 1)]
            yield pa.record_batch([*(batch[c] for c in kept), *hashes], names=[*kept, "output_sha256", "restored_sha256"])

    return moved.mapInArrow(run, f"{kinds}, output_sha256 string, restored_sha256 string")
