"""Best-fit packing by bin completion: branch and bound over the fillings of one sequence at a time.

Documents are tokenised once, inside tasks; only lengths and checksums of their pieces travel. A document longer than a
sequence is cut into full pieces, sequences of their own, and a rest that comes first. Rests are dealt at random into
groups of about ``group_pieces``, and each group is packed alone:

- Best-fit decreasing gives the first incumbent. The least number of sequences is bounded from below by the total and by
  the pieces that can't share a sequence; an incumbent that meets the bound is the best there is.
- Else a search takes the longest piece left and enumerates the undominated fillings around it: a filling is left out if
  another holds, in place of one or more of its pieces, one that is at least as long as them together. Fillings come by
  rising waste; a branch ends when the waste so far is more than a packing with one sequence less could have.
- The search is depth first with a budget of ``work``; each better packing is the new incumbent. Without a budget it is
  exhaustive. However it ends, every piece is packed.

Lengths are sets of bits in one integer, so "the longest that fits" and "two that fill it exactly" are a few operations.

Defined results: a null or empty text is one piece of the end id alone; equal lengths are taken in order of doc_id, piece
and salt; repeated rows are packed each; a null doc_id stays null; an empty table gives no pieces; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, stored, texts
from .token_ids import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, salt long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_KINDS = [pa.int64(), pa.int32(), *[pa.int64()] * 5]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of each document's ids and its end id: of a longer one a rest, if any, and then full pieces."""
    bound_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["doc_id"].to_pylist(), encoder(vocabulary).of_texts(batch["text"].to_pylist())):
                ids += end
                n = len(ids) // 4
                stops = range((n - 1) % capacity + 1, n + 1, capacity)
                for i, stop in enumerate(stops):
                    start = stops[i - 1] if i else 0
                    part = ids[4 * start : 4 * stop]
                    serial += 1
                    rows.append((doc, i, start, stop - start, zlib.crc32(part), n, serial))
            if rows:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), _KINDS)], names=[f.split()[0] for f in PIECES.split(", ")])

    return texts(docs).mapInArrow(cut, PIECES)


class Lengths:
    """A bag of piece lengths up to ``capacity``, with sets of those that are there as the bits of integers."""

    def __init__(self, lengths: list[int], capacity: int, budget: float = math.inf):
        self.capacity, self.budget = capacity, budget
        self.work = 0  # pieces taken out so far: what a search's budget counts
        self.counts = [0] * (capacity + 1)
        self.bits = self.mirror = 0  # bit s, bit capacity - s
        for s in lengths:
            self.add(s)

    def add(self, s: int) -> None:
        if not self.counts[s]:
            self.bits |= 1 << s
            self.mirror |= 1 << (self.capacity - s)
        self.counts[s] += 1

    def take(self, s: int) -> None:
        self.work += 1
        self.counts[s] -= 1
        if not self.counts[s]:
            self.bits ^= 1 << s
            self.mirror ^= 1 << (self.capacity - s)

    def most(self, room: int) -> int:
        """The longest piece that fits in the room; 0 if none does."""
        return max(0, (self.bits & ((2 << room) - 1)).bit_length() - 1)

    def between(self, low: int, high: int) -> bool:
        """Is there a piece of at least ``low`` and at most ``high``?"""
        return low <= high and bool(self.bits >> low & ((2 << (high - low)) - 1))

    def pairs(self, total: int, most: int) -> Iterator[int]:
        """The longer piece s, up to ``most``, of each two that are there and fill the total exactly; the most even two come first."""
        half = -(-total // 2)
        found = self.bits & (self.mirror >> (self.capacity - total)) & ((2 << min(most, total - 1)) - 1) if total > 1 else 0
        found >>= half
        if 2 * half == total and self.counts[half] < 2:
            found &= ~1
        while found:
            low = found & -found
            yield half + low.bit_length() - 1
            found ^= low

    def exact(self, total: int, size: int) -> Iterator[list[int]]:
        """One to three falling lengths that are there together and fill the total exactly; even ones come first, so that short pieces are kept for later."""
        if size == 1:
            if self.counts[total]:
                yield [total]
        elif size == 2:
            for s in self.pairs(total, total):
                yield [s, total - s]
        else:
            third = -(-total // 3)
            there = self.bits & ((1 << max(0, total - 1)) - 1) if total > 2 else 0
            there >>= third
            s = third
            while there and self.work < self.budget:
                skip = (there & -there).bit_length() - 1
                s += skip
                self.take(s)
                found = list(self.pairs(total - s, s))
                self.add(s)
                for t in found:
                    yield [s, t, total - s - t]
                there >>= skip + 1
                s += 1

def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of lengths: the longest first, each into the fullest bin that can hold it. Bins' rooms are bits of an integer."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0
    for s in sorted(lengths, reverse=True):
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(s)
        if left := room - s:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def least_bins(lengths: list[int], capacity: int) -> int:
    """A bound from below: for each limit k, pieces over capacity - k stand alone, and the room of others over half takes all from k on."""
    sizes = np.sort(np.asarray(lengths, np.int64))
    sums = np.concatenate([[0], np.cumsum(sizes)])
    bound = -(-int(sums[-1]) // capacity)
    n, half = len(sizes), int(np.searchsorted(sizes, capacity / 2, "right"))
    for k in np.unique(sizes[:half]).tolist():
        alone = int(np.searchsorted(sizes, capacity - k, "right"))
        first = int(np.searchsorted(sizes, k, "left"))
        mid, small = (alone - half) * capacity - int(sums[alone] - sums[half]), int(sums[half] - sums[first])
        bound = max(bound, n - half + max(0, -(-(small - mid) // capacity)))
    return max(bound, n - half)


def _dominated(bag: Lengths, found: list[int], left: int) -> bool:
    """Could another piece be added, or replace one of the filling's pieces or two of them, being longer than one or as long as two?"""
    for s in found:
        bag.take(s)
    out = bag.between(1, left)
    for i, s in enumerate(found):
        if out:
            break
        out = bag.between(s + 1, s + left) or any(bag.between(s + t, s + t + left) for t in found[i + 1 :])
    for s in found:
        bag.add(s)
    return out


def _longer_fillings(bag: Lengths, room: int, waste: int, width: int | None) -> list[list[int]]:
    """Fillings of four pieces and more that leave at most ``waste``, by rising waste; with a width, the first that are met, the longest pieces first."""
    kept: list[tuple[int, list[int]]] = []
    found: list[int] = []

    def deeper(left: int, most: int) -> bool:
        bag.work += 1
        if len(found) > 3 and left <= waste and not _dominated(bag, found, left):
            kept.append((left, found[:]))
            if width and (not left or len(kept) >= width):
                return True
        s = bag.most(min(most, left))
        while s:
            for k in range(min(bag.counts[s], left // s), 0, -1):
                found.extend([s] * k)
                over = deeper(left - k * s, s - 1)
                del found[-k:]
                if over or bag.work >= bag.budget:
                    return True
            s = bag.most(s - 1)
        return False

    if waste >= 0:
        deeper(room, room)
    return [x for _, x in sorted(kept, key=lambda x: x[0])]


def fillings(bag: Lengths, room: int, waste: int, width: int | None = None) -> Iterator[list[int]]:
    """Undominated fillings of a room that leave at most ``waste``: by rising waste those of up to three pieces, then longer ones.

    ``width`` bounds how many of either kind; without it, and within the bag's budget of work, they are all there.
    """
    one = bag.most(room)
    if not one or one == room:  # nothing fits, or one piece fills the room and so dominates every other filling
        if room - one <= waste:
            yield [one] if one else []
        return
    least = room - one  # the longest piece alone dominates whatever leaves as much or more
    given = 0
    for left in range(min(waste, least) + 1):
        if left == least:
            if not _dominated(bag, [one], left):
                yield [one]
            break
        if bag.work >= bag.budget or width and given >= width:
            break
        for size in (2, 3):
            for found in bag.exact(room - left, size):
                if not _dominated(bag, found, left):
                    yield found
                    given += 1
                    if width and given >= width:
                        break
    yield from _longer_fillings(bag, room, min(waste, least - 1), width)


def search(lengths: list[int], capacity: int, best: list[list[int]], bound: int, work: float, width: int | None) -> tuple[list[list[int]], bool]:
    """The best packing that the search finds below an incumbent, and whether it ended because there is no better one."""
    total, bag = sum(lengths), Lengths(lengths, capacity, work)
    bins: list[list[int]] = []
    open_: list[tuple[int, Iterator[list[int]]]] = []  # of each depth, the waste before it and what is left to try
    waste = 0
    limit = (len(best) - 1) * capacity - total
    while bag.work < work and limit >= 0:
        if bag.bits:
            first = bag.most(capacity)
            bag.take(first)
            bins.append([first])
            open_.append((waste, fillings(bag, capacity - first, limit - waste, width)))
        else:
            best = [x[:] for x in bins]
            limit -= capacity
            if len(best) <= bound:
                return best, True
        while open_:  # the next filling of the deepest sequence that has one; a sequence without goes back to the bag
            waste, tries = open_[-1]
            for s in bins[-1][1:]:
                bag.add(s)
            del bins[-1][1:]
            found = next((x for x in tries if waste + capacity - bins[-1][0] - sum(x) <= limit), None)
            if found is not None:
                for s in found:
                    bag.take(s)
                bins[-1] += found
                waste += capacity - sum(bins[-1])
                break
            open_.pop()
            bag.add(bins.pop()[0])
        if not open_:
            return best, width is None
    return best, limit < 0


def bin_completion(lengths: list[int], capacity: int, work: float = 400_000, width: int | None = 8, seed: int = 12) -> tuple[list[list[int]], bool]:
    """Bins of lengths, as few as the search finds, and whether they are proven to be the fewest there can be.

    The incumbent's emptiest bins are searched first, together with some drawn at random, in windows that double: a bin
    less for a window is a bin less for all. The last window is everything. ``work`` bounds the pieces that are tried,
    ``width`` the fillings of each sequence; with neither the last search is exhaustive.
    """
    best = best_fit_decreasing(lengths, capacity)
    bound = least_bins(lengths, capacity)
    drawn, left = random.Random(seed), work
    size = 4
    while len(best) > bound and left > 0:
        best.sort(key=sum)
        if size >= len(best):
            return search(lengths, capacity, best, bound, left, width)
        near, far = best[: size - size // 4], best[size - size // 4 :]
        drawn.shuffle(far)
        window, rest = near + far[: size // 4], far[size // 4 :]
        inside = [s for b in window for s in b]
        spent = min(left, work / 16) if left < math.inf else 50_000
        left -= spent
        found, _ = search(inside, capacity, window, len(window) - 1, spent, width)
        if len(found) < len(window):
            best = found + rest
        else:
            size *= 2
            if size >= len(best) and width:
                size = 4
    return best, len(best) <= bound


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, group_pieces: int = 4096, work: float = 400_000, seed: int = 12) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    found = stored(pieces(docs, vocabulary, capacity, end_id), "best-fit-pieces")
    rests = found.where(F.col("length") < capacity)
    groups = max(1, round(rests.count() / group_pieces))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "salt"], ascending=[False, True, True, True]).reset_index(drop=True)
        bins, _ = bin_completion(rows["length"].tolist(), capacity, work)
        lengths = rows["length"].to_numpy()
        at = dict(zip(lengths.tolist()[::-1], range(len(rows) - 1, -1, -1)))  # the first row of each length
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for b, held in enumerate(bins):
            place = 0
            for s in held:
                sequence[at[s]], offset[at[s]] = b, place
                at[s] += 1
                place += s
        return rows.assign(sequence_id=(np.int64(key[0]) << 32) + sequence, offset=offset)[[f.split()[0] for f in PLACED.split(", ")]]

    dealt = rests.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "salt", "ids_crc32"), F.lit(groups)))
    alone = found.where(F.col("length") == capacity).select(*[f.split()[0] for f in PIECES.split(", ")][:-1], (-F.col("salt")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return dealt.groupBy("group").applyInPandas(place, PLACED).unionByName(alone)
