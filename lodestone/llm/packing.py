"""First-fit-decreasing packing with a tournament tree of bin capacities, in randomised groups of pieces.

Documents are tokenised once, inside tasks; only the pieces' lengths and checksums travel. A document longer than a
sequence is cut into full pieces, which are sequences of their own, and a rest. Pieces are dealt at random into groups
of about ``group_pieces``; each group packs alone: the longest piece first, each into the leftmost open bin that can
hold it, found by walking down a tree whose nodes hold the largest room below them.

Defined results: null or empty text is one piece of the end id alone; equal lengths are taken in order of doc_id,
start and salt; a very long text is cut into full pieces and a rest; repeated rows are packed each; an empty table gives no pieces; columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, stored, texts
from .token_ids import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document's ids and its end id."""
    bound_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                rows = []
                for doc, ids in zip(some["doc_id"].to_pylist(), encoder(vocabulary).of_texts(some["text"].to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        part = ids[4 * start : 4 * (start + capacity)]
                        serial += 1
                        rows.append((doc, start, len(part) // 4, zlib.crc32(part), n, serial))
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], names=[f.split()[0] for f in PIECES.split(", ")])

    return texts(docs).mapInArrow(cut, PIECES)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, which come in falling order.

    The tournament tree has a leaf for each bin there could be; a node holds the most room of the leaves below, so
    the leftmost bin with enough room is found in as many steps as the tree is high.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, size in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, group_pieces: int = 4096, seed: int = 11) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    found = stored(pieces(docs, vocabulary, capacity, end_id), "pieces")
    groups = max(1, round(found.count() / group_pieces))
    dealt = found.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "salt", "ids_crc32"), F.lit(groups)))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "salt"], ascending=[False, True, True, True])
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(np.int64(key[0]) << 32) + bins, offset=offsets)[[f.split()[0] for f in PLACED.split(", ")]]

    return dealt.groupBy("group").applyInPandas(place, PLACED)
