"""Packed token-id matrices by best-fit-decreasing with a segment tree over capacities.

Each task packs its own documents, block by block of at most ``block_tokens`` ids, so nothing is shuffled and memory is
bounded. Overlong documents are split losslessly: full pieces and a rest. Pieces are taken longest first; each goes to
the open sequence with the least room that still holds it, found in a segment tree over the rooms 0..capacity whose
nodes count open sequences. A row is one sequence: its ids padded to ``capacity`` as little-endian bytes, the cumulative
segment lengths (from 0), where positions restart, and from which document and where in it each segment comes.

Defined results: null or empty text is a segment of the end id alone; ties go by order of arrival; repeated rows are
packed each; a very long text is cut into full pieces and a rest, in order; an empty table gives no sequence; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, texts
from .token_ids import encoder

SEQUENCES = pa.schema(
    [
        ("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())),
        ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("ids", pa.binary()), ("position_ids", pa.binary()),
    ]
)
_DDL = "sequence_id long, n_tokens int, doc_ids array<long>, doc_starts array<long>, cu_seqlens array<int>, position_resets array<int>, ids binary, position_ids binary"


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of the lengths in each bin; lengths come in falling order, none above the capacity."""
    leaves = 1 << capacity.bit_length()
    count = [0] * (2 * leaves)  # open bins by room
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []

    def shift(room: int, by: int) -> None:
        node = room + leaves
        while node:
            count[node] += by
            node //= 2

    for i, size in enumerate(lengths):
        node = size + leaves
        if not count[node]:  # climb to the first right neighbour that has an open bin, then go down left first
            while node > 1 and not (node % 2 == 0 and count[node + 1]):
                node //= 2
            if node > 1:
                node += 1
                while node < leaves:
                    node *= 2
                    node += not count[node]
        if node > 1:
            room = node - leaves
            at = open_bins[room].pop()
            shift(room, -1)
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(i)
        if room > size:
            open_bins[room - size].append(at)
            shift(room - size, 1)
    return bins


def packed_sequences(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, pad_id: int = 0, id_type: str = "<u2", block_tokens: int = 4_000_000) -> DataFrame:
    """One row for each packed sequence. ``id_type``: numpy name of the ids' little-endian type; an id beyond it is an error.

    Positions have two bytes while the capacity allows, else four.
    """
    bound_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    most = np.iinfo(id_type).max
    if max(end_id, pad_id) > most:
        raise ValueError(f"ids {end_id} and {pad_id} don't fit {id_type}")
    position_type = "<u2" if capacity <= 1 << 16 else "<u4"

    def emit(block: list[tuple[int | None, int, np.ndarray]], serial: int) -> pa.RecordBatch:
        block.sort(key=lambda x: -len(x[2]))
        rows = []
        for n, members in enumerate(best_fit_decreasing([len(x[2]) for x in block], capacity)):
            ids, positions = np.full(capacity, pad_id, id_type), np.zeros(capacity, position_type)
            cuts = [0]
            for i in members:
                part = block[i][2]
                ids[cuts[-1] : cuts[-1] + len(part)] = part
                positions[cuts[-1] : cuts[-1] + len(part)] = np.arange(len(part))
                cuts.append(cuts[-1] + len(part))
            rows.append((serial + n, cuts[-1], [block[i][0] for i in members], [block[i][1] for i in members], cuts, cuts[:-1], ids.tobytes(), positions.tobytes()))
        return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), SEQUENCES)], schema=SEQUENCES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 40
        block: list[tuple[int | None, int, np.ndarray]] = []
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                for doc, raw in zip(some["doc_id"].to_pylist(), encoder(vocabulary).of_texts(some["text"].to_pylist())):
                    ids = np.frombuffer(raw + end, "<u4")
                    if ids.max() > most:
                        raise ValueError(f"id {ids.max()} doesn't fit {id_type}: ask for a wider id_type")
                    ids = ids.astype(id_type)
                    for start in range(0, len(ids), capacity):
                        block.append((doc, start, ids[start : start + capacity]))
                    held += len(ids)
                    if held >= block_tokens:
                        out = emit(block, serial)
                        serial, block, held = serial + out.num_rows, [], 0
                        for part in range(0, out.num_rows, 500):
                            yield out.slice(part, 500)
        if block:
            out = emit(block, serial)
            for part in range(0, out.num_rows, 500):
                yield out.slice(part, 500)

    return texts(docs).mapInArrow(run, _DDL)


def write_packed(sequences: DataFrame, path: str) -> DataFrame:
    """Writes sequences as Parquet, a row for each line of the id matrix, and gives the table as written."""
    sequences.write.mode("errorifexists").parquet(path)
    return sequences.sparkSession.read.schema(sequences.schema).parquet(path)


def packed_digest(sequences: DataFrame) -> DataFrame:
    """A short form of each sequence: its documents and cuts, and checksums of its ids and positions."""
    return sequences.select(
        "sequence_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.size("doc_ids").cast("long").alias("n_segments"), "doc_ids", "doc_starts",
        "cu_seqlens", "position_resets", F.crc32("ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"),
    )
