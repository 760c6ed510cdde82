"""Running values over sorted rows of a table that no single task could hold.

``running`` sorts rows by range, so even the rows of one key lie in many tasks; each task keeps running values of its own
rows and the driver gets one row a task, from which it knows what comes before each. A channel is a map x -> a * x + b for
each row, composed in order from the start of the row's key: a = b = 1 counts, a = 1 sums, a = base hashes a sequence,
a = 0 sets a value that rows with a = 1, b = 0 hand on.

``list_ranks`` finds where each element of a linked list stands: tasks follow links among the elements of a range of ids
and give each piece of list that they can follow one entry in a shorter list, which is ranked in the same way. A round that
shortens little takes elements out by lot instead, about a quarter of them, wherever they lie. A list that fits in one
range ends the rounds.

Defined results: keys may be null, nulls are one key; rows equal in all keys and order columns follow each other in any
order; an empty table gives an empty table. A list with a cycle, or with two elements that have one successor, raises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A channel: from a row (as a tuple of the columns of ``by`` and ``carried``) to the numbers a and b.
Step = Callable[[dict], tuple[int, int]]
#: Values of channels are kept as signed integers of 17 bytes.
_WIDTH = 17


def _packed(x: int) -> bytes:
    return x.to_bytes(_WIDTH, "big", signed=True)


def _read(x: bytes) -> int:
    return int.from_bytes(x, "big", signed=True)


def running(df: DataFrame, by: list[str], order: list[str], channels: dict[str, tuple[Step, int | None]], ahead: list[str] = (), name: str = "running") -> DataFrame:
    """The rows of ``df`` with a column of 17 bytes (a signed integer, big-endian) for each channel: the composed maps up
    to and with the row, applied to 0. A channel is its step and a modulus or None.

    ``ahead`` names columns whose values in the next row of the same key are added as next_<name>; has_next says if there
    is one. The result is a stored table.
    """
    spark, columns, labels = df.sparkSession, df.columns, list(channels)
    steps = [channels[c] for c in labels]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    nexts = "".join(f", `next_{c}` {df.schema[c].dataType.simpleString()}" for c in ahead)
    schema = f"{fields}, has_next boolean{nexts}" + "".join(f", `_a_{c}` binary, `{c}` binary" for c in labels) + ", _part int, _first boolean, _sum boolean"

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, first = TaskContext.get().partitionId(), None, True
        now: list[tuple[int, int]] = []
        held, opening, out = None, None, []

        def emit(final: bool = False):
            block = pa.Table.from_pylist(out, schema=arrow).combine_chunks().to_batches() if out else []
            out.clear()
            return block

        arrow = None
        for batch in batches:
            if arrow is None:
                arrow = pa.schema(
                    [*batch.schema, pa.field("has_next", pa.bool_()), *[pa.field(f"next_{c}", batch.schema.field(c).type) for c in ahead], *[pa.field(f"{p}{c}", pa.binary()) for c in labels for p in ("_a_", "")], pa.field("_part", pa.int32()), pa.field("_first", pa.bool_()), pa.field("_sum", pa.bool_())]
                )
            for row in batch.to_pylist():
                own = tuple(row[c] for c in by)
                same = held is not None and own == key
                if held is None:
                    opening = row
                elif not same:
                    first = False
                if held is not None:
                    out.append(held | {"has_next": same} | {f"next_{c}": row[c] if same else None for c in ahead})
                for i, (step, modulus) in enumerate(steps):
                    a, b = step(row)
                    if same:
                        before = now[i]
                        a, b = a * before[0], a * before[1] + b
                    if modulus:
                        a, b = a % modulus, b % modulus
                    now[i : i + 1] = [(a, b)]
                key = own
                held = row | {"_part": part, "_first": first, "_sum": False}
                for c, (a, b) in zip(labels, now):
                    held[f"_a_{c}"], held[c] = _packed(a), _packed(b)
            if len(out) >= 5000:
                yield from emit()
        if held is not None:
            # what the tasks after and before this one need: its last row, which waits for its next, and its first one
            out.append(held | {"has_next": None, "_sum": True})
            out.append({c: opening[c] for c in columns} | {"_part": part, "_first": True, "_sum": True, "has_next": True})
            yield from emit()

    swept = stored(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).mapInArrow(sweep, schema), f"{name}-swept")
    edges = swept.where("_sum").collect()  # two rows for each task of the sort
    lasts = {r["_part"]: r for r in edges if r["has_next"] is None}
    opens = {r["_part"]: r for r in edges if r["has_next"]}
    before: dict[int, list[int]] = {}  # of each task, the values that the first key there has so far
    found: dict[int, dict] = {}  # of each task, what its last row meets next
    parts = sorted(lasts)
    carry, previous = [0] * len(labels), None
    for i, p in enumerate(parts):
        if previous is None or tuple(previous[c] for c in by) != tuple(opens[p][c] for c in by):
            carry = [0] * len(labels)
        before[p] = carry
        last = lasts[p]
        values = [_read(last[c]) + (_read(last[f"_a_{c}"]) * x if last["_first"] else 0) for c, x in zip(labels, carry)]
        carry = [v % m if m else v for v, (_, m) in zip(values, steps)]
        following = opens[parts[i + 1]] if i + 1 < len(parts) else None
        same = following is not None and tuple(following[c] for c in by) == tuple(last[c] for c in by)
        found[p] = {"has_next": same} | {f"next_{c}": following[c] if same else None for c in ahead}
        previous = last

    wanted = [c for c in swept.columns if not c.startswith("_a_") and c not in ("_part", "_first", "_sum")]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            rows = zip(batch["_part"].to_pylist(), batch["_first"].to_pylist(), batch["_sum"].to_pylist())
            marks = list(rows)
            for c, (_, modulus), at in zip(labels, steps, range(len(labels))):
                if any(f and before[p][at] for p, f, _ in marks):
                    maps, values = batch[f"_a_{c}"].to_pylist(), batch[c].to_pylist()
                    for j, (p, f, _) in enumerate(marks):
                        if f and before[p][at]:
                            v = _read(values[j]) + _read(maps[j]) * before[p][at]
                            values[j] = _packed(v % modulus if modulus else v)
                    table = table.set_column(table.schema.get_field_index(c), c, pa.array(values, pa.binary()))
            ends = {j: found[p] for j, (p, _, s) in enumerate(marks) if s}
            if ends:
                for c in ["has_next", *(f"next_{c}" for c in ahead)]:
                    values = table[c].to_pylist()
                    for j, x in ends.items():
                        values[j] = x[c]
                    table = table.set_column(table.schema.get_field_index(c), c, pa.array(values, table.schema.field(c).type))
            yield from table.select(wanted).combine_chunks().to_batches()

    kinds = ", ".join(f"`{c}` {swept.schema[c].dataType.simpleString()}" for c in wanted)
    return swept.where("not _sum or has_next is null").mapInArrow(settle, kinds)


def as_long(column: str):
    """A channel's value that fits in a long."""
    return F.conv(F.hex(F.substring(column, _WIDTH - 7, 8)), 16, -10).cast("long")


def _follow(values: int) -> Callable:
    """Follows links among the elements of one range: of each element, the first of its piece and sums before it there;
    of each piece, as a row of a shorter list, its first element, the one after its last and its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]  # (x, y, next_x, next_y, values...)
        place = {(r[0], r[1]): i for i, r in enumerate(rows)}
        follows = [place.get((r[2], r[3]), -1) for r in rows]
        led = bytearray(len(rows))
        for j in follows:
            if j >= 0:
                if led[j]:
                    raise ValueError("two elements of the list have one successor")
                led[j] = 1
        out, seen = [], 0
        for i, r in enumerate(rows):
            if led[i]:
                continue
            sums, j = [0] * values, i
            while True:
                at = rows[j]
                out.append((at[0], at[1], r[0], r[1], *sums, None, None, False))
                seen += 1
                sums = [s + v for s, v in zip(sums, at[4:])]
                if follows[j] < 0:
                    break
                j = follows[j]
            out.append((None, None, r[0], r[1], *sums, at[2], at[3], True))
        if seen < len(rows):
            raise ValueError("the list has a cycle")
        if out:
            names = ["x", "y", "head_x", "head_y", *[f"v{i}" for i in range(values)], "next_x", "next_y", "piece"]
            kinds = [pa.int64()] * (len(names) - 1) + [pa.bool_()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return run


def list_ranks(links: DataFrame, values: list[str], block: int = 1 << 16) -> DataFrame:
    """x, y and the sums of ``values`` (longs) over all elements before each element of a linked list.

    ``links`` has an element's id (x, y: longs), that of the next one (next_x, next_y; null at the list's end) and its
    values. A task holds about ``block`` elements at once.
    """
    named = [F.col(c).alias(f"v{i}") for i, c in enumerate(values)]
    found = _ranked(stored(links.select("x", "y", "next_x", "next_y", *named), "list"), len(values), block)
    return found.select("x", "y", *[F.col(f"v{i}").alias(c) for i, c in enumerate(values)])


def _ranked(links: DataFrame, values: int, block: int, depth: int = 0) -> DataFrame:
    n = links.count()
    sums = [f"v{i}" for i in range(values)]
    if depth > 200:
        raise ValueError("the list has a cycle")
    tasks = -(-n // block) or 1
    kinds = "x long, y long, head_x long, head_y long, " + "".join(f"{v} long, " for v in sums) + "next_x long, next_y long, piece boolean"
    dealt = links.repartitionByRange(tasks, "x", "y") if tasks > 1 else links.coalesce(1)
    swept = stored(dealt.select("x", "y", "next_x", "next_y", *sums).mapInArrow(_follow(values), kinds), "list-pieces")
    members = swept.where("not piece").drop("next_x", "next_y", "piece")
    if n <= block:
        return members.drop("head_x", "head_y")
    pieces = swept.where("piece").select(F.col("head_x").alias("x"), F.col("head_y").alias("y"), "next_x", "next_y", *sums)
    if pieces.count() > 0.7 * n:  # links lead far away: take elements out by lot
        return _by_lot(links, values, block, depth)
    above = _ranked(pieces, values, block, depth + 1)
    heads = above.select(F.col("x").alias("head_x"), F.col("y").alias("head_y"), *[F.col(v).alias(f"before_{v}") for v in sums])
    return stored(members.join(heads, ["head_x", "head_y"]).select("x", "y", *[(F.col(v) + F.col(f"before_{v}")).alias(v) for v in sums]), "list-ranks")


def _by_lot(links: DataFrame, values: int, block: int, depth: int) -> DataFrame:
    """Elements that draw 0 and follow one that draws 1 are joined to it; the rest is ranked, and they are put back."""
    sums = [f"v{i}" for i in range(values)]
    drawn = links.withColumn("lot", F.xxhash64(F.lit(depth), "x", "y").bitwiseAND(1))
    out = drawn.where("lot = 0").select(F.col("x").alias("next_x"), F.col("y").alias("next_y"), F.col("next_x").alias("far_x"), F.col("next_y").alias("far_y"), *[F.col(v).alias(f"own_{v}") for v in sums])
    led = stored(drawn.where("lot = 1").join(out, ["next_x", "next_y"], "left"), "list-lots")
    joined = F.col("own_v0").isNotNull()
    gone = led.where(joined).select(F.col("next_x").alias("x"), F.col("next_y").alias("y"))
    kept = led.select("x", "y", F.when(joined, F.col("far_x")).otherwise(F.col("next_x")).alias("next_x"), F.when(joined, F.col("far_y")).otherwise(F.col("next_y")).alias("next_y"), *[(F.col(v) + F.coalesce(f"own_{v}", F.lit(0))).alias(v) for v in sums])
    others = drawn.where("lot = 0").drop("lot").join(gone, ["x", "y"], "left_anti")
    above = _ranked(stored(kept.unionByName(others), "list-kept"), values, block, depth + 1)
    back = led.where(joined).select("x", "y", F.col("next_x").alias("to_x"), F.col("next_y").alias("to_y"), *[F.col(v).alias(f"lead_{v}") for v in sums])
    placed = back.join(above, ["x", "y"]).select(F.col("to_x").alias("x"), F.col("to_y").alias("y"), *[(F.col(v) + F.col(f"lead_{v}")).alias(v) for v in sums])
    return stored(above.unionByName(placed), "list-ranks")
