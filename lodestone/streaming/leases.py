"""Stateful streams: leases that run out, sessions that idleness ends, and a sink that appends each batch once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEASE = 300


def _expired(seconds: int) -> Callable:
    step = seconds * 1_000_000

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Beats of one owner in order of time: a lease whose next beat comes too late is given back when it ran out.

        Beats wait until the watermark has passed them, so one that comes in a later batch still takes its place.
        """
        at, event, times, ids = state.get if state.exists else (None, None, [], [])
        waiting = list(zip(times, ids))
        if not state.hasTimedOut:
            for rows in batches:
                waiting += zip(rows["at"].tolist(), rows["event_id"].tolist())
        waiting.sort()
        passed = max(0, state.getCurrentWatermarkMs()) * 1000
        n = sum(x[0] <= passed for x in waiting)
        out: list[tuple] = []
        for then, beat in waiting[:n]:
            if at is not None and then > at + step:
                out.append((key[0], event, at))
            at, event = then, beat
        waiting = waiting[n:]
        if at is not None and at + step < passed:
            out.append((key[0], event, at))
            at = event = None
        if at is None and not waiting:
            if state.exists:
                state.remove()
        else:
            state.update((at, event, [x[0] for x in waiting], [x[1] for x in waiting]))
            # when the next beat is reached, or the lease is over, whichever is first; always past the watermark
            due = [-(-x[0] // 1000) for x in waiting[:1]] + ([] if at is None else [(at + step) // 1000 + 1])
            state.setTimeoutTimestamp(max(min(due), passed // 1000 + 1))
        yield pd.DataFrame(out, columns=["owner", "event_id", "at"])

    return follow


def expired_leases(beats: DataFrame, seconds: int = LEASE, late: str = "0 seconds") -> DataFrame:
    """owner, event_id, at (microseconds) of leases that no later beat of the owner extended within ``seconds``.

    beats: a stream of owner, event_id, ts (timestamp). Every owner's state is one lease and the beats that the watermark
    hasn't passed, with a timeout in event time, so an owner that falls silent is noticed too. Beats later than ``late``
    don't count.
    """
    timed = beats.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    kind = "at long, event_id long, times array<long>, ids array<long>"
    return timed.groupBy("owner").applyInPandasWithState(_expired(seconds), "owner long, event_id long, at long", kind, "append", GroupStateTimeout.EventTimeTimeout)


def closed_sessions(events: DataFrame, key: str, idle: str = "24 hours", late: str = "0 seconds") -> DataFrame:
    """key, started, ended, n of sessions (a stream with ts) that are closed: the watermark is past their idle time."""
    found = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", idle).alias("w"))
    return found.agg(F.max("ts").alias("ended"), F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), "ended", "n")


def drained(stream: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream over all that is there, into a table of the shared folder, and gives that table.

    Files and checkpoint are in the folder that spark.checkpoint.dir names, so a batch that is run again after a lost
    executor counts once. ``settings`` of the session hold while the stream runs.
    """
    spark = stream.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    place = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            spark.conf.set(k, v)
        run = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/rows")
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def appended(stream: DataFrame, name: str, batch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A log of a stream: every micro-batch, as ``batch`` makes it, in a folder of its number, so that a repeated one replaces itself."""
    spark = stream.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    place = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(rows: DataFrame, number: int) -> None:
        batch(rows).write.mode("overwrite").parquet(f"{place}/rows/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/rows")
