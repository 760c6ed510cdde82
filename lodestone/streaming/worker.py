"""The workers' loop as one stateful stream: commands of a queue, in the order of their times, with its jobs as state.

Every queue's open jobs are in a list in the state store, so whoever claims does so alone; some queues in a row share a
list, as a list costs far more to fetch and put back than a job. Commands wait in a second list
until the watermark has passed them and are then carried out in the order of their times, whatever batch they came in. A
timer rings when the next one is due or the next lease runs out, so a job of a worker that fell silent goes back to its
queue without anyone asking. Finished jobs leave the state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators.state import ATTEMPTS, BACKOFF, LEASE, LONGEST

COMMANDS = "queue long, at long, event_id long, command string, job_id long, priority long"
JOBS = "queue long, job_id long, priority long, created long, status string, attempts long, due long, lease long, claimed long"
LOG = "queue long, event_id long, at long, job_id long, action string, status string, attempts long, until long"
SECOND = 1_000_000
#: Queues, by their ids in a row, that share a list.
TOGETHER = 32


class Job(NamedTuple):
    """Times are microseconds; due and lease may be None."""

    job_id: int
    priority: int
    created: int
    status: str = "PENDING"
    attempts: int = 0
    due: int | None = None
    lease: int | None = None
    claimed: int = 0


def _failed(job: Job, now: int) -> Job:
    """A job after an attempt that failed: to be tried again after a while that doubles, or given up."""
    if job.attempts >= ATTEMPTS:
        return job._replace(status="DEAD_LETTER", lease=None, due=None)
    wait = BACKOFF if job.attempts <= 0 else min(BACKOFF << min(job.attempts - 1, 32), LONGEST)
    return job._replace(status="FAILED", lease=None, due=now + wait * SECOND)


def _returned(jobs: dict[int, Job], now: int) -> Iterator[tuple]:
    """Jobs whose lease ran out before ``now`` fail at the time it did."""
    for job in sorted((j for j in jobs.values() if j.status == "RUNNING" and j.lease < now), key=lambda j: (j.lease, j.job_id)):
        after = _failed(job, job.lease)
        yield (None, job.lease, job.job_id, "RECLAIM", after.status, after.attempts, after.due)
        _keep(jobs, after)


def _keep(jobs: dict[int, Job], job: Job) -> None:
    if job.status in ("COMPLETED", "DEAD_LETTER"):
        del jobs[job.job_id]
    else:
        jobs[job.job_id] = job


def carried_out(jobs: dict[int, Job], commands: Iterable[tuple], until: int) -> Iterator[tuple]:
    """The log of commands (at, event_id, command, job_id, priority), in order, and of leases that run out up to ``until``.

    A job that is submitted again while it is open stays as it is. A poll first gives back what has run out, then takes
    the due job with the highest priority, of these the oldest. A heartbeat, complete or fail without a job_id is for the
    job that was claimed last and still runs; one for a job that doesn't run changes nothing.
    """
    for at, event_id, command, job_id, priority in commands:
        yield from _returned(jobs, at)
        if command == "submit":
            jobs.setdefault(job_id, Job(job_id, priority, at))
            continue
        if command == "poll":
            free = [j for j in jobs.values() if (j.status == "PENDING" or j.status == "FAILED" and j.attempts < ATTEMPTS) and (j.due is None or j.due <= at)]
            if not free:
                continue
            job = min(free, key=lambda j: (-j.priority, j.created, j.job_id))
            after = job._replace(status="RUNNING", attempts=job.attempts + 1, lease=at + LEASE * SECOND, claimed=at)
        else:
            running = [j for j in jobs.values() if j.status == "RUNNING" and job_id in (None, j.job_id)]
            if not running:
                continue
            job = max(running, key=lambda j: (j.claimed, j.job_id))
            after = {"heartbeat": job._replace(lease=at + LEASE * SECOND), "complete": job._replace(status="COMPLETED", lease=None), "fail": _failed(job, at)}[command]
        yield (event_id, at, job.job_id, command.upper(), after.status, after.attempts, after.lease if after.status == "RUNNING" else after.due if after.status == "FAILED" else None)
        _keep(jobs, after)
    yield from _returned(jobs, until)


class Worker(StatefulProcessor):
    """The jobs of some queues and the commands that wait for the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getListState("jobs", JOBS)
        self.waiting = handle.getListState("waiting", COMMANDS)

    def _advance(self, new: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        until = watermark * 1000
        ready, waiting, jobs = {}, [], {}
        for r in sorted([*(tuple(r) for r in self.waiting.get()), *new], key=lambda r: r[1:3]):
            if r[1] <= until:
                ready.setdefault(r[0], []).append(r[1:])
            else:
                waiting.append(r)
        for r in self.jobs.get():
            jobs.setdefault(r[0], {})[r[1]] = Job(*r[1:])
        log = [(queue, *x) for queue in dict.fromkeys([*jobs, *ready]) for x in carried_out(jobs.setdefault(queue, {}), ready.get(queue, ()), until)]
        held = [(queue, *job) for queue, own in jobs.items() for job in own.values()]
        for state, rows in ((self.jobs, held), (self.waiting, waiting)):
            state.put(rows) if rows else state.clear()
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        # a timer rings once the watermark is past it: when a command's time is reached, or a lease's is over
        times = [-(-r[1] // 1000) - 1 for r in waiting[:1]] + [j.lease // 1000 for own in jobs.values() for j in own.values() if j.status == "RUNNING"]
        if times:
            self.handle.registerTimer(max(min(times), watermark))
        yield pd.DataFrame(log, columns=[c.split()[0] for c in LOG.split(", ")]).astype({c: "Int64" for c in ("queue", "event_id", "until")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            wanted = frame[["queue", "at", "event_id", "command", "job_id", "priority"]].astype(object).where(lambda x: x.notna(), None)
            new += [(None if q is None else int(q), int(a), int(e), c, None if j is None else int(j), 0 if p is None else int(p)) for q, a, e, c, j, p in wanted.itertuples(index=False)]
        yield from self._advance(new, max(0, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


#: Lists and timers in the state need this store.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def worked(commands: DataFrame, late: str = "0 seconds") -> DataFrame:
    """The log of every queue's jobs: queue, event_id, at, job_id, action, status, attempts, until (lease or next attempt).

    commands: a stream of queue, event_id, ts (timestamp), command (submit, poll, heartbeat, complete, fail), job_id and
    priority. Commands later than ``late`` don't count. Start it with ``SETTINGS``.
    """
    timed = commands.withWatermark("ts", late).withColumns({"at": F.unix_micros("ts"), "queues": F.floor(F.col("queue") / TOGETHER)})
    return timed.groupBy("queues").transformWithStateInPandas(Worker(), LOG, "Append", "EventTime")
