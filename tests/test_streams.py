"""Stateful streams over several batches, with rows out of order, against their plain versions."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lodestone.streaming import leases, worker

ZERO = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def stream(spark, folder, batches, schema):
    """A stream that gives each list of rows in a batch of its own."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        for f in (folder / "in").glob("part-*.parquet"):
            f.rename(folder / f"{i:03}.parquet")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*.parquet")
    return rows.withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_late_beats_take_their_place(spark, tmp_path):
    """Beats at 1000, 800 and 1250 seconds in three batches: no gap is longer than the lease of 300 s until the last."""
    batches = [[(1, 1, 1000)], [(1, 2, 800)], [(1, 3, 1250)], [(2, 9, 5000)], [(2, 10, 9000)]]
    beats = stream(spark, tmp_path, batches, "owner long, event_id long, s long")
    found = {tuple(r) for r in leases.drained(leases.expired_leases(beats, 300, "10 minutes"), "late-beats").collect()}
    assert found == {(1, 3, 1250 * 10**6), (2, 9, 5000 * 10**6)}


def plain_leases(rows, seconds, watermark):
    out = set()
    for owner in {r[0] for r in rows}:
        beats = sorted((s, e) for o, e, s in rows if o == owner and s <= watermark)
        for (s, e), after in zip(beats, [*beats[1:], None]):
            if (watermark if after is None else after[0]) > s + seconds:
                out.add((owner, e, s * 10**6))
    return out


def test_leases_in_shuffled_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(4), i, rng.randrange(i * 20, i * 20 + 500)) for i in range(200)]
    beats = stream(spark, tmp_path, [rows[i : i + 40] for i in range(0, 200, 40)], "owner long, event_id long, s long")
    found = {tuple(r) for r in leases.drained(leases.expired_leases(beats, 150, "2 hours"), "shuffled-beats").collect()}
    assert found == plain_leases(rows, 150, max(r[2] for r in rows) - 7200)


def commands(seed, n=160):
    rng = random.Random(seed)
    return [(rng.randrange(3), i, rng.randrange(i * 30, i * 30 + 400), (c := rng.choice(["submit", "submit", "poll", "poll", "heartbeat", "complete", "fail"])), i if c == "submit" else None, rng.randrange(3)) for i in range(n)]


def plain_log(rows, watermark):
    out = []
    for queue in {r[0] for r in rows}:
        mine = sorted((s * 10**6, e, c, j, p) for q, e, s, c, j, p in rows if q == queue and s <= watermark)
        out += [(queue, *x) for x in worker.carried_out({}, mine, watermark * 10**6)]
    return sorted(out, key=str)


def test_worker_equals_carrying_out_in_order(spark, tmp_path):
    rows = commands(3)
    queue = stream(spark, tmp_path, [rows[i : i + 20] for i in range(0, 160, 20)], "queue long, event_id long, s long, command string, job_id long, priority long")
    found = leases.drained(worker.worked(queue, "10 minutes"), "worker-test", worker.SETTINGS)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == plain_log(rows, max(r[2] for r in rows) - 600) and {r[4] for r in got} == {"POLL", "HEARTBEAT", "COMPLETE", "FAIL", "RECLAIM"}


def test_jobs_by_hand():
    second = 10**6
    rows = [(0, 1, "submit", 1, 0), (second, 2, "submit", 2, 5), (2 * second, 3, "poll", None, 0), (3 * second, 4, "poll", None, 0), (10 * second, 5, "fail", 2, 0), (15 * second, 6, "poll", None, 0), (21 * second, 7, "poll", None, 0), (400 * second, 8, "poll", None, 0)]
    log = [(e, j, a, s, n) for e, _, j, a, s, n, _ in worker.carried_out({}, rows, 10_000 * second)]
    assert log == [
        (3, 2, "POLL", "RUNNING", 1), (4, 1, "POLL", "RUNNING", 1), (5, 2, "FAIL", "FAILED", 1), (7, 2, "POLL", "RUNNING", 2), (None, 1, "RECLAIM", "FAILED", 1), (None, 2, "RECLAIM", "FAILED", 2),
        (8, 2, "POLL", "RUNNING", 3), (None, 2, "RECLAIM", "DEAD_LETTER", 3),
    ]


def test_queues_share_their_state(spark, tmp_path):
    """Queues on both sides of a border, a negative one among them: the log is each one's own, the state is fetched for many at once."""
    rows = [(q * 7 - 20, *r[1:]) for r in commands(4, 120) for q in [r[1] % 40]]
    queue = stream(spark, tmp_path, [rows[i : i + 30] for i in range(0, 120, 30)], "queue long, event_id long, s long, command string, job_id long, priority long")
    log = worker.worked(queue, "10 minutes")
    assert "queues" in log._jdf.queryExecution().analyzed().toString() and worker.TOGETHER > 1
    got = sorted((tuple(r) for r in leases.drained(log, "worker-many", worker.SETTINGS).collect()), key=str)
    assert got and got == plain_log(rows, max(r[2] for r in rows) - 600)
