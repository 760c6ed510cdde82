"""Streams over the events, drained to the end, with the SQL that gives the same rows at once; and raw pages as a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.sources import tables
from lodestone.streaming import leases, worker

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def note(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return note


def _events(spark, sf_dir):
    return tables.stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT user_id AS owner, event_id, epoch_us(ts) AS at FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS beat, (SELECT max(ts) FROM events) AS now FROM events)
WHERE CASE WHEN beat IS NOT NULL THEN beat > ts + INTERVAL 300 SECOND ELSE epoch_ms(ts + INTERVAL 300 SECOND) + 1 <= epoch_ms(now) END""")
def stream_leases(spark, sf_dir):
    """Leases that ran out, by a stateful stream of beats."""
    beats = _events(spark, sf_dir).select(F.col("user_id").alias("owner"), "event_id", "ts")
    return leases.drained(leases.expired_leases(beats), "leases")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w > ts - INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM s), d AS (SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM g GROUP BY user_id, s)
SELECT user_id, epoch_us(started) AS started, epoch_us(ended) AS ended, n FROM d WHERE epoch_ms(ended + INTERVAL 6 HOUR) <= epoch_ms((SELECT max(ts) FROM events))""")
def stream_sessions(spark, sf_dir):
    """Sessions that six idle hours have closed, by a stream with session windows."""
    found = leases.drained(leases.closed_sessions(_events(spark, sf_dir), "user_id", "6 hours"), "sessions")
    return found.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w > ts - INTERVAL 24 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM s), d AS (SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM g GROUP BY user_id, s)
SELECT user_id, epoch_us(started) AS started, epoch_us(ended) AS ended, n FROM d WHERE epoch_ms(ended + INTERVAL 24 HOUR) <= epoch_ms((SELECT max(ts) FROM events))""")
def stream_sessions_day(spark, sf_dir):
    """The same with the usual idle day."""
    found = leases.drained(leases.closed_sessions(_events(spark, sf_dir), "user_id"), "sessions")
    return found.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n")


_JOB = "STRUCT(job_id BIGINT, priority BIGINT, created BIGINT, status VARCHAR, attempts BIGINT, due BIGINT, lease BIGINT, claimed BIGINT)"
_OF = "{{'job_id': {x}.job_id, 'priority': {x}.priority, 'created': {x}.created, 'status': {status}, 'attempts': {attempts}, 'due': {due}, 'lease': {lease}, 'claimed': {claimed}}}"
_FAILED = {"status": "CASE WHEN x.attempts >= 3 THEN 'DEAD_LETTER' ELSE 'FAILED' END", "attempts": "x.attempts", "lease": "NULL", "claimed": "x.claimed"}
_WAIT = "CASE WHEN x.attempts >= 3 THEN NULL ELSE {now} + least(10 * (1 << greatest(0, least(x.attempts - 1, 32))), 900) * 1000000 END"
_AFTER = {
    "poll": {"status": "'RUNNING'", "attempts": "x.attempts + 1", "due": "x.due", "lease": "t + 300000000", "claimed": "t"},
    "heartbeat": {"status": "'RUNNING'", "attempts": "x.attempts", "due": "x.due", "lease": "t + 300000000", "claimed": "x.claimed"},
    "complete": {"status": "'COMPLETED'", "attempts": "x.attempts", "due": "x.due", "lease": "NULL", "claimed": "x.claimed"},
    "fail": _FAILED | {"due": _WAIT.format(now="t")},
}


@query(f"""WITH RECURSIVE wm AS (SELECT epoch_ms(max(ts)) * 1000 AS wm FROM events),
c AS (SELECT user_id AS queue, event_id, epoch_us(ts) AS t, CASE WHEN event_type IN ('signup', 'purchase') THEN 'submit' WHEN event_type = 'view' THEN 'poll' WHEN event_type = 'error' THEN 'fail' WHEN event_id % 3 = 0 THEN 'complete' ELSE 'heartbeat' END AS command, floor(value)::BIGINT % 3 AS priority FROM events, wm WHERE epoch_us(ts) <= wm),
e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY command = 'end', t, event_id) AS n FROM (SELECT * FROM c UNION ALL SELECT DISTINCT queue, NULL::BIGINT, wm, 'end', 0 FROM c, wm)),
fold AS (SELECT DISTINCT queue, 0::BIGINT AS n, []::{_JOB}[] AS jobs, []::{_JOB}[] AS gone, NULL::{_JOB} AS done, NULL::BIGINT AS event_id, 0::BIGINT AS t, '' AS command FROM e UNION ALL
SELECT queue, n, CASE WHEN command = 'submit' THEN list_append(jobs, {{'job_id': event_id, 'priority': priority, 'created': t, 'status': 'PENDING', 'attempts': 0, 'due': NULL, 'lease': NULL, 'claimed': 0}}::{_JOB})
  WHEN done IS NULL THEN jobs ELSE list_filter(list_transform(jobs, lambda x: CASE WHEN x.job_id = done.job_id THEN done ELSE x END), lambda x: x.status NOT IN ('COMPLETED', 'DEAD_LETTER')) END, gone, done, event_id, t, command FROM (
SELECT *, list_filter(list_transform(jobs, lambda x: CASE WHEN chosen IS NULL OR x.job_id <> chosen THEN NULL {" ".join(f"WHEN command = '{c}' THEN {_OF.format(x='x', **a)}::{_JOB}" for c, a in _AFTER.items())} END), lambda x: x IS NOT NULL)[1] AS done FROM (
SELECT *, CASE WHEN command = 'poll' THEN list_sort(list_transform(list_filter(jobs, lambda x: (x.status = 'PENDING' OR (x.status = 'FAILED' AND x.attempts < 3)) AND (x.due IS NULL OR x.due <= t)), lambda x: {{'p': -x.priority, 'c': x.created, 'j': x.job_id}}))[1].j
  WHEN command IN ('heartbeat', 'complete', 'fail') THEN -list_sort(list_transform(list_filter(jobs, lambda x: x.status = 'RUNNING'), lambda x: {{'c': -x.claimed, 'j': -x.job_id}}))[1].j END AS chosen FROM (
SELECT e.queue, e.n, e.event_id, e.t, e.command, e.priority, list_transform(list_filter(f.jobs, lambda x: x.status = 'RUNNING' AND x.lease < e.t), lambda x: {_OF.format(x="x", **(_FAILED | {"due": _WAIT.format(now="x.lease"), "lease": "x.lease"}))}::{_JOB}) AS gone,
  list_filter(list_transform(f.jobs, lambda x: CASE WHEN x.status = 'RUNNING' AND x.lease < e.t THEN {_OF.format(x="x", **(_FAILED | {"due": _WAIT.format(now="x.lease")}))}::{_JOB} ELSE x END), lambda x: x.status <> 'DEAD_LETTER') AS jobs
FROM fold f JOIN e ON e.queue = f.queue AND e.n = f.n + 1))))
SELECT queue, event_id, t AS at, done.job_id AS job_id, upper(command) AS action, done.status AS status, done.attempts AS attempts, CASE done.status WHEN 'RUNNING' THEN done.lease WHEN 'FAILED' THEN done.due END AS until FROM fold WHERE done IS NOT NULL
UNION ALL SELECT queue, NULL, g.lease, g.job_id, 'RECLAIM', g.status, g.attempts, g.due FROM (SELECT queue, unnest(gone) AS g FROM fold)""")
def stream_worker(spark, sf_dir):
    """The log of every user's queue: events submit, poll, keep alive, complete and fail jobs; leases that run out give them back."""
    kind, e = F.col("event_type"), F.col("event_id")
    command = F.when(kind.isin("signup", "purchase"), "submit").when(kind == "view", "poll").when(kind == "error", "fail").when(e % 3 == 0, "complete").otherwise("heartbeat")
    commands = _events(spark, sf_dir).select(F.col("user_id").alias("queue"), e, "ts", command.alias("command"), F.when(command == "submit", e).alias("job_id"), (F.floor("value") % 3).alias("priority"))
    return leases.drained(worker.worked(commands), "worker", worker.SETTINGS)


@query("SELECT event_id, event_type AS task, floor(value * 10)::BIGINT AS latency_ms, event_id % 7 = 0 AS used_fallback FROM events WHERE event_type <> 'error'")
def invocation_log(spark, sf_dir):
    """A row for each model call, appended batch by batch."""
    rows = lambda d: d.where("event_type <> 'error'").select("event_id", F.col("event_type").alias("task"), F.floor(F.col("value") * 10).alias("latency_ms"), (F.col("event_id") % 7 == 0).alias("used_fallback"))
    return leases.appended(_events(spark, sf_dir), "invocations", rows).select("event_id", "task", "latency_ms", "used_fallback")


_TEXT = "regexp_replace(body, '(?s)<[^>]*>', ' ', 'g')"
for _entity, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, '{_entity}', '{_sign}')"
_TEXT = rf"trim(regexp_replace({_TEXT}, '\s+', ' ', 'g'))"


@query(rf"""SELECT page_id, place::INTEGER AS place, CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN 'HEADING' WHEN tag = 'li' THEN 'LIST' WHEN tag = 'figcaption' THEN 'CAPTION' WHEN tag IN ('td', 'th') THEN 'TABLE' ELSE 'PARAGRAPH' END AS element_type,
CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN substr(tag, 2, 1)::INTEGER END AS level, {_TEXT} AS text FROM (
SELECT page_id, lower(unnest(tags)) AS tag, unnest(bodies) AS body, generate_subscripts(tags, 1) - 1 AS place FROM (SELECT page_id, regexp_extract_all(html, '{tables.BLOCK}', 1) AS tags, regexp_extract_all(html, '{tables.BLOCK}', 2) AS bodies FROM pages)) WHERE {_TEXT} <> ''""")
def page_elements(spark, sf_dir):
    """Raw pages as a source of elements: headings, paragraphs, list items, in their order."""
    return tables.page_elements(tables.table(spark, sf_dir, "pages"))
