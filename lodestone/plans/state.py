"""Queries of what the store's rows are and may become; each with its SQL. Events stand for jobs, facts and requests."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evidence as E
from lodestone.operators import retrieval as R
from lodestone.operators import state as S
from lodestone.plans.evidence import _CANDIDATES, _candidates
from lodestone.plans.passages import _CLASS_SQL, _QUESTIONS, _list, _questions, _quoted
from lodestone.plans.store import table
from lodestone.sources.shared import written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def note(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, T.with_strip(sql)
        return f

    return note


def _of(items: list[str], at):
    return F.get(F.array(*[F.lit(x) for x in items]), at.cast("int"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 17")
def point_lookup(spark, sf_dir):
    """One row by its id: the predicate reaches the scan."""
    return table(spark, sf_dir, "documents").where("doc_id = 17").select("doc_id", "lang", "n_chars").limit(1)


@query("""SELECT l_orderkey AS document, l_linenumber AS page, l_partkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::INTEGER AS place FROM lineitem WHERE l_linenumber <= 3""")
def page_scan(spark, sf_dir):
    """Elements of the first three pages of every document, by page and reading order."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3")
    return rows.select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("page"), "l_partkey", (F.row_number().over(order) - 1).alias("place"))


@query("""SELECT page_id, CASE WHEN kind <> 'application/pdf' THEN 'UNSUPPORTED_TYPE' WHEN NOT starts_with(body, '%PDF') THEN 'NOT_A_PDF' WHEN size > 209715200 THEN 'TOO_LARGE' WHEN pages > 1500 THEN 'TOO_MANY_PAGES' ELSE 'ACCEPTED' END AS verdict, sha256(body) AS checksum, 'user/kb/' || page_id || '/original.pdf' AS storage_key FROM (
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'text/html' ELSE 'application/pdf' END AS kind, CASE WHEN page_id % 7 = 0 THEN html ELSE '%PDF-1.7' || html END AS body, strlen(html) * CASE WHEN page_id % 11 = 0 THEN 1000000 ELSE 1 END AS size, page_id * 37 % 2000 AS pages FROM pages)""")
def upload_checks(spark, sf_dir):
    """Uploads by type, opening bytes, size (200 MiB) and pages (1500), in this order; what is accepted gets a key."""
    p = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(
        p, F.when(p % 5 == 0, "text/html").otherwise("application/pdf").alias("kind"), F.when(p % 7 == 0, F.col("html")).otherwise(F.concat(F.lit("%PDF-1.7"), "html")).alias("body"),
        (F.octet_length("html").cast("long") * F.when(p % 11 == 0, 1000000).otherwise(1)).alias("size"), (p * 37 % 2000).alias("pages"),
    )
    verdict = F.when(F.col("kind") != "application/pdf", "UNSUPPORTED_TYPE").when(~F.startswith("body", F.lit("%PDF")), "NOT_A_PDF").when(F.col("size") > 200 << 20, "TOO_LARGE").when(F.col("pages") > 1500, "TOO_MANY_PAGES").otherwise("ACCEPTED")
    return rows.select("page_id", verdict.alias("verdict"), F.sha2("body", 256).alias("checksum"), F.concat(F.lit("user/kb/"), p.cast("string"), F.lit("/original.pdf")).alias("storage_key"))


_CHUNKS = """SELECT doc_id, i, CASE WHEN i % 4 > 0 THEN doc_id * 1000000 + i - i % 4 END AS parent_id, e.embedding IS NOT NULL AS embedded, source AS chapter, i // 6 AS section, i // 5 AS page_start, i // 5 + (i % 5 = 4)::INTEGER AS page_end, lang AS language, CASE WHEN contains(line, '|') THEN 'TABLE' ELSE 'PARAGRAPH' END AS element_type
FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) LEFT JOIN embeddings e ON e.vec_id = doc_id"""


def _chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    i = F.col("i")
    return docs.join(vectors, "doc_id", "left").select(
        "doc_id", F.col("doc_id").alias("document_id"), i, F.when(i % 4 > 0, F.col("doc_id") * 1000000 + i - i % 4).alias("parent_id"), "embedding", F.col("source").alias("chapter"), F.floor(i / 6).alias("section"),
        F.floor(i / 5).alias("page_start"), (F.floor(i / 5) + (i % 5 == 4).cast("int")).alias("page_end"), F.col("lang").alias("language"), F.when(F.contains("line", F.lit("|")), "TABLE").otherwise("PARAGRAPH").alias("element_type"),
    )


@query(f"SELECT doc_id, i::INTEGER AS i, parent_id FROM ({_CHUNKS}) WHERE parent_id IS NOT NULL AND embedded")
def searchable_chunks(spark, sf_dir):
    """Chunks that are searched: children with a vector."""
    return S.searchable(_chunks(spark, sf_dir)).select("doc_id", "i", "parent_id")


@query(f"SELECT doc_id, i::INTEGER AS i FROM ({_CHUNKS}) WHERE parent_id IS NOT NULL AND embedded AND language = 'en' AND element_type = 'PARAGRAPH' AND 2 BETWEEN page_start AND page_end AND section = 1")
def narrowed_chunks(spark, sf_dir):
    """Chunks that meet every filter that is set: language, kind of element, page, section."""
    found = S.narrowed(S.searchable(_chunks(spark, sf_dir)), language="en", element_types=["PARAGRAPH"], page_number=2, section=1, chapter=None, document_ids=[])
    return found.select("doc_id", "i")


@query("""SELECT event_id, job_type FROM (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'EMBEDDING' ELSE 'DOCUMENT_INGESTION' END AS job_type, ['PENDING', 'RUNNING', 'FAILED', 'COMPLETED', 'DEAD_LETTER'][event_id % 5 + 1] AS status, event_id % 4 AS attempts, CASE WHEN event_id % 6 > 0 THEN ts + INTERVAL 3 DAY END AS scheduled_at FROM events)
WHERE job_type = 'DOCUMENT_INGESTION' AND (status = 'PENDING' OR (status = 'FAILED' AND attempts < 3)) AND (scheduled_at IS NULL OR scheduled_at <= TIMESTAMP '2024-01-20 00:00:00')""")
def claimable_jobs(spark, sf_dir):
    """Jobs of a kind that are pending, or failed with attempts left, and due."""
    return S.claimable(_jobs(spark, sf_dir), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), ["DOCUMENT_INGESTION"]).select("event_id", "job_type")


_STATES = ["PENDING", "RUNNING", "FAILED", "COMPLETED", "DEAD_LETTER"]
_COMMANDS = ["claim", "heartbeat", "complete", "fail", "requeue", "cancel"]


def _jobs(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e, F.when(F.col("user_id") % 3 == 0, "EMBEDDING").otherwise("DOCUMENT_INGESTION").alias("job_type"), _of(_STATES, e % 5).alias("status"), (e % 4).alias("attempts"), F.lit(S.ATTEMPTS).alias("max_attempts"),
        F.when(e % 6 > 0, F.expr("ts + interval 3 days")).alias("scheduled_at"), F.col("ts").alias("at"), _of(_COMMANDS, F.floor(e / 7) % 6).alias("command"),
    )


@query(f"""WITH j AS (SELECT event_id, {_list(_STATES)}[event_id % 5 + 1] AS s, event_id % 4 AS n, {_list(_COMMANDS)}[event_id // 7 % 6 + 1] AS c, ts, CASE WHEN event_id % 6 > 0 THEN ts + INTERVAL 3 DAY END AS scheduled_at FROM events),
k AS (SELECT *, CASE WHEN c = 'claim' AND s = 'PENDING' THEN 'RUNNING' WHEN c = 'heartbeat' AND s = 'RUNNING' THEN 'RUNNING' WHEN c = 'complete' AND s = 'RUNNING' THEN 'COMPLETED' WHEN c = 'fail' AND s = 'RUNNING' THEN CASE WHEN n < 3 THEN 'FAILED' ELSE 'DEAD_LETTER' END
  WHEN c = 'requeue' AND s = 'FAILED' AND n < 3 THEN 'PENDING' WHEN c = 'cancel' AND s IN ('PENDING', 'RUNNING', 'FAILED', 'DEAD_LETTER') THEN 'CANCELLED' END AS new_status FROM j)
SELECT event_id, new_status, CASE WHEN new_status IS NOT NULL THEN n + (c = 'claim')::INTEGER END::BIGINT AS new_attempts, CASE WHEN c IN ('claim', 'heartbeat') AND new_status IS NOT NULL THEN ts + INTERVAL 300 SECOND END AS lease_until,
CASE WHEN new_status = 'FAILED' THEN date_trunc('second', ts) + to_seconds(CASE WHEN n <= 0 THEN 10 ELSE least(10 * 2 ** (n - 1), 900) END::INTEGER) WHEN new_status <> 'DEAD_LETTER' THEN scheduled_at END AS next_at FROM k""")
def job_commands(spark, sf_dir):
    """Jobs after claim, heartbeat, completion, failure, requeue and cancelling, where these are allowed."""
    return S.commanded(_jobs(spark, sf_dir)).select("event_id", "new_status", F.col("new_attempts").cast("long").alias("new_attempts"), "lease_until", "next_at")


_WORDS = {"document": ["PENDING", "PROCESSING", "COMPLETED", "FAILED", "DELETING"], "job": ["PENDING", "RUNNING", "FAILED", "DEAD_LETTER", "CANCELLED"], "message": ["RECEIVED", "PROCESSING", "COMPLETED", "FAILED", "CANCELLED"]}
_MACHINES = list(S.MACHINES)


@query(
    f"""WITH s AS (SELECT user_id, event_id, {_list(_MACHINES)}[user_id % 3 + 1] AS machine, CASE event_type {" ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(["signup", "view", "click", "purchase", "error"]))} ELSE 0 END AS k, ts FROM events),
n AS (SELECT user_id, event_id, machine, CASE machine {" ".join(f"WHEN '{m}' THEN {_list(w)}[k + 1]" for m, w in _WORDS.items())} END AS now, ts FROM s),
b AS (SELECT *, lag(now) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM n)
SELECT machine, event_id, before, now FROM b WHERE before IS NOT NULL AND (machine, before, now) NOT IN ({", ".join(f"('{m}', '{a}', '{b}')" for m, steps in S.MACHINES.items() for a, after in steps.items() for b in after)})"""
)
def state_machines(spark, sf_dir):
    """Steps of documents, jobs and messages that their machines don't allow."""
    kinds = ["signup", "view", "click", "purchase", "error"]
    k = F.lit(0)
    for i, name in enumerate(kinds):
        k = F.when(F.col("event_type") == name, i).otherwise(k)
    machine = _of(_MACHINES, F.col("user_id") % 3)
    now = F.lit(None).cast("string")
    for name, words in _WORDS.items():
        now = F.when(machine == name, _of(words, k)).otherwise(now)
    along = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", machine.alias("machine"), now.alias("now")).withColumn("before", F.lag("now").over(along)).where("before is not null")
    return S.illegal_steps(rows).select("machine", "event_id", "before", "now")


@query("""SELECT event_id, concat_ws(',', CASE WHEN NOT value > 0 THEN 'tokens' END, CASE WHEN NOT event_id % 9 >= event_id % 7 THEN 'pages' END, CASE WHEN user_id = event_id % 150 THEN 'own_parent' END, CASE WHEN (event_type = 'error') <> (event_id % 2 = 0) THEN 'reason' END, CASE WHEN NOT value / 100 BETWEEN 0 AND 1 THEN 'confidence' END, CASE WHEN (event_type = 'click') <> (event_id % 5 = 1) THEN 'lease' END) AS broken FROM events""")
def row_invariants(spark, sf_dir):
    """Which rules every row breaks: the sound ones and those for quarantine."""
    e, kind = F.col("event_id"), F.col("event_type")
    rules = {
        "tokens": F.col("value") > 0, "pages": e % 9 >= e % 7, "own_parent": F.col("user_id") != e % 150, "reason": (kind == "error") == (e % 2 == 0),
        "confidence": (F.col("value") / 100).between(0, 1), "lease": (kind == "click") == (e % 5 == 1),
    }
    return table(spark, sf_dir, "events").select("event_id", S.broken(rules).alias("broken"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_discount * 10 < 0.6 AND l_suppkey % 3 > 0, false) AS low_confidence, l_suppkey % 6 < 4 AS visual, l_partkey % 4 > 0 AS needs_ocr, l_linenumber + l_suppkey % 2 > l_linenumber AS spans_pages, l_quantity > 25 AS landscape FROM lineitem""")
def element_flags(spark, sf_dir):
    """Doubtful, visual, scanned, spanning and landscape elements (columns stand for confidence, type, page kind and pages)."""
    s = F.col("l_suppkey")
    confidence = F.when(s % 3 > 0, F.col("l_discount") * 10)
    kind = _of(["FIGURE", "CHART", "DIAGRAM", "TABLE", "PARAGRAPH", "LIST"], s % 6)
    page = _of(["NATIVE_TEXT", "SCANNED", "MIXED", "COMPLEX"], F.col("l_partkey") % 4)
    first = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", first, "l_partkey", F.coalesce(confidence < 0.6, F.lit(False)).alias("low_confidence"), kind.isin(S.VISUAL).alias("visual"),
        page.isin("SCANNED", "MIXED", "COMPLEX").alias("needs_ocr"), (first + s % 2 > first).alias("spans_pages"), (F.col("l_quantity") > 25).alias("landscape"),
    )


_PROVIDERS = [("local", 0, True, [0, 1]), ("near", 1, False, [0, 1, 2]), ("far", 2, True, [1, 2])]
_STEP = "CASE WHEN private AND NOT local_ THEN 'REFUSED' WHEN r = 1 THEN 'FAILED' WHEN r <> 0 THEN 'ANSWERED' END"
_TABLE = " UNION ALL ".join(f"SELECT '{p}' AS provider, {place} AS place, {str(local).lower()} AS local_, {t} AS task" for p, place, local, tasks in _PROVIDERS for t in tasks)


@query(f"""WITH q AS (SELECT event_id AS request_id, event_id % 4 AS task, user_id % 3 = 0 AS private FROM events), m AS (SELECT q.*, p.provider, p.place, p.local_, (request_id * (place + 3)) % 4 AS r FROM q JOIN ({_TABLE}) p USING (task)), s AS (SELECT *, {_STEP} AS step FROM m),
f AS (SELECT request_id, min(place) AS least, arg_min(step, place) FILTER (step IS NOT NULL) AS step, arg_min(provider, place) FILTER (step IS NOT NULL) AS provider, min(place) FILTER (step IS NOT NULL) AS place FROM s GROUP BY request_id)
SELECT q.request_id, CASE WHEN least IS NULL THEN 'UNSUPPORTED' ELSE coalesce(step, 'EXHAUSTED') END AS outcome, CASE WHEN step = 'ANSWERED' THEN provider END AS provider, coalesce(step = 'ANSWERED' AND place > least, false) AS fallback FROM q LEFT JOIN f USING (request_id)""")
def provider_routing(spark, sf_dir):
    """Which provider answers each request: by capability and order, over passing errors, never private data to a remote one."""
    e = F.col("event_id")
    requests = table(spark, sf_dir, "events").select(e.alias("request_id"), (e % 4).alias("task"), (F.col("user_id") % 3 == 0).alias("private"))
    able = spark.createDataFrame([(p, place, local, t) for p, place, local, tasks in _PROVIDERS for t in tasks], "provider string, place int, local boolean, task long")
    mark = (F.col("request_id") * (F.col("place") + 3)) % 4
    answers = requests.select("request_id", "task").join(F.broadcast(able), "task").withColumn("result", F.when(mark == 0, "passing").when(mark == 1, "fatal").otherwise("ok"))
    return S.routed(requests, answers)


@query("""SELECT user_id, event_id, event_type, n::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1)""")
def active_facts(spark, sf_dir):
    """Facts that nothing has superseded, newest first."""
    newest = W.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    order = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    active = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(newest)).where("k = 1")
    return active.select("user_id", "event_id", "event_type", (F.row_number().over(order) - 1).alias("place"))


@query("""WITH f AS (SELECT event_id, ['ACTIVE', 'UNCONFIRMED', 'DISPUTED', 'SUPERSEDED', 'DELETED', 'EXPIRED'][event_id % 6 + 1] AS s, ['supersede', 'dispute', 'expire', 'delete'][event_id // 6 % 4 + 1] AS c FROM events)
SELECT event_id, CASE WHEN c = 'supersede' AND s = 'ACTIVE' THEN 'SUPERSEDED' WHEN c = 'dispute' AND s IN ('ACTIVE', 'UNCONFIRMED') THEN 'DISPUTED' WHEN c = 'expire' AND s = 'ACTIVE' THEN 'EXPIRED' WHEN c = 'delete' AND s NOT IN ('DELETED', 'SUPERSEDED') THEN 'DELETED' END AS status FROM f""")
def fact_commands(spark, sf_dir):
    """Facts after they are superseded, disputed, expired or deleted, where that is allowed."""
    e = F.col("event_id")
    status, command = _of(["ACTIVE", "UNCONFIRMED", "DISPUTED", "SUPERSEDED", "DELETED", "EXPIRED"], e % 6), _of(["supersede", "dispute", "expire", "delete"], F.floor(e / 6) % 4)
    return table(spark, sf_dir, "events").select("event_id", S.fact_status(status, command).alias("status"))


_CHANGES = ["document", "page", "figure", "table", "page", "clear", "table"]


@query(f"""WITH RECURSIVE c AS MATERIALIZED (SELECT user_id, event_id, {_list(_CHANGES)}[event_id * 5 // 3 % 7 + 1] AS c, event_id % 50 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, CASE WHEN c = 'document' THEN t END AS d, CASE WHEN c = 'page' THEN t END AS p, CASE WHEN c = 'figure' THEN t END AS g, CASE WHEN c = 'table' THEN t END AS b FROM c WHERE n = 1 UNION ALL
SELECT c.user_id, c.event_id, c.n, CASE WHEN c = 'document' THEN t ELSE d END, CASE c WHEN 'document' THEN NULL WHEN 'page' THEN t WHEN 'clear' THEN NULL ELSE p END, CASE WHEN c = 'figure' THEN t END, CASE WHEN c = 'table' THEN t END FROM f JOIN c ON c.user_id = f.user_id AND c.n = f.n + 1)
SELECT event_id, d AS document, p AS page, g AS figure, b AS selected FROM f""")
def conversation_focus(spark, sf_dir):
    """What a conversation looks at after each change of focus."""
    e = F.col("event_id")
    changes = table(spark, sf_dir, "events").select("user_id", e, "ts", _of(_CHANGES, F.floor(e * 5 / 3) % 7).alias("command"), (e % 50).alias("target"))
    return S.focus(changes, "user_id", ["ts", "event_id"]).select("event_id", "document", "page", "figure", "selected")


@query("SELECT o_orderkey, date_diff('day', o_orderdate::DATE, max(l_shipdate)::DATE)::INTEGER AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate")
def exam_days(spark, sf_dir):
    """Days from one date to another, with their sign."""
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("at"))
    return table(spark, sf_dir, "orders").join(last, "o_orderkey").select("o_orderkey", F.datediff("at", "o_orderdate").alias("days"))


@query("""WITH gone AS (SELECT o_orderkey AS d FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS page FROM lineitem JOIN gone ON d = l_orderkey),
a AS (SELECT d, 0 AS stage, page, 'render/' || d || '/' || page AS item FROM p UNION ALL SELECT d, 1, 0, 'file/' || d FROM gone UNION ALL SELECT d, 2, 0, 'row/' || d FROM gone)
SELECT d AS document, item, (row_number() OVER (PARTITION BY d ORDER BY stage, page) - 1)::INTEGER AS step FROM a""")
def delete_plan(spark, sf_dir):
    """What goes with every deleted document, in this order: renders of its pages, its file, its row."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("document"))
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("page")).distinct().join(gone, "document", "left_semi")
    d = F.col("document").cast("string")
    renders = pages.select("document", F.lit(0).alias("stage"), "page", F.concat(F.lit("render/"), d, F.lit("/"), F.col("page").cast("string")).alias("item"))
    rest = gone.select("document", F.explode(F.array(F.struct(F.lit(1).alias("stage"), F.concat(F.lit("file/"), d).alias("item")), F.struct(F.lit(2).alias("stage"), F.concat(F.lit("row/"), d).alias("item")))).alias("x"))
    both = renders.unionByName(rest.select("document", "x.stage", F.lit(0).alias("page"), "x.item"))
    return both.select("document", "item", (F.row_number().over(W.partitionBy("document").orderBy("stage", "page")) - 1).alias("step"))


@query("""SELECT lang, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, round(count(*) / sum(count(*)) OVER (), 9) AS share, count(*) FILTER (NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS gaps FROM documents d GROUP BY lang""")
def ingestion_report(spark, sf_dir):
    """Documents by language: spread of lengths, share of all, and how many have no label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("there")).distinct()
    rows = docs.join(labelled, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count_if(F.col("there").isNull()).alias("gaps"))
    whole = rows.agg(F.sum("n").alias("total"))  # one row
    return rows.crossJoin(F.broadcast(whole)).select("lang", "n", "least", "most", F.round(F.col("n") / F.col("total"), 9).alias("share"), "gaps")


_RANKED = f"""SELECT query_id, rank, document_id = query_id % 6 AS gold FROM ({_CANDIDATES})"""


@query(f"""WITH r AS ({_RANKED}), g AS (SELECT query_id, count(*) FILTER (gold) AS n, count(*) FILTER (gold AND rank < 10) AS hit, min(rank) FILTER (gold) AS first, sum(CASE WHEN gold AND rank < 10 THEN ln(2) / ln(rank + 2) ELSE 0 END) AS dcg FROM r GROUP BY query_id)
SELECT query_id, round(CASE WHEN n > 0 THEN hit / n ELSE 0 END, 9)::DOUBLE AS recall_at_10, round(hit / 10, 9)::DOUBLE AS precision_at_10, round(coalesce(1.0 / (1 + first), 0), 9)::DOUBLE AS reciprocal_rank, round(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(least(n, 10)), lambda i: ln(2) / ln(i + 2))) ELSE 0 END, 9)::DOUBLE AS ndcg_at_10, n > 0 AS covered FROM g""")
def ranking_metrics(spark, sf_dir):
    """Recall and precision at ten, reciprocal rank, discounted gain and coverage of every list."""
    rows = _candidates(spark, sf_dir).select("query_id", "rank", (F.col("document_id") == F.col("query_id") % 6).alias("gold"))
    return R.ranking_metrics(rows, 10)


@query("""SELECT user_id, count(*) AS messages, sum(event_id % 40) AS tokens, count(*) >= 20 OR sum(event_id % 40) >= 8000 OR max(ts) + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) AS due FROM events GROUP BY user_id""")
def compaction_due(spark, sf_dir):
    """Conversations of 20 messages, 8000 tokens or 24 idle hours."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    rows = events.groupBy("user_id").agg(F.count("*").alias("messages"), F.sum(F.col("event_id") % 40).alias("tokens"), F.max("ts").alias("last"))
    due = (F.col("messages") >= 20) | (F.col("tokens") >= 8000) | F.expr("last + interval 24 hours <= now")
    return rows.crossJoin(F.broadcast(now)).select("user_id", "messages", "tokens", due.alias("due"))


_SLOTS = ["checklist", "schema", "preferred", "kb_state", "summary", "relevant", "pinned", "history", "required"]


@query(f"""WITH c AS (SELECT conv_id, sum(CASE WHEN role = 'system' THEN w ELSE 0 END) * 40 + 3000 AS fixed, {", ".join(f"sum(w) * {7 + 5 * i} % {900 + 200 * i} AS {s}" for i, s in enumerate(_SLOTS))} FROM (SELECT conv_id, role, len(regexp_extract_all(text, '\\S+')) AS w FROM conversations) GROUP BY conv_id),
l AS (SELECT conv_id, [{", ".join(" + ".join(["fixed", *_SLOTS[i:]]) for i in range(len(_SLOTS) + 1))}] AS t FROM c), s AS (SELECT *, coalesce(list_position(list_transform(t, lambda x: x <= 8000), true), 0) AS p FROM l)
SELECT conv_id, (CASE WHEN p > 0 THEN p - 1 ELSE {len(_SLOTS)} END)::INTEGER AS steps, t[CASE WHEN p > 0 THEN p ELSE {len(_SLOTS) + 1} END]::BIGINT AS total FROM s""")
def context_shedding(spark, sf_dir):
    """How many of the nine slots of a prompt must go until it fits 8000 tokens, and what it takes then."""
    rows = table(spark, sf_dir, "conversations").withColumn("w", F.regexp_count("text", F.lit(r"\S+")).cast("long"))
    total = F.sum("w")
    costs = rows.groupBy("conv_id").agg((F.sum(F.when(F.col("role") == "system", F.col("w")).otherwise(0)) * 40 + 3000).alias("fixed"), *[(total * (7 + 5 * i) % (900 + 200 * i)).alias(s) for i, s in enumerate(_SLOTS)])
    return S.shed(costs, "conv_id", "fixed", _SLOTS)


_ACK = ["Understood, I have noted the context.", "I have reviewed the material."]


@query(f"""WITH t AS (SELECT conv_id, turn, role, text, conv_id % 2 = 0 AS ack, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
m AS (
SELECT conv_id, 0 AS slot, 0 AS turn, 'system' AS role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content FROM t WHERE role = 'system' GROUP BY conv_id
UNION ALL SELECT conv_id, 1, 0, 'user', '[Student context]' || chr(10) || '- thread ' || conv_id FROM t WHERE turn = last AND conv_id % 3 = 0
UNION ALL SELECT conv_id, 1, 1, 'assistant', {_quoted(_ACK[0])} FROM t WHERE turn = last AND conv_id % 3 = 0 AND ack
UNION ALL SELECT conv_id, 2, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END, text FROM t WHERE role <> 'system' AND turn < last
UNION ALL SELECT c.conv_id, 3, 0, 'user', '[Reference material]' || chr(10) || '[S1] ' || d.text FROM t c JOIN documents d ON d.doc_id = c.conv_id WHERE turn = last
UNION ALL SELECT c.conv_id, 3, 1, 'assistant', {_quoted(_ACK[1])} FROM t c JOIN documents d ON d.doc_id = c.conv_id WHERE turn = last AND ack
UNION ALL SELECT conv_id, 4, 0, 'user', text FROM t WHERE turn = last
UNION ALL SELECT conv_id, 5, 0, 'user', '[Required output format]' || chr(10) || 'json' FROM t WHERE turn = last AND conv_id % 5 > 0
UNION ALL SELECT conv_id, 6, 0, 'user', '[Before you answer]' || chr(10) || '- cite' FROM t WHERE turn = last)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY slot, turn) - 1)::INTEGER AS place, role, sha256(content) AS digest FROM m""")
def prompt_messages(spark, sf_dir):
    """The messages of every prompt in their order: system, memory, turns, evidence, question, format, checklist."""
    rows = table(spark, sf_dir, "conversations")
    last = rows.withColumn("last", F.max("turn").over(W.partitionBy("conv_id")))
    end = last.where("turn = last")
    c = F.col("conv_id")
    system = last.where("role = 'system'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("content"))
    evidence = end.select("conv_id").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), "text"), "conv_id")
    row = lambda d, slot, turn, role, content: d.select("conv_id", F.lit(slot).alias("slot"), turn.alias("turn") if hasattr(turn, "alias") else F.lit(turn).cast("long").alias("turn"), (role if hasattr(role, "alias") else F.lit(role)).alias("role"), (content if hasattr(content, "alias") else F.lit(content)).alias("content"))
    memory, ack = c % 3 == 0, c % 2 == 0
    parts = [
        row(system, 0, 0, "system", F.col("content")), row(end.where(memory), 1, 0, "user", F.concat(F.lit("[Student context]\n- thread "), c.cast("string"))), row(end.where(memory & ack), 1, 1, "assistant", _ACK[0]),
        row(last.where("role <> 'system' and turn < last"), 2, F.col("turn"), F.when(F.col("role") == "user", "user").otherwise("assistant"), F.col("text")),
        row(evidence, 3, 0, "user", F.concat(F.lit("[Reference material]\n[S1] "), "text")), row(evidence.where(ack), 3, 1, "assistant", _ACK[1]), row(end, 4, 0, "user", F.col("text")),
        row(end.where(c % 5 > 0), 5, 0, "user", "[Required output format]\njson"), row(end, 6, 0, "user", "[Before you answer]\n- cite"),
    ]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.select("conv_id", (F.row_number().over(W.partitionBy("conv_id").orderBy("slot", "turn")) - 1).alias("place"), "role", F.sha2("content", 256).alias("digest"))


@query("SELECT event_id, round(coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 3 = 1 THEN value / 100 END, 0), 6)::DOUBLE AS score FROM events")
def persisted_score(spark, sf_dir):
    """The score kept with a citation: of the reranker, else of the fusion, else 0."""
    e = F.col("event_id")
    reranked, fused = F.when(e % 3 == 0, F.col("value")), F.when(e % 3 == 1, F.col("value") / 100)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.coalesce(reranked, fused, F.lit(0.0)), 6).alias("score"))


_EXIT = "CASE query_class WHEN 'EXACT_TERM' THEN 'EXACT_LOOKUP' WHEN 'TABLE' THEN CASE WHEN selected THEN 'TABLE_LOOKUP' END WHEN 'VISUAL' THEN CASE WHEN selected THEN 'VISUAL_LOOKUP' END END"
_GRAPHED = "query_class IN ('RELATIONSHIP','PREREQUISITE','CONCEPT_MAP')"


@query(f"""SELECT conv_id, turn, query_class, early_exit, graph AND {_GRAPHED} AS consult_graph, query_class NOT IN ('EXACT_TERM','TABLE','VISUAL','SUMMARY') AND early_exit IS NULL AS expand, selected OR conv_id % 5 = 0 AS narrowed FROM (
SELECT *, {_EXIT} AS early_exit FROM (SELECT conv_id, turn, {_CLASS_SQL} AS query_class, conv_id % 2 = 0 AS selected, turn % 4 = 0 AS graph FROM {_QUESTIONS}))""")
def retrieval_plan_full(spark, sf_dir):
    """The plan of every question where an object may be selected, a graph be at hand, and filters be set."""
    rows = _questions(spark, sf_dir).select("conv_id", "turn", T.query_class(F.col("q")).alias("query_class"), (F.col("conv_id") % 2 == 0).alias("selected"), (F.col("turn") % 4 == 0).alias("graph"))
    c, selected = F.col("query_class"), F.col("selected")
    exit_ = F.when(c == "EXACT_TERM", "EXACT_LOOKUP").when((c == "TABLE") & selected, "TABLE_LOOKUP").when((c == "VISUAL") & selected, "VISUAL_LOOKUP")
    return rows.select(
        "conv_id", "turn", c, exit_.alias("early_exit"), (F.col("graph") & c.isin("RELATIONSHIP", "PREREQUISITE", "CONCEPT_MAP")).alias("consult_graph"),
        (~c.isin("EXACT_TERM", "TABLE", "VISUAL", "SUMMARY") & exit_.isNull()).alias("expand"), (selected | (F.col("conv_id") % 5 == 0)).alias("narrowed"),
    )


_MODEL = r"""'1. ' || text || chr(10) || '  - ' || text || ' again' || chr(10) || chr(10) || '* ' || reverse(text) || chr(10) || '2) ' || upper(text) || chr(10) || '• more'"""


@query(rf"""SELECT conv_id, turn, len(v)::INTEGER AS n, sha256(array_to_string(v, chr(10))) AS digest FROM (SELECT conv_id, turn, list_concat([trim(text)], list_filter(list_slice(list_filter(list_transform(string_split({_MODEL}, chr(10)), lambda l: strip(regexp_replace(l, '^\s*(?:\d+[.)]\s*|[-*•]\s*)', ''))), lambda l: l <> ''), 1, 3), lambda l: l <> trim(text))) AS v FROM (SELECT conv_id, turn, regexp_replace(text, '\s+', ' ', 'g') AS text FROM conversations WHERE role = 'user'))""")
def query_variants(spark, sf_dir):
    """A question and the first three variants that a model gives, without list marks, blank lines and echoes."""
    t = F.regexp_replace("text", r"\s+", " ")
    said = F.concat(F.lit("1. "), t, F.lit("\n  - "), t, F.lit(" again\n\n* "), F.reverse(t), F.lit("\n2) "), F.upper(t), F.lit("\n• more"))
    variants = T.query_variants(F.trim(t), said)
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", variants.alias("v")).select("conv_id", "turn", F.size("v").alias("n"), F.sha2(F.array_join("v", "\n"), 256).alias("digest"))


_OPEN = ["However, ", "this ", "\"Therefore ", "", "(these) ", "Table 4: rows\n", "where x denotes ", "Its "]
_BARE = r"""regexp_replace(text, '^[ \t\r\n\f\x0B"''(\[‘“«]+', '')"""


@query(rf"""WITH c AS (SELECT doc_id, pos, {_list(_OPEN)}[(doc_id + pos) % {len(_OPEN)} + 1] || line AS text, ['TEXT', 'TEXT', 'TABLE', 'FORMULA', 'FIGURE', 'TEXT'][(doc_id * 3 + pos) % 6 + 1] AS chunk_type, pos % 7 = 0 AS orphan FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
w AS (SELECT *, {_BARE} AS bare, regexp_replace(lower(string_split_regex({_BARE}, '\s+')[1]), '^[.,;:!?]+|[.,;:!?]+$', '', 'g') AS word FROM c)
SELECT doc_id, pos::INTEGER AS pos, CASE WHEN orphan THEN NULL WHEN chunk_type = 'TABLE' THEN CASE WHEN NOT regexp_matches(text, '(?im)^\s*(table|tbl)\s*\.?\s*([A-Z]?\.?\d+(?:[.\-]\d+)*[a-z]?)(?:\W|$)') THEN 'TABLE_WITHOUT_ITS_CAPTION' END
WHEN chunk_type = 'FORMULA' THEN CASE WHEN NOT regexp_matches(text, '(?i)\b(where|let|denotes?|defined as|refers? to|is the|are the)\b') THEN 'FORMULA_WITHOUT_ITS_DEFINITION' END WHEN chunk_type = 'FIGURE' THEN 'VISUAL_WITHOUT_ITS_EXPLANATION'
WHEN word = '' THEN NULL WHEN regexp_matches(bare, '^\p{{Ll}}') OR list_contains({_list(T.CONTINUATIONS)}, word) THEN 'OPENS_MID_EXPLANATION' WHEN list_contains({_list(T.REFERENCES)}, word) THEN 'OPENS_WITH_A_REFERENCE' END AS reason FROM w""")
def expansion_reasons(spark, sf_dir):
    """Why a passage needs its parent, by its kind or by how it opens."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    text = F.concat(_of(_OPEN, (F.col("doc_id") + F.col("pos")) % len(_OPEN)), F.col("line"))
    kind = _of(["TEXT", "TEXT", "TABLE", "FORMULA", "FIGURE", "TEXT"], (F.col("doc_id") * 3 + F.col("pos")) % 6)
    parent = F.when(F.col("pos") % 7 > 0, F.col("doc_id"))
    return rows.select("doc_id", "pos", T.expansion_reason(text, kind, parent).alias("reason"))


@query("""WITH e AS (SELECT 'n' || c_nationkey AS a, 'c' || c_custkey AS b FROM customer UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier), two AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
s AS (SELECT c_custkey AS seed, 'c' || c_custkey AS node FROM customer WHERE c_acctbal > 9000), one AS (SELECT DISTINCT seed, b AS node FROM s JOIN two ON a = node), next AS (SELECT DISTINCT seed, b AS node FROM one JOIN two ON a = node),
n AS (SELECT seed, node, min(hop) AS hop FROM (SELECT seed, node, 0 AS hop FROM s UNION ALL SELECT seed, node, 1 FROM one UNION ALL SELECT seed, node, 2 FROM next) GROUP BY ALL)
SELECT seed, node, hop::INTEGER AS hop FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hop, node) AS k FROM n) WHERE k <= 50""")
def graph_subgraph(spark, sf_dir):
    """The nearest 50 nodes within two hops of every seed."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    customers = table(spark, sf_dir, "customer")
    edges = customers.select(key("n", "c_nationkey").alias("a"), key("c", "c_custkey").alias("b"))
    edges = edges.unionByName(table(spark, sf_dir, "nation").select(key("r", "n_regionkey").alias("a"), key("n", "n_nationkey").alias("b")))
    edges = edges.unionByName(table(spark, sf_dir, "supplier").select(key("n", "s_nationkey").alias("a"), key("s", "s_suppkey").alias("b")))
    seeds = customers.where("c_acctbal > 9000").select(F.col("c_custkey").alias("seed"), key("c", "c_custkey").alias("node"))
    return S.hops(edges, seeds, 2, 50)


@query(f"""WITH c AS MATERIALIZED ({_CANDIDATES}), g AS (SELECT query_id, chunk_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) - 1 AS rank FROM c WHERE document_id = query_id % 6),
l AS (SELECT query_id, 0 AS i, 'DENSE' AS r, chunk_id AS doc_id, rank FROM c WHERE rank < 15 UNION ALL SELECT query_id, 1, 'KEYWORD', chunk_id, rank - 10 FROM c WHERE rank BETWEEN 10 AND 24 UNION ALL SELECT query_id, 2, 'GRAPH', doc_id, rank FROM g),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, list_sort(list(DISTINCT r)) AS r, min(i * 1000 + rank) AS seen FROM l GROUP BY ALL)
SELECT query_id, doc_id, score, array_to_string(r, ',') AS retrievers, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) - 1 AS rank FROM f) WHERE rank < 10""")
def graph_fusion(spark, sf_dir):
    """Passages that the graph leads to, as one more list in the fusion."""
    c = _candidates(spark, sf_dir).select("query_id", F.col("chunk_id").alias("doc_id"), "rank", "document_id")
    graph = c.where(F.col("document_id") == F.col("query_id") % 6).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("doc_id")) - 1)
    part = lambda d, i, name: d.select("query_id", F.lit(i).alias("list_idx"), F.lit(name).alias("retriever"), "doc_id", F.col("rank").cast("int").alias("rank"))
    lists = part(c.where("rank < 15"), 0, "DENSE").unionByName(part(c.where("rank between 10 and 24").withColumn("rank", F.col("rank") - 10), 1, "KEYWORD")).unionByName(part(graph, 2, "GRAPH"))
    return R.fuse(lists).where("rank < 10").select("query_id", "doc_id", "score", F.array_join("retrievers", ",").alias("retrievers"), "rank")


@query("""WITH q AS (SELECT conv_id, turn, text, list_slice(string_split(text, '. '), 1, 8) AS s FROM conversations WHERE role = 'user'), s AS (SELECT conv_id, turn, unnest(s) AS sub, generate_subscripts(s, 1) - 1 AS i FROM q),
e AS (SELECT conv_id, turn, i, len(regexp_extract_all(lower(sub), '[a-z0-9]+')) AS n, (conv_id + turn + i) % 5 AS k FROM s), c AS (SELECT *, CASE WHEN k = 0 THEN 'UNSUPPORTED' WHEN k = 1 THEN 'CONFLICTING' WHEN k = 2 THEN 'PARTIALLY_SUPPORTED' ELSE 'SUPPORTED' END AS status FROM e WHERE n > 0)
SELECT conv_id, turn, count(*) AS questions, count(*) FILTER (status IN ('UNSUPPORTED', 'PARTIALLY_SUPPORTED')) AS open, (CASE WHEN count(*) FILTER (status IN ('UNSUPPORTED', 'PARTIALLY_SUPPORTED')) = 0 THEN 1 ELSE least(3, 1 + max(CASE WHEN status = 'UNSUPPORTED' THEN 2 WHEN status = 'PARTIALLY_SUPPORTED' THEN 1 ELSE 0 END)) END)::INTEGER AS rounds, bool_or(status = 'CONFLICTING') AS conflict FROM c GROUP BY conv_id, turn""")
def multi_hop_rounds(spark, sf_dir):
    """At most eight parts of every question, how many still need evidence, and rounds, three at most."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.posexplode(F.slice(F.split("text", r"\. "), 1, 8)).alias("i", "sub")).where(F.size(T.terms(F.col("sub"))) > 0)
    k = (F.col("conv_id") + F.col("turn") + F.col("i")) % 5
    status = F.when(k == 0, "UNSUPPORTED").when(k == 1, "CONFLICTING").when(k == 2, "PARTIALLY_SUPPORTED").otherwise("SUPPORTED")
    return R.coverage_rounds(rows.withColumn("status", status), ["conv_id", "turn"])


@query("""WITH e AS (SELECT user_id % 40 AS k, event_id, value, ts, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN ts + INTERVAL 1 HOUR ELSE ts + INTERVAL 2 DAY END AS expires_at FROM events), l AS (SELECT k, arg_max(event_id, (ts, event_id)) AS event_id FROM e GROUP BY k)
SELECT l.k AS cache_key, l.event_id, CASE WHEN e.expires_at IS NULL OR e.expires_at >= (SELECT max(ts) FROM events) THEN round(e.value, 6) END AS value FROM l JOIN e USING (event_id)""")
def cache_lookup(spark, sf_dir):
    """The cache after all puts (the last of a key counts), read at the end: null where the entry has expired."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    kind = F.col("event_type")
    expires = F.when(kind == "error", None).when(kind == "click", F.expr("ts + interval 1 hour")).otherwise(F.expr("ts + interval 2 days"))
    puts = events.select((F.col("user_id") % 40).alias("cache_key"), "event_id", "value", "ts", expires.alias("expires_at"))
    last = puts.groupBy("cache_key").agg(F.max_by(F.struct("event_id", "value", "expires_at"), F.struct("ts", "event_id")).alias("e"))
    fresh = F.col("e.expires_at").isNull() | (F.col("e.expires_at") >= F.col("now"))
    return last.crossJoin(F.broadcast(now)).select("cache_key", "e.event_id", F.when(fresh, F.round("e.value", 6)).alias("value"))


_LISTS = f"""c AS MATERIALIZED ({_CANDIDATES}), l AS (SELECT query_id, 0 AS i, 'EXACT' AS r, chunk_id AS doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) - 1)::INTEGER AS rank, document_id, text, question FROM c WHERE page = query_id // 20 % 4
UNION ALL SELECT query_id, 1, 'DENSE', chunk_id, rank, document_id, text, question FROM c WHERE rank < 30 UNION ALL SELECT query_id, 2, 'KEYWORD', chunk_id, rank - 10, document_id, text, question FROM c WHERE rank >= 10)"""


def _lists_of(candidates, *also):
    """The candidates as three ranked lists, with the columns ``also``."""
    c = candidates.select("query_id", F.col("chunk_id").alias("doc_id"), F.col("rank").cast("int").alias("rank"), "document_id", "page", *also)
    exact = c.where(F.col("page") == F.floor(F.col("query_id") / 20) % 4).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("doc_id")) - 1)
    part = lambda d, i, name: d.select("query_id", F.lit(i).alias("list_idx"), F.lit(name).alias("retriever"), "doc_id", "rank", "document_id", *also)
    return part(exact, 0, "EXACT").unionByName(part(c.where("rank < 30"), 1, "DENSE")).unionByName(part(c.where("rank >= 10").withColumn("rank", F.col("rank") - 10), 2, "KEYWORD"))


@query(f"""WITH {_LISTS}, f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(i * 1000 + rank) AS seen, arg_min(r || ':' || rank, i * 1000 + rank) AS payload FROM l GROUP BY ALL)
SELECT query_id, doc_id, payload, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) - 1)::INTEGER AS rank FROM f""")
def fused_payload(spark, sf_dir):
    """What a fused passage carries is what the first list that has it says."""
    lists = _lists_of(_candidates(spark, sf_dir)).withColumn("payload", F.concat("retriever", F.lit(":"), F.col("rank").cast("string")))
    return R.fuse(lists, payload="payload").select("query_id", "doc_id", "payload", "rank")


@query(f"""WITH {_LISTS}, f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, min(i * 1000 + rank) AS seen, any_value(document_id) AS subject, any_value(text) AS text, any_value(question) AS question FROM l GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, seen) - 1 AS fused_rank FROM f),
s AS (SELECT query_id, doc_id, subject, fused_rank, round(CASE WHEN len(question) = 0 THEN 0 ELSE len(list_intersect(list_distinct(question), list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))) / len(list_distinct(question)) END, 9) AS score, doc_id % 4 * 10 + 10 AS provenance FROM o WHERE fused_rank < 40),
b AS (SELECT query_id, subject, arg_max(doc_id, (provenance, doc_id)) AS doc_id FROM s GROUP BY ALL)
SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) - 1)::INTEGER AS rank FROM s JOIN b USING (query_id, subject, doc_id)""")
def memory_retrieval(spark, sf_dir):
    """Facts found exactly, by vector and by word, fused, reranked, and of those on one subject the best founded."""
    # what is asked of a text is settled where it stands, so that no list carries texts
    c = _candidates(spark, sf_dir).select("query_id", "chunk_id", "rank", "document_id", "page", F.round(E.lexical_score(F.col("question"), T.terms(F.col("text"))), 9).alias("score"))
    lists = _lists_of(written(c, "candidates"), "score")
    held = lists.select("query_id", "doc_id", F.col("document_id").alias("subject"), F.col("score").alias("met")).dropDuplicates(["query_id", "doc_id"])
    fused = R.fuse(lists).join(held, ["query_id", "doc_id"]).withColumn("score", F.col("met")).drop("met")
    ranked = E.rerank(fused, pool=50, most=40).withColumn("provenance", F.col("doc_id") % 4 * 10 + 10)
    best = ranked.groupBy("query_id", "subject").agg(F.max_by(F.struct("doc_id", "score", "fused_rank"), F.struct("provenance", "doc_id")).alias("b")).select("query_id", "b.*")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "fused_rank")
    return best.select("query_id", "doc_id", (F.row_number().over(order) - 1).alias("rank"))


@query("""SELECT query_id, vec_id, rank::INTEGER AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) - 1 AS rank
FROM embeddings q, embeddings v JOIN documents d ON d.doc_id = v.vec_id AND length(trim(d.text)) >= 50 AND d.lang = 'en' AND d.doc_id % 4 > 0 WHERE q.vec_id % 20 = 0) WHERE rank < 30""")
def dense_filtered(spark, sf_dir):
    """The nearest vectors of children (not each fourth) of completed English documents."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    done = table(spark, sf_dir, "documents").where("length(trim(text)) >= 50").select(F.col("doc_id").alias("vec_id"), F.col("lang").alias("language"), F.when(F.col("doc_id") % 4 > 0, F.col("doc_id")).alias("parent_id"))
    found = S.narrowed(S.searchable(vectors.join(done, "vec_id")), language="en")
    return R.dense_top_k(vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), found).select("query_id", "vec_id", "rank")


_KINDS = ["Table 3: ", "Fig. 2b ", "1. ", "- ", "∑∫∂√∇±", "", "Figure it out "]


@query(rf"""SELECT doc_id, pos::INTEGER AS pos, CASE WHEN strip(l) = '' THEN 'PARAGRAPH' WHEN regexp_matches(strip(l), {_quoted(T.CAPTION_SQL)}) THEN 'CAPTION' WHEN regexp_matches(strip(l), {_quoted(T.LIST_MARKER)}) THEN 'LIST'
WHEN length(regexp_replace(strip(l), '\s', '', 'g')) > 0 AND (length(regexp_replace(strip(l), '\s', '', 'g')) - length(regexp_replace(regexp_replace(strip(l), '\s', '', 'g'), '[{T.MATHEMATICAL}]', '', 'g'))) / length(regexp_replace(strip(l), '\s', '', 'g')) >= 0.25 THEN 'FORMULA'
WHEN pos % 9 < 4 AND NOT regexp_matches(strip(l), '[.!?:;]$') AND (pos % 5 >= 2 OR pos % 3 = 0) THEN 'HEADING' ELSE 'PARAGRAPH' END AS element_type FROM (SELECT doc_id, pos, {_list(_KINDS)}[(doc_id + pos) % 7 + 1] || left(line, (doc_id + pos) * 7 % 30) AS l FROM (
SELECT doc_id, unnest(t) AS line, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)))""")
def element_types(spark, sf_dir):
    """All types of elements: captions, lists, formulas, headings by size and weight, paragraphs."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    at = F.col("doc_id") + F.col("pos")
    text = F.concat(_of(_KINDS, at % 7), F.left("line", (at * 7 % 30).cast("int")))
    size, bold, lines = F.when(F.col("pos") % 5 >= 2, 1.2).otherwise(1.0), F.col("pos") % 3 == 0, F.when(F.col("pos") % 9 < 4, 2).otherwise(5)
    return rows.select("doc_id", "pos", T.element_type(text, size, bold, lines).alias("element_type"))
