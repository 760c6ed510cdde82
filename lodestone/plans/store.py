"""Queries of the scoped store: scans, lookups, merges, cascades, jobs, memory, history, graph; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.statistics import exact_percentiles
from lodestone.sources import merged
from lodestone.sources.shared import shared_path
from lodestone.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def note(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return note


@query("SELECT doc_id, n_chars FROM documents WHERE source = 'src1' AND lang = 'en'")
def scoped_documents(spark, sf_dir):
    """Rows of one scope only: the predicate reaches the scan."""
    return table(spark, sf_dir, "documents").where("source = 'src1' and lang = 'en'").select("doc_id", "n_chars")


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def owned_scope_semi(spark, sf_dir):
    """Rows whose owner row exists."""
    owner = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(owner, "doc_id", "left_semi")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49 AND l_discount >= 0.09)")
def multi_get(spark, sf_dir):
    """Many lookups by id as one semi join."""
    ids = table(spark, sf_dir, "lineitem").where("l_quantity >= 49 and l_discount >= 0.09").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(ids, "o_orderkey", "left_semi")


@query("SELECT user_id, event_id, n::INTEGER AS n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 10")
def list_newest_first(spark, sf_dir):
    """The ten newest rows of each owner."""
    order = W.partitionBy("user_id").orderBy(F.col("ts").desc(), "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(order).alias("n")).where("n <= 10")


@query("""SELECT doc_id, ordinal::INTEGER AS ordinal, parent, row_number() OVER (PARTITION BY doc_id ORDER BY (parent IS NULL) DESC, ordinal)::INTEGER AS place FROM (
SELECT doc_id, i - 1 AS ordinal, CASE WHEN (i - 1) % 4 = 0 THEN NULL ELSE doc_id END AS parent FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))""")
def two_tier_order(spark, sf_dir):
    """Parents first, then by ordinal."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n"))).withColumnRenamed("pos", "ordinal")
    rows = lines.select("doc_id", "ordinal", F.when(F.col("ordinal") % 4 == 0, None).otherwise(F.col("doc_id")).alias("parent"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("parent").isNull().desc(), "ordinal")))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k')::INTEGER >= 50")
def json_payload_filter(spark, sf_dir):
    """Rows by a value inside their JSON payload."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")).where("cast(k as int) >= 50")


@query("SELECT doc_id, sha256(text) AS checksum, CASE WHEN strlen(text) = 0 THEN 'EMPTY' WHEN strlen(text) > 20000 THEN 'TOO_LARGE' WHEN NOT regexp_matches(text, '\\w') THEN 'NO_TEXT' ELSE 'ACCEPTED' END AS verdict FROM documents")
def upload_validation(spark, sf_dir):
    """Checksum and verdict of every upload."""
    size = F.octet_length("text")
    verdict = F.when(size == 0, "EMPTY").when(size > 20000, "TOO_LARGE").when(~F.col("text").rlike(r"\w"), "NO_TEXT").otherwise("ACCEPTED")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"), verdict.alias("verdict"))


@query("""WITH v AS (SELECT o_orderkey, o_orderstatus, 0 AS version FROM orders UNION ALL SELECT o_orderkey, 'X' AS o_orderstatus, 1 AS version FROM orders WHERE o_orderkey % 3 = 0)
SELECT o_orderkey, arg_max(o_orderstatus, version) AS o_orderstatus, max(version)::INTEGER AS version FROM v GROUP BY o_orderkey""")
def merge_latest(spark, sf_dir):
    """Upsert: the newest version of each key stays."""
    orders = table(spark, sf_dir, "orders")
    old = orders.select("o_orderkey", "o_orderstatus", F.lit(0).alias("version"))
    new = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(1).alias("version"))
    return old.unionByName(new).groupBy("o_orderkey").agg(F.max_by("o_orderstatus", "version").alias("o_orderstatus"), F.max("version").alias("version"))


@query("""WITH v AS (SELECT o_orderkey, o_orderstatus, 0 AS version, false AS gone FROM orders UNION ALL SELECT o_orderkey, 'X', 1, o_orderkey % 15 = 0 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'Y', 2, false FROM orders WHERE o_orderkey % 7 = 0)
SELECT o_orderkey, o_orderstatus, version::INTEGER AS version FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY version DESC) AS n FROM v) WHERE n = 1 AND NOT gone""")
def merge_at_rest(spark, sf_dir):
    """Batches of changed and deleted rows merged into a table at rest, one of them twice and out of order."""
    orders, path = table(spark, sf_dir, "orders"), shared_path(spark, "orders")
    of = lambda rows, status, version: rows.select("o_orderkey", status.alias("o_orderstatus"), F.lit(version).alias("version"))
    merged.create_merged(of(orders, F.col("o_orderstatus"), 0), path, ["o_orderkey"], "version")
    later = of(orders.where("o_orderkey % 7 = 0"), F.lit("Y"), 2)
    first = of(orders.where("o_orderkey % 3 = 0"), F.lit("X"), 1).withColumn("deleted", F.col("o_orderkey") % 15 == 0)
    for batch in (later, first, later):
        merged.merge_batch(spark, path, batch, ["o_orderkey"], "version")
    return merged.read_merged(spark, path)


@query("SELECT d.doc_id, coalesce(len(e.embedding), 0)::INTEGER AS dimension, coalesce(round(e.embedding[1]::DOUBLE, 6), 0) AS first FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def attach_embeddings(spark, sf_dir):
    """Vectors joined to their rows; rows without one stay."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = table(spark, sf_dir, "documents").select("doc_id").join(vectors, "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.size("embedding"), F.lit(0)).alias("dimension"), F.coalesce(F.round(F.get("embedding", F.lit(0)).cast("double"), 6), F.lit(0.0)).alias("first"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark, sf_dir):
    """Children of deleted parents go."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(gone, "l_orderkey", "left_anti")


@query("SELECT o.o_orderkey, CASE WHEN c.c_custkey IS NULL THEN NULL ELSE o.o_custkey END AS o_custkey FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal >= 0")
def set_null_parent(spark, sf_dir):
    """References to deleted parents become null."""
    left = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("there"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(left, "o_custkey", "left")
    return rows.select("o_orderkey", F.when(F.col("there"), F.col("o_custkey")).alias("o_custkey"))


@query("SELECT event_id, user_id FROM events WHERE ts + INTERVAL 7 DAY >= (SELECT max(ts) FROM events)")
def ttl_sweep(spark, sf_dir):
    """Entries that have not expired a week after they were written."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    return events.crossJoin(F.broadcast(now)).where("ts + interval 7 days >= now").select("event_id", "user_id")


@query("SELECT d.doc_id, e.vec_id FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE length(trim(d.text)) >= 50 AND d.lang IN ('en', 'fr')")
def completed_gate(spark, sf_dir):
    """Vectors of completed documents in given languages."""
    done = table(spark, sf_dir, "documents").where("length(trim(text)) >= 50 and lang in ('en', 'fr')").select("doc_id")
    return table(spark, sf_dir, "embeddings").select("vec_id").join(done, F.col("vec_id") == F.col("doc_id")).select("doc_id", "vec_id")


@query("""WITH s AS (SELECT user_id, event_id, event_type AS now, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, event_id, before, now FROM s WHERE before IS NOT NULL AND (before, now) NOT IN (('signup','view'),('view','click'),('view','view'),('click','purchase'),('click','view'),('purchase','view'),('error','view'),('view','error'),('click','error'))""")
def illegal_transitions(spark, sf_dir):
    """Steps that the state machine doesn't allow: an anti join with its short table."""
    steps = [("signup", "view"), ("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("error", "view"), ("view", "error"), ("click", "error")]
    legal = spark.createDataFrame(steps, "before string, now string")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("now"), F.lag("event_type").over(order).alias("before")).where("before is not null")
    return rows.join(F.broadcast(legal), ["before", "now"], "left_anti").select("user_id", "event_id", "before", "now")


@query("""SELECT conv_id, turn, role, n::INTEGER AS n FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS n FROM conversations WHERE role <> 'assistant' OR (conv_id + turn) % 5 <> 0) WHERE n <= 4""")
def answered_history(spark, sf_dir):
    """The last four turns of each conversation, without answers that did not complete."""
    turns = table(spark, sf_dir, "conversations").where("role <> 'assistant' or (conv_id + turn) % 5 <> 0")
    order = W.partitionBy("conv_id").orderBy(F.col("turn").desc(), "role", "text")
    return turns.select("conv_id", "turn", "role", F.row_number().over(order).alias("n")).where("n <= 4")


@query("""WITH j AS (SELECT user_id, event_id, ts, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempts FROM events)
SELECT event_id, attempts::BIGINT AS attempts, CASE WHEN attempts <= 0 THEN 10 ELSE least(10 * (2 ** least(attempts - 1, 32))::BIGINT, 900) END::BIGINT AS backoff, attempts >= 3 AS dead FROM j""")
def job_backoff(spark, sf_dir):
    """Attempts so far, the wait before the next one, and whether none is left."""
    upto = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "events").withColumn("attempts", F.sum((F.col("event_type") == "error").cast("long")).over(upto))
    wait = F.when(F.col("attempts") <= 0, F.lit(10).cast("long")).otherwise(F.least(F.expr("shiftleft(10L, cast(least(attempts - 1, 32) as int))"), F.lit(900).cast("long")))
    return rows.select("event_id", "attempts", wait.alias("backoff"), (F.col("attempts") >= 3).alias("dead"))


@query("SELECT user_id, arg_max(event_id, (CASE WHEN event_type = 'purchase' THEN 30 WHEN event_type = 'click' THEN 20 ELSE 10 END) * 100000000000::BIGINT - event_id) AS event_id FROM events WHERE event_type <> 'error' GROUP BY user_id")
def job_claim_head(spark, sf_dir):
    """The head of each queue: highest priority, then oldest."""
    priority = F.when(F.col("event_type") == "purchase", 30).when(F.col("event_type") == "click", 20).otherwise(10)
    return table(spark, sf_dir, "events").where("event_type <> 'error'").groupBy("user_id").agg(F.max_by("event_id", F.struct(priority, -F.col("event_id"))).alias("event_id"))


@query("""WITH s AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS beat FROM events)
SELECT user_id, event_id FROM s WHERE beat IS NULL OR beat > ts + INTERVAL 300 SECOND""")
def lease_reclaim(spark, sf_dir):
    """Leases that no heartbeat extended in time."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.lead("ts").over(order).alias("beat"))
    return rows.where("beat is null or beat > ts + interval 300 seconds").select("user_id", "event_id")


@query("""SELECT user_id, event_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_until,
lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS superseded_by FROM events""")
def memory_supersede(spark, sf_dir):
    """Facts with their validity and what supersedes them."""
    order = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("ts").alias("valid_from"), F.lead("ts").over(order).alias("valid_until"), F.lead("event_id").over(order).alias("superseded_by"))


@query("""SELECT user_id, arg_max(event_id, (CASE event_type WHEN 'signup' THEN 40 WHEN 'purchase' THEN 30 WHEN 'click' THEN 20 ELSE 10 END) * 100000000000::BIGINT + event_id) AS event_id FROM events GROUP BY user_id""")
def memory_conflict(spark, sf_dir):
    """Of facts in conflict, the one of the best provenance, then the newest."""
    rank = F.when(F.col("event_type") == "signup", 40).when(F.col("event_type") == "purchase", 30).when(F.col("event_type") == "click", 20).otherwise(10)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct(rank, "event_id")).alias("event_id"))


@query("""WITH e AS (SELECT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation),
two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)
SELECT a AS node, count(DISTINCT b) AS neighbours, min(b) AS first FROM two GROUP BY a""")
def graph_neighbours(spark, sf_dir):
    """Neighbours within one hop, both ways."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edges = table(spark, sf_dir, "orders").select(key("c", "o_custkey").alias("a"), key("o", "o_orderkey").alias("b"))
    edges = edges.unionByName(table(spark, sf_dir, "customer").select(key("n", "c_nationkey").alias("a"), key("c", "c_custkey").alias("b")))
    edges = edges.unionByName(table(spark, sf_dir, "nation").select(key("r", "n_regionkey").alias("a"), key("n", "n_nationkey").alias("b")))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("neighbours"), F.min("b").alias("first"))


@query("""SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    """Exact percentiles of a measure by kind."""
    found = exact_percentiles(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return found.select("event_type", "n", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= ts - INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM s)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM g GROUP BY user_id, s""")
def session_inactivity(spark, sf_dir):
    """Sessions that six idle hours end, by gaps and islands."""
    order = W.partitionBy("user_id").orderBy("ts")
    rows = table(spark, sf_dir, "events").select("user_id", "ts").withColumn("new", F.when(F.lag("ts").over(order) >= F.expr("ts - interval 6 hours"), 0).otherwise(1))
    numbered = rows.withColumn("s", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "s").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n")).drop("s")


@query("""SELECT conv_id, count(*) AS messages, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS tokens, count(*) >= 6 OR sum(len(regexp_extract_all(text, '\\S+'))) >= 200 AS compact FROM conversations GROUP BY conv_id""")
def compaction_triggers(spark, sf_dir):
    """Conversations that are long enough to be compacted."""
    rows = table(spark, sf_dir, "conversations").withColumn("w", F.regexp_count("text", F.lit(r"\S+")).cast("long"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum("w").alias("tokens")).withColumn("compact", F.expr("messages >= 6 or tokens >= 200"))
