"""Queries that rerank, prune and shorten ranked passages; each with its SQL.

Every document whose id is divisible by 20 asks; its list are the documents behind it in steps of seven, some of them
twice, the second time as the first half of the text, so that repeats of all sorts are met.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evidence as E
from lodestone.plans.passages import _SENTENCES, _list
from lodestone.plans.store import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def note(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, T.with_strip(sql)
        return f

    return note


def _candidates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), T.terms(F.col("text")).alias("question"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("rank"))
    met = asked.withColumn("doc_id", F.col("query_id") + F.col("rank") * 7 % 25).join(docs, "doc_id")
    d, again = F.col("doc_id"), F.col("rank") >= 25
    text = F.when(again, F.expr("left(text, length(text) div 2)")).otherwise(F.col("text"))
    return met.select(
        "query_id", "question", "rank", (d * 2 + again.cast("int")).alias("chunk_id"), text.alias("text"), F.sha2(text, 256).alias("content_hash"),
        F.when(d % 5 == 0, None).when(d % 7 == 0, (d + 7) * 2).otherwise(F.floor(d / 3) + 1_000_000_000_000).alias("parent_id"),
        (d % 6).alias("document_id"), (d % 4).alias("page"), F.when(F.contains(text, F.lit("|")), "TABLE").otherwise("TEXT").alias("chunk_type"),
    )


_CANDIDATES = """SELECT query_id, question, rank, chunk_id, text, sha256(text) AS content_hash, parent_id, document_id, page, CASE WHEN contains(text, '|') THEN 'TABLE' ELSE 'TEXT' END AS chunk_type FROM (
SELECT q.query_id, q.question, q.rank, d.doc_id * 2 + (q.rank >= 25)::INTEGER AS chunk_id, CASE WHEN q.rank >= 25 THEN left(text, length(text) // 2) ELSE text END AS text,
CASE WHEN d.doc_id % 5 = 0 THEN NULL WHEN d.doc_id % 7 = 0 THEN (d.doc_id + 7) * 2 ELSE d.doc_id // 3 + 1000000000000 END AS parent_id, d.doc_id % 6 AS document_id, d.doc_id % 4 AS page
FROM (SELECT doc_id AS query_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS question, unnest(range(40)) AS rank FROM documents WHERE doc_id % 20 = 0) q JOIN documents d ON d.doc_id = q.query_id + q.rank * 7 % 25)"""
_WORDS_OF = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"


def reranked_sql(candidates: str) -> str:
    """SQL of the order by idf-weighted terms of the candidates (query_id, question, rank, chunk_id, text): their columns, fused_rank, score and rank anew."""
    return f"""SELECT * EXCLUDE (rank, terms), rank AS fused_rank, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) - 1)::INTEGER AS rank FROM (
SELECT c.*, round(CASE WHEN list_sum(list_transform(w.weights, lambda x: x.idf)) IS NULL THEN 0.0 ELSE coalesce(list_sum(list_transform(list_filter(w.weights, lambda x: list_contains(c.terms, x.term)), lambda x: x.idf)), 0.0) / list_sum(list_transform(w.weights, lambda x: x.idf)) END, 9) AS score
FROM (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS terms FROM ({candidates}) WHERE rank < 40) c LEFT JOIN (
SELECT query_id, list({{'term': term, 'idf': ln(1 + ((SELECT count(*) FROM documents) - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE))}} ORDER BY term) AS weights
FROM (SELECT DISTINCT query_id, unnest(question) AS term FROM ({candidates})) LEFT JOIN (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY term) USING (term) GROUP BY query_id) w USING (query_id))"""


def document_frequencies(docs):
    """term, df of every term of documents."""
    return docs.select(F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@query(f"SELECT query_id, chunk_id, score, rank FROM ({reranked_sql(_CANDIDATES)})")
def lexical_rerank(spark, sf_dir):
    """Each list's first 40 in the order of a score of question and passage together: shared terms, weighed by how telling they are."""
    ranked, docs = _candidates(spark, sf_dir), table(spark, sf_dir, "documents")
    questions = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), T.terms(F.col("text")).alias("question"))
    weights = E.term_weights(questions, document_frequencies(docs), docs.count())
    scored = ranked.drop("question").join(weights, "query_id").withColumn("score", F.round(E.weighted_score(F.col("weights"), T.terms(F.col("text"))), 9))
    return E.rerank(scored).select("query_id", "chunk_id", "score", "rank")


def pruned_sql(most: int | str, candidates: str = _CANDIDATES, also: str = "") -> str:
    """SQL of pruning; ``most`` is a number or an expression over the item, for which ``also`` names further columns."""
    also = "".join(f", s.{c.strip()}" for c in also.split(",") if c)
    return rf"""WITH RECURSIVE c AS MATERIALIZED ({candidates}),
w AS (SELECT *, {_WORDS_OF.format("lower(text)")} AS w, list_distinct(list_transform(list_filter(string_split_regex(text, '\r\n|\r|\n'), lambda l: strip(l) <> ''), lambda l: array_to_string({_WORDS_OF.format("lower(l)")}, ' '))) AS lines FROM c),
s AS MATERIALIZED (SELECT *, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: hash(array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
r AS (SELECT a.query_id, a.rank, list(b.rank) AS reps FROM s a JOIN s b ON a.query_id = b.query_id AND b.rank < a.rank
  WHERE a.chunk_id = b.chunk_id OR a.content_hash = b.content_hash OR a.parent_id = b.chunk_id OR b.parent_id = a.chunk_id
  OR (least(len(a.s), len(b.s)) > 0 AND len(list_intersect(a.s, b.s)) >= 0.8 * least(len(a.s), len(b.s)))
  OR (a.chunk_type = 'TABLE' AND b.chunk_type = 'TABLE' AND least(len(a.lines), len(b.lines)) > 0 AND len(list_intersect(a.lines, b.lines)) >= 0.8 * least(len(a.lines), len(b.lines))) GROUP BY ALL),
item AS MATERIALIZED (SELECT s.query_id, s.rank, s.chunk_id, s.parent_id, s.document_id, s.document_id * 10 + s.page AS page, coalesce(r.reps, []) AS reps{also}, row_number() OVER (PARTITION BY s.query_id ORDER BY s.rank) AS i FROM s LEFT JOIN r ON r.query_id = s.query_id AND r.rank = s.rank),
fold AS (SELECT query_id, i, [rank] AS kept, [chunk_id] AS ids, [parent_id] AS parents, [page] AS pages, [document_id] AS docs FROM item WHERE i = 1 UNION ALL
  SELECT query_id, i, CASE WHEN ok THEN list_append(kept, rank) ELSE kept END, CASE WHEN ok THEN list_append(ids, chunk_id) ELSE ids END, CASE WHEN ok THEN list_append(parents, parent_id) ELSE parents END, CASE WHEN ok THEN list_append(pages, page) ELSE pages END, CASE WHEN ok THEN list_append(docs, document_id) ELSE docs END FROM (
  SELECT item.*, f.kept, f.ids, f.parents, f.pages, f.docs, NOT list_has_any(f.kept, item.reps) AND (item.parent_id IS NULL OR len(list_filter(f.parents, lambda x: x = item.parent_id)) < 2)
    AND len(list_filter(f.pages, lambda x: x = item.page)) < 3 AND len(list_filter(f.docs, lambda x: x = item.document_id)) < {most} AS ok FROM fold f JOIN item ON item.query_id = f.query_id AND item.i = f.i + 1)),
last AS (SELECT query_id, arg_max(kept, i) AS kept, arg_max(ids, i) AS ids FROM fold GROUP BY query_id)
SELECT query_id, (unnest(range(len(kept))))::INTEGER AS rank, unnest(kept)::INTEGER AS old_rank, unnest(ids) AS chunk_id FROM last"""


@query(pruned_sql(4))
def prune_evidence(spark, sf_dir):
    """Passages that repeat nothing kept before them, with the shares of parents, pages and documents kept."""
    return E.prune(_candidates(spark, sf_dir).withColumn("query_class", F.lit("DIRECT")))


@query(pruned_sql(2))
def prune_comparison(spark, sf_dir):
    """The same for comparisons, for which a document's share is half as large."""
    return E.prune(_candidates(spark, sf_dir).withColumn("query_class", F.lit("COMPARISON")))


def compressed_sql(budget: int, candidates: str) -> str:
    """SQL of shortening the passages (query_id, rank, chunk_id, chunk_type, text, question) that ``candidates`` selects."""
    bearing = f"regexp_matches(u, '[0-9]') OR regexp_matches(u, '(?i)\\b\\w+n[’'']t\\b') OR list_has_any(regexp_extract_all(lower(u), '[a-z0-9]+'), {_list(T.NEGATIONS + T.QUALIFIERS)})"
    rows = r"list_filter(string_split_regex(text, '\r\n|\r|\n'), lambda l: strip(l) <> '')"
    table = "chunk_type = 'TABLE'"
    units, needed = f"CASE WHEN {table} THEN {rows} ELSE {_SENTENCES} END", f"CASE WHEN {table} THEN k <= 2 ELSE {bearing} END"
    whole = f"CASE WHEN {table} THEN len(units) <= 3 ELSE len(units) <= 1 OR list_contains({_list(E.STRUCTURED)}, chunk_type) END"
    return rf"""WITH RECURSIVE c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS p, count(*) OVER (PARTITION BY query_id) AS n FROM ({candidates})),
u AS MATERIALIZED (SELECT *, {units} AS units, len({_WORDS_OF.format("text")}) AS tokens FROM c),
x AS MATERIALIZED (SELECT query_id, p, k, u, question, chunk_type, len({_WORDS_OF.format("u")}) AS size, ({needed}) AS needed FROM (SELECT query_id, p, question, chunk_type, unnest(units) AS u, generate_subscripts(units, 1) AS k FROM u)),
base AS (SELECT query_id, p, sum(size) FILTER (needed) AS base, list(k ORDER BY k) FILTER (needed) AS first FROM x GROUP BY ALL),
event AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, far NULLS FIRST, k) AS e FROM (
  SELECT query_id, p, NULL AS far, NULL AS k, tokens, n, ({whole}) AS whole, coalesce(base, 0) AS base, coalesce(first, []) AS first, 0 AS size FROM u LEFT JOIN base USING (query_id, p)
  UNION ALL SELECT query_id, p, -len(list_intersect(list_distinct(regexp_extract_all(lower(u), '[a-z0-9]+')), list_distinct(question))), k, NULL, NULL, NULL, NULL, NULL, size FROM x WHERE NOT needed)),
fold AS (SELECT query_id, e, p, {budget} AS rest, greatest(1, {budget} // n) AS share, tokens <= greatest(1, {budget} // n) OR whole AS fits, CASE WHEN tokens <= greatest(1, {budget} // n) OR whole THEN tokens ELSE base END AS total, first AS chosen FROM event WHERE e = 1 UNION ALL
  SELECT query_id, e, p, rest, share, fits, CASE WHEN far IS NULL THEN CASE WHEN fits THEN tokens ELSE base END WHEN fits OR (total + size > share AND len(chosen) > 0) THEN total ELSE total + size END,
    CASE WHEN far IS NULL THEN first WHEN fits OR (total + size > share AND len(chosen) > 0) THEN chosen ELSE list_append(chosen, k) END FROM (
  SELECT v.query_id, v.e, v.p, v.far, v.k, v.size, v.tokens, v.base, v.first, f.total, f.chosen, CASE WHEN v.far IS NULL THEN f.rest - f.total ELSE f.rest END AS rest,
    CASE WHEN v.far IS NULL THEN greatest(1, floor((f.rest - f.total) / (v.n - v.p + 1))::BIGINT) ELSE f.share END AS share, CASE WHEN v.far IS NULL THEN v.tokens <= greatest(1, floor((f.rest - f.total) / (v.n - v.p + 1))::BIGINT) OR v.whole ELSE f.fits END AS fits
  FROM fold f JOIN event v ON v.query_id = f.query_id AND v.e = f.e + 1)),
last AS (SELECT query_id, p, arg_max(total, e) AS total, arg_max(chosen, e) AS chosen, bool_and(fits) AS fits FROM fold GROUP BY ALL),
cut AS (SELECT u.query_id, u.rank, u.chunk_id, u.text, l.total, l.fits, CASE WHEN {table} THEN array_to_string(list_transform(list_sort(l.chosen), lambda i: units[i]), chr(10)) ELSE array_to_string(list_transform(list_sort(l.chosen), lambda i: units[i]), ' ') END AS joined FROM u JOIN last l USING (query_id, p))
SELECT query_id, rank::INTEGER AS rank, chunk_id, total::INTEGER AS tokens, NOT fits AND joined NOT IN ('', text) AS compressed, sha256(CASE WHEN NOT fits AND joined NOT IN ('', text) THEN joined ELSE text END) AS digest FROM cut"""


def _of_kind(kind: str) -> str:
    return f"SELECT * FROM ({_CANDIDATES}) WHERE chunk_type = '{kind}' AND rank < 8"


def _compressed(spark, sf_dir, kind: str, budget: int):
    chosen = _candidates(spark, sf_dir).where((F.col("chunk_type") == kind) & (F.col("rank") < 8))
    return E.compress(chosen, budget).select("query_id", "rank", "chunk_id", "tokens", "compressed", F.sha2("text", 256).alias("digest"))


@query(compressed_sql(900, _of_kind("TEXT")))
def compress_prose(spark, sf_dir):
    """The first passages of each list in 900 words: sentences that carry weight, then those that meet the question."""
    return _compressed(spark, sf_dir, "TEXT", 900)


@query(compressed_sql(60, _of_kind("TABLE")))
def compress_table(spark, sf_dir):
    """Tables in 60 words: the opening lines, then the rows that meet the question."""
    return _compressed(spark, sf_dir, "TABLE", 60)


@query(compressed_sql(6000, _of_kind("TEXT")))
def compress_default(spark, sf_dir):
    """The same in the usual budget of 6000 words."""
    return _compressed(spark, sf_dir, "TEXT", 6000)


@query(f"""SELECT query_id, sum(len({_WORDS_OF.format("text")}))::BIGINT AS total_tokens, count(DISTINCT document_id) AS documents, count(*) AS passages FROM ({_CANDIDATES}) GROUP BY query_id""")
def evidence_totals(spark, sf_dir):
    """Tokens, documents and passages of each list."""
    rows = _candidates(spark, sf_dir).withColumn("tokens", F.size(T.words(F.col("text"))).cast("long"))
    return rows.groupBy("query_id").agg(F.sum("tokens").alias("total_tokens"), F.countDistinct("document_id").alias("documents"), F.count("*").alias("passages"))
