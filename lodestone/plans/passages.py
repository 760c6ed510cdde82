"""Queries over texts and ranked passages: classification, splitting, search, fusion, selection, validation; with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import keywords as K
from lodestone.operators import retrieval as R
from lodestone.plans.store import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def note(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, T.with_strip(sql)
        return f

    return note


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(items: list[str]) -> str:
    return "[" + ", ".join(map(_quoted, items)) + "]"


#: Openings that give the user turns of conversations a class of each kind.
OPENINGS = [
    "Define ", "In table 3, ", "Figure 4.2 shows ", "Quiz me on ", "Summarize ", "Draw a concept map of ", "Compare ", "How many ", "Across all documents, ",
    "If it rains then ", "What links ", "Prerequisites for ", "", "And what about that ", "Tell me more about ", "This ",
]
_QUESTIONS = f"(SELECT conv_id, turn, {_list(OPENINGS)}[(conv_id + turn) % {len(OPENINGS)} + 1] || text AS q FROM conversations WHERE role = 'user')"


def _questions(spark, sf_dir):
    opening = F.get(F.array(*[F.lit(x) for x in OPENINGS]), ((F.col("conv_id") + F.col("turn")) % len(OPENINGS)).cast("int"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(opening, F.col("text")).alias("q"))


_CLASS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(q, {_quoted(p)}) THEN '{c}'" for c, p in T.CLASS_RULES) + " ELSE 'DIRECT' END"


@query(f"SELECT conv_id, turn, {_CLASS_SQL} AS query_class FROM {_QUESTIONS}")
def classify_query(spark, sf_dir):
    """The class of every question: first rule that matches."""
    return _questions(spark, sf_dir).select("conv_id", "turn", T.query_class(F.col("q")).alias("query_class"))


@query(f"""SELECT conv_id, turn, query_class, query_class IN ('MULTI_DOCUMENT','MULTI_HOP','AGGREGATION','COMPARISON') AS decompose, query_class IN ('RELATIONSHIP','PREREQUISITE','CONCEPT_MAP') AS consult_graph,
CASE query_class WHEN 'EXACT_TERM' THEN 'EXACT_LOOKUP' END AS early_exit, query_class NOT IN ('EXACT_TERM','TABLE','VISUAL','SUMMARY') AS expand FROM (SELECT conv_id, turn, {_CLASS_SQL} AS query_class FROM {_QUESTIONS})""")
def retrieval_plan(spark, sf_dir):
    """The plan of every question without a selected object, with a graph at hand."""
    rows = _questions(spark, sf_dir).select("conv_id", "turn", T.query_class(F.col("q")).alias("query_class"))
    c = F.col("query_class")
    return rows.select(
        "conv_id", "turn", c, c.isin("MULTI_DOCUMENT", "MULTI_HOP", "AGGREGATION", "COMPARISON").alias("decompose"), c.isin("RELATIONSHIP", "PREREQUISITE", "CONCEPT_MAP").alias("consult_graph"),
        F.when(c == "EXACT_TERM", "EXACT_LOOKUP").alias("early_exit"), (~c.isin("EXACT_TERM", "TABLE", "VISUAL", "SUMMARY")).alias("expand"),
    )


@query(f"SELECT conv_id, turn, turn > 0 AND ({' OR '.join(f'regexp_matches(q, {_quoted(p)})' for p in T.FOLLOW_UP)}) AS rewrite FROM {_QUESTIONS}")
def follow_up(spark, sf_dir):
    """Questions that lean on the turns before them."""
    return _questions(spark, sf_dir).select("conv_id", "turn", ((F.col("turn") > 0) & T.is_follow_up(F.col("q"))).alias("rewrite"))


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: strip(s)), lambda s: s <> '')"


@query(f"SELECT doc_id, len({_SENTENCES})::INTEGER AS n, sha256(array_to_string({_SENTENCES}, '|')) AS digest FROM documents")
def sentence_split(spark, sf_dir):
    """Sentences of every document: how many, and a digest of them."""
    return table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n"), F.sha2(F.array_join("s", "|"), 256).alias("digest"))


@query(f"""SELECT doc_id, count(*)::BIGINT AS n, count(*) FILTER (regexp_matches(s, '[0-9]') OR regexp_matches(s, '(?i)\\b\\w+n[’'']t\\b') OR list_has_any(regexp_extract_all(lower(s), '[a-z0-9]+'), {_list(T.NEGATIONS + T.QUALIFIERS)}))::BIGINT AS bearing
FROM (SELECT doc_id, unnest({_SENTENCES}) AS s FROM documents) GROUP BY doc_id""")
def load_bearing(spark, sf_dir):
    """How many sentences of each document must not be lost."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(T.load_bearing(F.col("s"))).alias("bearing"))


@query("""SELECT doc_id, len(t)::INTEGER AS n_terms, len(list_distinct(t))::INTEGER AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)""")
def token_stats(spark, sf_dir):
    """Terms of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", T.terms(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_terms"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS uses FROM t GROUP BY term""")
def inverted_index(spark, sf_dir):
    """Terms with the number of documents and of uses."""
    return R.inverted_index(table(spark, sf_dir, "documents")).groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("uses"))


@query("""SELECT doc_id, pos::INTEGER AS pos, CASE WHEN trim(line) = '' THEN 'PARAGRAPH' WHEN regexp_matches(trim(line), '^\\s*(?:[-•*·‣▪◦–—]\\s|\\(?\\d{1,3}[.)]\\s|\\(?[a-zA-Z][.)]\\s|\\(?[ivxlcdm]{1,5}[.)]\\s)') THEN 'LIST'
WHEN NOT regexp_matches(strip(line), '[.!?:;]$') AND pos % 2 = 0 THEN 'HEADING' ELSE 'PARAGRAPH' END AS element_type FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""")
def element_classify(spark, sf_dir):
    """The type of every line; even lines count as bold."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.select("doc_id", "pos", T.element_type(F.col("line"), F.lit(1.0), F.col("pos") % 2 == 0, F.lit(1)).alias("element_type"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 500 >= 400 THEN 'COMPLEX' WHEN NOT (l_quantity * 4 >= 50 AND l_discount >= 0.05) AND l_tax >= 0.04 THEN 'SCANNED' WHEN (l_quantity * 4 >= 50 AND l_discount >= 0.05) AND l_tax >= 0.04 THEN 'MIXED' ELSE 'NATIVE_TEXT' END AS kind FROM lineitem""")
def page_classify(spark, sf_dir):
    """Kinds of pages from measurements (quantities stand for characters, rates for covers)."""
    kind = T.page_kind(F.col("l_quantity") * 4, F.when(F.col("l_discount") >= 0.05, 0.5).otherwise(0.0), F.when(F.col("l_tax") >= 0.04, 0.5).otherwise(0.0), F.when(F.col("l_partkey") % 500 >= 400, 400).otherwise(0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"))


def _nearest(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    done = table(spark, sf_dir, "documents").where("length(trim(text)) >= 50").select(F.col("doc_id").alias("vec_id"))
    return R.dense_top_k(queries, vectors.join(done, "vec_id", "left_semi"))


_DENSE = """SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) - 1 AS rank
FROM embeddings q, embeddings v JOIN documents d ON d.doc_id = v.vec_id AND length(trim(d.text)) >= 50 WHERE q.vec_id % 20 = 0) WHERE rank < 30"""


@query(f"SELECT query_id, vec_id, rank::INTEGER AS rank FROM ({_DENSE})")
def dense_topk(spark, sf_dir):
    """The 30 nearest completed passages of every query vector (each id divisible by 20)."""
    return _nearest(spark, sf_dir).select("query_id", "vec_id", "rank")


#: Query terms of a document: all of its text.
_TERMS_SQL = "SELECT doc_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents WHERE doc_id % 20 = 0"


def _query_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("doc_id % 20 = 0")
    return rows.select(F.col("doc_id").alias("query_id"), F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))


_KEYWORD = f"""SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM (
SELECT w.query_id, h.doc_id, round(sum(1 + ln(h.tf)), 6) AS score FROM ({_TERMS_SQL}) w JOIN (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY doc_id, term) h ON h.term = w.term
JOIN (SELECT query_id, count(*) AS n FROM ({_TERMS_SQL}) GROUP BY query_id) s ON s.query_id = w.query_id GROUP BY w.query_id, h.doc_id, s.n HAVING count(*) = s.n)) WHERE rank < 30"""


@query(f"SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM ({_KEYWORD})")
def keyword_topk(spark, sf_dir):
    """Documents that hold all terms of the text, for every document whose id is divisible by 20."""
    return K.keyword_top_k(_query_terms(spark, sf_dir), table(spark, sf_dir, "documents"))


@query("""WITH c AS (SELECT doc_id, unnest(generate_series(0, 2)) AS claim, text FROM documents WHERE lang = 'en'), s AS (SELECT doc_id, claim, CASE WHEN (doc_id * 7 + claim * 3) % 10 < 6 THEN 3 WHEN (doc_id * 7 + claim * 3) % 10 < 9 THEN 1 ELSE 2 END AS status FROM c)
SELECT doc_id, CASE WHEN max(CASE WHEN status = 2 THEN 1 ELSE 0 END) = 1 THEN 'REJECTED' WHEN min(status) = 1 THEN 'REPAIRABLE' ELSE 'VALID' END AS decision, count(*) FILTER (status = 3) AS entailed FROM s GROUP BY doc_id""")
def answer_decision(spark, sf_dir):
    """Decision on every answer from the status of its claims: contradicted rejects, unsupported can be repaired."""
    mark = (F.col("doc_id") * 7 + F.col("claim") * 3) % 10
    status = F.when(mark < 6, "ENTAILED").when(mark < 9, "NOT_SUPPORTED").otherwise("CONTRADICTED")
    claims = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("claim")).withColumn("status", status)
    decision = F.when(F.bool_or(F.col("status") == "CONTRADICTED"), "REJECTED").when(F.bool_or(F.col("status") == "NOT_SUPPORTED"), "REPAIRABLE").otherwise("VALID")
    return claims.groupBy("doc_id").agg(decision.alias("decision"), F.count_if(F.col("status") == "ENTAILED").alias("entailed"))


@query(r"""SELECT a.doc_id, len(list_distinct(list_filter(a.n, lambda x: NOT list_contains(b.n, x))))::INTEGER AS missing FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?'), lambda x: replace(x, ',', '')) AS n FROM documents) a
JOIN (SELECT doc_id + 1 AS doc_id, list_transform(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?'), lambda x: replace(x, ',', '')) AS n FROM documents) b ON a.doc_id = b.doc_id WHERE len(a.n) > 0""")
def numeric_fidelity(spark, sf_dir):
    """Numbers of a claim (a document) that its passage (the document before it) doesn't have."""
    numbers = F.transform(F.regexp_extract_all("text", F.lit(r"\d[\d,]*(?:\.\d+)?"), 0), lambda x: F.replace(x, F.lit(","), F.lit("")))
    rows = table(spark, sf_dir, "documents").select("doc_id", numbers.alias("n"))
    passages = rows.select((F.col("doc_id") + 1).alias("doc_id"), F.col("n").alias("known"))
    return rows.where("size(n) > 0").join(passages, "doc_id").select("doc_id", F.size(F.array_except("n", "known")).alias("missing"))


@query("""SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, round(greatest(least(a.l_quantity + 10, b.l_quantity + 10) - greatest(a.l_quantity, b.l_quantity), 0) / (20 - greatest(least(a.l_quantity + 10, b.l_quantity + 10) - greatest(a.l_quantity, b.l_quantity), 0)), 6) AS iou
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber""")
def bbox_iou(spark, sf_dir):
    """Overlap of boxes on one page (an order stands for a page, quantity for the left edge)."""
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    left, right = boxes.select("l_orderkey", F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("x")), boxes.select("l_orderkey", F.col("l_linenumber").alias("j"), F.col("l_quantity").alias("y"))
    shared = F.greatest(F.least(F.col("x") + 10, F.col("y") + 10) - F.greatest("x", "y"), F.lit(0.0))
    return left.join(right, "l_orderkey").where("i < j").select("l_orderkey", "i", "j", F.round(shared / (20 - shared), 6).alias("iou"))


@query("""SELECT a.doc_id, round(CASE WHEN least(len(a.s), len(b.s)) = 0 THEN 0 ELSE len(list_intersect(a.s, b.s)) / least(len(a.s), len(b.s)) END, 6) AS containment FROM
(SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)) a
JOIN (SELECT doc_id - 1 AS doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)) b ON a.doc_id = b.doc_id""")
def shingle_containment(spark, sf_dir):
    """How much of a document's five-word shingles the next document holds."""
    # texts meet, and are cut where they met: shingles are many times as large
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    following = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next_text"))
    of = lambda name: T.shingles(T.words(F.col(name)))
    both = F.transform(F.array(F.struct(of("text").alias("s"), of("next_text").alias("t"))), lambda x: T.containment(x["s"], x["t"]))
    return rows.join(following, "doc_id").select("doc_id", F.round(F.get(both, F.lit(0)), 6).alias("containment"))
