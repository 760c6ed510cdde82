"""Queries of layout, chunking, tables and prompt building; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import tables as G
from lodestone.functions import text as T
from lodestone.functions import tokens
from lodestone.operators import chunking, context, layout
from lodestone.plans.passages import _SENTENCES
from lodestone.plans.store import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def note(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, T.with_strip(sql)
        return f

    return note


#: Tells rows of a page apart, in the order of their lines.
_ID = "cast(l_linenumber as bigint) * 1000000000 + l_partkey * 10000 + l_suppkey"
_WORDS = r"len(list_filter(string_split_regex(s, '\s+'), lambda w: w <> ''))"
_SIZED = f"SELECT doc_id, i, {_WORDS}::INTEGER AS n FROM (SELECT doc_id, unnest({_SENTENCES}) AS s, generate_subscripts({_SENTENCES}, 1) AS i FROM documents)"


def _sizes(spark, sf_dir):
    sizes = F.transform(T.sentences(F.col("text")), lambda s: F.size(T.words(s)))
    return table(spark, sf_dir, "documents").select("doc_id", sizes.alias("sizes")).where("size(sizes) > 0")


@query(f"""WITH RECURSIVE p AS MATERIALIZED ({_SIZED}), fold AS (
SELECT doc_id, i, n AS used, 0 AS chunk FROM p WHERE i = 1 UNION ALL
SELECT p.doc_id, p.i, CASE WHEN used + n <= 400 OR used = 0 THEN used + n ELSE n END, chunk + CASE WHEN used + n <= 400 OR used = 0 THEN 0 ELSE 1 END FROM fold f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1)
SELECT doc_id, max(chunk + 1)::INTEGER AS chunks, string_agg(chunk, ',' ORDER BY i) AS members FROM fold GROUP BY doc_id""")
def sentence_pack(spark, sf_dir):
    """Sentences filled greedily into chunks of 400 words; a longer one stands alone."""
    got = _sizes(spark, sf_dir).select("doc_id", chunking.packed(F.col("sizes"), 400).alias("m"))
    return got.select("doc_id", (F.array_max("m") + 1).alias("chunks"), F.array_join(F.col("m").cast("array<string>"), ",").alias("members"))


@query(f"""WITH RECURSIVE p AS MATERIALIZED ({_SIZED}), fold AS (
SELECT doc_id, i, CASE WHEN n >= 1200 THEN 0 ELSE n END AS used, 0 AS part, CASE WHEN n >= 1200 THEN 1 ELSE 0 END AS next FROM p WHERE i = 1 UNION ALL
SELECT doc_id, i, CASE WHEN full_ >= 1200 THEN 0 ELSE full_ END, part, part + CASE WHEN full_ >= 1200 THEN 1 ELSE 0 END FROM (
SELECT p.doc_id, p.i, CASE WHEN used > 0 AND used + n > 1500 THEN n ELSE used + n END AS full_, next + CASE WHEN used > 0 AND used + n > 1500 THEN 1 ELSE 0 END AS part FROM fold f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1))
SELECT doc_id, count(DISTINCT part)::INTEGER AS parents, string_agg(part, ',' ORDER BY i) AS members FROM fold GROUP BY doc_id""")
def parent_groups(spark, sf_dir):
    """Elements gathered into parents of about 1200 words, 1500 at most."""
    got = _sizes(spark, sf_dir).select("doc_id", chunking.parent_groups(F.col("sizes")).alias("m"))
    return got.select("doc_id", F.size(F.array_distinct("m")).alias("parents"), F.array_join(F.col("m").cast("array<string>"), ",").alias("members"))


@query("""SELECT conv_id, section, min(turn) AS first, max(turn) AS last, count(*) AS size, any_value(role) AS path FROM (
SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS section FROM (
SELECT *, (lag(turn) OVER w IS NULL OR role IS DISTINCT FROM lag(role) OVER w)::INTEGER AS opens FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))) GROUP BY conv_id, section""")
def sections(spark, sf_dir):
    """Runs of rows that share their heading."""
    return chunking.sections(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query(f"""WITH h AS (SELECT l_orderkey AS k, {_ID} AS i, l_quantity AS size, l_shipdate::DATE::VARCHAR AS t FROM lineitem)
SELECT a.k AS document, a.i::BIGINT AS i, string_agg(b.t, ' > ' ORDER BY b.i) AS path FROM h a JOIN h b ON a.k = b.k AND b.i <= a.i
WHERE b.i = a.i OR b.size > (SELECT max(c.size) FROM h c WHERE c.k = a.k AND c.i > b.i AND c.i <= a.i) GROUP BY a.k, a.i""")
def heading_path(spark, sf_dir):
    """The headings above each heading, by font size."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.expr(_ID).alias("i"), F.col("l_quantity").alias("size"), F.col("l_shipdate").cast("date").cast("string").alias("text")))).alias("h"))
    found = rows.select(F.col("l_orderkey").alias("document"), "h", chunking.heading_paths(F.col("h")).alias("p"))
    return found.select("document", F.explode(F.arrays_zip("h", "p")).alias("z")).select("document", F.col("z.h.i").alias("i"), F.array_join("z.p", " > ").alias("path"))


_BOXES = f"SELECT l_orderkey AS page, {_ID} AS box_id, (l_suppkey % 5) * 110.0 AS left, l_partkey % 700 * 1.0 AS top, (l_suppkey % 5) * 110.0 + 40 + l_quantity AS right, l_partkey % 700 + 8.0 + l_linenumber % 3 AS bottom FROM lineitem"


def _boxes(spark, sf_dir):
    left, top = (F.col("l_suppkey") % 5) * 110.0, (F.col("l_partkey") % 700).cast("double")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.expr(_ID).alias("box_id"), left.alias("left"), top.alias("top"), (left + 40 + F.col("l_quantity")).alias("right"), (top + 8.0 + F.col("l_linenumber") % 3).alias("bottom"))


@query(f"""SELECT page, box_id, sum(breaks) OVER (PARTITION BY page ORDER BY top, box_id)::BIGINT AS block FROM (
SELECT *, coalesce((top - end_ > 1.6 * greatest(least(h, above), 1.0) OR abs(h - above) > 0.15 * greatest(h, above))::INTEGER, 0) AS breaks FROM (
SELECT *, lag(h) OVER w AS above, lag(bottom) OVER w AS end_ FROM (SELECT *, (bottom - top)::DOUBLE AS h FROM ({_BOXES})) WINDOW w AS (PARTITION BY page ORDER BY top, box_id)))""")
def paragraph_blocks(spark, sf_dir):
    """Lines of a page gathered into paragraphs."""
    return layout.paragraph_blocks(_boxes(spark, sf_dir)).select("page", "box_id", "block")


@query(f"""SELECT page, box_id, sum(new) OVER (PARTITION BY page, row ORDER BY "left", box_id)::BIGINT AS line FROM (
SELECT *, coalesce(("left" - lag("right") OVER (PARTITION BY page, row ORDER BY "left", box_id) >= 24)::INTEGER, 0) AS new FROM (SELECT *, floor(top / 100) AS row FROM ({_BOXES})))""")
def text_lines(spark, sf_dir):
    """Rows of words parted at gutters."""
    return layout.row_lines(_boxes(spark, sf_dir).withColumn("row", F.floor(F.col("top") / 100))).select("page", "box_id", "line")


_GUTTERS = f"""SELECT page, start::DOUBLE AS start, stop::DOUBLE AS stop FROM (
SELECT page, "left" AS stop, max("right") OVER (PARTITION BY page ORDER BY "left", "right", box_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start, min("left") OVER (PARTITION BY page) AS a, max("right") OVER (PARTITION BY page) AS z
FROM (SELECT *, list_sort(list("right" - "left") OVER (PARTITION BY page))[count(*) OVER (PARTITION BY page) // 2 + 1] AS mid FROM ({_BOXES})) WHERE "right" - "left" <= 1.5 * mid)
WHERE stop - start >= 24 AND start - a >= 90 AND z - stop >= 90"""


@query(_GUTTERS)
def gutters(spark, sf_dir):
    """Empty vertical strips between columns."""
    return layout.gutters(_boxes(spark, sf_dir))


@query(f"""WITH b AS ({_BOXES}), g AS ({_GUTTERS}), m AS (
SELECT b.page, b.box_id, b.top, b."left", coalesce(bool_or(b."left" < g.start AND b."right" > g.stop), false)::INTEGER AS spans, count(*) FILTER (g.start <= b."left") AS col FROM b LEFT JOIN g ON b.page = g.page GROUP BY ALL)
SELECT page, box_id, (row_number() OVER (PARTITION BY page ORDER BY band, col, top, "left", box_id) - 1)::INTEGER AS place FROM (
SELECT page, box_id, top, "left", CASE WHEN spans = 1 THEN 0 ELSE col END AS col, 2 * sum(spans) OVER (PARTITION BY page ORDER BY top, "left", box_id) - spans AS band FROM m)""")
def reading_order(spark, sf_dir):
    """Boxes of a page in reading order."""
    boxes = _boxes(spark, sf_dir)
    return layout.reading_order(boxes, layout.gutters(boxes))


_LINES = "SELECT source AS document, doc_id AS page, unnest(string_split(text, chr(10))) AS text FROM documents"


@query(f"""WITH l AS ({_LINES}) SELECT document, text, n FROM (SELECT document, text, count(DISTINCT page) AS n FROM l GROUP BY ALL) JOIN (SELECT document, count(DISTINCT page) AS pages FROM l GROUP BY ALL) USING (document) WHERE n >= greatest(3, CASE WHEN 0.15 * pages - floor(0.15 * pages) = 0.5 THEN 2 * round(0.15 * pages / 2) ELSE round(0.15 * pages) END)""")
def running_headers(spark, sf_dir):
    """Lines that come back on many pages."""
    lines = table(spark, sf_dir, "documents").select(F.col("source").alias("document"), F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("text"))
    return layout.running_headers(lines)


_CELLS = r"list_transform(string_split(l, '|'), lambda c: trim(regexp_replace(c, '\s+', ' ', 'g')))"


@query(f"""SELECT doc_id, n::INTEGER AS line, '| ' || array_to_string(c, ' | ') || ' |' AS markdown, '<tr>' || array_to_string(list_transform(c, lambda x: '<td>' || replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td>'), '') || '</tr>' AS html, to_json(c)::VARCHAR AS json
FROM (SELECT doc_id, n, {_CELLS} AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents) WHERE contains(l, '|'))""")
def table_render(spark, sf_dir):
    """Rows of tables as Markdown, HTML and JSON."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l")).where(F.contains("l", F.lit("|")))
    cells = rows.select("doc_id", "line", G.cells(F.col("l")).alias("c"))
    return cells.select("doc_id", "line", G.markdown_row(F.col("c")).alias("markdown"), G.html_row(F.col("c")).alias("html"), F.to_json("c").alias("json"))


@query("""WITH r AS (SELECT user_id, event_id AS id, 1 + event_id % 5 AS category, event_id % 4 AS level, event_type AS subject, ts AS stated_at, event_id % 2 = 0 AS is_correction FROM events WHERE event_id % 5 > 0 OR event_type = 'login')
SELECT user_id, id, category, 'R' || row_number() OVER (PARTITION BY user_id ORDER BY category, id) AS label FROM (
SELECT *, bool_or(category = 1) OVER (PARTITION BY user_id, subject) AS guarded, row_number() OVER (PARTITION BY user_id, subject ORDER BY level DESC, stated_at DESC NULLS LAST, is_correction DESC, id DESC) AS n FROM r)
WHERE category = 1 OR (NOT guarded AND n = 1)""")
def instruction_resolution(spark, sf_dir):
    """Instructions without conflicts: security first, then the latest of the highest level."""
    e = table(spark, sf_dir, "events").where("event_id % 5 > 0 or event_type = 'login'")
    rows = e.select("user_id", F.col("event_id").alias("id"), (1 + F.col("event_id") % 5).alias("category"), (F.col("event_id") % 4).alias("level"), F.col("event_type").alias("subject"), F.col("ts").alias("stated_at"), (F.col("event_id") % 2 == 0).alias("is_correction"))
    return context.resolved_instructions(rows, "user_id").select("user_id", "id", "category", "label")


@query(r"""SELECT conv_id, turn, spent::BIGINT AS spent FROM (SELECT conv_id, turn, row_number() OVER w AS n, sum(c) OVER w AS spent FROM (SELECT conv_id, turn, len(regexp_extract_all(text, '\S+')) AS c FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) WHERE n <= 10 AND spent <= 120""")
def context_shed(spark, sf_dir):
    """The newest turns of each thread that fit a budget."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_count("text", F.lit(r"\S+")).alias("cost"))
    return context.newest_that_fit(turns, "conv_id", "turn", "cost", budget=120, most=10).select("conv_id", "turn", "spent")


@query("SELECT conv_id, turn, 'answer-' || substr(sha256(role || chr(31) || text), 1, 12) AS version FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL")
def prompt_version(spark, sf_dir):
    """Digests of prompts."""
    return table(spark, sf_dir, "conversations").where("role is not null and text is not null").select("conv_id", "turn", context.version(F.col("role"), F.col("text")).alias("version"))


@query("""SELECT event_id, CASE WHEN event_type = 'logout' THEN 'CANCELLED' WHEN value < 10 THEN 'FAILED' ELSE 'COMPLETED' END AS outcome FROM events""")
def turn_outcome(spark, sf_dir):
    """How turns ended."""
    return table(spark, sf_dir, "events").select("event_id", context.turn_outcome(F.col("event_type") == "logout", F.col("value") < 10).alias("outcome"))


@query(f"""WITH r AS (SELECT l_orderkey AS query_id, {_ID} AS rank, l_partkey AS chunk_id, CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey % 4 * 1000 END AS parent_id, l_returnflag = 'A' AS expand FROM lineitem)
SELECT query_id, rank, CASE WHEN p.p_partkey IS NOT NULL THEN p.p_partkey ELSE chunk_id END AS chunk_id, p.p_partkey IS NOT NULL AS expanded FROM (
SELECT *, bool_or(expand) OVER (PARTITION BY query_id, parent_id) AND row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) = 1 AS takes FROM r) LEFT JOIN part p ON p.p_partkey = parent_id AND takes""")
def parent_expand(spark, sf_dir):
    """Wanted parents in the place of their first items."""
    l = table(spark, sf_dir, "lineitem")
    ranked = l.select(F.col("l_orderkey").alias("query_id"), F.expr(_ID).alias("rank"), F.col("l_partkey").alias("chunk_id"), F.when(F.col("l_suppkey") % 4 > 0, F.col("l_suppkey") % 4 * 1000).alias("parent_id"), (F.col("l_returnflag") == "A").alias("expand"))
    return chunking.with_parents(ranked, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id")))


#: Pieces that occur most often in words: that many of three letters, at the start and inside.
_PIECES = """SELECT piece FROM (SELECT piece, row_number() OVER (PARTITION BY starts_with(piece, '##') ORDER BY n DESC, piece) AS k FROM (SELECT piece, count(*) AS n FROM (
SELECT CASE WHEN i = 1 THEN '' ELSE '##' END || substr(term, i, 3) AS piece FROM (SELECT term, unnest(range(1, length(term) - 1)) AS i FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents))) GROUP BY piece)) WHERE k <= 300
UNION ALL SELECT m || c FROM (SELECT unnest(['', '##']) AS m), (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxy0123456789', '')) AS c)"""


@query(f"""WITH RECURSIVE p AS MATERIALIZED ({_PIECES}), t AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
cut AS (SELECT DISTINCT term, 0 AS i, 0 AS n FROM t UNION ALL SELECT term, i + step, n + 1 FROM (
  SELECT term, i, n, max(length(piece) - 2 * starts_with(piece, '##')::INTEGER) AS step FROM cut JOIN p ON p.piece = CASE WHEN i = 0 THEN '' ELSE '##' END || substr(term, i + 1, 3) OR p.piece = CASE WHEN i = 0 THEN '' ELSE '##' END || substr(term, i + 1, 1) WHERE i < length(term) GROUP BY ALL)),
w AS (SELECT term, coalesce(max(n) FILTER (i = length(term)), 1) AS n FROM cut GROUP BY term)
SELECT d.doc_id, coalesce(sum(w.n), 0)::INTEGER AS n_tokens, coalesce(sum(w.n), 0) + 2 <= 512 AS fits FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN w USING (term) GROUP BY d.doc_id""")
def vocabulary_counts(spark, sf_dir):
    """Tokens of every document by a vocabulary of pieces, and whether they fit a model."""
    docs = table(spark, sf_dir, "documents")
    at = F.explode(F.sequence(F.lit(1), F.length("term") - 2))
    places = docs.select(F.explode(T.terms(F.col("text"))).alias("term")).where("length(term) > 2").select("term", at.alias("at"))
    pieces = places.select(F.concat(F.when(F.col("at") == 1, "").otherwise("##"), F.expr("substr(term, at, 3)")).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    best = pieces.withColumn("k", F.row_number().over(W.partitionBy(F.startswith("piece", F.lit("##"))).orderBy(F.desc("n"), "piece"))).where("k <= 300")
    vocabulary = [r.piece for r in best.select("piece").collect()] + [m + c for m in ("", "##") for c in "abcdefghijklmnopqrstuvwxy0123456789"]  # 670 at most
    n = tokens.counter(vocabulary)(T.terms(F.col("text")))
    return docs.select("doc_id", n.alias("n_tokens")).withColumn("fits", tokens.fits(F.col("n_tokens")))
