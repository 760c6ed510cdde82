"""Queries of chunk children, their data and numbers, and of the structure of tables; each with its SQL.

Lines of documents stand for elements: those with a bar for tables, every seventeenth for a formula, every fourth for a
list, the rest for paragraphs; thirty lines make a section, ten a page.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import tables as G
from lodestone.functions import text as T
from lodestone.operators import chunking
from lodestone.plans.evidence import _WORDS_OF
from lodestone.plans.passages import _SENTENCES, _quoted
from lodestone.plans.store import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def note(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, T.with_strip(sql)
        return f

    return note


_ELEMENTS = rf"""SELECT doc_id, i // 30 AS section, i::INTEGER AS i, trim(line) AS text, len({_WORDS_OF.format("line")})::INTEGER AS size, CASE WHEN contains(line, '|') THEN 'TABLE' WHEN i % 17 = 5 THEN 'FORMULA' WHEN i % 4 = 1 THEN 'LIST' ELSE 'PARAGRAPH' END AS element_type,
contains(line, '|') OR i % 17 = 5 AS standalone, (i // 10)::INTEGER AS page, (i % 7)::DOUBLE AS x0, i::DOUBLE AS y0, i % 7 + 10.0::DOUBLE AS x1, i + 1.0::DOUBLE AS y1
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) WHERE trim(line) <> ''"""


def _elements(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where("trim(line) <> ''")
    i, barred = F.col("i"), F.contains("line", F.lit("|"))
    kind = F.when(barred, "TABLE").when(i % 17 == 5, "FORMULA").when(i % 4 == 1, "LIST").otherwise("PARAGRAPH")
    return rows.select(
        "doc_id", F.floor(i / 30).alias("section"), "i", F.trim("line").alias("text"), F.size(T.words(F.col("line"))).alias("size"), kind.alias("element_type"), (barred | (i % 17 == 5)).alias("standalone"),
        F.floor(i / 10).cast("int").alias("page"), (i % 7).cast("double").alias("x0"), i.cast("double").alias("y0"), (i % 7 + 10).cast("double").alias("x1"), (i + 1).cast("double").alias("y1"),
    )


def _children_sql(target: int, overlap: int, elements: str = _ELEMENTS, before: str = "") -> str:
    """Runs of elements by the rule, one element a step: what is open, and what was closed."""
    return rf"""WITH RECURSIVE {before}e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY i) AS n, count(*) OVER (PARTITION BY doc_id, section) AS total, sum(size) OVER (PARTITION BY doc_id, section ORDER BY i) AS upto FROM ({elements})),
a AS MATERIALIZED (SELECT doc_id, section, list_prepend(0, list(upto ORDER BY n)) AS cum FROM e GROUP BY ALL),
s AS MATERIALIZED (SELECT e.doc_id, e.section, n, total, standalone, cum FROM e JOIN a USING (doc_id, section)),
fold AS (
SELECT doc_id, section, n, CASE WHEN standalone OR cum[2] >= {target} THEN 0 ELSE 1 END AS open, CASE WHEN standalone THEN [(1, 1, true)] WHEN cum[2] >= {target} THEN [(1, 1, false)] ELSE [] END AS out FROM s WHERE n = 1 UNION ALL
SELECT doc_id, section, n, CASE WHEN standalone THEN 0 WHEN NOT full_ THEN first WHEN n = first OR {overlap} <= 0 THEN 0 ELSE list_min(list_filter(range(first + 1, n + 1), lambda j: cum[n + 1] - cum[j] <= {overlap} OR j = n)) END,
  CASE WHEN standalone THEN list_concat(out, CASE WHEN open > 0 THEN [(open, n - 1, false)] ELSE [] END, [(n, n, true)]) WHEN full_ THEN list_append(out, (first, n, false)) ELSE out END
FROM (SELECT s.*, f.open, f.out, CASE WHEN f.open > 0 THEN f.open ELSE s.n END AS first, s.cum[s.n + 1] - s.cum[CASE WHEN f.open > 0 THEN f.open ELSE s.n END] >= {target} AS full_ FROM fold f JOIN s ON s.doc_id = f.doc_id AND s.section = f.section AND s.n = f.n + 1)),
last AS (SELECT f.doc_id, f.section, CASE WHEN open > 0 THEN list_append(out, (open, f.n, false)) ELSE out END AS out FROM fold f JOIN a USING (doc_id, section) WHERE f.n = len(cum) - 1),
runs AS MATERIALIZED (SELECT doc_id, section, unnest(out) AS r, generate_subscripts(out, 1) - 1 AS child FROM last),
chunks AS MATERIALIZED (SELECT r.doc_id, r.section, r.child::INTEGER AS child, any_value(r.r[3]) AS alone, min(e.i) AS first, max(e.i) AS last, string_agg(e.text, chr(10) || chr(10) ORDER BY e.n) AS text, greatest(1, sum(e.size))::INTEGER AS tokens, min(e.element_type) AS low, max(e.element_type) AS high,
  min(e.page) AS page_start, max(e.page) AS page_end, min(e.x0) AS x0, min(e.y0) AS y0, max(e.x1) AS x1, max(e.y1) AS y1 FROM runs r JOIN e ON e.doc_id = r.doc_id AND e.section = r.section AND e.n BETWEEN r.r[1] AND r.r[2] GROUP BY ALL)
"""


@query(_children_sql(40, 10) + "SELECT doc_id, section, child, first, last, CASE WHEN alone THEN low ELSE 'TEXT' END AS chunk_type, tokens, sha256(text) AS content_hash FROM chunks")
def child_chunks(spark, sf_dir):
    """Children of 40 words with an overlap of 10; tables and formulas stand alone."""
    found = chunking.chunk_rows(_elements(spark, sf_dir), ["doc_id", "section"], 40, 10)
    return found.select("doc_id", "section", "child", "first", "last", "chunk_type", "tokens", F.sha2("text", 256).alias("content_hash"))


@query(_children_sql(400, 70) + "SELECT doc_id, section, child, first, last, CASE WHEN alone THEN low ELSE 'TEXT' END AS chunk_type, tokens FROM chunks")
def child_chunks_default(spark, sf_dir):
    """The same at the usual 400 words and an overlap of 70."""
    return chunking.chunk_rows(_elements(spark, sf_dir), ["doc_id", "section"]).select("doc_id", "section", "child", "first", "last", "chunk_type", "tokens")


@query(_children_sql(40, 10) + "SELECT doc_id, section, child, CASE WHEN low = high THEN low END AS element_type, page_start, page_end, CASE WHEN page_start = page_end THEN x0 END AS x0, CASE WHEN page_start = page_end THEN y0 END AS y0, CASE WHEN page_start = page_end THEN x1 END AS x1, CASE WHEN page_start = page_end THEN y1 END AS y1, page_start <> page_end AS spans_pages FROM chunks")
def chunk_metadata(spark, sf_dir):
    """What the elements of each child agree on: type, pages, and one box where they are on one page."""
    found = chunking.chunk_rows(_elements(spark, sf_dir), ["doc_id", "section"], 40, 10)
    return found.select("doc_id", "section", "child", "element_type", "page_start", "page_end", "x0", "y0", "x1", "y1", (F.col("page_start") != F.col("page_end")).alias("spans_pages"))


@query(_children_sql(40, 10) + """SELECT doc_id, tier, section, child, (row_number() OVER (PARTITION BY doc_id, tier ORDER BY section, child) - 1)::INTEGER AS ordinal FROM (
SELECT doc_id, 'CHILD' AS tier, section, child FROM chunks UNION ALL SELECT DISTINCT doc_id, 'PARENT', section, 0 FROM chunks)""")
def chunk_ordinals(spark, sf_dir):
    """Parents and children of a document, each numbered by itself."""
    rows = chunking.chunk_rows(_elements(spark, sf_dir), ["doc_id", "section"], 40, 10).select("doc_id", F.lit("CHILD").alias("tier"), "section", "child")
    both = rows.unionByName(rows.select("doc_id", F.lit("PARENT").alias("tier"), "section", F.lit(0).alias("child")).distinct())
    return both.withColumn("ordinal", F.row_number().over(W.partitionBy("doc_id", "tier").orderBy("section", "child")) - 1)


_PACKED = rf"""fold AS (SELECT k, i, part, n AS used, 0 AS piece FROM p WHERE i = 1 UNION ALL
SELECT p.k, p.i, p.part, CASE WHEN used + n <= $most$ THEN used + n ELSE n END, piece + CASE WHEN used + n <= $most$ THEN 0 ELSE 1 END FROM fold f JOIN p ON p.k = f.k AND p.i = f.i + 1)"""


@query(rf"""WITH RECURSIVE p AS MATERIALIZED (SELECT doc_id AS k, i, part, len({_WORDS_OF.format("part")}) AS n FROM (SELECT doc_id, unnest({_SENTENCES}) AS part, generate_subscripts({_SENTENCES}, 1) AS i FROM documents)), {_PACKED.replace("$most$", "70")}
SELECT k AS doc_id, piece::INTEGER AS piece, sha256(string_agg(part, ' ' ORDER BY i)) AS digest, sum(len({_WORDS_OF.format("part")}))::INTEGER AS tokens FROM fold GROUP BY ALL""")
def flush_sentences(spark, sf_dir):
    """Prose that is too long for one child, in pieces of whole sentences of at most 70 words."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    found = rows.select("doc_id", F.posexplode(chunking.pieces(F.col("s"), F.transform("s", lambda x: F.size(T.words(x))), 70, " ")).alias("piece", "text"))
    return found.select("doc_id", "piece", F.sha2("text", 256).alias("digest"), F.size(T.words(F.col("text"))).alias("tokens"))


@query(rf"""WITH RECURSIVE l AS (SELECT doc_id, trim(line) AS part, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line) <> ''),
p AS MATERIALIZED (SELECT doc_id AS k, part, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, len({_WORDS_OF.format("part")}) AS n FROM l), {_PACKED.replace("$most$", "70")}
SELECT k AS doc_id, piece::INTEGER AS piece, sha256(CASE WHEN k % 2 = 0 AND piece > 0 THEN anchor || chr(10) ELSE '' END || body) AS digest FROM (SELECT k, piece, string_agg(part, chr(10) ORDER BY i) AS body FROM fold GROUP BY k, piece) JOIN (SELECT k, part AS anchor FROM p WHERE i = 1) USING (k)""")
def oversize_split(spark, sf_dir):
    """Tables (even ids) and formulas that are too long, by lines; a table's first line opens each of its pieces."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", lines.alias("l"))
    cut = lambda anchor: chunking.pieces(F.col("l"), F.transform("l", lambda x: F.size(T.words(x))), 70, "\n", anchor)
    found = rows.select("doc_id", F.posexplode(F.when(F.col("doc_id") % 2 == 0, cut(True)).otherwise(cut(False))).alias("piece", "text"))
    return found.select("doc_id", "piece", F.sha2("text", 256).alias("digest"))


#: Whole documents as elements of books of thirty, under headings that change every seventh and return.
_BOOKS = rf"""SELECT doc_id // 30 AS book, doc_id % 30 AS i, 'part ' || (doc_id % 30 // 7 % 3) AS path, strip(text) AS text, len({_WORDS_OF.format("text")})::INTEGER AS size, doc_id % 10 AS page, 0.0 AS x0, 0.0 AS y0, 1.0 AS x1, 1.0 AS y1,
CASE WHEN contains(text, '|') OR doc_id % 13 = 4 THEN 'TABLE' WHEN doc_id % 17 = 5 THEN 'FORMULA' WHEN doc_id % 4 = 1 THEN 'LIST' ELSE 'PARAGRAPH' END AS element_type FROM documents"""
_PARENTS = f"""books AS MATERIALIZED (SELECT *, element_type IN ('TABLE', 'FORMULA') AS standalone, sum(opens) OVER (PARTITION BY book ORDER BY i) - 1 AS s FROM (SELECT *, (lag(i) OVER w IS NULL OR path IS DISTINCT FROM lag(path) OVER w)::INTEGER AS opens FROM ({_BOOKS}) WINDOW w AS (PARTITION BY book ORDER BY i))),
full_ AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY book, s ORDER BY i) AS n FROM books WHERE text <> ''),
grown AS (SELECT book, s, n, CASE WHEN size >= 1200 THEN 0 ELSE size END AS used, 0 AS part, CASE WHEN size >= 1200 THEN 1 ELSE 0 END AS following FROM full_ WHERE n = 1 UNION ALL
SELECT book, s, n, CASE WHEN now >= 1200 THEN 0 ELSE now END, part, part + CASE WHEN now >= 1200 THEN 1 ELSE 0 END FROM (
SELECT f.book, f.s, f.n, CASE WHEN used > 0 AND used + size > 1500 THEN size ELSE used + size END AS now, following + CASE WHEN used > 0 AND used + size > 1500 THEN 1 ELSE 0 END AS part FROM grown g JOIN full_ f ON f.book = g.book AND f.s = g.s AND f.n = g.n + 1)),
parents AS MATERIALIZED (SELECT f.*, part FROM full_ f JOIN grown g USING (book, s, n)),
"""
_FAMILY = "SELECT book AS doc_id, s * 1000 + part AS section, i, text, size, element_type, standalone, page, x0, y0, x1, y1 FROM parents"


def _books(spark, sf_dir):
    d = F.col("doc_id")
    kind = F.when(F.contains("text", F.lit("|")) | (d % 13 == 4), "TABLE").when(d % 17 == 5, "FORMULA").when(d % 4 == 1, "LIST").otherwise("PARAGRAPH")
    rows = table(spark, sf_dir, "documents").select(
        F.floor(d / 30).alias("book"), (d % 30).alias("i"), F.concat(F.lit("part "), (F.floor(d % 30 / 7) % 3).cast("string")).alias("path"), T.strip(F.col("text")).alias("text"), F.size(T.words(F.col("text"))).alias("size"),
        (d % 10).alias("page"), kind.alias("element_type"), *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 1.0), ("y1", 1.0))],
    )
    return rows.withColumn("standalone", F.col("element_type").isin("TABLE", "FORMULA"))


@query(_children_sql(400, 70, _FAMILY, _PARENTS) + rf""", long AS MATERIALIZED (SELECT *, alone AND low = 'TABLE' AS tabled FROM chunks WHERE tokens > 700),
parts AS MATERIALIZED (SELECT doc_id, section, child, alone, tabled, part, row_number() OVER (PARTITION BY doc_id, section, child ORDER BY k) AS i, len({_WORDS_OF.format("part")}) AS n FROM (
  SELECT doc_id, section, child, alone, tabled, unnest(p) AS part, generate_subscripts(p, 1) AS k FROM (SELECT *, CASE WHEN alone THEN list_filter(list_transform(string_split_regex(text, '
|
|
'), lambda l: strip(l)), lambda l: l <> '') ELSE {_SENTENCES} END AS p FROM long))),
filled AS (SELECT doc_id, section, child, i, part, n AS used, 0 AS piece FROM parts WHERE i = 1 UNION ALL
  SELECT p.doc_id, p.section, p.child, p.i, p.part, CASE WHEN used + n <= 700 THEN used + n ELSE n END, piece + CASE WHEN used + n <= 700 THEN 0 ELSE 1 END FROM filled f JOIN parts p ON p.doc_id = f.doc_id AND p.section = f.section AND p.child = f.child AND p.i = f.i + 1),
cut AS (SELECT f.doc_id, f.section, f.child, f.piece, CASE WHEN any_value(p.tabled) AND f.piece > 0 THEN any_value(p.part) || chr(10) ELSE '' END || CASE WHEN any_value(p.alone) THEN string_agg(f.part, chr(10) ORDER BY f.i) ELSE string_agg(f.part, ' ' ORDER BY f.i) END AS text
  FROM filled f JOIN parts p ON p.doc_id = f.doc_id AND p.section = f.section AND p.child = f.child AND p.i = 1 GROUP BY f.doc_id, f.section, f.child, f.piece)
SELECT doc_id AS book, (section // 1000)::BIGINT AS section, (section % 1000)::INTEGER AS parent, child, coalesce(cut.piece, 0)::INTEGER AS piece, CASE WHEN alone THEN low ELSE 'TEXT' END AS chunk_type, greatest(1, len({_WORDS_OF.format("coalesce(cut.text, chunks.text)")}))::INTEGER AS tokens, sha256(coalesce(cut.text, chunks.text)) AS content_hash
FROM chunks LEFT JOIN cut USING (doc_id, section, child)""")
def chunk_families(spark, sf_dir):
    """Children of 400 words of every parent, in pieces where they pass 700, of whole books."""
    found = chunking.chunk_families(_books(spark, sf_dir), "book", "path")[1]
    return found.select("book", "section", "parent", "child", "piece", "chunk_type", "tokens", F.sha2("text", 256).alias("content_hash"))


@query(f"""WITH RECURSIVE {_PARENTS.rstrip().rstrip(",")} SELECT book, s::BIGINT AS section, part::INTEGER AS parent, min(i) AS first, max(i) AS last, greatest(1, sum(size))::INTEGER AS tokens, CASE WHEN min(element_type) = max(element_type) AND bool_and(standalone) THEN min(element_type) ELSE 'TEXT' END AS chunk_type,
sha256(string_agg(text, chr(10) || chr(10) ORDER BY i)) AS content_hash FROM parents GROUP BY ALL""")
def chunk_parents(spark, sf_dir):
    """The parents of the same books."""
    found = chunking.chunk_families(_books(spark, sf_dir), "book", "path")[0]
    return found.select("book", "section", "parent", "first", "last", "tokens", "chunk_type", F.sha2("text", 256).alias("content_hash"))


def _grids(spark, sf_dir):
    """Grids of eight parts each: with a header, without, with a row of units, with units in it, of words, with blank rows, all blank."""
    parts = table(spark, sf_dir, "part")
    text = lambda c: F.col(c).cast("string")
    rows = parts.select(F.floor(F.col("p_partkey") / 8).alias("g"), "p_partkey", F.array("p_name", text("p_size"), (F.round(F.col("p_retailprice") * 100)).cast("long").cast("string")).alias("n"), F.array("p_name", "p_type", "p_brand").alias("w"))
    groups = rows.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "n", "w"))).alias("r"))
    numbers, words = F.transform("r", lambda x: x["n"]), F.transform("r", lambda x: x["w"])
    line = lambda *cells: F.array(F.array(*[F.lit(c).cast("string") for c in cells]))
    v = F.col("g") % 6
    grid = (
        F.when(F.col("g") % 37 == 0, line(None, " ", ""))
        .when(v == 0, F.concat(line("Name", "Size (cm)", "Price\nin cents"), numbers))
        .when(v == 1, numbers)
        .when(v == 2, F.concat(line("Name", "Size", "Price [$]"), line("", "cm", "cents"), numbers))
        .when(v == 3, F.concat(line(" Name ", "Size [mm]", "(estimated)"), numbers, line("total", "9")))
        .when(v == 4, F.concat(line("Term", "Meaning | use", ""), words))
        .otherwise(F.concat(line(None, None, None), line("Name", None, "Price <net>"), line("", " ", ""), numbers, line("a & b", None, "")))
    )
    return groups.select("g", F.when(F.col("g") % 2 == 0, F.concat(F.lit("Table "), F.col("g").cast("string"))).alias("caption"), G.structure(grid).alias("t"))


_GRIDS = rf"""WITH base AS (SELECT p_partkey // 8 AS g, list([p_name, p_size::VARCHAR, round(p_retailprice * 100)::BIGINT::VARCHAR] ORDER BY p_partkey) AS n, list([p_name, p_type, p_brand] ORDER BY p_partkey) AS w FROM part GROUP BY ALL),
grid AS (SELECT g, CASE WHEN g % 37 = 0 THEN [[NULL, ' ', '']] WHEN g % 6 = 0 THEN list_concat([['Name', 'Size (cm)', 'Price' || chr(10) || 'in cents']], n) WHEN g % 6 = 1 THEN n WHEN g % 6 = 2 THEN list_concat([['Name', 'Size', 'Price [$]'], ['', 'cm', 'cents']], n)
  WHEN g % 6 = 3 THEN list_concat([[' Name ', 'Size [mm]', '(estimated)']], n, [['total', '9']]) WHEN g % 6 = 4 THEN list_concat([['Term', 'Meaning | use', '']], w) ELSE list_concat([[NULL, NULL, NULL], ['Name', NULL, 'Price <net>'], ['', ' ', '']], n, [['a & b', NULL, '']]) END AS grid FROM base),
rows_ AS (SELECT g, list_filter(list_transform(grid, lambda r: list_transform(r, lambda c: trim(regexp_replace(coalesce(c, ''), '\s+', ' ', 'g')))), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS r FROM grid),
square AS (SELECT g, w, len(list_filter(r, lambda x: len(x) <> w)) > 0 AS ragged, list_transform(r, lambda x: list_transform(range(1, w + 1), lambda i: coalesce(x[i], ''))) AS r FROM (SELECT *, list_max(list_transform(r, lambda x: len(x))) AS w FROM rows_ WHERE len(r) > 0)),
flag AS (SELECT *, list_transform(r, lambda x: len(list_filter(x, lambda c: c <> '' AND regexp_matches(c, {_quoted(G.NUMERIC)}))) > 0) AS data FROM square),
head AS (SELECT *, data[1] AS bare, CASE WHEN data[1] THEN list_transform(range(w), lambda i: '') ELSE r[1] END AS names, CASE WHEN data[1] THEN r ELSE r[2:] END AS body, CASE WHEN data[1] THEN data ELSE data[2:] END AS bodydata FROM flag),
unit AS (SELECT *, coalesce(NOT bare AND len(list_filter(body[1], lambda c: c <> '')) > 0 AND len(list_filter(body[1], lambda c: length(c) > 12)) = 0 AND NOT bodydata[1] AND list_contains(bodydata[2:], true), false) AS own, bare OR NOT list_contains(data[2:], true) AS assumed FROM head),
done AS (SELECT g, CASE WHEN g % 2 = 0 THEN 'Table ' || g END AS caption, ragged, assumed, CASE WHEN own THEN body[2:] ELSE body END AS rows_,
  list_transform(range(1, w + 1), lambda i: CASE WHEN names[i] = '' THEN 'Column ' || i WHEN strip(regexp_extract(names[i], {_quoted(G.TRAILING_UNIT)}, 1)) <> '' AND strip(regexp_extract(names[i], {_quoted(G.TRAILING_UNIT)}, 2)) <> '' THEN strip(regexp_extract(names[i], {_quoted(G.TRAILING_UNIT)}, 1)) ELSE names[i] END) AS headers,
  list_transform(range(1, w + 1), lambda i: coalesce(CASE WHEN own THEN nullif(body[1][i], '') END, CASE WHEN strip(regexp_extract(names[i], {_quoted(G.TRAILING_UNIT)}, 1)) <> '' THEN nullif(strip(regexp_extract(names[i], {_quoted(G.TRAILING_UNIT)}, 2)), '') END)) AS units FROM unit)"""


@query(_GRIDS + """SELECT g, array_to_string(headers, ';') AS headers, array_to_string(list_transform(units, lambda u: coalesce(u, '-')), ';') AS units, len(rows_)::INTEGER AS n_rows, ragged AS was_ragged, assumed AS header_assumed,
round(1 - CASE WHEN ragged THEN 0.3 ELSE 0 END - CASE WHEN assumed THEN 0.2 ELSE 0 END, 6)::DOUBLE AS confidence FROM done""")
def table_structure(spark, sf_dir):
    """Headers, units and rows of grids, and how far they are to be trusted."""
    t = F.col("t")
    return _grids(spark, sf_dir).where("t is not null").select(
        "g", F.array_join(t["headers"], ";").alias("headers"), F.array_join(t["units"], ";", "-").alias("units"), F.size(t["rows"]).alias("n_rows"), t["was_ragged"].alias("was_ragged"), t["header_assumed"].alias("header_assumed"), F.round(G.confidence(t), 6).alias("confidence"),
    )


_MD = r"'| ' || array_to_string(list_transform({}, lambda c: replace(replace(c, '|', '\|'), chr(10), ' ')), ' | ') || ' |'"
_PROSE = """strip(array_to_string(list_concat(CASE WHEN caption IS NULL THEN [] ELSE [caption] END, list_transform(list_filter(list_transform(rows_, lambda r: array_to_string(list_filter(list_transform(range(1, len(headers) + 1), lambda i: CASE WHEN strip(r[i]) = '' THEN NULL ELSE headers[i] || ' ' || strip(r[i]) || coalesce(' ' || units[i], '') END), lambda x: x IS NOT NULL), ', ')), lambda x: x <> ''), lambda x: x || '.')), chr(10)))"""


@query(
    _GRIDS
    + f"""SELECT g, {_PROSE} AS prose, coalesce(caption || chr(10) || chr(10), '') || array_to_string(list_concat([{_MD.format("list_transform(range(1, len(headers) + 1), lambda i: headers[i] || coalesce(' (' || units[i] || ')', ''))")}, '| ' || array_to_string(list_transform(headers, lambda h: '---'), ' | ') || ' |'], list_transform(rows_, lambda r: {_MD.format("r")})), chr(10)) AS markdown FROM done"""
)
def table_render_prose(spark, sf_dir):
    """Tables in prose, for embedding, and in Markdown."""
    t = F.col("t")
    return _grids(spark, sf_dir).where("t is not null").select("g", G.prose(t, F.col("caption")).alias("prose"), G.markdown(t, F.col("caption")).alias("markdown"))


@query(_GRIDS + f"""SELECT p_partkey, CASE WHEN d.g IS NOT NULL AND p_partkey % 8 = 0 THEN sha256({_PROSE}) ELSE sha256(p_name) END AS digest FROM part p LEFT JOIN done d ON d.g = p_partkey // 8""")
def table_prose_replaced(spark, sf_dir):
    """Elements with the text of their table, rendered, in place of their own; others as they are."""
    rendered = _grids(spark, sf_dir).where("t is not null").select((F.col("g") * 8).alias("p_partkey"), G.prose(F.col("t"), F.col("caption")).alias("prose"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name").join(rendered, "p_partkey", "left")
    return rows.select("p_partkey", F.sha2(F.coalesce("prose", "p_name"), 256).alias("digest"))
