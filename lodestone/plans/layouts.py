"""Queries of page layout beyond reading order: rows, regions, captions, running headers, covers; each with its SQL.

An order stands for a page, its lines for boxes of the page (as in ingestion), customers for documents.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import layout
from lodestone.plans.ingestion import _BOXES, _boxes
from lodestone.plans.passages import _quoted
from lodestone.plans.store import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def note(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, T.with_strip(sql)
        return f

    return note


@query(f"""WITH RECURSIVE w AS MATERIALIZED (SELECT page, box_id, top::DOUBLE AS top, bottom::DOUBLE AS bottom, row_number() OVER (PARTITION BY page ORDER BY top, "left", box_id) AS n FROM ({_BOXES})),
fold AS (SELECT page, box_id, n, top AS first, greatest(bottom - top, 1) AS h, 0 AS row FROM w WHERE n = 1 UNION ALL
SELECT w.page, w.box_id, w.n, CASE WHEN abs(w.top - f.first) > 0.5 * f.h THEN w.top ELSE f.first END, CASE WHEN abs(w.top - f.first) > 0.5 * f.h THEN greatest(w.bottom - w.top, 1) ELSE f.h END, f.row + CASE WHEN abs(w.top - f.first) > 0.5 * f.h THEN 1 ELSE 0 END FROM fold f JOIN w ON w.page = f.page AND w.n = f.n + 1)
SELECT page, box_id, row::INTEGER AS row FROM fold""")
def rows_from_words(spark, sf_dir):
    """Words gathered into rows: a new one where a word leaves the height of the row's first word."""
    return layout.word_rows(_boxes(spark, sf_dir)).select("page", "box_id", "row")


_CAPTIONED = """SELECT page, box_id, top, bottom, box_id // 10000 % 5 AS kind, 'Table ' || (box_id % 9) AS text FROM boxes"""
_MARKS = ["Table 3: ", "Fig. 2b ", "figure A.1 - ", "Chart 4-2 ", "Scheme 12.3.1 ", "Table of contents ", "Plate 7x9 ", ""]
_LABELLED = f"""SELECT page, box_id, 800 - bottom::DOUBLE AS y0, 800 - top::DOUBLE AS y1, ['TABLE', 'FIGURE', 'CAPTION', 'CAPTION', 'CAPTION'][box_id // 10000 % 5 + 1] AS element_type,
[{", ".join(map(_quoted, _MARKS))}][box_id % {len(_MARKS)} + 1] || 'of ' || box_id AS text FROM ({_BOXES})"""
_KIND_SQL = f"""CASE lower(regexp_extract(text, {_quoted(T.CAPTION_SQL)}, 1)) WHEN 'fig' THEN 'FIGURE' WHEN 'figure' THEN 'FIGURE' WHEN 'plate' THEN 'FIGURE' WHEN 'exhibit' THEN 'FIGURE' WHEN 'table' THEN 'TABLE' WHEN 'tbl' THEN 'TABLE' WHEN 'chart' THEN 'CHART' WHEN 'diagram' THEN 'DIAGRAM' WHEN 'scheme' THEN 'DIAGRAM' END"""


def _labelled(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    b = F.col("box_id")
    kind = F.get(F.array(*[F.lit(x) for x in ["TABLE", "FIGURE", "CAPTION", "CAPTION", "CAPTION"]]), (F.floor(b / 10000) % 5).cast("int"))
    mark = F.get(F.array(*[F.lit(x) for x in _MARKS]), (b % len(_MARKS)).cast("int"))
    return boxes.select("page", "box_id", (800 - F.col("bottom")).alias("y0"), (800 - F.col("top")).alias("y1"), kind.alias("element_type"), F.concat(mark, F.lit("of "), b.cast("string")).alias("text"))


@query(f"""SELECT page, box_id, {_KIND_SQL} AS kind, CASE WHEN {_KIND_SQL} IS NOT NULL THEN trim(regexp_extract(text, {_quoted(T.CAPTION_SQL)}, 2), '. ') END AS number FROM ({_LABELLED})""")
def caption_labels(spark, sf_dir):
    """What captions name, and the number they give it."""
    text = F.col("text")
    return _labelled(spark, sf_dir).select("page", "box_id", T.caption_kind(text).alias("kind"), T.caption_number(text).alias("number"))


@query(f"""WITH b AS MATERIALIZED ({_LABELLED}), c AS (SELECT *, {_KIND_SQL} AS names FROM b WHERE element_type = 'CAPTION')
SELECT page, box_id, element_type, caption FROM (SELECT e.page, e.box_id, e.element_type, c.text AS caption, row_number() OVER (PARTITION BY e.page, e.box_id ORDER BY c.box_id IS NULL, greatest(e.y0 - c.y1, c.y0 - e.y1, 0), c.y1 DESC, c.box_id) AS n
FROM b e LEFT JOIN c ON c.page = e.page AND c.names = e.element_type AND greatest(e.y0 - c.y1, c.y0 - e.y1, 0) <= 3 * (c.y1 - c.y0) WHERE e.element_type IN ('TABLE', 'FIGURE')) WHERE n = 1""")
def caption_nearest(spark, sf_dir):
    """The nearest caption of a table's or figure's own kind within three heights of it."""
    return layout.nearest_captions(_labelled(spark, sf_dir).withColumn("names", T.caption_kind(F.col("text")))).select("page", "box_id", "element_type", "caption")


@query(f"""WITH b AS MATERIALIZED ({_BOXES}) SELECT page, box_id FROM b l WHERE box_id % 3 > 0 AND NOT EXISTS (SELECT 1 FROM b r WHERE r.page = l.page AND r.box_id % 3 = 0 AND (l."left" + l."right") / 2 BETWEEN r."left" AND r."right" AND (l.top + l.bottom) / 2 BETWEEN r.top - 40 AND r.bottom + 40)""")
def region_anti(spark, sf_dir):
    """Lines whose middle is in no region of a table."""
    boxes = _boxes(spark, sf_dir)
    regions = boxes.where("box_id % 3 = 0").select("page", F.col("left").alias("x0"), F.col("right").alias("x1"), (F.col("top") - 40).alias("y0"), (F.col("bottom") + 40).alias("y1"))
    return layout.outside(boxes.where("box_id % 3 > 0"), regions).select("page", "box_id")


@query(f"""SELECT page, round(least(sum(("right" - "left") * (bottom - top)) / 40000, 1), 6)::DOUBLE AS cover, sum((box_id % 2 = 0)::INTEGER) * 2 > count(*) AS bold, list_sort(list((bottom - top)::DOUBLE))[count(*) // 2 + 1] AS body_size FROM ({_BOXES}) GROUP BY page""")
def page_measures(spark, sf_dir):
    """How much of a page its boxes cover, whether most are bold, and the upper median of their heights."""
    boxes = _boxes(spark, sf_dir).withColumn("bold", F.col("box_id") % 2 == 0)
    return layout.measures(boxes, area=40000.0)


_MARGIN = r"""SELECT source AS document, doc_id AS page, pos, line, strip(regexp_replace(CASE WHEN pos = 0 THEN CASE doc_id % 3 WHEN 0 THEN 'Chapter ' || doc_id % 2 || ' | ' || doc_id WHEN 1 THEN doc_id || ' — Chapter ' || doc_id % 2 ELSE line END ELSE line END, '^\d+\s*[|—–]\s*|\s*[|—–]\s*\d+$', '', 'g')) AS text, pos * 30.0 AS top, ['PARAGRAPH', 'HEADING', 'PARAGRAPH', 'CAPTION', 'HEADING', 'LIST'][(doc_id // 2 + pos) % 6 + 1] AS element_type FROM (
SELECT source, doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents))"""
_HEADERS = f"""SELECT document, text, n FROM (SELECT document, text, count(DISTINCT page) AS n FROM ({_MARGIN}) WHERE top < 80 AND text <> '' AND element_type IN ('HEADING', 'PARAGRAPH') GROUP BY ALL) JOIN (SELECT source AS document, count(DISTINCT doc_id) AS pages FROM documents GROUP BY ALL) USING (document)
WHERE n >= greatest(3, CASE WHEN 0.15 * pages - floor(0.15 * pages) = 0.5 THEN 2 * round(0.15 * pages / 2) ELSE round(0.15 * pages) END)"""


def _margin(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("document"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    chapter, number = F.concat(F.lit("Chapter "), (F.col("page") % 2).cast("string")), F.col("page").cast("string")
    head = F.when(F.col("page") % 3 == 0, F.concat(chapter, F.lit(" | "), number)).when(F.col("page") % 3 == 1, F.concat(number, F.lit(" — "), chapter)).otherwise(F.col("line"))
    kinds = F.array(*[F.lit(x) for x in ("PARAGRAPH", "HEADING", "PARAGRAPH", "CAPTION", "HEADING", "LIST")])
    return rows.select("document", "page", "pos", F.when(F.col("pos") == 0, head).otherwise(F.col("line")).alias("text"), (F.col("pos") * 30.0).alias("top"), F.get(kinds, ((F.floor(F.col("page") / 2) + F.col("pos")) % 6).cast("int")).alias("element_type"))


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("document"), F.col("doc_id").alias("page"))


@query(_HEADERS)
def margin_headers(spark, sf_dir):
    """Headings and paragraphs in the top margin, page numbers aside, that come back on three pages and 15 percent of all, rounded half to even."""
    return layout.margin_headers(_margin(spark, sf_dir), _pages(spark, sf_dir))


@query(f"""WITH m AS MATERIALIZED ({_MARGIN}), h AS ({_HEADERS}) SELECT page, pos::INTEGER AS pos FROM m WHERE NOT (top < 80 AND element_type IN ('HEADING', 'PARAGRAPH') AND EXISTS (SELECT 1 FROM h WHERE h.document = m.document AND h.text = m.text))""")
def header_suppression(spark, sf_dir):
    """Lines without running headers; places keep their gaps."""
    rows = _margin(spark, sf_dir)
    return layout.without_headers(rows, layout.margin_headers(rows, _pages(spark, sf_dir))).select("page", "pos")


_PAGE_KIND = """CASE WHEN o_orderkey % 11 = 0 THEN 'COMPLEX' WHEN o_orderkey % 11 IN (1, 2) THEN 'SCANNED' ELSE 'NATIVE_TEXT' END"""


@query(f"""SELECT o_orderkey AS page, {_PAGE_KIND} AS kind, count(l_orderkey) FILTER ({_PAGE_KIND} = 'NATIVE_TEXT') AS elements FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def page_kind_gate(spark, sf_dir):
    """Every page with its elements; scanned and complex pages keep their row and have none."""
    k = F.col("o_orderkey") % 11
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.when(k == 0, "COMPLEX").when(k.isin(1, 2), "SCANNED").otherwise("NATIVE_TEXT").alias("kind"))
    elements = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.lit(1).alias("element"))
    kept = layout.readable(elements, pages).groupBy("page").agg(F.count("*").alias("elements"))
    return pages.join(kept, "page", "left").select("page", "kind", F.coalesce("elements", F.lit(0).cast("long")).alias("elements"))


_SHAPES = f"""SELECT page, box_id, "left"::DOUBLE AS "left", "right"::DOUBLE AS "right", top::DOUBLE AS top, CASE WHEN box_id % 13 = 0 THEN top - 1 ELSE bottom END::DOUBLE AS bottom, 612.0::DOUBLE AS width, (600 + page % 3 * 100)::DOUBLE AS height FROM ({_BOXES})"""


def _shapes(spark, sf_dir):
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.lit(612.0).alias("width"), (600 + F.col("o_orderkey") % 3 * 100).cast("double").alias("height"))
    boxes = _boxes(spark, sf_dir).withColumn("bottom", F.when(F.col("box_id") % 13 == 0, F.col("top") - 1).otherwise(F.col("bottom")))
    return boxes.join(pages, "page")  # every figure meets its page's measures


@query(f"""SELECT page, box_id, CASE WHEN ok THEN "left" END AS x0, CASE WHEN ok THEN height - bottom END AS y0, CASE WHEN ok THEN "right" END AS x1, CASE WHEN ok THEN height - top END AS y1, 'figures/' || page || '/' || box_id || '.png' AS crop_key FROM (SELECT *, "right" > "left" AND bottom > top AS ok FROM ({_SHAPES}))""")
def bbox_flip(spark, sf_dir):
    """Boxes measured from the bottom of their page, null where they have no area, and where their crop is kept."""
    box = layout.flipped(F.col("left"), F.col("right"), F.col("top"), F.col("bottom"), F.col("height"))
    key = F.concat(F.lit("figures/"), F.col("page").cast("string"), F.lit("/"), F.col("box_id").cast("string"), F.lit(".png"))
    return _shapes(spark, sf_dir).select("page", "box_id", box.alias("b"), key.alias("crop_key")).select("page", "box_id", "b.x0", "b.y0", "b.x1", "b.y1", "crop_key")


@query(f"""SELECT page, box_id, l, t, r, b, r <= l OR b <= t AS degenerate FROM (SELECT page, box_id, greatest(0, trunc("left" * s)::INTEGER) AS l, greatest(0, trunc(top * s)::INTEGER) AS t, least(trunc(width * s)::INTEGER, trunc("right" * s)::INTEGER) AS r, least(trunc(height * s)::INTEGER, trunc(bottom * s)::INTEGER) AS b FROM (SELECT *, 144.0::DOUBLE / 72 AS s FROM ({_SHAPES})))""")
def crop_geometry(spark, sf_dir):
    """Pixels of a crop at 144 dots an inch, kept inside the page; whether nothing is left."""
    d = _shapes(spark, sf_dir)
    box = F.struct(F.col("left").alias("x0"), (F.col("height") - F.col("bottom")).alias("y0"), F.col("right").alias("x1"), (F.col("height") - F.col("top")).alias("y1"))
    return d.select("page", "box_id", layout.crop(box, F.col("width"), F.col("height"), 144).alias("c")).select("page", "box_id", "c.l", "c.t", "c.r", "c.b", ((F.col("c.r") <= F.col("c.l")) | (F.col("c.b") <= F.col("c.t"))).alias("degenerate"))


@query(f"""SELECT a.page, a.box_id AS i, b.box_id AS j, a."left" < b."right" AND b."left" < a."right" AND a.top < b.bottom AND b.top < a.bottom AS intersects, least(a."left", b."left")::DOUBLE AS x0, least(a.top, b.top)::DOUBLE AS y0, greatest(a."right", b."right")::DOUBLE AS x1, greatest(a.bottom, b.bottom)::DOUBLE AS y1, greatest(a."left" - 5, 0)::DOUBLE AS expanded
FROM ({_BOXES}) a JOIN ({_BOXES}) b ON a.page = b.page AND a.box_id < b.box_id WHERE b.box_id - a.box_id < 1000000000""")
def bbox_operations(spark, sf_dir):
    """Pairs of boxes of one line of a page: whether they meet, the box around both, and the first with five points more to its left."""
    a = _boxes(spark, sf_dir)
    return layout.box_pairs(a, reach=1000000000, margin=5.0)
