"""Reading order and layout of boxes on pages (page, box_id, left, top, right, bottom), by windows over each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import strip
from lodestone.operators.chunking import spread


def paragraph_blocks(lines: DataFrame, gap: float = 1.6, change: float = 0.15) -> DataFrame:
    """Adds block: a new one where the gap or the change of height to the line above is too large."""
    along = W.partitionBy("page").orderBy("top", "box_id")
    height = F.col("bottom") - F.col("top")
    above, end = F.lag(height).over(along), F.lag("bottom").over(along)
    breaks = (F.col("top") - end > gap * F.greatest(F.least(height, above), F.lit(1.0))) | (F.abs(height - above) > change * F.greatest(height, above))
    return lines.withColumn("_new", F.coalesce(breaks.cast("int"), F.lit(0))).withColumn("block", F.sum("_new").over(along)).drop("_new")


def row_lines(words: DataFrame, gutter: float = 24.0) -> DataFrame:
    """Adds line: words of a row (page, row) parted where the gap to the word before is a gutter or more."""
    along = W.partitionBy("page", "row").orderBy("left", "box_id")
    new = F.coalesce((F.col("left") - F.lag("right").over(along) >= gutter).cast("int"), F.lit(0))
    return words.withColumn("_new", new).withColumn("line", F.sum("_new").over(along)).drop("_new")


def upper_median(value: Column) -> Column:
    """Of a page's values in order, the one at half their number, counted from 0."""
    held = F.array_sort(F.collect_list(value))
    return F.get(held, F.floor(F.size(held) / 2).cast("int"))


def gutters(boxes: DataFrame, gap: float = 24.0, column: float = 90.0, wide: float = 1.5) -> DataFrame:
    """page, start, stop of the vertical strips that no box of usual width touches, with columns on both sides."""
    width = F.col("right") - F.col("left")
    middle = boxes.groupBy("page").agg(upper_median(width).alias("_median"))
    usual = boxes.join(middle, "page").where(width <= wide * F.col("_median"))
    along = W.partitionBy("page").orderBy("left", "right", "box_id")
    reach = F.max("right").over(along.rowsBetween(W.unboundedPreceding, -1))
    whole = W.partitionBy("page")
    swept = usual.select("page", F.col("left").alias("stop"), reach.alias("start"), F.min("left").over(whole).alias("_min"), F.max("right").over(whole).alias("_max"))
    return swept.where((F.col("stop") - F.col("start") >= gap) & (F.col("start") - F.col("_min") >= column) & (F.col("_max") - F.col("stop") >= column)).select("page", "start", "stop")


def reading_order(boxes: DataFrame, strips: DataFrame) -> DataFrame:
    """page, box_id, place: bands between boxes that span a gutter, in them by column; pages without gutters by top."""
    held = boxes.join(strips.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_strips")), "page", "left")
    held = held.withColumn("_strips", F.coalesce("_strips", F.array().cast("array<struct<start:double,stop:double>>")))
    spans = F.exists("_strips", lambda s: (F.col("left") < s["start"]) & (F.col("right") > s["stop"]))
    column = F.size(F.filter("_strips", lambda s: s["start"] <= F.col("left")))
    along = W.partitionBy("page").orderBy("top", "left", "box_id")
    marked = held.select("page", "box_id", "top", "left", F.when(spans, 0).otherwise(column).alias("_column"), spans.cast("int").alias("_spans"))
    # a spanning box is a band of its own: it closes the one above and the next box opens another
    band = marked.withColumn("_band", 2 * F.sum("_spans").over(along) - F.col("_spans"))
    return band.select("page", "box_id", (F.row_number().over(W.partitionBy("page").orderBy("_band", "_column", "top", "left", "box_id")) - 1).alias("place"))


# Page numbers beside a running header.
PAGE_NUMBER = r"^[0-9]+\s*[|—–]\s*|\s*[|—–]\s*[0-9]+$"


def running_headers(lines: DataFrame, pages: int = 3, share: float = 0.15) -> DataFrame:
    """document, text, n of lines (document, page, text) found on enough pages: a least number, and a share rounded half to even."""
    totals = lines.groupBy("document").agg(F.countDistinct("page").alias("_pages"))
    found = lines.groupBy("document", "text").agg(F.countDistinct("page").alias("n"))
    return found.join(totals, "document").where(F.col("n") >= F.greatest(F.lit(pages), F.bround(share * F.col("_pages")))).select("document", "text", "n")


def _in_margin(lines: DataFrame, margin: float) -> DataFrame:
    return lines.withColumns({"_bare": strip(F.regexp_replace("text", PAGE_NUMBER, "")), "_high": F.col("top") < margin})


#: Elements that a running header can be taken for.
RUNNING = ["HEADING", "PARAGRAPH"]


def margin_headers(lines: DataFrame, pages: DataFrame, margin: float = 80.0, least: int = 3, share: float = 0.15) -> DataFrame:
    """Running headers of lines (document, page, text, top, element_type): headings and paragraphs in the top margin, page numbers aside.

    pages (document, page) are all there are, also those without lines: the share is of them.
    """
    total = pages.groupBy("document").agg(F.countDistinct("page").alias("_pages"))
    high = _in_margin(lines, margin).where(F.col("_high") & (F.col("_bare") != "") & F.col("element_type").isin(RUNNING))
    found = high.groupBy("document", F.col("_bare").alias("text")).agg(F.countDistinct("page").alias("n"))
    return found.join(total, "document").where(F.col("n") >= F.greatest(F.lit(least), F.bround(share * F.col("_pages")))).select("document", "text", "n")


def without_headers(lines: DataFrame, headers: DataFrame, margin: float = 80.0) -> DataFrame:
    """The lines but for headings and paragraphs in the top margin that are running headers; captions and lists stay."""
    marked = _in_margin(lines, margin)
    known = headers.select(F.col("document").alias("_document"), F.col("text").alias("_text"))
    match = (F.col("document") == F.col("_document")) & (F.col("_bare") == F.col("_text")) & F.col("_high") & F.col("element_type").isin(RUNNING)
    return marked.join(known, match, "left_anti").drop("_bare", "_high")


def word_rows(words: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Adds row: words by top and left, a new row where one's top leaves the first word's by half its height."""
    lists = words.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("top", "left", "box_id", F.greatest(F.col("bottom") - F.col("top"), F.lit(1.0)).alias("height")))).alias("w"))
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(0.0).alias("height"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, w: Column) -> Column:
        new = s["top"].isNull() | (F.abs(w["top"] - s["top"]) > tolerance * s["height"])
        kept = lambda a, b: F.when(new, a).otherwise(b)
        return F.struct(kept(w["top"], s["top"]).alias("top"), kept(w["height"], s["height"]).alias("height"), (s["i"] + 1).alias("i"), kept(F.concat(s["starts"], F.array(s["i"])), s["starts"]).alias("starts"))

    rows = lists.select("page", "w", spread(F.aggregate("w", start, step, lambda s: s["starts"]), F.size("w")).alias("r"))
    return rows.select("page", F.explode(F.arrays_zip("w", "r")).alias("z")).select("page", F.col("z.w.box_id").alias("box_id"), F.col("z.r").alias("row"))


#: Heights of a page are cut into strips of so many points; what may meet shares one.
STRIP = 100.0


def _strips(low: Column, high: Column) -> Column:
    """A row for each strip that an interval touches."""
    of = lambda x: F.floor(x / STRIP).cast("long")
    return F.explode(F.sequence(of(low), F.greatest(of(high), of(low))))


def nearest_captions(elements: DataFrame, reach: float = 3.0) -> DataFrame:
    """Tables and figures with the nearest caption that names their kind, no farther than ``reach`` of its heights, or null.

    elements: page, box_id, element_type, text, y0, y1 (from the bottom), names (the kind a caption names). A caption with
    its reach and an object meet where they touch the same strip of the page; meeting twice does no harm to the nearest.
    """
    captions = elements.where("element_type = 'CAPTION'").select("page", F.col("names").alias("element_type"), F.struct(F.col("y0").alias("a"), F.col("y1").alias("b"), F.col("box_id").alias("id"), F.col("text").alias("text")).alias("c"))
    far = reach * (F.col("c.b") - F.col("c.a"))
    captions = captions.where(far >= 0).withColumn("strip", _strips(F.col("c.a") - far, F.col("c.b") + far))
    objects = elements.where("element_type in ('TABLE', 'FIGURE')").select("page", "box_id", "element_type", "y0", "y1")
    gap = F.greatest(F.col("y0") - F.col("c.b"), F.col("c.a") - F.col("y1"), F.lit(0.0))
    near = objects.withColumn("strip", _strips(F.col("y0"), F.col("y1"))).join(captions, ["page", "element_type", "strip"]).withColumn("gap", gap).where(F.col("gap") <= reach * (F.col("c.b") - F.col("c.a")))
    best = near.groupBy("page", "box_id").agg(F.min_by("c.text", F.struct("gap", -F.col("c.b"), F.col("c.id"))).alias("caption"))
    return objects.join(best, ["page", "box_id"], "left")


def outside(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Lines whose middle is in none of their page's regions (page, x0, y0, x1, y1): of these, only those in the middle's strip are looked at."""
    x, y = (F.col("left") + F.col("right")) / 2, (F.col("top") + F.col("bottom")) / 2
    held = regions.where("y0 <= y1").select(F.col("page").alias("_page"), "x0", "y0", "x1", "y1", _strips(F.col("y0"), F.col("y1")).alias("_strip"))
    return lines.join(held, (F.col("page") == F.col("_page")) & (F.floor(y / STRIP).cast("long") == F.col("_strip")) & x.between(F.col("x0"), F.col("x1")) & y.between(F.col("y0"), F.col("y1")), "left_anti")


def measures(boxes: DataFrame, area: float) -> DataFrame:
    """page, cover (at most 1), bold (by majority), body_size (upper median of heights)."""
    height = F.col("bottom") - F.col("top")
    return boxes.groupBy("page").agg(
        F.round(F.least(F.sum((F.col("right") - F.col("left")) * height) / area, F.lit(1.0)), 6).alias("cover"),
        (F.sum(F.col("bold").cast("int")) * 2 > F.count("*")).alias("bold"), upper_median(height).alias("body_size"),
    )


def readable(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Elements of pages that are neither scanned nor complex."""
    return elements.join(pages.where("kind not in ('SCANNED', 'COMPLEX')").select("page"), "page", "left_semi")


def flipped(left: Column, right: Column, top: Column, bottom: Column, height: Column) -> Column:
    """A box from the page's bottom, or null without area."""
    box = F.struct(left.alias("x0"), (height - bottom).alias("y0"), right.alias("x1"), (height - top).alias("y1"))
    return F.when((right > left) & (bottom > top), box)


def crop(box: Column, width: Column, height: Column, dpi: int) -> Column:
    """Pixels l, t, r, b of a box (from the bottom, in points) on a rendered page, kept inside it."""
    scale = dpi / 72
    pixel = lambda c: (c * scale).cast("int")
    return F.struct(
        F.greatest(F.lit(0), pixel(box["x0"])).alias("l"), F.greatest(F.lit(0), pixel(height - box["y1"])).alias("t"),
        F.least(pixel(width), pixel(box["x1"])).alias("r"), F.least(pixel(height), pixel(height - box["y0"])).alias("b"),
    )


def box_pairs(boxes: DataFrame, reach: int, margin: float) -> DataFrame:
    """page, i, j of boxes whose ids are less than ``reach`` apart: intersects, the box around both, and the first's left edge with a margin."""
    a = boxes.select("page", F.col("box_id").alias("i"), F.struct("left", "right", "top", "bottom").alias("a"))
    b = boxes.select("page", F.col("box_id").alias("j"), F.struct("left", "right", "top", "bottom").alias("b"))
    met = a.join(b, "page").where((F.col("i") < F.col("j")) & (F.col("j") - F.col("i") < reach))
    meets = (F.col("a.left") < F.col("b.right")) & (F.col("b.left") < F.col("a.right")) & (F.col("a.top") < F.col("b.bottom")) & (F.col("b.top") < F.col("a.bottom"))
    return met.select(
        "page", "i", "j", meets.alias("intersects"), F.least("a.left", "b.left").alias("x0"), F.least("a.top", "b.top").alias("y0"), F.greatest("a.right", "b.right").alias("x1"),
        F.greatest("a.bottom", "b.bottom").alias("y1"), F.greatest(F.col("a.left") - margin, F.lit(0.0)).alias("expanded"),
    )
