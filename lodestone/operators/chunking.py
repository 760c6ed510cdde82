"""From elements to chunks: sections, parent groups, greedy packing, heading paths. Folds run inside one row's array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T


def sections(elements: DataFrame, key: str, order: str, path: str) -> DataFrame:
    """key, section, first, last, size of each run of elements with an equal heading path."""
    along = W.partitionBy(key).orderBy(order)
    opens = (~F.col(path).eqNullSafe(F.lag(path).over(along)) | F.lag(order).over(along).isNull()).cast("int")
    marked = elements.select(key, order, path, opens.alias("_opens")).withColumn("section", F.sum("_opens").over(along))
    return marked.groupBy(key, "section").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("size"), F.first(path).alias("path"))


def spread(starts: Column, n: Column) -> Column:
    """The number of its run for each of n elements, from the runs' first places."""
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(n))
    runs = F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x, k: F.array_repeat(k, x["b"] - x["a"])))
    return F.when(F.size(starts) > 0, runs).otherwise(F.array().cast("array<int>"))


def packed_starts(sizes: Column, most: int) -> Column:
    """Where chunks open when parts are filled greedily up to ``most``; a larger part stands alone.

    The fold keeps the places where chunks open, so it copies an array once for each chunk, not for each part.
    """
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def step(state: Column, size: Column) -> Column:
        fits = (state["i"] > 0) & (state["used"] + size <= most)
        opened = F.when(fits, state["starts"]).otherwise(F.concat(state["starts"], F.array(state["i"])))
        return F.struct(F.when(fits, state["used"] + size).otherwise(size).alias("used"), (state["i"] + 1).alias("i"), opened.alias("starts"))

    return F.aggregate(F.transform(sizes, lambda x: x.cast("int")), start, step, lambda state: state["starts"])


def packed(sizes: Column, most: int) -> Column:
    """The chunk number of every part when parts are filled greedily up to ``most``; a larger part stands alone."""
    return spread(packed_starts(sizes, most), F.size(sizes))


def sliced(items: Column, starts: Column) -> Column:
    """The stretches of an array that begin at rising places, each up to the next."""

    def of(z: Column) -> Column:
        ends = F.concat(F.slice(z["starts"], 2, F.greatest(F.size(z["starts"]) - 1, F.lit(0))), F.array(F.size(z["items"])))
        return F.transform(F.arrays_zip(z["starts"].alias("a"), ends.alias("b")), lambda x: F.slice(z["items"], x["a"] + 1, x["b"] - x["a"]))

    return F.get(F.transform(F.array(F.struct(items.alias("items"), starts.alias("starts"))), of), F.lit(0))


def parent_starts(sizes: Column, target: int = 1200, most: int = 1500) -> Column:
    """Where groups of elements open: closed before one that would pass ``most``, and after reaching ``target``."""
    start = F.struct(F.lit(target).alias("used"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def step(state: Column, size: Column) -> Column:
        opens = (state["used"] >= target) | (state["used"] + size > most)
        opened = F.when(opens, F.concat(state["starts"], F.array(state["i"]))).otherwise(state["starts"])
        return F.struct(F.when(opens, size).otherwise(state["used"] + size).alias("used"), (state["i"] + 1).alias("i"), opened.alias("starts"))

    return F.aggregate(F.transform(sizes, lambda x: x.cast("int")), start, step, lambda state: state["starts"])


def parent_groups(sizes: Column, target: int = 1200, most: int = 1500) -> Column:
    """The group number of every element."""
    return spread(parent_starts(sizes, target, most), F.size(sizes))


def children(sizes: Column, standalone: Column, target: int = 400, overlap: int = 70) -> Column:
    """first, last, alone of the children of a parent group, from its elements' sizes and whether they stand alone.

    A standing element first closes what has gathered. Prose gathers until it reaches ``target``; the next child begins
    with the last elements that fit ``overlap``, with one at least, but never with all of the child before, and what is carried over is a
    child of its own if nothing follows.
    """
    upto = F.aggregate(sizes, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x.cast("int"))))
    kind = "array<struct<first:int,last:int,alone:boolean>>"
    none = F.array().cast(kind)

    def run(first: Column, last: Column, alone: bool) -> Column:
        return F.array(F.struct(first.alias("first"), last.alias("last"), F.lit(alone).alias("alone"))).cast(kind)

    def of(cum: Column) -> Column:
        begin = F.struct(F.lit(-1).alias("open"), none.alias("out"))

        def step(state: Column, i: Column) -> Column:
            first = F.when(state["open"] < 0, i).otherwise(state["open"])
            full = F.get(cum, i + 1) - F.get(cum, first) >= target
            kept = F.array_min(F.filter(F.sequence(first + 1, i), lambda j: (F.get(cum, i + 1) - F.get(cum, j) <= overlap) | (j == i)))
            carried = F.when((i > first) & F.lit(overlap > 0), kept).otherwise(F.lit(-1))
            before = F.when(state["open"] < 0, none).otherwise(run(state["open"], i - 1, False))
            prose = F.struct(F.when(full, carried).otherwise(first).alias("open"), F.when(full, F.concat(state["out"], run(first, i, False))).otherwise(state["out"]).alias("out"))
            return F.when(F.get(standalone, i), F.struct(F.lit(-1).alias("open"), F.concat(state["out"], before, run(i, i, True)).alias("out"))).otherwise(prose)

        n = F.size(sizes)
        end = lambda s: F.when(s["open"] < 0, s["out"]).otherwise(F.concat(s["out"], run(s["open"], n - 1, False)))
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), begin, step, end)).otherwise(none)

    return F.get(F.transform(F.array(upto), of), F.lit(0))


_ITEM = ["i", "text", "size", "element_type", "standalone", "page", "x0", "y0", "x1", "y1"]


def _parts(text: Column, alone: Column, kind: Column, most: int) -> Column:
    """The pieces of a child's text that is longer than ``most``: whole sentences of prose, lines of what stands alone.

    A table's first line opens each of its pieces. A sentence or a line that is too long by itself stays whole.
    """

    def of(parts: Column, mark: str, anchor: bool = False) -> Column:
        bound = lambda p: pieces(p, F.transform(p, lambda x: F.size(T.words(x))), most, mark, anchor)
        return F.get(F.transform(F.array(parts), bound), F.lit(0))

    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: T.strip(x)), lambda x: x != "")
    return F.when(~alone, of(T.sentences(text), " ")).when(kind == "TABLE", of(lines, "\n", True)).otherwise(of(lines, "\n"))


def chunk_rows(elements: DataFrame, keys: list[str], target: int = 400, overlap: int = 70, most: int | None = None) -> DataFrame:
    """One row for each child of each parent group, with what its elements agree on.

    elements: the group's keys, i (place), text, size, element_type, standalone, page, x0, y0, x1, y1. A child's box joins
    its elements' where they are on one page; its type is theirs where they have one. With ``most``, a child that is
    longer is given out in pieces, numbered from 0.
    """
    groups = elements.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*_ITEM))).alias("e"))
    return _children_of(groups, keys, target, overlap, most)


def _children_of(groups: DataFrame, keys: list[str], target: int, overlap: int, most: int | None) -> DataFrame:
    runs = children(F.transform("e", lambda x: x["size"]), F.transform("e", lambda x: x["standalone"]), target, overlap)
    each = groups.select(*keys, "e", F.posexplode(runs).alias("child", "run")).withColumn("m", F.slice("e", F.col("run.first") + 1, F.col("run.last") - F.col("run.first") + 1))
    of = lambda c: F.transform("m", lambda x: x[c])
    pages, kinds = F.array_distinct(of("page")), F.array_distinct(of("element_type"))
    box = lambda how, c: F.when(F.size(pages) == 1, how(of(c)))
    rows = each.select(
        *keys, "child", F.get(of("i"), F.lit(0)).alias("first"), F.element_at(of("i"), -1).alias("last"), F.array_join(of("text"), "\n\n").alias("text"),
        F.aggregate(of("size"), F.lit(0), lambda s, x: s + x.cast("int")).alias("tokens"), F.col("run.alone").alias("alone"),
        F.when(F.col("run.alone"), F.get(of("element_type"), F.lit(0))).otherwise("TEXT").alias("chunk_type"), F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).alias("element_type"),
        F.array_min(of("page")).alias("page_start"), F.array_max(of("page")).alias("page_end"),
        box(F.array_min, "x0").alias("x0"), box(F.array_min, "y0").alias("y0"), box(F.array_max, "x1").alias("x1"), box(F.array_max, "y1").alias("y1"),
    )
    if most is not None:
        parts = F.when(F.col("tokens") <= most, F.array("text")).otherwise(_parts(F.col("text"), F.col("alone"), F.col("chunk_type"), most))
        others = [c for c in rows.columns if c not in ("text", "tokens")]
        rows = rows.select(*others, F.posexplode(parts).alias("piece", "text")).withColumn("tokens", F.size(T.words(F.col("text"))))
    return rows.withColumn("tokens", F.greatest(F.lit(1), "tokens")).drop("alone")


def chunk_families(elements: DataFrame, document: str, path: str, parent_target: int = 1200, parent_most: int = 1500, target: int = 400, most: int = 700, overlap: int = 70) -> tuple[DataFrame, DataFrame]:
    """Parents and their children, from a document's elements in reading order.

    elements: document, i (place), path (headings above it), text, size, element_type, standalone, page and box. Runs of
    elements under one path are sections; blank elements end none and are left out. A section is cut into parents of about
    ``parent_target``, each parent into children of about ``target``, which share ``overlap`` with the one before; what is
    longer than ``most`` by itself is split at sentences or lines. Children have document, section, parent and child, and
    piece where they were split; parents have their text, tokens and kind.
    """
    along = W.partitionBy(document).orderBy("i")
    opens = (~F.col(path).eqNullSafe(F.lag(path).over(along)) | F.lag("i").over(along).isNull()).cast("int")
    rows = elements.withColumn("_opens", opens).withColumn("section", F.sum("_opens").over(along) - 1)
    full = rows.where(T.strip(F.col("text")) != "")
    held = full.groupBy(document, "section").agg(F.sort_array(F.collect_list(F.struct(*_ITEM))).alias("all"))
    starts = parent_starts(F.transform("all", lambda x: x["size"]), parent_target, parent_most)
    groups = held.select(document, "section", F.posexplode(sliced(F.col("all"), starts)).alias("parent", "e"))
    kinds, alone = F.array_distinct(F.transform("e", lambda x: x["element_type"])), F.forall("e", lambda x: x["standalone"])
    parents = groups.select(
        document, "section", "parent", F.array_join(F.transform("e", lambda x: x["text"]), "\n\n").alias("text"), F.greatest(F.lit(1), F.aggregate("e", F.lit(0), lambda s, x: s + x["size"].cast("int"))).alias("tokens"),
        F.when((F.size(kinds) == 1) & alone, F.get(kinds, F.lit(0))).otherwise("TEXT").alias("chunk_type"), F.get("e", F.lit(0))["i"].alias("first"), F.element_at("e", -1)["i"].alias("last"),
    )
    return parents, _children_of(groups, [document, "section", "parent"], target, overlap, most)


def pieces(parts: Column, sizes: Column, most: int, mark: str, anchor: bool = False) -> Column:
    """Parts filled greedily into texts of at most ``most``; with ``anchor``, the first part opens every text behind the first."""

    def texts(z: Column) -> Column:
        found = F.transform(sliced(z["parts"], packed_starts(z["sizes"], most)), lambda x: F.array_join(x, mark))
        return F.transform(found, lambda t, k: F.when(k > 0, F.concat(F.get(z["parts"], F.lit(0)), F.lit(mark), t)).otherwise(t)) if anchor else found

    found = F.get(F.transform(F.array(F.struct(parts.alias("parts"), sizes.alias("sizes"))), texts), F.lit(0))
    return F.when(F.size(parts) > 0, found).otherwise(F.array().cast("array<string>"))


def heading_paths(headings: Column) -> Column:
    """Paths of headings (structs of size and text, in order): larger headings stay above, equal and smaller ones go."""
    kind = "array<struct<size:double,text:string>>"
    start = F.struct(F.array().cast(kind).alias("stack"), F.array().cast("array<array<string>>").alias("out"))

    def step(state: Column, h: Column) -> Column:
        own = F.array(F.struct(h["size"].cast("double").alias("size"), h["text"].alias("text")))
        # sizes fall along the stack, so dropping all that aren't larger is the same as popping
        stack = F.concat(F.filter(state["stack"], lambda x: x["size"] > h["size"]), own).cast(kind)
        return F.struct(stack.alias("stack"), F.concat(state["out"], F.array(F.transform(stack, lambda x: x["text"]))).alias("out"))

    return F.aggregate(headings, start, step, lambda state: state["out"])


def with_parents(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked items (query_id, rank, chunk_id, parent_id, expand): a wanted parent takes its first item's place.

    A parent is wanted if any item that needs expansion names it; a parent that isn't there leaves the item as it is.
    """
    wanted = F.max(F.col("expand").cast("int")).over(W.partitionBy("query_id", "parent_id")) == 1
    first = F.row_number().over(W.partitionBy("query_id", "parent_id").orderBy("rank")) == 1
    marked = ranked.withColumn("_parent", F.when(F.col("parent_id").isNotNull() & wanted & first, F.col("parent_id")))
    there = chunks.select(F.col("chunk_id").alias("_parent"), F.lit(True).alias("_there"))
    return marked.join(there, "_parent", "left").select("query_id", "rank", F.when(F.col("_there"), F.col("_parent")).otherwise(F.col("chunk_id")).alias("chunk_id"), F.coalesce("_there", F.lit(False)).alias("expanded"))
