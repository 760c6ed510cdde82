"""Column functions over rows of tables: cells and their renderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import strip


def cells(line: Column, mark: str = "|") -> Column:
    """Cells of a line, trimmed, with white space made single."""
    return F.transform(F.split(line, f"[{mark}]"), lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))


def markdown_row(row: Column) -> Column:
    """A row in Markdown; bars inside cells are escaped and line ends become spaces."""
    safe = F.transform(row, lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    return F.concat(F.lit("| "), F.array_join(safe, " | "), F.lit(" |"))


def html_row(row: Column) -> Column:
    """A row in HTML, escaped."""
    safe = F.transform(row, lambda c: F.concat(F.lit("<td>"), F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</td>")))
    return F.concat(F.lit("<tr>"), F.array_join(safe, ""), F.lit("</tr>"))


# What a number and a unit behind a name look like in a cell, and how long a unit is at most.
NUMERIC = r"^(?:\s*(?:[<>~≈±]|\+/-)?\s*[-+]?\d{1,3}(?:,\d{3})*(?:\.\d+)?|\s*[-+]?\d*\.?\d+)"
TRAILING_UNIT = r"^(.*?)\s*[(\[]([^)\]]{1,12})[)\]]\s*$"
UNIT_LENGTH = 12


def is_numeric(cell: Column) -> Column:
    return (cell != "") & cell.rlike(NUMERIC)


def _holds_numbers(row: Column) -> Column:
    return F.exists(row, is_numeric)


def structure(grid: Column) -> Column:
    """headers, units, rows, was_ragged, header_assumed of a grid of cells; null where every cell is blank.

    A first row with a number is data, and columns are numbered. Else it names the columns; the next row holds units if
    its cells are short, none is a number and numbers follow. A unit in brackets behind a name is taken from it.
    """

    def with_(value: Column, f) -> Column:  # binds a value to a name, so that it is worked out once
        return F.get(F.transform(F.array(value), f), F.lit(0))

    def resolve(rows: Column) -> Column:
        width = F.array_max(F.transform(rows, F.size))
        ragged = F.exists(rows, lambda r: F.size(r) != width)
        square = F.transform(rows, lambda r: F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.get(r, i), F.lit(""))))
        return with_(F.struct(square.alias("rows"), width.alias("width"), ragged.alias("ragged")), headed)

    def headed(t: Column) -> Column:
        first, rest = F.get(t["rows"], F.lit(0)), F.slice(t["rows"], 2, F.size(t["rows"]))
        bare = _holds_numbers(first)
        names = F.when(bare, F.array_repeat(F.lit(""), t["width"])).otherwise(first)
        return with_(F.struct(names.alias("names"), F.when(bare, t["rows"]).otherwise(rest).alias("body"), (bare | ~F.exists(rest, _holds_numbers)).alias("assumed"), bare.alias("bare"), t["ragged"].alias("ragged")), measured)

    def measured(t: Column) -> Column:
        next_, below = F.get(t["body"], F.lit(0)), F.slice(t["body"], 2, F.size(t["body"]))
        filled = F.filter(next_, lambda c: c != "")
        set_out = ~t["bare"] & (F.size(filled) > 0) & ~F.exists(filled, lambda c: F.length(c) > UNIT_LENGTH) & ~_holds_numbers(filled) & F.exists(below, _holds_numbers)
        own = F.coalesce(set_out, F.lit(False))

        def column(name: Column, i: Column) -> Column:
            inner, unit = strip(F.regexp_extract(name, TRAILING_UNIT, 1)), strip(F.regexp_extract(name, TRAILING_UNIT, 2))
            split = (inner != "") & (unit != "")
            named = F.when(split, inner).otherwise(name)
            written = F.when(own, F.nullif(F.get(next_, i), F.lit("")))
            return F.struct(F.when(named == "", F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(named).alias("name"), F.coalesce(written, F.when(split, unit)).alias("unit"))

        columns = F.transform(t["names"], column)
        return F.struct(F.transform(columns, lambda c: c["name"]).alias("headers"), F.transform(columns, lambda c: c["unit"]).alias("units"), F.when(own, below).otherwise(t["body"]).alias("rows"), t["ragged"].alias("was_ragged"), t["assumed"].alias("header_assumed"))

    cleaned = F.transform(grid, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))
    populated = F.filter(cleaned, lambda r: F.exists(r, lambda c: c != ""))
    return with_(populated, lambda rows: F.when(F.size(rows) > 0, resolve(rows)))


def confidence(table: Column) -> Column:
    """How far a table is to be trusted: less where rows were ragged or the header was assumed."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.when(table["was_ragged"], 0.3).otherwise(0.0) - F.when(table["header_assumed"], 0.2).otherwise(0.0))


def labelled(table: Column) -> Column:
    """Headers with their units in brackets."""
    return F.transform(F.arrays_zip(table["headers"].alias("h"), table["units"].alias("u")), lambda x: F.when(x["u"].isNull(), x["h"]).otherwise(F.concat(x["h"], F.lit(" ("), x["u"], F.lit(")"))))


def markdown(table: Column, caption: Column) -> Column:
    """A table in Markdown, its caption above."""
    rule = F.concat(F.lit("| "), F.array_join(F.transform(table["headers"], lambda h: F.lit("---")), " | "), F.lit(" |"))
    body = F.array_join(F.concat(F.array(markdown_row(labelled(table)), rule), F.transform(table["rows"], markdown_row)), "\n")
    return F.when(caption.isNull(), body).otherwise(F.concat(caption, F.lit("\n\n"), body))


def prose(table: Column, caption: Column) -> Column:
    """A table in prose: a line for each row that names its columns; empty cells are left out."""

    def line(row: Column) -> Column:
        cell = lambda x: F.concat_ws(" ", x["h"], strip(x["c"]), x["u"])
        zipped = F.arrays_zip(table["headers"].alias("h"), row.alias("c"), table["units"].alias("u"))
        return F.array_join(F.transform(F.filter(zipped, lambda x: strip(x["c"]) != ""), cell), ", ")

    lines = F.transform(F.filter(F.transform(table["rows"], line), lambda x: x != ""), lambda x: F.concat(x, F.lit(".")))
    return strip(F.array_join(F.concat(F.array_compact(F.array(strip(caption))), lines), "\n"))
