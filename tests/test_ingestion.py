from pyspark.sql import functions as F

from lodestone.functions import tables
from lodestone.operators import chunking, context, layout


def test_folds(spark):
    row = spark.createDataFrame([([3, 4, 9, 1, 1],)], "s array<int>")
    got = row.select(chunking.packed(F.col("s"), 7).alias("p"), chunking.parent_groups(F.col("s"), 7, 9).alias("g")).first()
    assert got.p == [0, 0, 1, 2, 2] and got.g == [0, 0, 1, 2, 2]
    assert row.select(chunking.packed(F.array().cast("array<int>"), 7).alias("p")).first().p == []


def test_heading_paths(spark):
    row = spark.createDataFrame([([(20.0, "A"), (14.0, "B"), (14.0, "C"), (20.0, "D")],)], "h array<struct<size:double,text:string>>")
    assert row.select(chunking.heading_paths(F.col("h")).alias("p")).first().p == [["A"], ["A", "B"], ["A", "C"], ["D"]]


def test_two_columns_are_read_one_after_the_other(spark):
    boxes = [(1, 1, 0.0, 0.0, 400.0, 10.0), *[(1, 2 + 2 * i, 0.0, 20.0 + 20 * i, 150.0, 30.0 + 20 * i) for i in range(3)], *[(1, 3 + 2 * i, 250.0, 20.0 + 20 * i, 400.0, 30.0 + 20 * i) for i in range(3)]]
    page = spark.createDataFrame(boxes, "page int, box_id int, left double, top double, right double, bottom double")
    strips = layout.gutters(page)
    assert [tuple(r) for r in strips.collect()] == [(1, 150.0, 250.0)]
    assert [r.box_id for r in layout.reading_order(page, strips).orderBy("place").collect()] == [1, 2, 4, 6, 3, 5, 7]


def test_security_claims_its_subject(spark):
    rows = spark.createDataFrame([("k", 1, 1, 0, "x", None, False), ("k", 2, 3, 9, "x", None, False), ("k", 3, 3, 1, "y", None, False), ("k", 4, 3, 2, "y", None, False)], "key string, id int, category int, level int, subject string, stated_at timestamp, is_correction boolean")
    assert {r.id: r.label for r in context.resolved_instructions(rows, "key").collect()} == {1: "R1", 4: "R2"}


def test_cells_are_escaped(spark):
    row = spark.createDataFrame([("a <b> |  c  d",)], "l string")
    got = row.select(tables.markdown_row(tables.cells(F.col("l"))).alias("m"), tables.html_row(tables.cells(F.col("l"))).alias("h")).first()
    assert got.m == "| a <b> | c d |" and got.h == "<tr><td>a &lt;b&gt;</td><td>c d</td></tr>"
