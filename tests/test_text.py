from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import retrieval as R


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_classes_in_order(spark):
    for q, expected in [("Define entropy", "EXACT_TERM"), ("Compare A and B", "COMPARISON"), ("hello", "DIRECT"), ("quiz me", "QUIZ_GENERATION")]:
        assert one(spark, T.query_class(F.col("q")), q=q) == expected


def test_shingles_and_containment(spark):
    assert one(spark, T.shingles(T.words(F.col("t")), 2), t="a b c a b") == ["a b", "b c", "c a"]
    assert one(spark, T.shingles(T.words(F.col("t")), 5), t="a b") == ["a b"]
    assert one(spark, T.shingles(T.words(F.col("t")), 5), t="") == []


def test_fusion_adds_zero_based_ranks(spark):
    lists = spark.createDataFrame([(1, 0, "DENSE", 7, 0), (1, 1, "KEYWORD", 7, 0), (1, 0, "DENSE", 8, 1)], "query_id long, list_idx int, retriever string, doc_id long, rank int")
    rows = R.fuse(lists).orderBy("rank").collect()
    assert rows[0].doc_id == 7 and abs(rows[0].score - 2 / 60) < 1e-8 and rows[0].retrievers == ["DENSE", "KEYWORD"]


def test_opening_reason(spark):
    assert one(spark, T.opening_reason(F.col("t")), t="This shows it.") == "OPENS_WITH_A_REFERENCE"
    assert one(spark, T.opening_reason(F.col("t")), t="and so on") == "OPENS_MID_EXPLANATION"
    assert one(spark, T.opening_reason(F.col("t")), t="Entropy grows.") is None
