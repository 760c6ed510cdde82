"""Accuracy of the trained queries on rows they don't learn from."""

from pyspark.sql import functions as F

from lodestone.llm import queries

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_rows(spark):
    found = queries.op9_language_id(spark, SF).where("held_out and lang_pred != 'und'")
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").where("lang is not null")
    right = found.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95, right


def test_toxicity_of_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").where("toxic is not null")
    rows = queries.op3_toxicity(spark, SF).where("held_out").join(labels, "doc_id").toPandas()
    toxic, plain = rows[rows["toxic"] == 1]["score"], rows[rows["toxic"] == 0]["score"]
    area = sum((a > b) + 0.5 * (a == b) for a in toxic for b in plain) / (len(toxic) * len(plain))
    assert area >= 0.9, (area, len(toxic), len(plain))
