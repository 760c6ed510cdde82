"""What is shuffled: texts and ids, and not what is many times as large."""

import os

import pytest

from lodestone.plans import passages, state

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def below_join(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan[plan.index("Join") :]


def test_shingles_are_cut_after_texts_met(spark):
    assert "sequence(" not in below_join(passages.QUERIES["shingle_containment"](spark, FOLDER))


def test_lists_of_facts_carry_no_texts(spark):
    assert "text#" not in below_join(state.QUERIES["memory_retrieval"](spark, FOLDER))


def test_ranked_lists_carry_no_texts(spark):
    from lodestone.plans import flagship

    for rows in (flagship.ranked_passages(spark, FOLDER), flagship.chosen_passages(spark, FOLDER)):
        assert not {"text", "parent_text"} & set(rows.columns) and rows.count() > 0


def test_weights_travel_to_the_texts(spark):
    """Texts meet a pool's rows last, so that they aren't dealt out by question once these weights are too many to broadcast."""
    from lodestone.plans import flagship

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = flagship.QUERIES["memory_recall"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "doc_id" in joins[0] and "query_id" not in joins[0].split("Join")[1]


def test_texts_are_compared_by_what_they_share(spark):
    """Lists without texts are pruned as lists with them; of a text, only what another one has too travels to the lists."""
    import random

    from pyspark.sql import functions as F

    from lodestone.operators import evidence

    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(80)) for _ in range(12)]
    texts += [" ".join(t.split()[:k]) for t, k in zip(texts, (79, 70, 40, 8))] + ["", "one two", "x | y\nz | y", "x | y\nz | y\nu | v"]
    rows = [(q, "DIRECT", r, c, f"hash{c}", None, c, 0, "TABLE" if "|" in texts[c] else "TEXT", texts[c]) for q in range(8) for r, c in enumerate(rng.sample(range(len(texts)), 12))]
    ranked = spark.createDataFrame(rows, "query_id long, query_class string, rank int, chunk_id long, content_hash string, parent_id long, document_id long, page long, chunk_type string, text string")
    items = evidence.shared_items(ranked.select(F.col("chunk_id").alias("content"), "text", (F.col("chunk_type") == "TABLE").alias("table")).distinct())
    given = ranked.drop("text").join(items.withColumnRenamed("content", "chunk_id"), "chunk_id", "left")
    found = [sorted(tuple(r) for r in evidence.prune(x, per_document=9, per_page=9).collect()) for x in (ranked, given)]
    assert found[0] == found[1] and 0 < len(found[0]) < len(rows)
    held = {r.content: len(r.shingles) for r in items.collect()}
    assert held[0] == 75 and 4 not in held and sum(held.values()) < 2 * (75 + 66 + 36 + 4 + 10)


def test_terms_of_a_passage_are_found_once(spark):
    """However many questions have a passage in their pool, its text is read below the step that makes a row for each."""
    from lodestone.operators import evidence

    pool = spark.createDataFrame([(q, c, q) for q in range(5) for c in range(3)], "query_id long, chunk_id long, rank int")
    weights = spark.createDataFrame([(q, [("a", 1.0), (f"t{q}", 3.0)]) for q in range(5)], "query_id long, weights array<struct<term:string,idf:double>>")
    found = evidence.scored_pool(pool, weights, spark.createDataFrame([(0, "A b"), (1, "t1 a"), (2, None)], "chunk_id long, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.index("Generate") < plan.index("regexp_extract_all")
    scores = {(r.query_id, r.chunk_id): r.score for r in found.collect()}
    assert scores == {(q, c): [0.25, 1.0 if q == 1 else 0.25, 0.0][c] for q in range(5) for c in range(3)}
