"""Small cases of the rules that depend on order, by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import tables as G
from lodestone.functions import text as T
from lodestone.operators import answers as A
from lodestone.operators import chunking, evidence, keywords, retrieval, state
from lodestone.operators.statistics import exact_percentiles
from lodestone.operators.timing import Stopwatch


def structure(spark, grid):
    found = spark.createDataFrame([(grid,)], "g array<array<string>>").select(G.structure(F.col("g")).alias("t")).first().t
    return found and (found.headers, found.units, found["rows"], found.was_ragged, found.header_assumed)


def test_table_structure(spark):
    assert structure(spark, [["Town", "Visitors"], ["Lund", "4,100"], ["Graz", "512"]]) == (["Town", "Visitors"], [None, None], [["Lund", "4,100"], ["Graz", "512"]], False, False)
    assert structure(spark, [["18", "0.4"], ["19", "0.6"]]) == (["Column 1", "Column 2"], [None, None], [["18", "0.4"], ["19", "0.6"]], False, True)
    assert structure(spark, [["Town", "Rain"], ["", "mm"], ["Lund", "61"]]) == (["Town", "Rain"], [None, "mm"], [["Lund", "61"]], False, False)
    assert structure(spark, [["", None], ["\n", None]]) is None
    assert structure(spark, [["Depth (fathoms)", "(at low tide)"], ["7"]]) == (["Depth", "(at low tide)"], ["fathoms", None], [["7", ""]], True, False)


def runs(spark, sizes, alone=None, **how):
    rows = spark.createDataFrame([(sizes, alone or [False] * len(sizes))], "s array<int>, a array<boolean>")
    return [tuple(r) for r in rows.select(chunking.children(F.col("s"), F.col("a"), **how).alias("r")).first().r]


def test_children_carry_over(spark):
    assert runs(spark, [10, 10, 10], target=20, overlap=5) == [(0, 1, False), (1, 2, False), (2, 2, False)]  # the last element is carried though it is larger than the overlap
    assert runs(spark, [25], target=20, overlap=5) == [(0, 0, False)]
    assert runs(spark, [5, 5, 5], target=15, overlap=100) == [(0, 2, False), (1, 2, False)]  # never all of it
    assert runs(spark, [5, 9, 5], [False, True, False], target=20, overlap=5) == [(0, 0, False), (1, 1, True), (2, 2, False)]
    assert runs(spark, [], target=20, overlap=5) == []


def test_greedy_packing(spark):
    pack = lambda sizes, most: spark.createDataFrame([(sizes,)], "s array<int>").select(chunking.packed(F.col("s"), most).alias("p")).first().p
    assert pack([3, 3, 3, 9, 1], 6) == [0, 0, 1, 2, 3] and pack([], 6) == [] and pack([7], 6) == [0]
    group = lambda sizes: spark.createDataFrame([(sizes,)], "s array<int>").select(chunking.parent_groups(F.col("s"), 12, 15).alias("p")).first().p
    assert group([5, 5, 6, 12, 1]) == [0, 0, 1, 2, 3] and group([13, 1]) == [0, 1]


RANKED = "query_id long, query_class string, rank int, chunk_id long, content_hash string, parent_id long, document_id long, page int, chunk_type string, text string"


def kept(spark, *passages, query_class="DIRECT", **how):
    rows = [(1, query_class, i, *p) for i, p in enumerate(passages)]
    return [r.chunk_id for r in evidence.prune(spark.createDataFrame(rows, RANKED), **how).orderBy("rank").collect()]


def test_pruning(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    one = (10, "h1", None, 1, 1, "TEXT", words(1))
    assert kept(spark, one, one) == [10]  # the same passage twice
    assert kept(spark, one, (11, "h1", None, 2, 1, "TEXT", words(2))) == [10]  # the same hash
    assert kept(spark, one, (11, "h2", 10, 2, 1, "TEXT", words(2))) == [10]  # its child
    assert kept(spark, one, (11, "h2", None, 2, 1, "TEXT", words(1) + " and two")) == [10]  # it holds the first
    assert kept(spark, one, (11, None, None, 2, 1, "TEXT", words(2)), (12, None, None, 3, 1, "TEXT", words(3))) == [10, 11, 12]  # no hash is no equal hash
    many = [(20 + i, f"m{i}", None, 1, i, "TEXT", words(20 + i)) for i in range(6)]
    assert kept(spark, *many) == [20, 21, 22, 23] and kept(spark, *many, query_class="COMPARISON") == [20, 21]
    family = [(40 + i, f"f{i}", 7, i, i, "TEXT", words(40 + i)) for i in range(4)]
    assert kept(spark, *family) == [40, 41]


def test_compression_keeps_what_carries_weight(spark):
    claim = "The sample melts at 320 degrees. It does not dissolve in water."
    filler = " ".join(f"Filler sentence number goes here {w} and further on." for w in ("alpha", "beta", "gamma", "delta"))
    schema = "query_id long, question array<string>, rank int, chunk_id long, chunk_type string, text string"
    for budget in (5, 10, 20, 40):
        rows = spark.createDataFrame([(1, ["gamma"], 0, 1, "TEXT", f"{filler} {claim}")], schema)
        found = evidence.compress(rows, budget).first()
        assert "320" in found.text and "not dissolve" in found.text and found.compressed
    rows = spark.createDataFrame([(1, ["gamma"], 0, 1, "TEXT", f"{filler} {claim}"), (1, ["gamma"], 1, 2, "FORMULA", "x = y " * 50)], schema)
    first, second = evidence.compress(rows, 50).orderBy("rank").collect()
    assert "gamma" in first.text and "alpha" not in first.text and not second.compressed and second.tokens == 150


def test_web_search(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "apple tart and red wine"), (3, "green pear"), (4, "pie of red apple"), (5, "Red, red apple")], "doc_id long, text string")
    ask = lambda q: [r.doc_id for r in keywords.web_search(spark.createDataFrame([(1, q)], "query_id long, q string"), docs).orderBy("rank").collect()]
    assert ask("red apple") == [1, 4, 5, 2]  # side by side in the first three, ties by id
    assert set(ask('"red apple"')) == {1, 4, 5} and set(ask("red apple -pie")) == {2, 5} and set(ask('apple -"red apple"')) == {2}
    assert set(ask("pear or tart")) == {2, 3} and ask("the of") == [] and ask("-pie") == [] and ask("") == []


def test_answers(spark):
    parse = lambda raw: spark.createDataFrame([(raw,)], "r string").select(A.parsed_answer(F.col("r")).alias("a")).first().a
    assert not parse("{").valid and not parse(None).valid and not parse('{"answer": "x"}').valid  # no claims, yet not insufficient
    good = parse('{"answer": "x", "claims": [{"text": " t ", "citations": ["[S1]"]}]}')
    assert good.valid and good.claims[0].text == "t" and good.claims[0].citations == ["[S1]"]
    for blank in (r"\t", r"\n", r"\u00a0", r" \u2003\r\n"):
        assert not parse('{"answer": "x", "claims": [{"text": "%s", "citations": ["S1"]}]}' % blank).valid
        assert not parse('{"answer": "x", "claims": [{"text": "t", "citations": ["%s"]}]}' % blank).valid
        assert not parse('{"answer": "%s", "claims": [{"text": "t", "citations": ["S1"]}]}' % blank).valid


def test_backoff_and_percentiles(spark):
    waits = spark.createDataFrame([(n,) for n in (-1, 0, 1, 2, 5, 8, 40, 4000)], "n int").select(state.backoff(F.col("n")).alias("w")).collect()
    assert [r.w for r in waits] == [10, 10, 10, 20, 160, 900, 900, 900]
    rows = spark.createDataFrame([("a", float(v)) for v in [*range(100), *[50] * 900]] + [("b", 3.0), ("c", None)], "k string, v double")
    found = {r.k: r for r in exact_percentiles(rows, "k", "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}).collect()}
    plain = sorted([*range(100), *[50] * 900])
    at = lambda q: plain[int(q * 999)] + (plain[min(999, int(q * 999) + 1)] - plain[int(q * 999)]) * (q * 999 - int(q * 999))
    assert [found["a"][p] for p in ("p0", "p50", "p99", "p100")] == pytest.approx([at(0), at(0.5), at(0.99), at(1)]) and found["b"].p50 == 3.0 and "c" not in found


def test_percentiles_with_an_outlier_are_cut_again(spark):
    """One value far away leaves no range fuller than it may be, however few a task may put in order."""
    values = sorted([float(i * i % 7919) / 7 for i in range(3000)] + [1e12])
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", 2.0)], "k string, v double").repartition(3)
    wanted = {"p1": 0.01, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    found = {r.k: r for r in exact_percentiles(rows, "k", "v", wanted, most=5).collect()}
    assert [found["a"][p] for p in wanted] == pytest.approx(list(np.quantile(values, list(wanted.values())))) and found["b"].p50 == 1.5 and found["a"].n == 3001


def test_dense_search_with_ties(spark):
    vectors = spark.createDataFrame([(i, [1.0, float(i % 3), 0.0]) for i in range(50)] + [(99, None)], "vec_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(1, [2.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], "query_id long, embedding array<double>")
    found = retrieval.dense_top_k(queries, vectors, 5).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in found] == [0, 3, 6, 9, 12, 2, 5, 8, 11, 14]
    assert retrieval.dense_top_k(queries.where("false"), vectors, 5).count() == 0


def test_stopwatch(spark):
    watch = Stopwatch(spark)
    with watch.stage("search"):
        spark.range(10).count()
    with pytest.raises(ValueError), watch.stage("unheard of"):
        pass
    took = {r.stage: r.ms for r in watch.rows().collect()}
    assert len(took) == 11 and took["search"] > 0 and took["prune"] == 0


def test_reasons(spark):
    cases = [("However, it fell.", "TEXT", "OPENS_MID_EXPLANATION"), ("this one", "TEXT", "OPENS_MID_EXPLANATION"), ("This one", "TEXT", "OPENS_WITH_A_REFERENCE"), ("(“Their house", "TEXT", "OPENS_WITH_A_REFERENCE"), ("A house", "TEXT", None), ("", "TEXT", None),
             ("1 2 3", "TABLE", "TABLE_WITHOUT_ITS_CAPTION"), ("Table 3. x\n1 2", "TABLE", None), ("Table of x", "TABLE", "TABLE_WITHOUT_ITS_CAPTION"), ("E = m", "FORMULA", "FORMULA_WITHOUT_ITS_DEFINITION"), ("E = m where m is", "FORMULA", None), ("x", "CHART", "VISUAL_WITHOUT_ITS_EXPLANATION")]
    rows = spark.createDataFrame([(t, k, w) for t, k, w in cases], "t string, k string, w string")
    assert [r.got for r in rows.select(T.expansion_reason(F.col("t"), F.col("k"), F.lit(1)).alias("got")).collect()] == [w for _, _, w in cases]
