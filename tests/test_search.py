"""Search, reranking, chunking and merging against plain versions of what they promise."""

import math
import os
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.text import STOP_WORDS
from lodestone.functions import tokens
from lodestone.operators import chunking, dense, evidence, keywords, layout, retrieval, state
from lodestone.operators.intervals import points_in
from lodestone.sources import merged
from lodestone.sources.shared import shared_path

VECTOR = "embedding array<double>"


def near(spark, vectors, queries, k, **how):
    rows = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in vectors], f"vec_id long, {VECTOR}").repartition(3)
    asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in queries], f"query_id long, {VECTOR}")
    plain = sorted(tuple(r) for r in retrieval.dense_top_k(asked, rows, k).collect())
    found, compared = dense.indexed_top_k(asked, dense.build_index(rows, **how), k)
    assert sorted(tuple(r) for r in found.select("query_id", "vec_id", "cosine", "rank").collect()) == plain
    return sum(r.compared for r in compared.collect()) / max(1, len(queries) * sum(v is not None for _, v in vectors))


def test_index_leaves_out_what_is_far(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    points = [(i, centres[i % 30] + 0.05 * rng.normal(size=16)) for i in range(3000)]
    assert near(spark, points, [(i, v) for i, v in points[:50]], 20, cells=30) < 0.2


def test_index_is_exact_where_nothing_can_be_left_out(spark):
    rng = np.random.default_rng(4)
    points = [(i, rng.normal(size=24)) for i in range(700)] + [(9000, None), (9001, np.zeros(24))]
    near(spark, points, [(i, rng.normal(size=24)) for i in range(20)], 30)
    near(spark, [(i, [1.0, i % 3]) for i in range(60)], [(1, [1.0, 0.0]), (2, [0.0, 1.0])], 7, cells=4)  # ties, also across cells
    near(spark, points[:5], [(1, rng.normal(size=24))], 30)  # fewer than k


def test_index_packs_split_large_cells(spark, monkeypatch):
    monkeypatch.setattr(dense, "PACK", 20)
    monkeypatch.setattr(dense, "PACKS_TO_A_TASK", 2)
    rng = np.random.default_rng(5)
    near(spark, [(i, rng.normal(size=8)) for i in range(900)], [(i, rng.normal(size=8)) for i in range(70)], 10, cells=3)


def test_index_of_nothing(spark):
    empty = spark.createDataFrame([], f"vec_id long, {VECTOR}")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], f"query_id long, {VECTOR}")
    assert dense.indexed_top_k(asked, dense.build_index(empty), 3)[0].count() == 0


def plain_search(q, docs):
    alternatives, now = [], []
    for token in re.findall(r'-?"[^"]*"|\S+', q):
        if token.lower() == "or":
            alternatives.append(now)
            now = []
        else:
            terms = [(i, t) for i, t in enumerate(re.findall("[a-z0-9]+", token.lower())) if t not in STOP_WORDS]
            if terms:
                now.append((token.startswith("-"), terms))
    alternatives.append(now)
    scores = {}
    for d, text in docs:
        words = re.findall("[a-z0-9]+", text.lower())
        starts = lambda terms: [s for s in range(-5, len(words)) if all(0 <= s + i < len(words) and words[s + i] == t for i, t in terms)]
        for clauses in alternatives:
            wanted = [c for c in clauses if not c[0]]
            if not wanted or any(starts(t) for no, t in clauses if no) or not all(starts(t) for _, t in wanted):
                continue
            hits = sorted({(s + i, (k, i)) for k, (_, t) in enumerate(wanted) for s in starts(t) for i, _ in t})
            slots = {slot for _, slot in hits}
            score, last, latest = 0.0, -1, {}
            for pos, slot in hits:
                latest[slot] = pos
                if len(latest) == len(slots) and min(latest.values()) > last:
                    last = min(latest.values())
                    score += 1 / (1 + max(pos - last + 1 - len(slots), 0))
            scores[d] = max(scores.get(d, 0), round(score, 6))
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))


def test_web_search_equals_a_plain_one(spark):
    rng = random.Random(8)
    vocabulary = ["red", "apple", "pie", "the", "of", "wine", "tart", "pear"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 14)))) for i in range(120)] + [(500, ""), (501, "Red-apple; PIE!")]
    forms = ["red apple", '"red apple" pie', "pear wine OR tart", "red -pie", 'apple -"red apple"', '"apple of" red', "unknown red", "unknown OR pear", "-pie", "the of", "", "apple apple", '-"red pie" wine or "the tart"']
    asked = spark.createDataFrame(list(enumerate(forms)), "query_id long, q string")
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = keywords.positional_index(rows)
    found = keywords.web_search(asked, index, k=1000).orderBy("query_id", "rank").collect()
    for i, q in enumerate(forms):
        assert [(r.doc_id, r.score) for r in found if r.query_id == i] == plain_search(q, docs), q
    assert keywords.web_search(asked, rows.where("false")).count() == 0 and index.documents == 122


def test_weighted_score(spark):
    docs = ["a b", "a c", "a", "d"]
    df = spark.createDataFrame([("a", 3), ("b", 1), ("c", 1), ("d", 1)], "term string, df long")
    idf = lambda n: math.log(1 + (4 - n + 0.5) / (n + 0.5))
    asked = spark.createDataFrame([(1, ["b", "a", "b", "zz"]), (2, [])], "query_id long, question array<string>")
    weights = evidence.term_weights(asked, df, 4)
    pairs = weights.crossJoin(spark.createDataFrame([(d,) for d in docs], "text string"))
    found = {(r.query_id, r.text): r.s for r in pairs.withColumn("s", evidence.weighted_score(F.col("weights"), T.terms(F.col("text")))).collect()}
    whole = idf(3) + idf(1) + idf(0)
    for text, have in zip(docs, (idf(3) + idf(1), idf(3), idf(3), 0)):
        assert abs(found[1, text] - have / whole) < 1e-12 and found[2, text] == 0


ELEMENT = "d long, i int, path string, text string, size int, element_type string, standalone boolean, page int, x0 double, y0 double, x1 double, y1 double"


def test_children_are_split_where_they_are_too_long(spark):
    """Prose at sentences, a table at lines with its first one before each piece, a formula at lines; blank elements are skipped."""
    sentence = lambda w: f"The {w} is here now."
    prose = " ".join(sentence(w) for w in "abcdef")
    lines = "Caption of all\nr1 x y\n\nr2 x y\nr3 x y\n"
    texts = [("p", prose, "PARAGRAPH"), ("p", " \t\n", "PARAGRAPH"), ("p", lines, "TABLE"), ("q", lines, "FORMULA"), ("p", "short one", "LIST")]
    rows = [(1, i, path, t, len(t.split()), kind, kind in ("TABLE", "FORMULA"), 1, 0.0, 0.0, 1.0, 1.0) for i, (path, t, kind) in enumerate(texts)]
    parents, children = chunking.chunk_families(spark.createDataFrame(rows, ELEMENT), "d", "path", 25, 60, 8, 12, 3)
    got = [(r.section, r.chunk_type, r.text) for r in children.orderBy("section", "parent", "child", "piece").collect()]
    pairs = [" ".join(sentence(w) for w in "abcdef"[i : i + 2]) for i in (0, 2, 4)]
    table = ["Caption of all\nr1 x y\nr2 x y\nr3 x y"]
    assert [x for x in got if x[1] == "TEXT"] == [(0, "TEXT", p) for p in pairs] + [(2, "TEXT", "short one")]
    assert [t for _, k, t in got if k == "TABLE"] == [lines] and table  # twelve words fit
    less = chunking.chunk_families(spark.createDataFrame(rows, ELEMENT), "d", "path", 25, 60, 5, 9, 3)[1].orderBy("section", "parent", "child", "piece").collect()
    assert [r.text for r in less if r.chunk_type == "TABLE"] == ["Caption of all\nr1 x y\nr2 x y", "Caption of all\nr3 x y"]
    assert [r.text for r in less if r.chunk_type == "FORMULA"] == ["Caption of all\nr1 x y\nr2 x y", "r3 x y"]
    assert {(r.section, r.chunk_type) for r in parents.collect()} == {(0, "TEXT"), (0, "TABLE"), (1, "FORMULA"), (2, "TEXT")}


def test_sentences_end_without_white_space(spark):
    row = spark.createDataFrame([("First one. Second part.\n",), ("\u2003 \t\n",)], "t string")
    assert [r.s for r in row.select(T.sentences(F.col("t")).alias("s")).collect()] == [["First one.", "Second part."], []]


def test_running_headers_are_headings_and_paragraphs(spark):
    lines = [("d", p, "Chapter 1", 10.0, "PARAGRAPH" if p < 3 else "CAPTION") for p in range(6)] + [("d", p, f"{p} | Notes", 20.0, "HEADING") for p in range(4)] + [("d", 0, "Notes", 200.0, "HEADING")]
    rows = spark.createDataFrame(lines, "document string, page int, text string, top double, element_type string")
    pages = lambda n: spark.createDataFrame([("d", p) for p in range(n)], "document string, page int")
    heads = lambda n: {tuple(r) for r in layout.margin_headers(rows, pages(n)).collect()}
    assert heads(6) == {("d", "Chapter 1", 3), ("d", "Notes", 4)}
    assert heads(30) == {("d", "Notes", 4)} and heads(31) == set()  # the share is of all pages, also of those without lines
    left = layout.without_headers(rows, layout.margin_headers(rows, pages(6))).collect()
    assert sorted((r.page, r.element_type) for r in left) == [(0, "HEADING"), (3, "CAPTION"), (4, "CAPTION"), (5, "CAPTION")]


def test_hops_equal_following_everything(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(50)] + [("hub", f"n{i}") for i in range(40)] + [("hub", f"far{i}") for i in range(300)]
    seeds = [(i, f"n{i}") for i in range(20)] + [(3, "hub"), (99, "nowhere")]
    two = {a: set() for e in edges for a in e}
    for a, b in edges:
        two[a].add(b)
        two[b].add(a)
    for most in (1, 7, 500):
        wanted = set()
        for s in {s for s, _ in seeds}:
            seen = {}
            front = {n for t, n in seeds if t == s}
            for hop in range(4):
                for n in front:
                    seen.setdefault(n, hop)
                front = {m for n in front for m in two.get(n, ())} - set(seen)
            wanted |= {(s, n, h) for n, h in sorted(seen.items(), key=lambda x: (x[1], x[0]))[:most]}
        found = state.hops(spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame(seeds, "seed long, node string"), 3, most)
        assert {(r.seed, r.node, r.hop) for r in found.collect()} == wanted


def files(spark, path):
    return {(r.part, r.f) for r in spark.read.parquet(path).select("part", F.input_file_name().alias("f")).distinct().collect()}


def test_merging_writes_only_what_changes(spark):
    path = shared_path(spark, "merged-test")
    of = lambda rows: spark.createDataFrame(rows, "k long, v string, version int, deleted boolean")
    merged.create_merged(of([(i, "a", 0, False) for i in range(200)]), path, ["k"], "version", parts=16)
    read = lambda: {r.k: (r.v, r.version) for r in merged.read_merged(spark, path).collect()}
    before = files(spark, path)
    batch = of([(1, "b", 1, False), (2, None, 1, True), (500, "new", 1, False), (1, "older", 0, False), (1, "b", 1, False)])
    written = merged.merge_batch(spark, path, batch, ["k"], "version", parts=16)
    after = files(spark, path)
    assert 1 <= len(written) <= 3 and {x for x in before if x[0] not in written} == {x for x in after if x[0] not in written} and before != after
    assert read()[1] == ("b", 1) and 2 not in read() and read()[500] == ("new", 1) and len(read()) == 200
    assert merged.merge_batch(spark, path, batch, ["k"], "version", parts=16) == [] and files(spark, path) == after  # again: nothing to do
    assert merged.merge_batch(spark, path, of([(2, "late", 0, False)]), ["k"], "version", parts=16) == [] and 2 not in read()  # older than its deletion
    assert merged.merge_batch(spark, path, of([]), ["k"], "version", parts=16) == []
    merged.merge_batch(spark, path, of([(2, "back", 2, False)]), ["k"], "version", parts=16)
    assert read()[2] == ("back", 2)


def test_points_meet_their_intervals_once(spark):
    rng = random.Random(6)
    spans = [(i, low := rng.randrange(200), rng.choice([None, low, low + 1, low + rng.randrange(1, 120)])) for i in range(150)] + [(900, 0, 1 << 41), (901, None, 5), (902, (1 << 40) - 1, None)]
    times = [(i, rng.randrange(330)) for i in range(80)] + [(500, 0), (501, None), (502, (1 << 40) - 1)]
    found = points_in(spark.createDataFrame(times, "p long, at long"), "at", spark.createDataFrame(spans, "i long, low long, high long"), "low", "high")
    got = sorted((r.p, r.i) for r in found.collect())
    assert got == sorted((p, i) for p, at in times for i, low, high in spans if at is not None and low is not None and low <= at and (high is None or at < high))


def test_pieces_of_words(spark):
    count = tokens.piece_counts(["un", "##believ", "##able", "##a", "believ", "a", "able", "##"])
    assert [count([w]) for w in ("unbelievable", "able", "unable", "believa", "xable", "ab", "")] == [3, 1, 2, 2, 1, 1, 0]
    rows = spark.createDataFrame([(["unbelievable", "a"],), ([],), (None,)], "w array<string>")
    assert [r.n for r in rows.select(tokens.counter(["un", "##believable", "a"])(F.col("w")).alias("n")).collect()] == [3, 0, 0]
    fit = spark.createDataFrame([(510,), (511,)], "n int").select(tokens.fits(F.col("n")).alias("f")).collect()
    assert [r.f for r in fit] == [True, False]


def test_search_among_what_is_allowed(spark):
    docs = spark.createDataFrame([(i, "red apple" + " pie" * (i % 3)) for i in range(9)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red"), (2, "pie")], "query_id long, q string")
    allowed = spark.createDataFrame([(1, 3), (1, 4), (2, 4), (2, 3), (2, 4)], "query_id long, doc_id long")
    found = keywords.web_search(asked, docs, allowed=allowed).collect()
    assert {(r.query_id, r.doc_id) for r in found} == {(1, 3), (1, 4), (2, 4)}


def test_web_search_shuffles_no_candidates(spark):
    """Every document has both words and every question asks for them: what is shuffled are the best of each block, not the pairs."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("red apple and pie").alias("text"))
    asked = spark.range(200).select(F.col("id").alias("query_id"), F.lit("red pie").alias("q"))
    found = keywords.web_search(asked, docs, 5)
    rows = found.collect()
    assert len(rows) == 1000 and {r.doc_id for r in rows} == set(range(5)) and {r.score for r in rows} == {round(1 / 3, 6)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CartesianProduct" in plan and "SortMergeJoin" not in plan


def test_web_search_counts_one_span_at_a_place(spark):
    """Where two slots end at one place, only the shortest span counts, as in SQL."""
    docs = spark.createDataFrame([(1, "red pie red")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, '"pie red" red')], "query_id long, q string")
    # slots pie at 1, red (of the phrase) at 2, red at 0 and 2: the span from 0 is no shortest one at 2
    assert [r.score for r in keywords.web_search(asked, docs).collect()] == [1.0]


def test_all_terms_of_a_text(spark):
    docs = [(1, "a b c"), (2, "c b a a"), (3, "a b"), (4, ""), (5, "A-b c d")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    terms = spark.createDataFrame([(9, t) for t in "abc"] + [(8, "d"), (8, "zz"), (7, "d")], "query_id long, term string")
    found = [(r.query_id, r.doc_id, r.score, r["rank"]) for r in keywords.keyword_top_k(terms, rows).orderBy("query_id", "rank").collect()]
    assert found == [(7, 5, 1.0, 0), (9, 2, round(3 + math.log(2), 6), 0), (9, 1, 3.0, 1), (9, 5, 3.0, 2)]


def test_containment_of_lists_at_once():
    """All pairs of lists as a plain comparison has them, also across blocks of hashes, with empty and null lists."""
    rng = random.Random(5)
    lists = [rng.sample(range(-20_000, 20_000), k) for k in (9000, 12_000, 7)] + [[], None, [3], [3, 4, 5, 6, 7], [3, 4, 5, 6, -9]]
    lists.append(lists[0][:5000] + [50_000 + i for i in range(1250)])
    found = evidence.contained(pa.array(lists, pa.list_(pa.int64())), 0.8)
    for i, a in enumerate(lists):
        for j, b in enumerate(lists):
            assert found[i, j] == bool(a and b and len(set(a) & set(b)) / min(len(a), len(b)) >= 0.8), (i, j)
    assert found[0, 8] and found[6, 7]


def test_compared_rows_are_passed_on():
    """However many questions come, no more rows are held than said, and all vectors compared are counted."""
    rng = np.random.default_rng(3)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 4)))
    vectors, wanted, rows = unit(60), unit(50), []
    for v in range(0, 60, 20):
        for q in range(0, 50, 10):
            data = [np.arange(v, v + 20), vectors[v : v + 20], np.arange(q, q + 10), wanted[q : q + 10], np.zeros(10), np.full(10, np.inf)]
            rows.append(dict(zip(("ids", "vectors", "query_ids", "query_vectors", "query_away", "query_reach"), (x.tobytes() for x in data)), near=0.0, far=2.0))
    found = list(dense._compared(iter([pa.RecordBatch.from_pylist(rows)]), 3, held=60, most=60))
    assert len(found) > 1 and max(b.num_rows for b in found) <= 90
    table = pa.Table.from_batches(found).to_pandas()
    assert table.groupby("query_id")["pairs"].sum().tolist() == [60] * 50
    best = table.sort_values(["query_id", "cosine", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(3)
    exact = np.argsort(-np.round(wanted @ vectors.T, 9), axis=1, kind="stable")[:, :3]
    assert best["vec_id"].to_numpy().reshape(50, 3).tolist() == exact.tolist()


def test_blocks_are_small_and_a_task_merges_them(spark, monkeypatch):
    """Many blocks in one task give k rows for a question, the index is smaller than the texts, and an id in several blocks counts once."""
    monkeypatch.setattr(keywords, "BLOCK", 4000)
    monkeypatch.setattr(keywords, "LEAST", 10**9)
    rng = random.Random(8)
    rows = [(i % 900, " ".join(rng.choice(["river", "stone", *(f"word{rng.randrange(400)}" for _ in range(8))]) for _ in range(60))) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "river stone"), (2, "river OR stone")], "query_id long, q string")
    index = keywords.positional_index(docs)
    # a file for each block, so that a task reads one at a time
    assert index.blocks.count() == len(index.blocks.inputFiles()) > 50
    found = [tuple(r) for r in keywords.web_search(asked, index, 1000).select("query_id", "doc_id", "score", "rank").collect()]
    monkeypatch.setattr(keywords, "BLOCK", 10**9)
    size = sum(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for f in keywords.positional_index(docs).blocks.inputFiles())
    assert size < sum(len(t) for _, t in rows) / 2
    assert sorted(found) == sorted(tuple(r) for r in keywords.web_search(asked, docs, 1000).select("query_id", "doc_id", "score", "rank").collect())
    assert len({r[:2] for r in found}) == len(found) > 500
    out = []
    given = keywords._met

    def counted(batches, scored, k):
        for batch in given(batches, scored, k):
            out.append(batch.num_rows)
            yield batch

    alternatives = pa.array([[{"query_id": 1, "alt": 0, "terms": [{"clause": 0, "place": 0, "slot": 0, "negated": False, "term": "river"}]}]])
    blocks = index.blocks.drop("block").toArrow().combine_chunks().to_batches()[0]
    batch = pa.record_batch([*blocks.columns, pa.concat_arrays([alternatives] * blocks.num_rows)], names=[*blocks.schema.names, "alternatives"])
    assert list(counted([batch], keywords._dense, 5)) and sum(out) == 5


def test_only_what_may_be_among_the_best_is_scored(spark, monkeypatch):
    """With bounds, a task gives the same documents of its blocks, equal scores by id, and scores a fraction of the candidates."""
    monkeypatch.setattr(keywords, "BLOCK", 6000)
    monkeypatch.setattr(keywords, "HELD", 1000)
    monkeypatch.setattr(keywords, "LEAST", 10**9)
    rng = random.Random(4)
    words, weights = ["red", "apple", "pie", "of", "wine", "tart", *(f"w{i}" for i in range(60))], [8, 6, 4, 3, 2, 1, *[0.5] * 60]
    docs = [(i * 37 % 1000, " ".join(rng.choices(words, weights, k=rng.choice([3, 20, 100])))) for i in range(1000)]
    forms = ["red", "red apple", '"red apple" pie', "pie red apple", "wine tart OR red pie", "red -pie", '"apple of" red', 'apple -"red apple"', "red apple -tart", "apple apple", '"pie pie" red', "w1 w2 OR w3"]
    asked = spark.createDataFrame(list(enumerate(forms)), "query_id long, q string")
    index = keywords.positional_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    assert index.blocks.count() > 20
    found = keywords.web_search(asked, index, k=3).orderBy("query_id", "rank").collect()
    for i, q in enumerate(forms):
        assert [(r.doc_id, r.score) for r in found if r.query_id == i] == plain_search(q, docs)[:3], q

    terms = [{"clause": i, "place": 0, "slot": i, "negated": False, "term": t} for i, t in enumerate(["apple", "pie", "red"])]
    alternatives = pa.array([[{"query_id": 1, "alt": 0, "terms": terms}]])
    blocks = index.blocks.drop("block").toArrow().combine_chunks().to_batches()[0]
    batch = pa.record_batch([*blocks.columns, pa.concat_arrays([alternatives] * blocks.num_rows)], names=[*blocks.schema.names, "alternatives"])
    scored = []

    def dense(asked, block, pair, owner):
        scored.append(len(pair))
        return keywords._dense(asked, block, pair, owner)

    rows = lambda **more: [tuple(r.values()) for b in keywords._met([batch], dense, 3, **more) for r in b.to_pylist()]
    whole, n = rows(), sum(scored)
    scored.clear()
    assert rows(near=keywords._near) == whole and n > 300 and sum(scored) < n / 2


def test_the_best_are_taken_before_the_shuffle(spark):
    rows = spark.range(100).selectExpr("id % 3 AS q", "id % 7 AS score", "id")
    plan = retrieval.top_ranked(rows, "q", "score", "id", 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
