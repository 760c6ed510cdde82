"""The pipeline's stages, one after another, against plain versions of what each decides."""

import random
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the house near river was old and people came every morning with bread water fresh apples stories about ships winter".split(),
    "de": "das Haus am Fluss war alt und die Leute kamen jeden Morgen mit Brot Wasser frischen Geschichten über Schiffe Winter".split(),
}


def corpus():
    random.seed(8)
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(random.choices(WORDS[lang], k=40)), lang, "big" if i % 5 else "small"))
    rows += [(100 + i, rows[i][1], rows[i][2], "big") for i in range(6)]  # exact copies
    rows += [(200 + i, rows[i][1] + " end", rows[i][2], "big") for i in range(6)]  # near copies
    rows += [(300, rows[9][1] + " write to anna@example.com today", "de", "small"), (400, None, "en", "big"), (401, "", None, None), (402, "12 34 --", "en", "big")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def least_of_each_group(rows):
    """Ids that stay when all pairs of sets of five-word shingles are compared."""
    sets = {i: {tuple(t.lower().split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def test_stages(spark):
    rows = corpus()
    docs, after = spark.createDataFrame(rows, SCHEMA), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""), "stage")
        after.append(docs.collect())
        if len(after) < 5:
            assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")], name
    language, unique, private, mixed, packed = after
    lettered = {i for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    assert {r.doc_id for r in language} == lettered
    assert {r.doc_id for r in unique} == least_of_each_group([(r.doc_id, r.text) for r in language])
    before = {r.doc_id: r.text for r in unique}
    assert {r.doc_id: r.text for r in private} == {i: t.replace("anna@example.com", "[EMAIL]") for i, t in before.items()}
    assert all(r.n_chars == len(r.text) for r in private)
    times = Counter(r.doc_id for r in mixed)
    assert set(times) == set(before)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in packed) == sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    assert max(r.offset + r.length for r in packed) <= 2048


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""), "stage")
        assert docs.count() == 0


def test_awkward_rows_pass_all_stages(spark):
    """A very long text, repeated rows, rows without an id, and columns named like helpers."""
    text = " ".join(WORDS["en"])
    rows = [(1, text, "en", "a", 0, "x", 1), (1, text, "en", "a", 0, "x", 2), (None, text + " more words stand here now", "en", None, None, None, 3), (2, "the house near the river " * 9000, "en", "b", 1, "y", 4), (3, None, "en", "a", None, None, 5), (4, " ".join(WORDS["de"]), "de", "a", 7, "z", 6)]
    docs = spark.createDataFrame(rows, SCHEMA + ", _hash string, key long")
    columns, after = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""), "stage")
        after.append(docs.collect())
        if len(after) < 5:
            assert docs.columns == columns, name
    assert [sorted({(r.doc_id or 0) for r in rows}) for rows in after] == [[0, 1, 2, 4]] * 5
    assert len(after[0]) == 5 and len(after[1]) == 4
