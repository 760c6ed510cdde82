"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, and plain versions."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import binary_output, language_id, mixing, near_dedup, packing, personal_data, token_counts, toxicity, winnowing

IDS, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, component_id string, key string, node string, score string, spans string, place string"
LONG = "lorem ipsum dolor sit amet consectetur " * 4000
TEXTS = [(1, "the cat sat on the mat by the door"), (2, "the cat sat on the mat by the door"), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, "die Katze sitzt auf der Matte"), (7, "die Katze sitzt auf der Matte"), (8, "12 34"), (None, "mail x@y.com now"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i is None else ("de" if i == 7 else "en"), None if i == 3 else "s", None, *["clash"] * 7) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def everything(docs):
    """What each operator makes of a table, but for the searches, which have tests of their own."""
    model = language_id.fit(docs, PIECES)
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("toxic"))
    return {
        "counts": token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json")),
        "binary": binary_output.packed_digest(binary_output.packed_sequences(docs, IDS)),
        "toxicity": toxicity.score(docs, toxicity.fit(docs, labels)),
        "dedup": near_dedup.near_duplicates(docs),
        "fingerprints": winnowing.edited_fingerprints(docs),
        "mixing": mixing.mixed(docs, whole=True),
        "spans": personal_data.personal_spans(docs),
        "redacted": personal_data.redact(docs),
        "language": language_id.predict(docs, model),
        "packing": packing.pack(docs, IDS),
    }


def test_awkward_rows_keep_their_place(docs):
    found = everything(docs)
    for name in ("counts", "toxicity", "dedup", "fingerprints", "spans", "redacted", "language"):
        assert found[name].count() == len(TEXTS), name
    assert sum(r.n_segments for r in found["binary"].collect()) >= len(TEXTS)
    assert sorted(i for r in found["binary"].collect() for i, start in zip(r.doc_ids, r.doc_starts) if start == 0 and i is not None) == sorted(i for i, _ in TEXTS if i is not None)
    assert found["packing"].where("start = 0").count() == len(TEXTS) and {r.doc_id for r in found["mixing"].collect()} == {i for i, _ in TEXTS}
    assert found["redacted"].columns == docs.columns
    languages = {(r.doc_id, r.lang_pred) for r in found["language"].where("score = 0").collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (8, "und")} <= languages
    kept = {r.doc_id: r for r in found["dedup"].where("doc_id is not null").collect()}
    assert kept[2].component_id == 1 and not kept[2].kept and kept[5].n_shingles == 0


def test_empty_tables(docs):
    for name, found in everything(docs.where("false")).items():
        assert found.count() == 0, name


def test_pieces_hold_every_id_once(docs):
    library = Tokenizer.from_file(IDS)
    rows = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), IDS).toPandas()
    for doc, text in {i: t for i, t in TEXTS if i is not None}.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = rows[rows["doc_id"] == doc].sort_values("start")
        assert own["start"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() == len(ids)
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own["start"], own["length"])] == own["ids_crc32"].tolist()
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 2048


def test_fingerprints_follow_the_falling_order(docs):
    rows = [(i, t or "") for i, t in dict(TEXTS).items() if i is not None]
    found = {r.doc_id: r for r in winnowing.edited_fingerprints(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    order = sorted(rows, reverse=True)
    for (doc, text), (_, following) in zip(order, [*order[1:], order[0]]):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert found[doc].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and found[doc].n_chars == len(text)
    assert found[1].fingerprint == found[2].fingerprint


def test_winnowing_takes_the_rightmost_least():
    hashes = np.random.default_rng(1).integers(0, 9, 400).astype(np.uint64)
    plain = sorted({max(range(i, i + 7), key=lambda j: (-int(hashes[j]), j)) for i in range(len(hashes) - 6)})
    assert winnowing.kept(hashes, 7).tolist() == plain


def test_short_texts_are_like_their_edited_text(spark):
    rows = [(i, "".join(chr(97 + (i * 31 + j * j * 7 + j // 3) % 26) for j in range(62 + i))) for i in range(190)]
    found = winnowing.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 190 and min(r.near_edited for r in found) > 0


def test_near_duplicates_equal_comparing_all(spark):
    rng = np.random.default_rng(4)
    base = [[f"w{x}" for x in rng.integers(0, 60, 40)] for _ in range(12)]
    rows = []
    for i in range(150):
        words = list(base[rng.integers(12)])
        for at in rng.integers(0, 40, rng.integers(0, 4)):
            words[at] = f"v{rng.integers(5)}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4, block=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(sets[i]), find(i)) for i in range(len(rows))}
