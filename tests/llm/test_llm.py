import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import binary_output, mixing, near_dedup, packing, personal_data, token_counts, winnowing
from lodestone.llm.token_ids import IdEncoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(1, "one two three four five six seven", "en", "a", 33), (2, "one two three four five six seven", "en", "a", 33), (3, None, None, None, None), (4, "", "en", "b", 0), (None, "call +1 (743) 555-3824 or x@y.com now", "en", "b", 37)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def mixed_texts(n=400):
    random.seed(3)
    parts = ["a", "B", " ", "\n", "  ", "é", "1", "234", "'s", "<|endoftext|>", "###", "漢字", "Σ", "aaa", "the "]
    return ["".join(random.choice(parts) for _ in range(random.randrange(40))) for _ in range(n)] + ["", "a" * 3000]


def test_counts_and_ids_equal_the_library():
    for name, own in (("word_bpe_49k.json", lambda p, x: token_counts.MergeCounter(p).of_texts(x).tolist()), ("byte_bpe_50k.json", lambda p, x: [len(b) // 4 for b in IdEncoder(p).of_texts(x)])):
        path, x = public_tokenizers.path(name), mixed_texts()
        assert own(path, x) == [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(x, add_special_tokens=False)]


def test_packers_fit():
    lengths = np.sort(np.random.default_rng(0).integers(1, 101, 500))[::-1]
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    assert max(offsets + lengths) <= 100 and np.bincount(bins, lengths).max() <= 100
    packed = binary_output.best_fit_decreasing(lengths.tolist(), 100)
    assert sorted(i for b in packed for i in b) == list(range(500)) and all(sum(lengths[i] for i in b) <= 100 for b in packed)


def test_near_duplicates(docs):
    found = {r.doc_id: r for r in near_dedup.near_duplicates(docs, size=4).collect()}
    assert found[2].component_id == 1 and not found[2].kept and found[1].kept and found[3].n_shingles == 0 and found[4].kept
    assert near_dedup.near_duplicates(docs.where("false")).count() == 0


def test_fingerprint_windows():
    w = winnowing.Winnower(3, 4)
    hashes, positions = w.of("abcabcabcabc")
    assert len(hashes) == len(positions) and (np.diff(positions) > 0).all()


def test_rules_and_redaction(docs):
    assert personal_data.rule_spans("x@y.com 10.0.0.1; 4111111111111111; +1 (743) 555-3824") == [(0, 0, 7), (1, 8, 16), (2, 18, 34), (3, 36, 53)]
    texts = {r.doc_id: r.text for r in personal_data.redact(docs).collect()}
    assert texts[None] == "call [PHONE] or [EMAIL] now" and texts[3] is None


def test_mixing_keeps_whole(docs):
    assert mixing.mixed(docs, whole=True).count() >= 5
    assert mixing.mixed(docs.where("false")).count() == 0
