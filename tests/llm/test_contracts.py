"""The queries of operators 2, 6, 7 and 9 against plain versions of what they promise."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import binary_output, language_id, mixing, personal_data, queries
from lodestone.llm.common import shared_path

SCHEMA = "doc_id long, text string, lang string, source string"
PIECES, IDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def by_rules(text):
    out = []
    for kind, pattern in RULES.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m.group())
            right = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if right[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def personal_texts():
    rng = random.Random(2)
    parts = ["a@b.co", "x.y+z@mail.example.org", "@", "10.0.0.1", "999.1.1.1", "1.2.3.4.5", "4111111111111111", "4111 1111 1111 1111", "4111111111111112", "+1 (743) 555-3824", "+12345678", "+1", "12-34", " ", ", ", "é", "𝔸", "word", "."]
    return ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(600)]


def test_personal_data_counts_and_spans(spark, folder):
    texts = [*personal_texts(), None, "", "a@b.co " * 3000]
    found = {r.doc_id: r for r in queries.op7_personal_data(spark, folder([(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        base = by_rules(text or "")
        counts = Counter(k for k, _, _ in base)
        assert [found[i][f"n_{k}"] for k in RULES] == [counts[k] for k in RULES], text
        written = [f"{k}:{a}:{b}" for k, a, b in base]
        assert found[i].base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(found[i].spans.split(","))


def test_bootstrap_finds_planted_identifiers(spark):
    """Cards with a wrong check digit and phones without a plus sign where cards and phones stand; and nothing else."""
    rng = random.Random(7)
    card = lambda: "".join(rng.choices("0123456789", k=15))
    passing = lambda x: next(x + c for c in "0123456789" if luhn(x + c))
    failing = lambda x: next(x + c for c in "0123456789" if not luhn(x + c))
    dial = lambda: f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, planted = [], set()
    for i in range(400):
        filler = " ".join(rng.choices(words, k=20))
        if i < 60:
            said = f"charged to card number {passing(card())} on"
        elif i < 120:
            said = f"please call me at +1 {dial()} after"
        elif i < 160:
            said = f"charged to card number {(x := failing(card()))} on"
            planted.add((i, "card", x))
        elif i < 200:
            said = f"please call me at {(x := dial())} after"
            planted.add((i, "phone", x))
        elif i < 300:  # numbers of no kind, in places of their own
            said = f"order {failing(card())} was shipped in box {rng.randrange(10**6, 10**7)}"
        else:
            said = "nothing to see"
        rows.append((i, f"{filler} {said} {filler}"))
    found = set()
    texts = dict(rows)
    for r in personal_data.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        more = set(map(tuple, r.spans)) - set(map(tuple, r.base))
        found |= {(r.doc_id, personal_data.KINDS[k], texts[r.doc_id][a:b]) for k, a, b in more}
    recall, precision = len(found & planted) / len(planted), len(found & planted) / max(1, len(found))
    assert recall >= 0.95 and precision >= 0.95, (recall, precision, sorted(found - planted)[:5])


def test_redaction_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "mail x@y.com", 5, "k", "s")], "doc_id long, text string, _id long, _key string, _SPANS string")
    out = personal_data.redact(docs)
    assert out.columns == docs.columns and out.first().text == "mail [EMAIL]"


def plain_exponent(tokens, evenness, limit, whole):
    """The least of many exponents that keeps both limits."""
    total = sum(tokens)
    for a in np.linspace(0, 1, 4001):
        raised = [(t / total) ** a for t in tokens]
        p = [x / sum(raised) for x in raised]
        entropy = -sum(x * math.log(x) for x in p)
        ratio = [x / t for x, t in zip(p, tokens)]
        epochs = max(ratio) / min(ratio) if whole else max(ratio) * total
        if entropy <= evenness * math.log(len(tokens)) + 1e-9 and epochs <= limit + 1e-9:
            return a
    return 1.0


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("sizes", [[900, *[10] * 10], [400, 300, 200, 1], [50, 50]])
def test_mixing_keeps_its_limits(spark, sizes, whole):
    rows, tokens = [], []
    for s, n in enumerate(sizes):
        rows += [(len(rows) + i, "w " * 100, None, f"s{s}") for i in range(n)]
        tokens.append(100 * n)
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = mixing.mixed(docs, evenness=0.95, most_epochs=4.0, whole=whole).select("doc_id", "source", "epoch", "weight", "n_tokens").collect()
    a = plain_exponent(tokens, 0.95, 4.0, whole)
    raised = [t**a for t in tokens]
    weights = {f"s{i}": x / sum(raised) for i, x in enumerate(raised)}
    times = Counter(r.doc_id for r in taken)
    assert max(times.values()) <= 4 and all(abs(r.weight - weights[r.source]) < 2e-3 for r in taken)
    wanted = max(t / weights[f"s{i}"] for i, t in enumerate(tokens)) if whole else sum(tokens)
    got = defaultdict(int)
    for r in taken:
        got[r.source] += r.n_tokens
    for i, t in enumerate(tokens):
        # whole documents are taken, so up to one document of a source, or what the grid of exponents is coarse by, is left
        assert abs(got[f"s{i}"] - weights[f"s{i}"] * wanted) <= 100 + 0.01 * weights[f"s{i}"] * wanted
    if whole:
        assert set(times) == {r[0] for r in rows}
    for source in {r.source for r in taken}:
        epochs = Counter(r.epoch for r in taken if r.source == source)
        n = sum(1 for r in rows if r[3] == source)
        assert all(epochs[e] == n for e in range(max(epochs)))  # all but the last epoch are full


def test_mixing_with_clashing_columns_and_limits_that_cannot_hold(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "s", 1, 2, 3)], SCHEMA + ", _source long, RANK long, _epochs long")
    out = mixing.mixed(docs, whole=True)
    assert out.count() == 1 and set(docs.columns) <= set(out.columns) and out.first()["_source"] == 1
    with pytest.raises(ValueError):
        mixing.mixed(docs, budget=100.0, most_epochs=4.0)
    with pytest.raises(ValueError):
        mixing.mixed(docs, budget=2.0, whole=True)


def test_packed_matrices_equal_the_library(spark):
    rng = random.Random(4)
    words = ["the", " house", "é", "漢字", "\n", "12", " of", "<|endoftext|>"]
    rows = [(i, "".join(rng.choices(words, k=rng.choice([0, 5, 60, 900])))) for i in range(120)] + [(500, None)]
    sequences = binary_output.packed_sequences(spark.createDataFrame(rows, "doc_id long, text string"), IDS, capacity=256)
    written = binary_output.write_packed(sequences, shared_path(spark, "test")).collect()
    library, parts = Tokenizer.from_file(IDS), defaultdict(dict)
    for r in written:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        assert not ids[r.n_tokens :].any()
        for doc, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            parts[doc][start] = ids[a:b].tolist()
    for doc, text in rows:
        wanted, got = [*library.encode(text or "", add_special_tokens=False).ids, 1], []
        for start, ids in sorted(parts[doc].items()):
            assert start == len(got)
            got += ids
        assert got == wanted
    digest = binary_output.packed_digest(sequences).collect()
    assert Counter(r.ids_crc32 for r in digest) == Counter(zlib.crc32(r.ids) for r in written)


def test_packed_ids_that_do_not_fit(spark):
    docs = spark.createDataFrame([(1, "relationship house")], "doc_id long, text string")
    with pytest.raises(Exception, match="doesn't fit"):
        binary_output.packed_sequences(docs, IDS, id_type="<u1").collect()
    with pytest.raises(ValueError):
        binary_output.packed_sequences(docs, IDS, end_id=70_000)
    long = binary_output.packed_sequences(docs, IDS, capacity=100_000).first()
    assert len(long.position_ids) == 400_000


def all_segmentations(word, rows, table):
    """The logarithm of the sum over segmentations, place by place; and by enumerating them all where there are few."""
    word = "▁" + word
    alpha = np.zeros((len(word) + 1, table.shape[1]))
    alpha[0], shift = 1, 0.0
    for end in range(1, len(word) + 1):
        for start in range(end):
            row = rows.get(word[start:end])
            if row is not None:
                alpha[end] += alpha[start] * table[row]
            elif end - start == 1:
                alpha[end] += alpha[start] * language_id.UNKNOWN
        if alpha[end].max() < 1e-100:
            alpha *= 1e100
            shift -= 100 * math.log(10)

    def enumerate_all(start):
        if start == len(word):
            return np.ones(table.shape[1])
        total = np.zeros(table.shape[1])
        for end in range(start + 1, len(word) + 1):
            row = rows.get(word[start:end])
            if row is not None or end - start == 1:
                total += (table[row] if row is not None else language_id.UNKNOWN) * enumerate_all(end)
        return total

    found = np.log(alpha[-1]) + shift
    if len(word) < 12:
        assert np.allclose(found, np.log(enumerate_all(0)))
    return found


def test_forward_sums_over_all_segmentations():
    pieces = language_id.vocabulary_pieces(PIECES)
    rows = {p: i for i, p in enumerate(pieces)}
    assert len(pieces) > 31_000 and any(len(p) > 12 for p in pieces) and any(p != p.lower() for p in pieces)
    table = language_id.padded(np.random.default_rng(0).random((len(pieces), 3)) * 1e-3 + 1e-7)
    words = ["a", "Relationship", "HELLO", "internationalisation", "你好世界这是一个没有空格的句子", "x😀y", "½", "a" * 70, "antidisestablishmentarianism" * 3, "é" * 50 + "Straße"]
    found = language_id.word_logs(words, language_id.piece_trie(PIECES), table)
    for word, own in zip(words, found):
        assert np.allclose(own, all_segmentations(word, rows, table)), word


def test_expected_counts_are_the_derivative_of_the_sum():
    """A piece's expected uses are what the logarithm of the sum grows by with the logarithm of its probability."""
    pieces = language_id.vocabulary_pieces(PIECES)
    trie = language_id.piece_trie(PIECES)
    base = np.random.default_rng(1).random((len(pieces), 1)) * 1e-3 + 1e-6
    word, step = "Relationships", 1e-5
    uses = language_id.expected_counts([word], trie, language_id.padded(base), np.array([0]), np.array([2.0]))
    for row in np.argsort(-uses[:-2, 0])[:8]:
        more = base.copy()
        more[row] *= math.exp(step)
        grown = language_id.word_logs([word], trie, language_id.padded(more)) - language_id.word_logs([word], trie, language_id.padded(base))
        assert abs(2 * grown[0, 0] / step - uses[row, 0]) < 1e-3


def test_letters_and_words(spark, folder):
    assert not any(map(language_id.has_letter, ["½ ² ①", "", "12 34 -- _", "́"])) and language_id.has_letter("ⅷ ª 1")
    rows = [(i, "the house near the river" if i % 2 else "das Haus am alten Fluss", "en" if i % 2 else "de", None) for i in range(80)]
    extra = [(200, "½ ² ①", "en", None), (201, None, None, None), (202, "THE HOUSE " * 20_000, None, None), (203, "a" * 5000 + " the", None, None)]
    found = {r.doc_id: r for r in queries.op9_language_id(spark, folder(rows + extra)).collect()}
    assert [(found[i].lang_pred, found[i].score) for i in (200, 201)] == [("und", 0.0)] * 2
    assert all(found[i].lang_pred == lang for i, _, lang, _ in rows) and found[203].lang_pred in ("en", "de")
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())


def test_many_languages_have_no_cap(spark):
    docs = spark.createDataFrame([(i, f"w{chr(97 + i % 26)}x{chr(97 + i // 26)} here", f"l{i}") for i in range(230)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, PIECES, rounds=1)
    assert len(model.languages) == 230 and language_id.predict(docs.limit(3), model).where(F.col("lang_pred") != "und").count() == 3
