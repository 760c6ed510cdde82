"""Fill-in-middle, bin completion and the conversations' trie against plain versions of what they promise."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import bin_completion, conversation_trie, fill_in_middle, queries, scans
from lodestone.llm.common import stored

DOCS = "doc_id long, text string, lang string, n long, frames string, form string"
TALKS = "conv_id long, turn long, role string, text string, node string, depth long"
IDS = public_tokenizers.path("byte_bpe_50k.json")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def odd_texts():
    rng = random.Random(4)
    parts = ["a", "é", "漢", "𝔸", "<P>", "<S", "<M>", "word ", "\n", "\0", "<", "P>"]
    some = ["".join(rng.choices(parts, [9, 5, 5, 5, 1, 2, 1, 9, 3, 1, 3, 3], k=rng.randrange(60))) for _ in range(300)]
    return [*some, None, "", "x", "𝔸" * 70_000, "plain ascii " * 9000, "é<S>"]


@pytest.fixture
def documents(spark, tmp_path):
    def write(texts, ids=None):
        rows = [(i, t, None, 1, "f", "g") for i, t in zip(ids or range(len(texts)), texts)]
        spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def plain_middle(i, text):
    n = len(text)
    h = [int(sha(f"1:{i}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    first = "<P>" + text[:a], "<S>" + text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, a, b - a, sha("".join(first if form == "psm" else first[::-1]) + "<M>" + text[a:b]), sha(text)


def test_fill_in_middle_equals_cutting_the_text(spark, documents):
    texts = odd_texts()
    found = {r.doc_id: r for r in queries.op11_fill_in_middle(spark, documents(texts)).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        r = found[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == plain_middle(i, text or ""), text and text[:80]


@pytest.mark.parametrize("units", [1, 2, 7, 64])
def test_small_frames_give_the_same_texts(spark, units):
    """Cuts within, between and at the ends of frames; and the output itself, not only its digest."""
    texts = ["".join(random.Random(i).choices("aé漢𝔸 ", k=i)) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    moved = stored(fill_in_middle.fill_in_middle(fill_in_middle.framed(docs, units)), "moved")
    outputs = {r.doc_id: r for r in fill_in_middle.with_text(moved).collect()}
    hashes = {r.doc_id: r for r in fill_in_middle.with_digests(moved).collect()}
    for i, text in enumerate(texts):
        assert (outputs[i].form, sha(outputs[i].output), hashes[i].restored_sha256) == (plain_middle(i, text)[1], plain_middle(i, text)[4], sha(text))


def test_only_cut_frames_are_opened():
    starts, frames = fill_in_middle.to_frames("é".encode() * 1000, 10)
    text = fill_in_middle.Seekable(starts, frames)
    parts = [*text.part(0, 333), *text.part(333, 777), *text.part(777, 1000)]
    assert sorted(text.opened) == [33, 77] and sum(u for u, _ in parts) == 1000 and sum(f is g for _, f in parts for g in frames) == 98
    assert b"".join(fill_in_middle.decompress(f) for _, f in parts).decode() == "é" * 1000


def test_digests_find_markers_wherever_frames_begin():
    output = "<S>end<P>sta<M>middle"
    for width in range(1, 9):
        frames = [fill_in_middle.compress(output[i : i + width].encode()) for i in range(0, len(output), width)]
        assert fill_in_middle.digests("spm", frames) == (sha(output), sha("stamiddleend"))


def test_fill_in_middle_on_awkward_rows(spark):
    rows = [(None, "no id"), (1, None), (1, None), (2, "twice"), (2, "twice")]
    docs = spark.createDataFrame([(i, t, 5, True) for i, t in rows], "doc_id long, text string, starts int, marked boolean")
    run = lambda d: fill_in_middle.with_digests(fill_in_middle.fill_in_middle(fill_in_middle.framed(d)))
    found = sorted(run(docs).collect(), key=str)
    assert len(found) == 5 and all(r.form == "plain" for r in found if r.doc_id != 2)
    assert len({tuple(r) for r in found}) == 3 and run(docs.where("false")).count() == 0


def fewest(lengths, capacity):
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[i]}.values():
            rooms[j] -= lengths[i]
            go(i + 1, rooms)
            rooms[j] += lengths[i]
        rooms.append(capacity - lengths[i])
        go(i + 1, rooms)
        rooms.pop()

    go(0, [])
    return best


def test_bin_completion_is_exact_without_bounds():
    rng = random.Random(5)
    for _ in range(400):
        capacity = rng.choice([10, 20, 30, 50])
        lengths = sorted((rng.randrange(1, rng.choice([capacity, capacity // 2 + 1, capacity // 3 + 2])) for _ in range(rng.randrange(1, 11))), reverse=True)
        least = fewest(lengths, capacity)
        bins, proven = bin_completion.bin_completion(lengths, capacity, float("inf"), None)
        assert len(bins) == least and proven and bin_completion.least_bins(lengths, capacity) <= least
        assert sorted(s for b in bins for s in b) == sorted(lengths) and max(map(sum, bins)) <= capacity


def test_search_beats_best_fit_and_never_loses_a_piece():
    rng, better = random.Random(1), 0
    for low, high, n in ((200, 700, 1500), (1, 1024, 700), (1, 5, 4000), (250, 400, 900), (1023, 1024, 30), (1, 2, 1)):
        lengths = [rng.randrange(low, high) for _ in range(n)]
        bins, _ = bin_completion.bin_completion(lengths, 1024)
        first = bin_completion.best_fit_decreasing(lengths, 1024)
        assert sorted(s for b in bins for s in b) == sorted(lengths) and max(map(sum, bins)) <= 1024
        assert bin_completion.least_bins(lengths, 1024) <= len(bins) <= len(first)
        better += len(bins) < len(first)
    assert better


def test_best_fit_packing_holds_the_library_s_ids(spark, documents):
    rng = random.Random(6)
    texts = ["".join(rng.choices(["one ", "zwölf ", "漢字", "\n\n", "'s", "<|endoftext|>"], k=rng.randrange(400))) for _ in range(150)]
    texts += [None, "", "a b " * 2000, "x " * 1023, "x " * 1022 + "x", "same", "same"]
    placed = queries.op12_best_fit_packing(spark, documents(texts, [*range(len(texts) - 2), 7, 7])).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in placed:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    library = Tokenizer.from_file(IDS)
    for i, text in enumerate(texts[:-2]):
        if i == 7:
            continue
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        own, at = sorted(pieces[i], key=lambda r: r.piece), 0
        for k, r in enumerate(own):
            assert (r.piece, r.start, r.doc_tokens) == (k, at, len(ids)) and (r.length == 1024 or k == 0 and r.length < 1024)
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    assert len(pieces[7]) == 3
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    rests = [r.length for r in placed if r.length < 1024]
    assert len(sequences) <= len(placed) - len(rests) + bin_completion.least_bins(rests, 1024) + 1


def test_packing_of_nothing(spark, documents):
    empty = spark.createDataFrame([], DOCS)
    assert bin_completion.pack(empty, IDS).count() == 0


def plain_trie(rows):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talks[c].append((turn is not None, turn or 0, role or "", text or ""))
    for t in talks.values():
        t.sort(key=lambda r: (r[:2], sha(f"{len(r[2].encode())}:{r[2]}{r[3]}")))
    rebuilt = {}
    for c in talks:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(r[2:] for r in talks.get(c - c % 20, [])[:h] + talks[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
        ends[rebuilt[c]].append(c)
    inner = defaultdict(set)
    for p in members:
        if p:
            inner[p[:-1]].add(p)
    out = set()
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        own = (len(members[p]) - 1) * len([w for w in p[-1][1].translate({c: " " for c in range(9, 14)}).split(" ") if w]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in inner
            saved[p[:d]] += own
    for p, m in members.items():
        out.add((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(inner[p]), leaves[p], saved[p], sha(",".join(map(str, ends[p])))))
    return out


def talks(seed):
    rng = random.Random(seed)
    said = ["hello there", "what is it", "a\tb\nc", "", None, "é è", "again and again and again"]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(said[: rng.choice([2, 7])])) for c in rng.sample(range(130), 90) for t in range(rng.randrange(1, 6))]
    rows += [(500 + i, t, "user", "copy") for i in range(60) for t in range(4)]  # many copies, also of deep prefixes
    rows += [(740, t, "user", f"deep {t}") for t in range(150)] + [(741, t, "user", f"deep {t}") for t in range(150)]
    rows += [(None, 0, "user", "lost"), (3000, None, "user", "first"), (3000, None, "user", "first"), (3000, 5, None, None), (3000, 5, "user", "tie"), (9021, 0, "user", "only")]
    return rows


FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_a_plain_one(spark, tmp_path, seed):
    rows = talks(seed)
    spark.createDataFrame([(*r, "n", 7) for r in rows], TALKS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op13_conversation_trie(spark, str(tmp_path))
    got = [tuple(r[f] for f in FIELDS) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)
    held = duckdb.connect()
    held.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert {tuple(r) for r in held.sql(f"SELECT {', '.join(FIELDS)} FROM ({queries.ORACLE_SQL['op13_conversation_trie']})").fetchall()} == set(got)


def test_trie_of_nothing(spark, tmp_path):
    spark.createDataFrame([], TALKS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op13_conversation_trie(spark, str(tmp_path)).count() == 0


def test_long_digests_are_joined_from_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE_BYTES", 30)
    rows = [(i, b"n") for i in range(-50, 400)] + [(7, b"m")]
    found = dict(conversation_trie._digests(spark.createDataFrame([(n, i) for i, n in rows], "node binary, conv_id long")).collect())
    assert {bytes(k): v for k, v in found.items()} == {b"n": sha(",".join(map(str, range(-50, 400)))), b"m": sha("7")}


@pytest.mark.parametrize("order", ["near", "far"])
def test_list_ranks(spark, order):
    """Links between neighbours shorten fast; links all over the ids are taken out by lot."""
    n = 900
    ids = list(range(n))
    if order == "far":
        random.Random(3).shuffle(ids)
    rows = [(a, a % 3, b, None if b is None else b % 3, 1, a) for a, b in zip(ids, [*ids[1:], None])]
    links = spark.createDataFrame(rows, "x long, y long, next_x long, next_y long, one long, own long")
    found = {r.x: (r.one, r.own) for r in scans.list_ranks(links, ["one", "own"], block=100).collect()}
    total = 0
    for place, i in enumerate(ids):
        assert found[i] == (place, total)
        total += i


def test_cycles_are_refused(spark):
    links = spark.createDataFrame([(0, 0, 1, 0, 1), (1, 0, 0, 0, 1)], "x long, y long, next_x long, next_y long, one long")
    with pytest.raises(Exception, match="cycle"):
        scans.list_ranks(links, ["one"]).collect()


def test_running_values_cross_tasks(spark):
    rows = [(k, i, i % 5) for k, n in ((None, 3), (1, 200), (2, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(7)
    found = scans.running(df, ["k"], ["i"], {"n": (lambda r: (1, 1), None), "hash": (lambda r: (31, r["v"]), 1_000_003)}, ahead=["i"])
    assert spark.conf.get("spark.sql.shuffle.partitions") != "1"
    for r in found.collect():
        want = 0
        for j in range(r.i + 1):
            want = (want * 31 + j % 5) % 1_000_003
        size = {None: 3, 1: 200, 2: 1}[r.k]
        assert int.from_bytes(r.n, "big") == r.i + 1 and int.from_bytes(r.hash, "big") == want
        assert r.has_next == (r.i + 1 < size) and r.next_i == (r.i + 1 if r.has_next else None)
