"""Language ID by unigram piece models whose probability of a word sums over all its segmentations.

The pieces are all those of a fixed public vocabulary file, capitals and long ones included. For each language, piece
probabilities are learned by expectation maximisation over the word counts of a bounded sample of labelled documents
(``fit_docs`` of each language at most, taken by a hash of the id): every round, executors run the forward and backward
sums over all segmentations of their words and add up expected piece counts; only a table of pieces by languages, whose
size the vocabulary and the number of languages bound, comes to the driver. To score a text, a forward pass sums over the
segmentations of each of its words; a word's result is kept in a table of bounded size, as words repeat.

Words are the white-space separated parts of a text (Unicode's white space, alike for learning and scoring) with the
vocabulary's word-start mark before them, whatever their length; a character that no piece covers has a small fixed
probability. A word is first parted where no piece spans: the sum over all its segmentations is the product of the sums
over these parts, so that nothing is cut. Pieces are found by walking a trie of them from all positions at once.

Defined results: null text, and text without a letter (Unicode's letters; signs such as one half are none), gives ``und``
with score 0; empty training data gives ``und`` for all; ties go to the alphabetically first language; repeated rows give
repeated results; very long texts and words take time in proportion to their length, and memory too; an empty table gives an empty
result; columns other than doc_id, text and (for learning) lang are ignored.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordTable, bound_batches, once_per_worker, per_batch, segment_sums, stored, texts

#: Probability of a character that no piece covers, and the least of a known piece.
UNKNOWN, LEAST = 1e-7, 1e-7
#: Parts of words of more characters are summed in logarithms, where nothing underflows: 40 factors of LEAST are 1e-280.
LONG = 40
#: Characters of the words that are summed together, about.
TOGETHER = 60_000


@functools.lru_cache(2)
def vocabulary_pieces(path: str) -> tuple[str, ...]:
    """Pieces that can stand in a word; their places are their rows in the tables of probabilities."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return tuple(dict.fromkeys(x for x in found if x))


class Trie:
    """Pieces as a hash table from a node and a character to the next node, with the row of the piece that ends there."""

    def __init__(self, pieces: tuple[str, ...]):
        nodes: dict[tuple[int, int], int] = {}
        row = [-1]
        for n, piece in enumerate(pieces):
            at = 0
            for c in piece:
                step = (at, ord(c))
                at = nodes.get(step, 0)
                if not at:
                    nodes[step] = at = len(row)
                    row.append(-1)
            row[at] = n
        self.row = np.array(row, np.int32)
        self.bits = max(4, (4 * len(nodes)).bit_length())
        keys = np.array([(a << 21) | c for a, c in nodes], np.int64)
        values = np.fromiter(nodes.values(), np.int32, len(nodes))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot = self.slots(keys)
        while len(keys):  # each key to the first free place from its own on
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, character: np.ndarray) -> np.ndarray:
        """The nodes behind; 0 where there is none."""
        keys = (node.astype(np.int64) << 21) | character
        slot = self.slots(keys)
        out = np.zeros(len(keys), np.int32)
        held = self.keys[slot]
        hit = held == keys
        out[hit] = self.values[slot[hit]]
        at = np.flatnonzero(~hit & (held >= 0))
        while len(at):
            slot[at] = (slot[at] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[at]]
            hit = held == keys[at]
            out[at[hit]] = self.values[slot[at[hit]]]
            at = at[~hit & (held >= 0)]
        return out


@functools.lru_cache(2)
def piece_trie(path: str) -> Trie:
    return Trie(vocabulary_pieces(path))


@dataclass
class Lattice:
    """Parts of words, laid end to end, and the pieces in them.

    A part of n characters has n + 1 places from ``first`` on; ``owner`` is its word. Edges lead from one place to
    another and bear a piece's row (-2: an uncovered character); they are in order of their ends' distance from the
    part's first place, and of their length.
    """

    owner: np.ndarray
    size: np.ndarray
    first: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    row: np.ndarray
    depth: np.ndarray
    length: np.ndarray

    def groups(self) -> Iterator[slice]:
        """Slices of edges that end at different places."""
        if len(self.row):
            new = np.flatnonzero((np.diff(self.depth) != 0) | (np.diff(self.length) != 0)) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), len(self.row)]):
                yield slice(a, b)

    def only(self, parts: np.ndarray) -> Lattice:
        """The given parts (a mask) alone."""
        if parts.all():
            return self
        part = np.searchsorted(self.first, self.start, side="right") - 1
        keep = parts[part]
        size = self.size[parts]
        first = np.cumsum(size + 1) - size - 1
        moved = np.zeros(len(parts), np.int64)
        moved[parts] = first - self.first[parts]
        by = moved[part[keep]]
        return Lattice(self.owner[parts], size, first, self.start[keep] + by, self.stop[keep] + by, self.row[keep], self.depth[keep], self.length[keep])


def lattice(words: list[str], trie: Trie) -> Lattice:
    """All pieces in words (the start mark is put before each), in parts that no piece spans."""
    flat = np.frombuffer("".join("\u2581" + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    n = len(flat)
    room = np.repeat(ends, lengths)  # where the word of each character ends
    starts, stops, rows = [], [], []
    at = np.arange(n)
    node = np.zeros(n, np.int32)
    reach = at + 1
    single = np.full(n, -2, np.int32)
    size = 0
    while len(at):
        node = trie.step(node, flat[at + size])
        size += 1
        live = node > 0
        at, node = at[live], node[live]
        row = trie.row[node]
        ending = np.flatnonzero(row >= 0)
        if size == 1:
            single[at[ending]] = row[ending]
        elif len(ending):
            begun = at[ending]
            starts.append(begun)
            stops.append(begun + size)
            rows.append(row[ending])
            reach[begun] = begun + size
        on = at + size < room[at]
        at, node = at[on], node[on]
    # a place is a seam if no piece from before reaches beyond it; words end at seams, as no piece leaves its word
    seam = np.append(True, np.maximum.accumulate(reach) <= np.arange(1, n + 1)) if n else np.ones(1, bool)
    seams = np.flatnonzero(seam)
    size_of = np.diff(seams)
    first = seams[:-1] + np.arange(len(size_of))
    begun = np.concatenate([np.arange(n), *starts])
    ended = np.concatenate([np.arange(1, n + 1), *stops])
    row = np.concatenate([single, *rows])
    part = np.cumsum(seam[:-1])[begun] - 1 if n else begun
    depth, length = ended - seams[:-1][part], ended - begun
    order = np.lexsort((length, depth))
    part, begun, ended = part[order], begun[order], ended[order]
    owner = np.searchsorted(ends, seams[:-1], side="right")
    return Lattice(owner, size_of, first, begun + part, ended + part, row[order], depth[order], length[order])


def forward(parts: Lattice, table: np.ndarray) -> np.ndarray:
    """Sums over all segmentations up to each place. ``table``: probabilities by piece and language, with UNKNOWN in its row -2."""
    alpha = np.zeros((int((parts.size + 1).sum()), table.shape[1]))
    alpha[parts.first] = 1
    for group in parts.groups():
        alpha[parts.stop[group]] += alpha[parts.start[group]] * table[parts.row[group]]
    return alpha


def forward_logs(parts: Lattice, logs: np.ndarray) -> np.ndarray:
    """As ``forward``, in logarithms."""
    alpha = np.full((int((parts.size + 1).sum()), logs.shape[1]), -np.inf)
    alpha[parts.first] = 0
    for group in parts.groups():
        stop = parts.stop[group]
        alpha[stop] = np.logaddexp(alpha[stop], alpha[parts.start[group]] + logs[parts.row[group]])
    return alpha


def word_logs(words: list[str], trie: Trie, table: np.ndarray) -> np.ndarray:
    """The logarithm of the sum over all segmentations of each word, by language."""
    out = np.zeros((len(words), table.shape[1]))
    parts = lattice(words, trie)
    brief = parts.size <= LONG
    some = parts.only(brief)
    total = [(some, np.log(np.maximum(forward(some, table)[some.first + some.size], 1e-300)))]
    if not brief.all():
        some = parts.only(~brief)
        total.append((some, forward_logs(some, np.log(np.maximum(table, 1e-300)))[some.first + some.size]))
    for some, found in total:
        for column in range(table.shape[1]):
            out[:, column] += np.bincount(some.owner, found[:, column], len(words))
    return out


def expected_counts(words: list[str], trie: Trie, table: np.ndarray, column: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words that count ``weights`` times in the language ``column``."""
    parts = lattice(words, trie)
    own = np.searchsorted(parts.first, parts.start, side="right") - 1
    edge = np.log(table[parts.row, column[parts.owner[own]]])[:, None]
    alpha = np.full((int((parts.size + 1).sum()), 1), -np.inf)
    beta = alpha.copy()
    alpha[parts.first] = 0
    last = parts.first + parts.size
    beta[last] = 0
    groups = list(parts.groups())
    for group in groups:
        stop = parts.stop[group]
        alpha[stop] = np.logaddexp(alpha[stop], alpha[parts.start[group]] + edge[group])
    # from the end: edges in order of their starts' distance, so that of one length no two leave the same place
    depth = parts.depth - parts.length
    order = np.lexsort((parts.length, -depth))
    change = np.flatnonzero((np.diff(depth[order]) != 0) | (np.diff(parts.length[order]) != 0)) + 1
    for some in np.split(order, change):
        start = parts.start[some]
        beta[start] = np.logaddexp(beta[start], beta[parts.stop[some]] + edge[some])
    used = np.exp(alpha[parts.start] + edge + beta[parts.stop] - alpha[last][own])[:, 0] * weights[parts.owner[own]]
    width = table.shape[1]
    cell = (parts.row % len(table)).astype(np.int64) * width + column[parts.owner[own]]
    return np.bincount(cell, used, len(table) * width).reshape(table.shape)


def together(words: list[str]) -> Iterator[slice]:
    """Slices of words that are summed at once."""
    begun, held = 0, 0
    for i, word in enumerate(words):
        held += len(word) + 1
        if held >= TOGETHER:
            yield slice(begun, i + 1)
            begun, held = i + 1, 0
    if begun < len(words):
        yield slice(begun, len(words))


def padded(probabilities: np.ndarray) -> np.ndarray:
    """The table with a row for uncovered characters (at -2) and one that is not used (at -1)."""
    return np.vstack([probabilities, np.full((1, probabilities.shape[1]), UNKNOWN), np.zeros((1, probabilities.shape[1]))])


@dataclass(frozen=True)
class LanguageModel:
    """Piece probabilities by language: a table of the vocabulary's size times the number of languages."""

    vocabulary: str
    languages: tuple[str, ...]
    probabilities: np.ndarray


def fit(docs: DataFrame, vocabulary: str, learn: Column | None = None, fit_docs: int = 500, rounds: int = 3) -> LanguageModel:
    """Learns from the rows where ``learn`` holds and lang is not null.

    ``fit_docs`` bounds the sample: of a language with more rows, those whose id hashes below a fitting share are taken.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if learn is not None:
        known = known.where(learn)
    known = known.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    totals = known.groupBy("lang").agg(F.least(F.lit(1.0), fit_docs / F.count("*")).alias("share"))
    dealt = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20))
    # a row for each language, as the model has a column for each
    sample = known.join(F.broadcast(totals), "lang").where(dealt < F.col("share") * (1 << 20)).select("lang", "text")

    def tally(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter[tuple[str, str]] = Counter()
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            found.update((lang, w) for w in text.split())
        return pa.record_batch([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    words = sample.mapInArrow(per_batch(tally), "lang string, word string, n long")
    words = stored(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    languages = tuple(r[0] for r in words.select("lang").distinct().orderBy("lang").collect())
    size, n_languages = len(vocabulary_pieces(vocabulary)), len(languages)
    table = np.full((size, max(1, n_languages)), 1.0 / size)
    row_of = {x: i for i, x in enumerate(languages)}

    for _ in range(rounds if languages else 0):
        sent = spark.sparkContext.broadcast(table)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            trie, at = piece_trie(vocabulary), padded(sent.value)
            total = np.zeros_like(at)
            for batch in batches:
                own = batch["word"].to_pylist()
                column = np.fromiter(map(row_of.__getitem__, batch["lang"].to_pylist()), np.int64, len(own))
                weights = batch["n"].to_numpy().astype(float)
                for some in together(own):
                    total += expected_counts(own[some], trie, at, column[some], weights[some])
            piece, column = np.nonzero(total[:-2])
            yield pa.record_batch([pa.array(piece), pa.array(column), pa.array(total[piece, column])], names=["piece", "column", "uses"])

        uses = words.mapInArrow(count, "piece long, column long, uses double").groupBy("piece", "column").agg(F.sum("uses").alias("uses")).toPandas()
        new = np.zeros((size, n_languages))
        new[uses["piece"], uses["column"]] = uses["uses"]
        table = np.maximum((new + 0.01) / (new + 0.01).sum(axis=0), LEAST)
        sent.unpersist()
    return LanguageModel(vocabulary, languages, table)


def has_letter(text: str) -> bool:
    """Whether a text has a letter: a character of Unicode's categories L*."""
    return any(map(str.isalpha, text))


class Scorer:
    """Log-likelihoods of words under each language."""

    def __init__(self, model: LanguageModel):
        self.trie = piece_trie(model.vocabulary)
        self.table = padded(model.probabilities)
        self.known = WordTable(self.of_words)

    def of_words(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.table.shape[1]))
        for some in together(words):
            out[some] = word_logs(words[some], self.trie, self.table)
        return out

    def of_texts(self, column: list[str]) -> np.ndarray:
        words: list[str] = []
        lengths = np.zeros(len(column), np.int64)
        for i, text in enumerate(column):
            own = text.split()
            words += own
            lengths[i] = len(own)
        return segment_sums(self.known.rows(words), lengths)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score (the posterior of that language under equal priors) of every document."""
    spark = docs.sparkSession
    bound_batches(spark)
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    languages = model.languages

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = once_per_worker(key, lambda: Scorer(sent.value))
        column = batch["text"].to_pylist()
        letters = np.array([has_letter(t) for t in column]) & bool(languages)
        logs = scorer.of_texts(column)
        best = logs.argmax(axis=1)
        posterior = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        names = [languages[b] if ok else "und" for b, ok in zip(best, letters)]
        return pa.record_batch([batch["doc_id"], pa.array(names), pa.array(np.where(letters, posterior, 0.0))], names=["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(per_batch(score), "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The documents, columns and all, whose language is found with a score above ``least``."""
    spark = docs.sparkSession
    bound_batches(spark)
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    languages, schema = model.languages, docs.schema

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = [t or "" for t in batch["text"].to_pylist()]
        logs = once_per_worker(key, lambda: Scorer(sent.value)).of_texts(column)
        posterior = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        letters = np.array([has_letter(t) for t in column]) & bool(languages)
        return batch.filter(pa.array(letters & ((posterior > least) | (len(languages) < 2))))

    return docs.mapInArrow(per_batch(keep), schema)
