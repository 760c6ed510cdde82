"""Token counts by rank-synchronous array merging.

Texts are normalised and split as the vocabulary file says (canonical composition, white space, lower case, its own
split pattern). The pre-tokens of a batch become one ragged numpy array of symbol ids. In each round every sequence
applies its lowest-ranked pair wherever that pair stands; sequences without a known pair leave. What survives is counted.
Words repeat, so each word's count is computed once and kept in a table of bounded size.

Defined results: null or empty text has 0 tokens; a text of any length is counted whole; repeated rows give repeated
results; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, bound_batches, per_batch, segment_sums, texts

_NO_PAIR = np.int64(1) << 40
#: Small letters that the library takes and Python does not: sigma at a word's end, and two letters newer than Python's tables.
_SMALL = (("\u03a3", "\u03c3"), ("\ua7cb", "\u0264"), ("\ua7dc", "\u019b"))
#: Python calls these white space, the vocabulary's pattern does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")


@functools.cache
def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class MergeCounter:
    """Counts the tokens of words with the merges of a byte-level vocabulary file whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        ids = model["vocab"]
        n = len(ids)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merged = [a.removesuffix(suffix) + b if suffix else a + b for a, b in pairs]
        keys = np.array([ids[a] * n + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.n = n
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.result = np.array([ids[x] for x in merged], np.int64)
        symbols = byte_symbols()
        self.inner = np.array([ids[c] for c in symbols], np.int64)
        self.last = np.array([ids[c + suffix] for c in symbols], np.int64)
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.space = regex.compile(r"\s+")
        self.table = WordTable(self.of_words)

    def survivors(self, tokens: list[bytes]) -> np.ndarray:
        """How many symbols of each pre-token survive all merges."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out = lengths.copy()
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        if not len(flat):
            return out
        symbols = self.inner[flat]
        stops = np.cumsum(lengths)[lengths > 0] - 1
        symbols[stops] = self.last[flat[stops]]
        owner = np.repeat(np.arange(len(tokens)), lengths)
        while len(symbols) > 1:
            key = symbols[:-1] * self.n + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbols), _NO_PAIR)
            rank[:-1] = np.where((self.keys[at] == key) & (owner[1:] == owner[:-1]), self.ranks[at], _NO_PAIR)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbols))))
            marked = np.flatnonzero((rank == least) & (least < _NO_PAIR))
            if not len(marked):
                break
            run = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(marked) != 1]), np.arange(len(marked)), 0))
            marked = marked[(np.arange(len(marked)) - run) % 2 == 0]  # of "aaa", the left pair merges
            symbols[marked] = self.result[rank[marked]]
            keep = least < _NO_PAIR
            keep[marked + 1] = False
            out -= np.bincount(owner[marked], minlength=len(out))
            symbols, owner = symbols[keep], owner[keep]
        return out

    def of_words(self, words: list[str]) -> np.ndarray:
        """Token counts of words that hold no white space."""
        total = np.zeros(len(words), np.int64)
        for at in range(0, len(words), 50_000):
            part = [self.split.findall(w) for w in words[at : at + 50_000]]
            owner = np.repeat(np.arange(len(part)), [len(p) for p in part])
            counts = self.survivors([t.encode() for p in part for t in p])
            total[at : at + len(part)] = np.bincount(owner, counts, minlength=len(part)).astype(np.int64)
        return total

    def words(self, text: str) -> list[str]:
        """The white-space separated words of a text without special strings, normalised."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            for capital, small in _SMALL:
                text = text.replace(capital, small)
        text = text.lower()
        if _SEPARATORS.search(text):
            return self.space.sub(" ", text).strip(" ").split(" ")
        return text.split()

    def of_texts(self, column: list[str]) -> np.ndarray:
        """Token counts of whole texts; each special string counts as one token."""
        extra = np.zeros(len(column), np.int64)
        lengths = np.zeros(len(column), np.int64)
        words: list[str] = []
        for i, text in enumerate(column):
            before = len(words)
            if "<|" in text and (parts := self.special.split(text))[1:]:
                extra[i] = len(parts) - 1
                for part in parts:
                    words += self.words(part)
            else:
                words += self.words(text)
            lengths[i] = len(words) - before
        return segment_sums(self.table.rows(words), lengths) + extra


@functools.lru_cache(2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of every text. ``vocabulary``: path of the vocabulary file on every machine."""
    bound_batches(docs.sparkSession)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch(
            [batch["doc_id"], batch["n_bytes"], pa.array(counter(vocabulary).of_texts(batch["text"].to_pylist()), pa.int64())],
            names=["doc_id", "n_bytes", "n_tokens"],
        )

    rows = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(per_batch(count), "doc_id long, n_bytes long, n_tokens long")
