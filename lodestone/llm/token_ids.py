"""Token ids of whole texts as little-endian 32-bit bytes, as the vocabulary file's own library gives them.

A text is cut before each space and each line feed. Where no white space follows white space, the byte-level split
pattern never reaches over such a cut, so the ids of the parts, each looked up once, join to the ids of the text. New
parts are encoded by the faster library for rank files, with ranks read from the same vocabulary: there an id is the
rank of its merge. Any other text, and texts with special strings, go to the file's own library whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

import numpy as np

from .token_counts import byte_symbols

#: The split pattern of byte-level vocabularies.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNSAFE = re.compile(r"\s\s|\0|<\|")


class IdEncoder:
    """Ids of texts; keeps the ids of up to ``limit`` parts."""

    def __init__(self, path: str, limit: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.fast = self._by_ranks(path)
        self.known: dict[str, bytes] = {}
        self.limit = limit

    @staticmethod
    def _by_ranks(path: str):
        """The encoder of plain parts by rank, or None where the vocabulary isn't plain byte-level in the order of its merges."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = ("".join(m.split(" ") if isinstance(m, str) else m) for m in merges)
        split = spec["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        if spec["normalizer"] or not plain or any(ids[x] != 256 + i for i, x in enumerate(pairs)):
            return None
        of_symbol = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(of_symbol[c] for c in x): i for x, i in ids.items() if all(c in of_symbol for c in x) and i < 256 + len(merges)}
        made = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return made.encode_ordinary

    def _parts(self, column: list[str]) -> list[bytes]:
        if self.fast is None:
            return self._library(column)
        return [array("I", x).tobytes() for x in map(self.fast, column)]

    def _library(self, column: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(column, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def of_texts(self, column: list[str]) -> list[bytes]:
        """The ids of each text, four bytes an id."""
        if len(self.known) > self.limit:
            self.known = {}
        known = self.known
        parts: list[list[str] | None] = []
        new: dict[str, None] = {}
        for text in column:
            if _UNSAFE.search(text):
                parts.append(None)
                continue
            cut = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
            parts.append(cut)
            for x in cut:
                if x not in known:
                    new[x] = None
        fresh = list(new)
        for at in range(0, len(fresh), 10_000):
            some = fresh[at : at + 10_000]
            known.update(zip(some, self._parts(some)))
        return [b"".join(map(known.__getitem__, p)) if p is not None else self._library([t])[0] for t, p in zip(column, parts)]


@functools.lru_cache(2)
def encoder(path: str) -> IdEncoder:
    return IdEncoder(path)
