"""Counts of tokens by a vocabulary of pieces: each word is cut from its start, the longest piece first."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a piece that goes on with a word.
INSIDE = "##"
#: Words whose counts a worker remembers.
KEPT = 100_000
#: Tokens that a model takes, and those it adds to each text.
LIMIT, ADDED = 512, 2


def _tree(pieces: Iterable[str]) -> dict:
    """Pieces as a tree of characters; a node that ends a piece has the empty key."""
    root: dict = {}
    for piece in pieces:
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        node[""] = True
    return root


def piece_counts(vocabulary: Iterable[str]) -> Callable[[list[str]], int]:
    """Counts the pieces of words: pieces that open a word, then such as are marked to go on. A word that can't be cut is one token."""
    found = list(vocabulary)
    first, later = _tree(p for p in found if p and not p.startswith(INSIDE)), _tree(p[len(INSIDE) :] for p in found if len(p) > len(INSIDE) and p.startswith(INSIDE))
    known: dict[str, int] = {}

    def of(word: str) -> int:
        at, n, tree = 0, 0, first
        while at < len(word):
            node, end = tree, 0
            for i in range(at, len(word)):
                node = node.get(word[i])
                if node is None:
                    break
                if "" in node:
                    end = i + 1
            if not end:
                return 1
            at, n, tree = end, n + 1, later
        return n

    def count(words: list[str]) -> int:
        if len(known) > KEPT:
            known.clear()
        total = 0
        for w in words:
            if (n := known.get(w)) is None:
                n = known[w] = of(w)
            total += n
        return total

    return count


def counter(vocabulary: Iterable[str]) -> Callable[[Column], Column]:
    """A column function from arrays of words to numbers of tokens; the vocabulary travels to the workers once with the function."""
    pieces = sorted(set(vocabulary))
    held: list[Callable[[list[str]], int]] = []

    @F.pandas_udf("int")
    def tokens(words: pd.Series) -> pd.Series:
        if not held:
            held.append(piece_counts(pieces))
        return words.map(lambda w: 0 if w is None else held[0](w)).astype("int32")

    return tokens


def fits(tokens: Column, most: int = LIMIT, added: int = ADDED) -> Column:
    """Whether a text's tokens, with those that a model adds, are no more than it takes."""
    return tokens + added <= most
