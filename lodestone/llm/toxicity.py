"""Toxicity from class-conditional Kneser-Ney models of characters.

Two models, one of toxic and one of ordinary documents, share their lower orders: only the highest order has counts of
its own class, and what it has not seen backs off to continuation counts pooled over both classes, so a rare expression
neither class has shown weighs nothing. Texts are lower-cased runs of letters, each padded at its ends. The difference
of log-likelihoods is length-normalised, per character, over the whole text and over its most telling window of
``window`` words (a single word by default: an insult in a long text); a logistic calibration of both gives the score.

Counts and calibration come from a bounded sample of labelled rows: at most ``fit_docs`` of each class, taken by a hash
of the id, two thirds for the counts and one third for the calibration. A row of the calibration weighs as many rows as
it stands for, so the score is a probability at the labels' own share of toxic rows, however many are sampled. Executors
count; the driver gets the distinct n-grams of that sample.

Defined results: null or empty text, and text without letters, has both differences 0 and the score that calibration
gives them; a very long text is scored whole; equally telling windows give one peak; without labels of both classes every score is 0; repeated rows give repeated results; labels that
contradict each other count once each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordTable, bound_batches, once_per_worker, per_batch, segment_sums, stored, texts

ORDER = 5
#: Characters are taken modulo this many codes; an n-gram of ORDER of them is one integer.
CODES = 4096
_BITS = 12
_WORD = re.compile(r"[^\W\d_]+")
_EDGE = "\x01"


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Padded words as one array of character codes, and the padded lengths."""
    text = "".join(_EDGE * (ORDER - 1) + w + _EDGE for w in words)
    flat = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) % np.uint64(CODES)
    return flat, np.fromiter(map(len, words), np.int64, len(words)) + ORDER


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the highest order of all words, and how many each word has."""
    flat, lengths = codes(words)
    n = len(flat) - ORDER + 1
    key = np.zeros(max(n, 0), np.uint64)
    for i in range(ORDER):
        key = (key << np.uint64(_BITS)) | flat[i : i + len(key)]
    ends = np.cumsum(lengths)
    inside = np.ones(len(key), bool)
    for k in range(1, ORDER):  # those that would reach into the next word
        inside[np.minimum(ends[:-1] - k, len(key) - 1)] = False
    return key[inside], lengths - ORDER + 1


def _tail(key: np.ndarray, order: int) -> np.ndarray:
    return key & np.uint64((1 << (_BITS * order)) - 1)


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows of values at the wanted keys; 0 where there is none."""
    if not len(keys):
        return np.zeros((len(wanted), *values.shape[1:]))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = values[at].astype(float)
    found[keys[at] != wanted] = 0
    return found


def _by_context(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts (keys without their last character), with summed counts and the number of kinds that follow."""
    contexts, where = np.unique(keys >> np.uint64(_BITS), return_inverse=True)
    total = np.stack([np.bincount(where, c, len(contexts)) for c in counts.T], 1)
    kinds = np.stack([np.bincount(where, c > 0, len(contexts)) for c in counts.T], 1)
    return contexts, total, kinds


@dataclass(frozen=True)
class ToxicityModel:
    """levels: for each order from 1, n-grams with counts (pooled, but by class at the last), and their contexts."""

    levels: tuple
    discount: float
    weights: tuple[float, float, float]
    window: int


def kneser_ney(top: np.ndarray, counts: np.ndarray) -> tuple:
    """The levels of a model from the distinct n-grams of the highest order and their counts (toxic, ordinary)."""
    order = np.argsort(top)
    levels = [(top[order], counts[order].astype(float))]
    kinds = top
    for n in range(ORDER - 1, 0, -1):
        kinds, found = np.unique(_tail(kinds, n), return_counts=True)
        levels.append((kinds, found.astype(float)[:, None]))
    return tuple((k, c, *_by_context(k, c)) for k, c in reversed(levels))


def differences(levels: tuple, discount: float, words: list[str]) -> np.ndarray:
    """For each word: log-likelihood as toxic less that as ordinary, and its number of characters with the end mark."""
    if not words:
        return np.zeros((0, 2))
    key, per_word = grams(words)
    p = np.full((len(key), 1), 1.0 / CODES)
    for n, (keys, counts, contexts, total, kinds) in enumerate(levels, 1):
        own = _tail(key, n)
        context = own >> np.uint64(_BITS)
        count, sums, follow = _find(keys, counts, own), _find(contexts, total, context), _find(contexts, kinds, context)
        seen = np.maximum(sums, 1)
        p = np.where(sums > 0, (np.maximum(count - discount, 0) + discount * follow * p) / seen, p)
    gain = np.log(p[:, 0]) - np.log(p[:, -1])
    return np.stack([segment_sums(gain, per_word), per_word.astype(float)], 1)


class Scorer:
    """Features of texts: the two length-normalised differences."""

    def __init__(self, model: ToxicityModel):
        self.window = model.window
        self.known = WordTable(lambda words: differences(model.levels, model.discount, words))

    def features(self, column: list[str]) -> np.ndarray:
        words: list[str] = []
        lengths = np.zeros(len(column), np.int64)
        for i, text in enumerate(column):
            own = _WORD.findall(text.lower())
            words += own
            lengths[i] = len(own)
        rows = self.known.rows(words)
        total = np.zeros((len(rows) + 1, 2))
        np.cumsum(rows, axis=0, out=total[1:])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        whole = total[ends] - total[starts]
        out = np.zeros((len(column), 2))
        out[:, 0] = whole[:, 0] / np.maximum(whole[:, 1], 1)
        stop = np.minimum(np.arange(len(rows)) + self.window, np.repeat(ends, lengths))
        start = np.maximum(stop - self.window, np.repeat(starts, lengths))
        part = total[stop] - total[start]
        telling = part[:, 0] / np.maximum(part[:, 1], 1)
        full = np.flatnonzero(lengths)
        if len(full):
            out[full, 1] = np.maximum.reduceat(telling, starts[full])
        return out


def _features(docs: DataFrame, model: ToxicityModel, score: bool, *also: str) -> DataFrame:
    spark = docs.sparkSession
    bound_batches(spark)
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = once_per_worker(key, lambda: Scorer(sent.value))
        found = scorer.features(batch["text"].to_pylist())
        own = [probability(found, sent.value.weights)] if score else [found[:, 0], found[:, 1]]
        return pa.record_batch([batch["doc_id"], *(batch[c] for c in also), *map(pa.array, own)], names=["doc_id", *also, *(["score"] if score else ["mean", "peak"])])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in also}
    names = [f"{c} {k}" for c, k in {"doc_id": "long", **kinds, **({"score": "double"} if score else {"mean": "double", "peak": "double"})}.items()]
    return texts(docs, *also).mapInArrow(per_batch(run), ", ".join(names))


def probability(features: np.ndarray, weights: tuple[float, float, float]) -> np.ndarray:
    """The calibrated score."""
    z = weights[0] + features @ np.array(weights[1:])
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def calibrated(features: np.ndarray, toxic: np.ndarray, stands_for: np.ndarray, penalty: float = 1e-5, rounds: int = 60) -> tuple[float, float, float]:
    """Weights of a logistic fit by Newton's method, on scaled features with a small penalty; a row counts ``stands_for`` times."""
    part = stands_for / stands_for.sum()
    scale = np.maximum(np.abs(features).max(axis=0), 1e-9)
    x = np.column_stack([np.ones(len(features)), features / scale])
    w = np.zeros(3)
    ridge = penalty * np.diag([1e-3, 1, 1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (part * (toxic - p)) - ridge @ w
        bend = (x.T * (part * (p * (1 - p) + 1e-9))) @ x + ridge
        w = w + np.clip(np.linalg.solve(bend, slope), -5, 5)
    return float(w[0]), float(w[1] / scale[0]), float(w[2] / scale[1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, fit_docs: int = 4000, window: int = 1) -> ToxicityModel | None:
    """Learns from labelled rows (doc_id, toxic) where ``learn`` holds; None without rows of both classes."""
    bound_batches(docs.sparkSession)
    marks = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    if learn is not None:
        marks = marks.where(learn)
    n = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    dealt = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20))
    rates = [min(1.0, fit_docs / n[c]) for c in (0, 1)]
    share = F.when(F.col("toxic") == 1, rates[1]).otherwise(rates[0])
    # about twice fit_docs rows at most, so they can be broadcast and no text is shuffled
    marks = marks.where(dealt < share * (1 << 20)).withColumn("calibrate", F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(3)) == 0)
    sample = stored(texts(docs).join(F.broadcast(marks), "doc_id").select("doc_id", "text", "toxic", "calibrate"), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch["toxic"].to_pylist()
            found: list[list[str]] = [[], []]
            for text, toxic in zip(batch["text"].to_pylist(), marks):
                found[toxic] += _WORD.findall(text.lower())
            for toxic in (0, 1):
                keys, n = np.unique(grams(found[toxic])[0] if found[toxic] else np.zeros(0, np.uint64), return_counts=True)
                yield pa.record_batch([pa.array(keys.astype(np.int64)), pa.array(n * toxic), pa.array(n * (1 - toxic))], names=["gram", "toxic", "plain"])

    counted = sample.where("not calibrate").select("text", "toxic").mapInArrow(count, "gram long, toxic long, plain long")
    top = counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")).toPandas()
    levels = kneser_ney(top["gram"].to_numpy().astype(np.uint64), top[["toxic", "plain"]].to_numpy())
    once, twice = (int((top[["toxic", "plain"]].to_numpy() == k).sum()) for k in (1, 2))
    draft = ToxicityModel(levels, once / max(1, once + 2 * twice), (0.0, 0.0, 0.0), window)
    held = _features(sample.where("calibrate"), draft, False, "toxic").toPandas()
    if held["toxic"].nunique() < 2:
        held = _features(sample, draft, False, "toxic").toPandas()
    toxic = held["toxic"].to_numpy()
    weights = calibrated(held[["mean", "peak"]].to_numpy(), toxic, 1 / np.array(rates)[toxic])
    return ToxicityModel(levels, draft.discount, weights, window)


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """doc_id and score (0 to 1, higher is likelier toxic) of every document."""
    if model is None:
        return texts(docs).select("doc_id", F.lit(0.0).alias("score"))
    return _features(docs, model, True)
