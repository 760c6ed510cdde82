import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import toxicity


def test_a_score_means_the_same_whatever_is_sampled(spark):
    """A word that 400 toxic and 540 ordinary documents have isn't toxic to 70 percent, however few ordinary ones are taken."""
    random.seed(11)
    plain = ["river", "garden", "window", "market", "letter", "bridge", "summer", "paper"]
    rows = []
    for i in range(4000):
        toxic = int(i < 400)
        words = random.choices(plain, k=12) + ["".join(random.choices("abdeginorstu", k=5)) for _ in range(3)]
        if toxic or i < 940:
            words.append("grumble")
        if i < 200:
            words.append("vilest")
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4).cache()
    flagged = []
    for fit_docs in (4000, 400):
        model = toxicity.fit(docs, docs.select("doc_id", "toxic"), fit_docs=fit_docs)
        flagged.append(toxicity.score(docs, model).where(F.col("score") >= 0.7).count())
    assert 200 <= flagged[0] < 400 and abs(flagged[0] - flagged[1]) < 40  # a hundredth of the rows


def plain_kneser_ney(texts, discount):
    """Log-likelihoods of a word, as toxic and as ordinary: the highest order by class, the others shared by what precedes them."""
    edge, order = toxicity._EDGE, toxicity.ORDER
    cut = lambda w: [(edge * (order - 1) + w + edge)[i : i + order] for i in range(len(w) + 1)]
    top = [Counter(g for w in words for g in cut(w)) for words in texts]
    kinds, levels = set(top[0]) | set(top[1]), {}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[-n:] for g in kinds)
        kinds = set(levels[n])

    def likelihood(gram, counts):
        p = 1 / toxicity.CODES
        for n in range(1, order + 1):
            held = counts if n == order else levels[n]
            same = {g: c for g, c in held.items() if g[:-1] == gram[-n:-1] and c}
            if sum(same.values()):
                p = (max(same.get(gram[-n:], 0) - discount, 0) + discount * len(same) * p) / sum(same.values())
        return p

    return lambda w: [sum(math.log(likelihood(g, counts)) for g in cut(w)) for counts in top]


def test_differences_equal_a_plain_kneser_ney():
    texts = [["scum", "scum", "trash", "the", "idiots"], ["the", "then", "trust", "thing", "ideas", "the", "sculpture"]]
    keys = [np.unique(toxicity.grams(words)[0], return_counts=True) for words in texts]
    every = np.unique(np.concatenate([k for k, _ in keys]))
    counts = np.zeros((len(every), 2))
    for column, (k, n) in enumerate(keys):
        counts[np.searchsorted(every, k), column] = n
    plain, words = plain_kneser_ney(texts, 0.7), ["scum", "the", "scums", "zebra", "a", "trash", "ideas"]
    found = toxicity.differences(toxicity.kneser_ney(every, counts), 0.7, words)
    for word, (gain, length) in zip(words, found):
        toxic, ordinary = plain(word)
        assert abs(gain - (toxic - ordinary)) < 1e-9 and length == len(word) + 1
