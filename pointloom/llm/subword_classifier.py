"""Quality classifier from supervised subword embeddings.

Every word and each of its character n-grams (with word boundaries) is hashed
to a bucket with a learned vector; a document is the mean of all its vectors;
a linear layer and softmax give the classes. Vectors and layer are trained
together by plain stochastic gradient descent in numpy, with a falling rate;
vectors take larger steps than the layer, since each has a small share of the
mean. A mean of words does not see that words repeat, so a word is spelled with
the binary length of its occurrence's number in the document from the second
one on ("ber", then "ber" with 2 twice, with 3 four times): the n-grams at its end are
then shared by all words that stand as often, and what they mean is learned.

Training takes at most ``max_docs`` labelled documents, chosen by hash of
their id, so its size is bounded whatever the corpus; scoring covers all.
The layer is linear, so a word's share of the logits is one number, which
each task remembers by word.

Defined cases: null and empty texts consist of one empty word; labels
that are null or on missing documents are ignored; several labels of one id
count as the largest; without two classes to learn from, every score is the
smoothed share of label 1; repeated rows get equal scores; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .labelled import score_documents, training_rows


#: Distinct words whose part of the score a task remembers.
WORDS_HELD = 400_000


@dataclass(frozen=True)
class SubwordSettings:
    buckets: int = 1 << 17
    width: int = 16
    shortest: int = 2
    longest: int = 4
    epochs: int = 6
    rate: float = 0.4
    vector_rate: float = 50.0
    max_docs: int = 3000
    seed: int = 7


_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def hashed(words: list[str], s: SubwordSettings) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the word) of every word and of each of its character n-grams, for all words at once."""
    marked = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts, owner, at = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(words)), sizes), np.arange(len(codes))
    stops = (starts + sizes)[owner]
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(sizes.max(initial=1)), _BASE)]))
    found = [(np.add.reduceat((codes + np.uint64(1)) * powers[at - starts[owner]], starts) if len(words) else codes, np.arange(len(words)))]
    for n in range(s.shortest, s.longest + 1):
        fits = np.flatnonzero(at + n <= stops)
        gram = np.full(len(fits), np.uint64(n))
        for k in range(n):
            gram = gram * _BASE + codes[fits + k]
        found.append((gram, owner[fits]))
    mixed = np.concatenate([h for h, _ in found]) * _MIX
    mixed = (mixed ^ mixed >> np.uint64(29)) * _MIX
    return (mixed >> np.uint64(32)).astype(np.int64) % s.buckets, np.concatenate([o for _, o in found])


def words_of(text: str) -> Counter:
    """How often each spelling of a word occurs; later occurrences are spelled with the binary length of their number."""
    counts = Counter(text.split() or [""])
    for word, times in list(counts.items()):
        counts[word] = 1
        for size in range(2, times.bit_length() + 1):
            counts[f"{word}\1{size}"] = min(times, (1 << size) - 1) - (1 << size - 1) + 1
    return counts


def features_of(text: str, s: SubwordSettings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a document and their shares, which add up to 1."""
    counts = words_of(text)
    flat, owner = hashed(list(counts), s)
    buckets, back = np.unique(flat, return_inverse=True)
    shares = np.bincount(back, np.fromiter(counts.values(), np.float64, len(counts))[owner])
    return buckets, (shares / shares.sum()).astype(np.float32)


class SubwordModel:
    """Learned vectors and layer; ``fit`` trains, ``score`` gives the chance of label 1.

    ``pulls`` has each bucket's vector times the layer's difference between
    the classes, all that scoring needs.
    """

    def __init__(self, settings: SubwordSettings, vectors=None, layer=None, constant: float | None = None):
        self.settings, self.vectors, self.layer, self.constant = settings, vectors, layer, constant
        self.pulls = None if vectors is None else (vectors @ (layer[1] - layer[0])).astype(np.float64)
        self._words: dict[str, tuple[float, int]] = {}

    def __getstate__(self):
        return {"settings": self.settings, "constant": self.constant, "pulls": self.pulls}

    def __setstate__(self, state):
        self.__dict__.update(state, vectors=None, layer=None, _words={})

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], settings: SubwordSettings = SubwordSettings()) -> SubwordModel:
        y = np.array(labels, np.int64)
        if len(set(labels)) < 2:
            return cls(settings, constant=float((y.sum() + 1) / (len(y) + 2)))
        random = np.random.default_rng(settings.seed)
        vectors = random.uniform(-1, 1, (settings.buckets, settings.width)).astype(np.float32) / settings.width
        layer = np.zeros((2, settings.width), np.float32)
        examples = [features_of(t, settings) for t in texts]
        # the rarer class weighs more, at most fourfold
        share = np.bincount(y, minlength=2) / len(y)
        weight = np.minimum(4.0, 0.5 / share)
        steps, done = settings.epochs * len(y), 0
        for _ in range(settings.epochs):
            for k in random.permutation(len(y)):
                buckets, shares = examples[k]
                rate = settings.rate * (1 - done / steps) * weight[y[k]]
                rows = vectors[buckets]
                mean = shares @ rows
                logits = layer @ mean
                chance = np.exp(logits - logits.max())
                chance /= chance.sum()
                chance[y[k]] -= 1
                pull = layer.T @ chance
                layer -= rate * np.outer(chance, mean)
                vectors[buckets] = rows - settings.vector_rate * rate * shares[:, None] * pull
                done += 1
        return cls(settings, vectors, layer)

    def _learn(self, words: set[str]) -> None:
        """For words not seen yet, (sum over their buckets, number of buckets)."""
        if len(self._words) > WORDS_HELD:
            self._words.clear()
        new = [w for w in words if w not in self._words]
        if new:
            buckets, owner = hashed(new, self.settings)
            sums = np.bincount(owner, self.pulls[buckets], len(new)).tolist()
            self._words.update(zip(new, zip(sums, np.bincount(owner, minlength=len(new)).tolist(), strict=True), strict=True))

    def score_many(self, texts: list[str]) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        counted = [words_of(t) for t in texts]
        self._learn(set().union(*counted))
        out = []
        for counts in counted:
            logit, size = 0.0, 0
            for word, times in counts.items():
                pull, n = self._words[word]
                logit += times * pull
                size += times * n
            out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, logit / size)))))
        return out

    def score(self, text: str) -> float:
        return self.score_many([text])[0]


def op10_subword_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = SubwordSettings()
    docs = documents(spark, sf_dir)
    rows = training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", 5, 0, settings.max_docs)
    model = SubwordModel.fit([t for t, _ in rows], [y for _, y in rows], settings)
    return score_documents(docs, model, 5, 0)
