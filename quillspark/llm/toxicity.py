"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has the probability
p = sigmoid(b + sum of the weights of its words' features); the document's is
the noisy-or 1 - prod(1 - p). Weights are learned from document labels alone by
gradient descent on the noisy-or likelihood, kept at 0 or above (no word makes
a sentence harmless) with an L1 penalty, on a bounded sample of labelled
rows (TRAIN_POSITIVE + TRAIN_NEGATIVE documents of at most TRAIN_DOC_CHARS
characters, chosen by a hash of doc_id; the classes are weighted back to their
true shares). The sentence scores then
say where the offence stands.

A word's features are the word and its first letters, so that unseen endings
of a known stem still count.

Cases: a null text or one without words scores 0. Without labels of both
classes every score is 0. Documents with several label rows take the highest.
Rows with equal doc_id are each scored; of equally bad sentences the first is
the worst. Very long texts are scored whole, but not learned from. score()
replaces columns of its own names and keeps all others; locate() reads doc_id
and text. Empty tables give an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TRAIN_POSITIVE, TRAIN_NEGATIVE = 1500, 2500
#: Longer documents aren't trained on, so that the sample has a size bound; they are scored like all others.
TRAIN_DOC_CHARS = 30_000
THRESHOLD = 0.3
PREFIXES = (3, 4, 5, 6)
#: Words whose weight a worker remembers.
MEMORY_WORDS = 500_000
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_ENDS = frozenset(".!?\n")


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}~" for k in PREFIXES if len(word) > k)]


def sentences(text: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for token in _TOKEN.findall(text.lower()):
        if token in _ENDS:
            out.append([])
        else:
            out[-1].append(token)
    return [s for s in out if s]


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.words = weights, bias, {}

    def word(self, word: str) -> float:
        if len(self.words) > MEMORY_WORDS:
            self.words.clear()
        w = self.words[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return w

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: probability, sentences, the worst sentence's number (-1: none) and its probability."""
        score, count, worst, top = np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.full(len(texts), -1), np.zeros(len(texts))
        known = self.words
        for i, text in enumerate(texts):
            tokens = _TOKEN.findall(text.lower()) if text else []
            got = list(map(known.get, tokens))
            if None in got:
                got = [g if g is not None else np.inf if t in _ENDS else self.word(t) for t, g in zip(tokens, got, strict=True)]
            w = np.array(got)
            ends = np.isinf(w)
            number = np.cumsum(ends)[~ends]  # of each word's sentence; those without words have none
            if not len(number):
                continue
            new = np.concatenate([[True], number[1:] != number[:-1]])
            z = np.add.reduceat(w[~ends], np.flatnonzero(new)) + self.bias
            soft = np.logaddexp(0, z)
            score[i], count[i], worst[i] = -np.expm1(-soft.sum()), len(z), z.argmax()
            top[i] = 1 / (1 + np.exp(-np.clip(z.max(), -500, 500)))
        return score, count, worst, top


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.flatnonzero(np.diff(values, prepend=-1))]


class Bags:
    """Texts as bags of sentences: the arrays that the likelihood needs."""

    def __init__(self, texts: list[str], least_docs: int = 1):
        known, number = {}, {}
        owner, sent, word = [], [], []
        for d, text in enumerate(texts):
            for words in sentences(text or ""):
                word.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
                sent.append(np.full(len(words), len(owner)))
                owner.append(d)
        none = [np.zeros(0, np.int64)]
        self.docs, self.words = len(texts), len(known)
        self.owner, self.sent, self.word = np.array(owner, np.int64), np.concatenate(sent or none), np.concatenate(word or none)
        pairs = [(k, number.setdefault(f, len(number))) for w, k in known.items() for f in features(w)]
        of, feature = np.array(pairs, np.int64).reshape(-1, 2).T
        # documents of each feature: distinct (word, document), spread over the word's features
        held = _distinct(self.word * self.docs + self.owner[self.sent]) if owner else none[0]
        first, times = np.searchsorted(of, held // max(1, self.docs)), np.bincount(of, minlength=self.words)[held // max(1, self.docs)]
        spread = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
        seen = _distinct(feature[spread] * self.docs + np.repeat(held % max(1, self.docs), times))
        keep = np.bincount(seen // max(1, self.docs), minlength=len(number)) >= least_docs
        self.names = [f for f, k in zip(number, keep, strict=True) if k]
        self.of, self.feature = of[keep[feature]], (np.cumsum(keep) - 1)[feature[keep[feature]]]

    def likelihood(self, w: np.ndarray, b: float, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, float]:
        """The weighted negative log of the noisy-or likelihood, and its slopes in w and b."""
        per_word = np.bincount(self.of, weights=w[self.feature], minlength=self.words)
        z = np.bincount(self.sent, weights=per_word[self.word], minlength=len(self.owner)) + b
        # -log of the chance that no sentence is toxic
        total = np.maximum(np.bincount(self.owner, weights=np.logaddexp(0, z), minlength=self.docs), 1e-6)
        loss = (weight * np.where(y, -np.log(-np.expm1(-total)), total)).sum()
        back = (np.where(y, -1 / np.expm1(np.minimum(total, 500)), 1.0) * weight)[self.owner] / (1 + np.exp(-z))
        of_word = np.bincount(self.word, weights=back[self.sent], minlength=self.words)
        return float(loss), np.bincount(self.feature, weights=of_word[self.of], minlength=len(self.names)), float(back.sum())


def fit(texts: list[str], labels: np.ndarray, share: float, rounds: int = 80, least_docs: int = 3, rate: float = 0.3, decay: float = 2e-5) -> Model:
    """share: the true share of label 1. Adam on the weighted noisy-or likelihood."""
    bags = Bags(texts, least_docs)
    if not len(bags.owner) or len(set(labels.tolist())) < 2:
        return Model({}, -50.0)
    y = labels.astype(bool)
    weight = np.where(y, share / y.sum(), (1 - share) / (~y).sum())
    n = len(bags.names)
    w, b = np.zeros(n), np.log(share / (len(bags.owner) / bags.docs))
    mean, var, mean_b, var_b = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, rounds + 1):
        _, grad, grad_b = bags.likelihood(w, b, y, weight)
        grad = grad + decay
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        mean_b, var_b = 0.9 * mean_b + 0.1 * grad_b, 0.999 * var_b + 0.001 * grad_b**2
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w = np.maximum(0.0, w - rate * (mean / c1) / (np.sqrt(var / c2) + 1e-8))
        b -= rate * (mean_b / c1) / (np.sqrt(var_b / c2) + 1e-8)
    return Model({f: float(v) for f, v in zip(bags.names, w, strict=True) if abs(v) > 1e-3}, float(b))


def train(docs: DataFrame, labels: DataFrame, positive: int = TRAIN_POSITIVE, negative: int = TRAIN_NEGATIVE) -> Model:
    """Learns from docs (doc_id, text) and labels (doc_id, toxic); rows without either aren't read."""
    labels = common.only(labels, "doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {bool(r["toxic"]): r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model({}, -50.0)
    chosen = common.sample_below(labels.filter("toxic = 1"), "doc_id", positive, counts[True]).unionByName(common.sample_below(labels.filter("toxic <> 1"), "doc_id", negative, counts[False]))
    texts = common.only(docs, "doc_id", "text").filter(F.length("text") <= TRAIN_DOC_CHARS)
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy("doc_id").select("text", "toxic").toPandas()
    return fit(rows["text"].tolist(), rows["toxic"].to_numpy(), counts[True] / (counts[True] + counts[False]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score, predicted, n_sentences, worst_sentence (from 0) and worst_score."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.drop("score", "predicted", "n_sentences", "worst_sentence", "worst_score")
    shared = spark.sparkContext.broadcast((model.weights, model.bias))
    names = ["score", "n_sentences", "worst_sentence", "worst_score"]
    models: list[Model] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not models:
            models.append(Model(*shared.value))
        found = models[0].score(batch.column(batch.schema.get_field_index("text")).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], names=[*batch.schema.names, *names])

    schema = docs.withColumns({"score": F.lit(0.0), "n_sentences": F.lit(0).cast("bigint"), "worst_sentence": F.lit(0).cast("bigint"), "worst_score": F.lit(0.0)}).schema
    return docs.mapInArrow(common.per_batch(work), schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def locate(docs: DataFrame, model: Model, least: float = 0.1) -> DataFrame:
    """One row per offending sentence: doc_id, start, end (code points of the text), sentence, score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        m, rows = Model(*shared.value), []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for part in re.finditer(r"[^.!?\n]+", text or ""):
                words = [w for s in sentences(part[0]) for w in s]
                p = 1 / (1 + np.exp(-(m.bias + sum(map(m.word, words))))) if words else 0.0
                if p >= least:
                    rows.append((doc, part.start(), part.end(), part[0].strip(), float(p)))
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["doc_id", "start", "end", "sentence", "score"])

    return common.only(docs, "doc_id", "text").mapInArrow(common.per_batch(work), "doc_id bigint, start bigint, end bigint, sentence string, score double")
