"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence s has the probability
p(s) = sigmoid(z(s)), z(s) = bias + weights of its distinct words, where a word's
weight is the sum over the word itself and its beginnings of 3 to 6 letters
(inflected insults share a stem), and a document is toxic if any of its
sentences is (noisy-or).  In a noisy-or of all sentences length alone would
make a document toxic; so what a sentence without learned words has counts
once for the document (the leak), and a sentence adds what its words raise it
over that, weak rises by their square:

    P(document) = 1 - exp(-q),    q = leak + sum(gain(z(s))),    leak = softplus(bias)
    gain(z) = max(0, softplus(z) - leak) ** 2 / softplus(z)

The gain is smooth in z, nothing for a sentence that its words don't raise,
and near softplus(z), the noisy-or's own term, for one that they raise much.  Weights and bias are trained by this very likelihood, from document
labels alone; sentence scores come with them and locate the offending
sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import text_slices

SENTENCE_END = re.compile(r"(?<=[.!?\n])")
WORD = re.compile(r"\w+")
MAX_CACHE = 300_000


def sentence_words(text: str) -> list[tuple[int, int, set[str]]]:
    """(start, end, distinct lower-case words) of each sentence that has words."""
    out, at = [], 0
    for s in SENTENCE_END.split(text):
        words = set(WORD.findall(s.lower()))
        if words:
            out.append((at, at + len(s), words))
        at += len(s)
    return out


def word_features(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in range(3, 7) if n <= len(word))]


class WordWeights(dict):
    """Weight of a word, summed over its features when first met."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > MAX_CACHE:
            self.clear()
        get = self.weights.get
        value = self[word] = sum([get(f, 0.0) for f in word_features(word)])
        return value


@dataclass
class Model:
    bias: float
    weights: dict[str, float]

    def sentence_scores(self, sentences: list[tuple[int, int, set[str]]]) -> np.ndarray:
        look = self.__dict__.setdefault("_words", WordWeights(self.weights)).__getitem__
        return np.array([sum(map(look, words)) for _, _, words in sentences], float) + self.bias

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights}

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of a text and (start, end, probability) of its sentences.

        A text without words has the score of the leak alone.
        """
        sentences = sentence_words(text)
        z = self.sentence_scores(sentences)
        p = 1 / (1 + np.exp(-z))
        own, leak = np.logaddexp(0, z), np.logaddexp(0, self.bias)
        q = leak + (np.maximum(own - leak, 0) ** 2 / own).sum()
        return float(-np.expm1(-q)), [(a, b, float(x)) for (a, b, _), x in zip(sentences, p)]


def _informative(bags: list, toxic: np.ndarray, min_documents: int, min_chi2: float) -> tuple[dict[str, int], np.ndarray]:
    """Numbers of the features whose presence depends on the label (chi-square of the 2 x 2 table), and 1 for
    those that stand in a larger share of the toxic documents, else 0."""
    seen = [Counter(), Counter()]
    for bag, y in zip(bags, toxic):
        words = set().union(*[s[2] for s in bag]) if bag else set()
        seen[int(y > 0)].update({f for w in words for f in word_features(w)})
    pos, neg = float((toxic > 0).sum()), float((toxic <= 0).sum())
    names = [f for f in seen[0].keys() | seen[1].keys() if seen[0][f] + seen[1][f] >= min_documents]
    a, b = (np.array([seen[k][f] for f in names], float) for k in (1, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = (pos + neg) * (a * (neg - b) - b * (pos - a)) ** 2 / (pos * neg * (a + b) * (pos + neg - a - b))
    kept = {f: float(x * neg > y * pos) for f, c, x, y in sorted(zip(names, chi2, a, b)) if c >= min_chi2}
    return {f: i for i, f in enumerate(kept)}, np.array(list(kept.values()), float)


def loss_and_gradient(theta: np.ndarray, words: np.ndarray, sentence: np.ndarray, document: np.ndarray, share: np.ndarray,
                      toxic: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted log loss and its gradient by the weights and the bias (the last of ``theta``).

    ``words`` has the feature and ``sentence`` the sentence of each occurrence,
    ``document`` the document of each sentence.
    """
    bias = theta[-1]
    z = bias + np.bincount(sentence, theta[words], len(document))
    own, leak = np.logaddexp(0, z), np.logaddexp(0, bias)
    rise = np.maximum(1 - leak / own, 0)
    q = leak + np.bincount(document, own * rise ** 2, len(toxic))
    loss = -(share * np.where(toxic > 0, np.log(-np.expm1(-np.maximum(q, 1e-9))), -q)).sum()
    by_document = share * np.where(toxic > 0, -1 / np.expm1(np.clip(q, 1e-9, 500)), 1.0)
    # slopes of the gain: 1 - (1 - rise)^2 by softplus(z), -2 * rise by the leak
    by_sentence = by_document[document] * rise * (2 - rise) / (1 + np.exp(-z))
    from_leak = by_document.sum() - 2 * (by_document[document] * rise).sum()
    from_bias = by_sentence.sum() + from_leak / (1 + np.exp(-bias))
    return float(loss), np.append(np.bincount(words, by_sentence[sentence], len(theta) - 1), from_bias)


def fit(texts: list[str], toxic: np.ndarray, importance: np.ndarray, min_documents: int = 3, min_chi2: float = 10.0,
        steps: int = 200, rate: float = 0.1, penalty: float = 2e-5) -> Model:
    """Weighted log loss of the documents' probabilities, minimised by Adam with an L1 penalty.

    Features that a larger share of the toxic documents has than of the others
    start with a weight of 1: at 0 no sentence is raised and nothing would move.
    """
    bags = [sentence_words(t) for t in texts]
    vocabulary, more = _informative(bags, toxic, min_documents, min_chi2)
    words, sentence, document = [], [], []
    for d, bag in enumerate(bags):
        for _, _, ws in bag or [(0, 0, set())]:
            ids = [vocabulary[f] for w in ws for f in word_features(w) if f in vocabulary]
            sentence += [len(document)] * len(ids)
            words += ids
            document.append(d)
    words, sentence, document = (np.array(x, np.int64) for x in (words, sentence, document))
    share = importance / importance.sum()
    prior = float(np.clip((share * toxic).sum(), 1e-4, 1 - 1e-4))
    theta = np.zeros(len(vocabulary) + 1)
    theta[-1] = np.log(prior) - 1
    theta[:-1] = more
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        _, grad = loss_and_gradient(theta, words, sentence, document, share, toxic)
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad * grad
        theta -= rate * (mean / (1 - 0.9 ** t)) / (np.sqrt(square / (1 - 0.999 ** t)) + 1e-8)
        # soft threshold: what no document needs stays zero
        size = rate * penalty / (np.sqrt(square[:-1] / (1 - 0.999 ** t)) + 1e-8)
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - size, 0)
    return Model(float(theta[-1]), {w: float(theta[i]) for w, i in vocabulary.items() if theta[i]})


def within(sizes: list[tuple], left: dict[int, int]) -> list:
    """Ids of the (id, label, characters) that take at most half of what is left for their label, in turn."""
    left, taken = dict(left), []
    for d, y, n in sizes:
        if 2 * n <= left[y]:
            left[y] -= n
            taken.append(d)
    return taken


def train(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_toxic: int = 1_000, max_clean: int = 3_000, total_chars: int = 32_000_000) -> Model:
    """Model from a bounded sample of the labelled rows for which ``allowed`` holds.

    The sample has at most ``max_toxic`` and ``max_clean`` documents, taken in
    the order of a hash of the id, and about ``total_chars`` characters, which
    the classes share as they do the documents.  A text of any length goes in
    if it takes at most half of the characters its class has left, so a few
    long ones never crowd out the others.  Weights restore the labels' own
    proportions.  A null id or label is left out; an id with several labels is
    toxic if any says so, and of several texts of an id the one with the least
    digest is taken.  Without both classes the
    model is the prior alone.
    """
    spark = docs.sparkSession
    truth = labels.where(allowed & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.max(label_col).alias("__y"))
    sizes = {r["__y"]: r["count"] for r in truth.groupBy("__y").count().collect()}
    picked = [(r[0], y) for y, most in ((1, max_toxic), (0, max_clean))
              for r in truth.where(F.col("__y") == y).orderBy(F.xxhash64(id_col), id_col).limit(most).select(id_col).collect()]
    if not picked:
        return Model(-5.0, {})
    chosen = spark.createDataFrame(picked, StructType([StructField("__id", truth.schema[0].dataType),
                                                       StructField("__y", LongType())]))
    # at most max_toxic + max_clean rows of an id and a label
    sample = docs.where(F.col(text_col).isNotNull()).join(F.broadcast(chosen), F.col(id_col) == F.col("__id"))
    chars = {r["__id"]: r["n"] for r in sample.groupBy("__id").agg(F.max(F.char_length(text_col)).alias("n")).collect()}
    fit_in = within([(d, y, chars[d]) for d, y in picked if d in chars],
                    {y: total_chars * most // (max_toxic + max_clean) for y, most in ((1, max_toxic), (0, max_clean))})
    taken = F.broadcast(spark.createDataFrame([(d,) for d in fit_in], StructType(chosen.schema.fields[:1])))
    rows = sample.join(taken, "__id", "left_semi").select(
        F.col("__id"), F.col("__y"), F.col(text_col).alias("__t"))
    # of repeated ids the text with the least digest
    rows = rows.groupBy("__id", "__y").agg(F.min_by("__t", F.sha2(F.col("__t").cast("binary"), 256)).alias("__t")).orderBy(
        "__id").collect()
    toxic = np.array([r["__y"] for r in rows], float)
    found = {y: max(int((toxic == y).sum()), 1) for y in (0, 1)}
    if not len(rows):
        return Model(-5.0, {})
    importance = np.array([sizes[r["__y"]] / found[r["__y"]] for r in rows], float)
    return fit([r["__t"] for r in rows], toxic, importance)


def score(docs: DataFrame, model: Model, text_col: str = "text", sentence_threshold: float = 0.1,
          score_col: str = "score", offending_col: str = "offending") -> DataFrame:
    """``docs`` with ``score`` and ``offending``: (start, end, score) of sentences at or over the threshold.

    Positions are in code points.  A null text counts as empty and gets the
    score of a sentence without words.  Columns of ``docs`` with the two names
    are replaced; repeated rows stay.
    """
    kept = [c for c in docs.columns if c not in (score_col, offending_col)]
    frame = docs.select(*kept)
    span = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())])
    schema = StructType([*frame.schema.fields, StructField(score_col, DoubleType()), StructField(offending_col, ArrayType(span))])
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for part, texts in text_slices(batches, text_col):
            got = [model.score(t) for t in texts]
            bad = [[{"start": a, "end": b, "score": p} for a, b, p in s if p >= sentence_threshold] for _, s in got]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in got], pa.float64()), pa.array(bad, spans)],
                                             [*kept, score_col, offending_col])

    return frame.mapInArrow(run, schema)
