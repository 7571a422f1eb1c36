"""Toxicity by multiple-instance learning: a document is a bag of sentences and toxic if any of them is.

A sentence's chance is p = sigmoid(b + the weights of its distinct words); the document's is the noisy-or 1 - prod(1 - p),
which is 1 - exp(-sum softplus(z)). Only documents have labels: the log loss of the noisy-or gives every sentence its share of the
gradient. The same sentence chances then say where a document is toxic.

A word weighs what the word itself and its beginnings weigh, so a stem is known with endings that the sample hasn't. Weights stand under the
hashes of these features; only features that go with the label in the sample have one. So a document of the sample is
its number of sentences and the few sentences with such features, and the fit is small however long texts are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import Memo, cut, map_batches, texts_of

MOST_LABELS = 8000
#: A feature needs so many documents of the sample, and so many have a weight: those whose share differs most between toxic and clean ones.
LEAST_DOCS, MOST_FEATURES = 6, 500
#: Lengths of the beginnings of words.
STEMS = range(3, 9)
MOST_WORDS = 500_000
_SENTENCE = re.compile(r"[^.!?\n…。！？]*(?:[.!?…。！？]+|\n|$)")
_WORD = re.compile(r"[^\W_]+")


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Where sentences begin and end: up to marks of the end or a line feed; those without a visible character are left out."""
    for m in _SENTENCE.finditer(text):
        if m.start() < m.end() and not m.group().isspace():
            yield m.start(), m.end()


def words(sentence: str) -> set[str]:
    return set(_WORD.findall(sentence.lower()))


def features(word: str) -> list[int]:
    """Hashes of the word and of its beginnings."""
    raw = lambda x: zlib.crc32(x.encode("utf-8", "surrogatepass"))
    return [raw(f"{word} "), *(raw(word[:k]) for k in STEMS if k <= len(word))]


@dataclass
class Model:
    bias: float
    weights: dict[int, float]

    def __post_init__(self) -> None:
        self._known = Memo(MOST_WORDS)

    def __getstate__(self) -> dict:
        return {"bias": self.bias, "weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def _word(self, word: str) -> float:
        get = self.weights.get
        found = self._known[word] = sum(get(f, 0.0) for f in features(word))
        return found

    def logit(self, sentence: str) -> float:
        known, word = self._known, self._word
        # In the order of the words, so that equal sentences have equal sums.
        return self.bias + sum(sorted([known[w] if w in known else word(w) for w in words(sentence)]))

    def sentence_scores(self, text: str) -> Iterator[tuple[int, int, float]]:
        """Begin, end and chance of each sentence."""
        self._known.make_room()
        for a, b in sentences(text):
            yield a, b, float(1 / (1 + np.exp(-np.clip(self.logit(text[a:b]), -40, 40))))

    def score(self, text: str) -> float:
        """The noisy-or of the text's sentences; without any, 0."""
        self._known.make_room()
        z = np.fromiter((self.logit(text[a:b]) for a, b in sentences(text)), float)
        return float(-np.expm1(-np.logaddexp(0, z).sum()))


@dataclass
class Bag:
    """A document of the sample: its number of sentences, and of those that have features, each one's number of them and all of them end to end."""

    sentences: int
    sizes: np.ndarray
    features: np.ndarray


def bag(text: str, known: np.ndarray) -> Bag:
    """known: sorted features; places in it stand for them."""
    sizes, found, n = [], [], 0
    for a, b in sentences(text):
        n += 1
        own = np.array([f for w in words(text[a:b]) for f in features(w)], np.uint32)
        at = np.searchsorted(known, own)
        at = np.sort(at[known[np.minimum(at, len(known) - 1)] == own]) if len(known) else at[:0]
        if len(at):
            sizes.append(len(at))
            found.append(at)
    return Bag(n, np.array(sizes, np.int32), np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32))


def fit(bags: list[Bag], labels: np.ndarray, n_features: int, epochs: int = 40, rate: float = 0.1, decay: float = 3e-5, batch: int = 256, seed: int = 5) -> tuple[float, np.ndarray]:
    """Bias and weights by Adam steps on the log loss of the noisy-or. With one class only, or no rows, no feature weighs anything and the bias follows the smoothed share of 1."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    mean = max(1.0, float(np.mean([x.sentences for x in bags]))) if bags else 1.0
    theta = np.zeros(n_features + 1)
    theta[-1] = np.log(np.expm1(-np.log1p(-share) / mean))  # so a document of mean length has the share as its score
    if len(set(labels.tolist())) < 2:
        return float(theta[-1]), theta[:-1]
    # Behind a document's sentences with features stands one for all the others, with their number.
    copies = [np.r_[np.ones(len(x.sizes)), x.sentences - len(x.sizes)] for x in bags]
    m, s, step, rng = np.zeros_like(theta), np.zeros_like(theta), 0, np.random.default_rng(seed)
    for epoch in range(epochs):
        order, now = rng.permutation(len(bags)), rate * 0.5 ** (4 * epoch / epochs)
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            times, n = np.concatenate([copies[d] for d in pick]), np.concatenate([bags[d].features for d in pick])
            counts = np.array([len(copies[d]) for d in pick])
            row = np.repeat(np.arange(len(times)), np.concatenate([np.r_[bags[d].sizes, 0] for d in pick]))
            z = theta[-1] + np.bincount(row, theta[n], minlength=len(times))
            total = np.add.reduceat(times * np.logaddexp(0, z), np.r_[0, np.cumsum(counts)[:-1]])
            # Of each sentence's softplus: 1 where the document is clean, -exp(-S) / (1 - exp(-S)) where it is toxic.
            pull = np.where(labels[pick] > 0, -1 / np.expm1(np.clip(total, 1e-6, 50)), 1.0) / len(pick)
            g = np.repeat(pull, counts) * times / (1 + np.exp(-np.clip(z, -40, 40)))
            used, back = np.unique(n, return_inverse=True)
            grad = np.r_[np.bincount(back, g[row], minlength=len(used)) + decay * theta[used], g.sum()]
            used = np.r_[used, n_features].astype(np.int64)
            step += 1
            m[used] = 0.9 * m[used] + 0.1 * grad
            s[used] = 0.99 * s[used] + 0.01 * grad * grad
            theta[used] -= now * np.sqrt(1 - 0.99**step) / (1 - 0.9**step) * m[used] / (np.sqrt(s[used]) + 1e-8)
    return float(theta[-1]), theta[:-1]


def train(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, most_features: int = MOST_FEATURES, holdout: int = 3) -> Model:
    """Learn from at most `most_labels` labelled documents with crc32(doc_id as text) mod `holdout` <> 1.

    The sample is the labels of lowest hash, so it is the same at every run; labels that are null, and documents that have
    none, teach nothing. Of several labels of one document the highest counts; rows that share a doc_id all teach.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    labels = labels.where("doc_id is not null and toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % holdout != 1)
    sample = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    # The sample has at most most_labels rows of two numbers, so it can be sent to every task. Its texts are used twice.
    known = cut(inputs(docs).join(F.broadcast(sample), "doc_id"), large=False)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(np.array([f for w in words(t) for f in features(w)], np.uint32)) for t in texts_of(batch)]
        toxic = np.repeat(np.array(batch.column("toxic").to_pylist(), np.int64), [len(x) for x in found])
        kinds, back = np.unique(np.concatenate(found) if found else np.empty(0, np.uint32), return_inverse=True)
        columns = [kinds.astype(np.int64), np.bincount(back, minlength=len(kinds)), np.bincount(back, toxic, minlength=len(kinds)).astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["feature", "docs", "toxic"])

    totals = known.agg(F.count("*").alias("docs"), F.sum("toxic").alias("toxic")).first()
    if not totals["docs"]:
        return Model(fit([], np.empty(0), 0)[0], {})
    n, ones = float(totals["docs"]), float(totals["toxic"])
    counts = map_batches(known, count, "feature long, docs long, toxic long").groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    share = F.col("docs") / n
    apart = F.abs(F.col("toxic") / max(ones, 1.0) - (F.col("docs") - F.col("toxic")) / max(n - ones, 1.0)) / F.sqrt(share * (1 - share) + 1 / n)
    best = counts.where(F.col("docs") >= LEAST_DOCS).orderBy(apart.desc(), "feature").limit(most_features).select("feature")
    keys = np.sort(np.array([r["feature"] for r in best.collect()], np.uint32))
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [bag(t, shared.value) for t in texts_of(batch)]
        columns = [batch.column("toxic"), batch.column("doc_id"), pa.array([x.sentences for x in made], pa.int32()), pa.array([x.sizes for x in made], pa.list_(pa.int32())), pa.array([x.features for x in made], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, ["toxic", "doc_id", "n", "sizes", "features"])

    got = map_batches(known, make, "toxic int, doc_id long, n int, sizes array<int>, features array<int>").toArrow().to_pydict()
    rows = sorted(zip(got["doc_id"], got["toxic"], got["n"], got["sizes"], got["features"], strict=True))
    bags = [Bag(r[2], np.array(r[3], np.int32), np.array(r[4], np.int32)) for r in rows]
    bias, weights = fit(bags, np.array([r[1] for r in rows], float), len(keys))
    return Model(bias, {k: w for k, w in zip(keys.tolist(), weights.tolist(), strict=True) if w})


def inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def toxicity_scores(docs: DataFrame, model: Model, threshold: float = 0.7, holdout: int = 3) -> DataFrame:
    """docs: doc_id long, text string; other columns are ignored.

    Returns doc_id, held_out (crc32(doc_id as text) mod `holdout` = 1), score and predicted (1 if score >= threshold) for each row. A text
    without a sentence (null, empty or blank) scores 0; a null doc_id is not held out; repeated rows stay; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shared.value.score(t) for t in texts_of(batch)], pa.float64())], ["doc_id", "score"])

    return map_batches(inputs(docs), make, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % holdout == 1, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def offending_sentences(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The sentences whose own chance is at least `threshold`: doc_id, begin and end (code points, the end behind it), score and sentence.

    Texts are read as toxicity_scores reads them; documents without such a sentence have no row; repeated rows give repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(d, a, b, p, t[a:b]) for d, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True) for a, b, p in shared.value.sentence_scores(t) if p >= threshold]
        kinds = {"doc_id": pa.int64(), "begin": pa.int64(), "end": pa.int64(), "score": pa.float64(), "sentence": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    return map_batches(inputs(docs), make, "doc_id long, begin long, end long, score double, sentence string")
