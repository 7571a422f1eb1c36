"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum (v_if x_i)^2]), in time linear in the
document's distinct features. It is fitted on the driver from a bounded sample of labelled documents
(`most_labels`), whose sparse features are made on the executors; scoring is one pass over the texts.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import map_batches, texts_of

WORD_BUCKETS = 1 << 15
RANK = 4
#: Bins of each statistic; every bin is a feature.
STAT_BINS = 12
STATS = (
    "log_chars", "log_words", "mean_word", "upper_share", "digit_share", "symbol_share", "space_share",
    "distinct_words", "distinct_lines", "log_lines", "words_a_line", "symbol_words", "top_word", "meta_log_n_chars",
)
N_FEATURES = WORD_BUCKETS + len(STATS) * STAT_BINS
MOST_LABELS = 8000
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SYMBOL[[ord(c) for c in ".,"]] = False
_ODD_END = re.compile(rb"[!-+\-/:-@\[-`{-~](?=[ \n]|$)")


def features(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (distinct, ascending) and values of one text; words count by the root of their share."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.lower().split()
    n = len(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(1, len(data))
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = lambda mask: counts[mask].sum() / size
    if n:
        codes, times = np.unique(np.fromiter(map(zlib.crc32, words), np.uint32, n), return_counts=True)
        buckets, at = np.unique(codes % WORD_BUCKETS, return_inverse=True)
        values = np.sqrt(np.bincount(at, times) / n)
    else:
        codes, times, buckets, values = np.empty(0), np.zeros(1), np.empty(0, np.int64), np.empty(0)
    log = lambda x: np.log2(1 + x)
    unit = lambda x: x * STAT_BINS
    stats = (
        log(len(text)) / 1.6, log(n) / 1.4, (size / max(1, n)) / 1.5, unit(share(_UPPER)) * 2, unit(share(_DIGIT)) * 4, unit(share(_SYMBOL)) * 3, unit(share(_SPACE)) * 2,
        unit(len(codes) / max(1, n)) * 0.999, unit(len(set(lines)) / max(1, len(lines))) * 0.999, log(len(lines)), log(n / max(1, len(lines))), unit(len(_ODD_END.findall(data)) / max(1, n)),
        unit(times.max() / max(1, n)) * 2, log(n_chars or 0) / 1.6,
    )
    own = [WORD_BUCKETS + i * STAT_BINS + min(STAT_BINS - 1, max(0, int(s))) for i, s in enumerate(stats)]
    return np.concatenate([buckets.astype(np.int64), own]), np.concatenate([values, np.full(len(own), 0.5)])


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.empty(len(rows))
        for i, (at, x) in enumerate(rows):
            v = self.factors[at] * x[:, None]
            out[i] = self.bias + self.weights[at] @ x + 0.5 * (np.square(v.sum(axis=0)).sum() - np.square(v).sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, rate: float = 0.05, decay: float = 1e-4, batch: int = 128, seed: int = 7) -> Model:
    """Adam steps on the log loss. With one class only, or no rows, the model is the smoothed share of 1."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    rng = np.random.default_rng(seed)
    theta = np.zeros((N_FEATURES, 1 + RANK))
    theta[:, 1:] = rng.normal(0, 0.01, (N_FEATURES, RANK))
    bias = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return Model(bias, theta[:, 0] * 0, theta[:, 1:] * 0)
    m, s, step, bm, bs = np.zeros_like(theta), np.zeros_like(theta), 0, 0.0, 0.0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            at = np.concatenate([rows[i][0] for i in pick]).astype(np.int64)
            x = np.concatenate([rows[i][1] for i in pick]).astype(np.float64)
            sizes = np.array([len(rows[i][0]) for i in pick])
            of, first = np.repeat(np.arange(len(pick)), sizes), np.r_[0, np.cumsum(sizes)[:-1]]
            v = theta[at, 1:] * x[:, None]
            total = np.add.reduceat(v, first, axis=0)
            z = bias + np.add.reduceat(theta[at, 0] * x, first) + 0.5 * (np.square(total).sum(1) - np.add.reduceat(np.square(v).sum(1), first))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)
            used, back = np.unique(at, return_inverse=True)
            g = np.empty((len(used), 1 + RANK))
            g[:, 0] = np.bincount(back, err[of] * x)
            for f in range(RANK):
                g[:, 1 + f] = np.bincount(back, err[of] * x * (total[of, f] - v[:, f]))
            g += decay * theta[used]
            step += 1
            m[used] = 0.9 * m[used] + 0.1 * g
            s[used] = 0.99 * s[used] + 0.01 * g * g
            fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            theta[used] -= rate * fix * m[used] / (np.sqrt(s[used]) + 1e-8)
            bg = err.sum()
            bm, bs = 0.9 * bm + 0.1 * bg, 0.99 * bs + 0.01 * bg * bg
            bias -= rate * fix * bm / (np.sqrt(bs) + 1e-8)
    return Model(bias, theta[:, 0].copy(), theta[:, 1:].copy())


def train(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, holdout: int = 5) -> Model:
    """Learn from at most `most_labels` labelled documents with crc32(doc_id as text) mod `holdout` <> 0.

    The sample is the labels of lowest hash, so it is the same at every run; labels that are null, and
    documents that have none, teach nothing. Of several labels of one document the lowest counts.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    labels = labels.where("doc_id is not null and quality in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % holdout != 0)
    sample = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [features(t, n) for t, n in zip(texts_of(batch), batch.column("n_chars").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column("quality"), batch.column("doc_id"), pa.array([m[0].astype(np.int32) for m in made], pa.list_(pa.int32())), pa.array([m[1].astype(np.float32) for m in made], pa.list_(pa.float32()))],
            ["quality", "doc_id", "at", "x"],
        )

    # The sample has at most most_labels rows of two numbers, so it can be sent to every task.
    known = inputs(docs).select("doc_id", "text", "n_chars").join(F.broadcast(sample), "doc_id")
    got = map_batches(known, make, "quality int, doc_id long, at array<int>, x array<float>").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    rows = [(np.asarray(a.values), np.asarray(x.values)) for a, x in zip(got["at"], got["x"], strict=True)]
    return fit(rows, got["quality"].to_numpy().astype(float))


def inputs(docs: DataFrame) -> DataFrame:
    """doc_id, text and n_chars (null where docs has no such column)."""
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), n_chars.alias("n_chars"))


def quality_scores(docs: DataFrame, model: Model, threshold: float = 0.3, holdout: int = 5) -> DataFrame:
    """docs: doc_id long, text string, n_chars long (optional); other columns are ignored.

    Returns doc_id, held_out (crc32(doc_id as text) mod `holdout` = 0), score and predicted (1 if
    score >= threshold) for each row. Null text counts as empty and is scored too; a null doc_id is not
    held out; repeated rows stay; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = shared.value.scores([features(t, n) for t, n in zip(texts_of(batch), batch.column("n_chars").to_pylist(), strict=True)])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = map_batches(inputs(docs), make, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % holdout == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def keep_quality(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs with score >= threshold, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    has_n = "n_chars" in docs.columns

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_chars = batch.column("n_chars").to_pylist() if has_n else [None] * batch.num_rows
        score = shared.value.scores([features(t, n) for t, n in zip(texts_of(batch), n_chars, strict=True)])
        return batch.filter(pa.array(score >= threshold))

    return map_batches(docs, make, docs.schema)
