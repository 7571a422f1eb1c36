"""Language identification by interpolated Kneser-Ney character models.

A text is the words (runs of letters, lower-cased) in it; each word is scored with start and end marks, so
a text's cross-entropy is a sum over its words and every distinct word is scored once a worker. For each
order the n-grams of all languages stand in one sorted array of 64-bit hashes beside a matrix of
discounted probabilities, and the contexts in another beside their back-off weights. The language with the lowest
cross-entropy a character wins; a text is rejected if that is further above what is usual for the language
than nearly all calibration texts reach. What is usual is the median, and the spread follows from the median
absolute deviation, so a few wrong labels among the calibration texts change neither.

Models are fitted on a bounded sample of labelled documents: about `most_docs` a language, those of lowest hash.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import cut, held, map_batches, texts_of

ORDER = 4
MOST_DOCS, MOST_LANGS = 1500, 500
UND = "und"
#: Rejected: over this many deviations (of calibration texts of like length) above the median, and over this
#: many times what all but a few calibration texts reached: those above the quantile SEEN may be wrongly labelled.
MOST_DEVIATIONS, BEYOND_SEEN, SEEN = 8.0, 1.5, 0.95
#: Beyond so many characters a longer text is not expected to lie closer to the mean.
STEADY_CHARS = 400
MOST_PIECES = MOST_WORDS = 300_000
_LETTERS = re.compile(r"[^\W\d_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)
_CHARS_AT_ONCE, WORDS_AT_ONCE = 2_000_000, 20_000
#: Words times languages that are scored at once; a word has a row of numbers for each of its letters meanwhile.
NUMBERS_AT_ONCE = 40_000


def words_of(piece: str) -> list[str]:
    return _LETTERS.findall(piece.lower())


def _grams(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For every letter and end mark of the words: its word, and by order 1.. the hash of the n-gram ending there and of its context."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    span = sizes + ORDER
    codes = np.ones(span.sum(), np.uint64)  # 1: the start mark
    ends = np.cumsum(span)
    text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.repeat(np.arange(len(words)), sizes)
    codes[np.arange(len(text)) + (word + 1) * (ORDER - 1) + word] = text.astype(np.uint64) + np.uint64(16)
    codes[ends - 1] = 2  # the end mark
    of = np.repeat(np.arange(len(words)), sizes + 1)
    at = np.arange(len(of)) + (of + 1) * (ORDER - 1)

    def hashed(stop: np.ndarray, n: int) -> np.ndarray:
        acc = np.full(len(stop), n, np.uint64)
        for k in range(n - 1, -1, -1):
            acc = (acc + codes[stop - k]) * _MUL
            acc ^= acc >> np.uint64(32)
        return acc

    return of, [hashed(at, n) for n in range(1, ORDER + 1)], [hashed(at - 1, n - 1) for n in range(1, ORDER + 1)]


@dataclass
class LanguageModel:
    langs: list[str]
    n_chars: int = 1
    grams: list[np.ndarray] = field(default_factory=list)
    shares: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoffs: list[np.ndarray] = field(default_factory=list)
    mean: np.ndarray | None = None
    deviation: np.ndarray | None = None
    limit: np.ndarray | None = None

    def word_bits(self, words: list[str]) -> np.ndarray:
        """A row for each word: its bits in every language, then the characters (letters and end mark) scored."""
        of, grams, contexts = _grams(words)
        p = np.full((len(of), len(self.langs)), 1.0 / self.n_chars)
        for n in range(ORDER):
            p *= self._found(self.contexts[n], self.backoffs[n], contexts[n], 1.0)
            p += self._found(self.grams[n], self.shares[n], grams[n], 0.0)
        bits = -np.log2(np.maximum(p, 1e-12))
        out = np.zeros((len(words), len(self.langs) + 1))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(of, bits[:, k], len(words))
        out[:, -1] = np.bincount(of, minlength=len(words))
        return out

    @staticmethod
    def _found(keys: np.ndarray, rows: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        out = rows[at]
        out[keys[at] != wanted] = other
        return out

    def strangeness(self, best: np.ndarray, entropy: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """How many deviations above the language's median."""
        return (entropy - self.mean[best]) * np.sqrt(np.minimum(chars, STEADY_CHARS)) / self.deviation[best]


def _gather(words: list[str], times: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """By order: the n-grams' hashes ascending, their counts by language, their contexts, and the n-gram one character shorter at their end."""
    of, grams, contexts = _grams(words)
    out = []
    for n in range(ORDER):
        keys, first, at = np.unique(grams[n], return_index=True, return_inverse=True)
        out.append((keys, _summed(at, times[of], len(keys)), contexts[n][first], grams[max(0, n - 1)][first]))
    return out


def _summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, values[:, k], n) for k in range(values.shape[1])], axis=1)


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """One table of the same n-grams' tables from several sets of words."""
    keys, first, at = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    return keys, _summed(at, np.concatenate([p[1] for p in parts]), len(keys)), *(np.concatenate([p[i] for p in parts])[first] for i in (2, 3))


def fit(counts: dict[str, Counter]) -> LanguageModel:
    """Models of the languages from their words' counts. Words are taken WORDS_AT_ONCE at a time, so that memory follows the distinct n-grams."""
    langs = sorted(counts)
    words = sorted(set().union(*counts.values()))
    tables: list[tuple[np.ndarray, ...]] = []
    for i in range(0, len(words), WORDS_AT_ONCE):
        some = words[i : i + WORDS_AT_ONCE]
        new = _gather(some, np.array([[counts[x][w] for x in langs] for w in some], float))
        tables = [_merged([old, more]) for old, more in zip(tables, new, strict=True)] if tables else new
    model = LanguageModel(langs)
    model.n_chars = len(tables[0][0]) + 1
    for n in range(ORDER):
        keys, c, contexts, _ = tables[n]
        if n < ORDER - 1:  # in how many contexts of one more character it was seen
            _, longer, _, ending = tables[n + 1]
            c = _summed(np.searchsorted(keys, ending), (longer > 0).astype(float), len(keys))
        once, twice = (c == 1).sum(axis=0), (c == 2).sum(axis=0)
        cut_by = np.where(once > 0, once / np.maximum(1, once + 2 * twice), 0.5)
        ctx, back = np.unique(contexts, return_inverse=True)
        total, kinds = _summed(back, c, len(ctx)), _summed(back, (c > 0).astype(float), len(ctx))
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.maximum(c - cut_by, 0) / total[back]
            backoff = cut_by * kinds / total
        model.grams.append(keys)
        model.shares.append(np.where(total[back] > 0, share, 0.0))
        model.contexts.append(ctx)
        model.backoffs.append(np.where(total > 0, backoff, 1.0))
    model.mean, model.deviation, model.limit = np.zeros(len(langs)), np.ones(len(langs)), np.full(len(langs), MOST_DEVIATIONS)
    return model


class Scorer:
    """Sums of bits by language for texts; pieces and words seen before are looked up. Bounded by MOST_PIECES and MOST_WORDS."""

    def __init__(self, model: LanguageModel):
        self.model, self.width = model, len(model.langs) + 1
        self._reset()

    def _reset(self) -> None:
        self.pieces: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.table = np.zeros((1024, self.width))
        self.bits = np.zeros((0, self.width))

    def _learn(self, pieces: list[str]) -> None:
        split = [words_of(p) for p in pieces]
        new = [w for w in dict.fromkeys(w for ws in split for w in ws) if w not in self.words]
        if new:
            start = len(self.words)
            self.words.update((w, start + i) for i, w in enumerate(new))
            step = max(1, NUMBERS_AT_ONCE // self.width)
            self.bits = np.vstack([self.bits[:start], *(self.model.word_bits(new[i : i + step]) for i in range(0, len(new), step))])
        start = len(self.pieces)
        while start + len(pieces) > len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        flat = np.fromiter((self.words[w] for ws in split for w in ws), np.int64)
        row = np.repeat(np.arange(len(pieces)), [len(ws) for ws in split])
        for k in range(self.width):
            self.table[start : start + len(pieces), k] = np.bincount(row, self.bits[flat, k], len(pieces)) if len(flat) else 0
        self.pieces.update((p, start + i) for i, p in enumerate(pieces))

    def sums(self, texts: list[str]) -> np.ndarray:
        out, at = np.zeros((len(texts), self.width)), 0
        while at < len(texts):
            stop, chars = at, 0
            while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= _CHARS_AT_ONCE):
                chars += len(texts[stop])
                stop += 1
            if len(self.pieces) > MOST_PIECES or len(self.words) > MOST_WORDS:
                self._reset()
            split = [t.split() for t in texts[at:stop]]
            missing = set().union(*split).difference(self.pieces) if split else set()
            if missing:
                self._learn(sorted(missing))
            for i, pieces in enumerate(split):
                if pieces:
                    out[at + i] = self.table[np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))].sum(axis=0)
            at = stop
        return out

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether accepted, of each text."""
        langs = self.model.langs
        if not langs:
            return [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        sums = self.sums(texts)
        chars = np.maximum(1, sums[:, -1])
        entropy = sums[:, :-1] / chars[:, None]
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(texts)), best]
        score = 1 / np.exp2(np.minimum(60, (low[:, None] - entropy) * np.minimum(chars, 40)[:, None])).sum(axis=1)
        lettered = sums[:, -1] > 0
        accepted = lettered & (self.model.strangeness(best, low, chars) <= self.model.limit[best])
        return [langs[b] if ok else UND for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0), accepted


def scorer(model: LanguageModel) -> Scorer:
    return held(("language", id(model)), lambda: Scorer(model))


def train(docs: DataFrame, most_docs: int = MOST_DOCS, holdout: int = 2, most_langs: int = MOST_LANGS) -> LanguageModel:
    """Learn from documents with a lang, a text and crc32(doc_id as text) mod 4 <> `holdout`.

    About `most_docs` documents a language are taken, whole: those whose hash is lowest. Every fifth of them only
    calibrates the rejection. Of more than `most_langs` languages those with most documents are learned. With no such document the model has no language and judges all texts `und`.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where("doc_id is not null and text is not null and lang is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != holdout)
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    if not totals:
        return LanguageModel([])
    limits = F.create_map(*(F.lit(x) for lang, n in sorted(totals.items()) for x in (lang, most_docs / n)))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    sample = cut(known.where(place < limits[F.col("lang")]).withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
            found.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    counted = map_batches(sample.where("not calibrates").drop("calibrates"), count, "lang string, word string, n long")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, Counter] = {lang: Counter() for lang in totals}
    for lang, word, n in zip(*(counted[c].to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts[lang][word] = n
    counts = {lang: c for lang, c in counts.items() if c}
    if not counts:
        return LanguageModel([])
    model = fit(counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums = scorer(shared.value).sums(texts_of(batch))
        own = [shared.value.langs.index(x) if x in shared.value.langs else -1 for x in batch.column("lang").to_pylist()]
        chars = sums[:, -1]
        keep = np.array([o >= 0 for o in own]) & (chars > 0)
        bits = sums[np.arange(len(own)), own]
        return pa.RecordBatch.from_arrays([pa.array(np.array(own)[keep], pa.int64()), pa.array((bits / np.maximum(1, chars))[keep]), pa.array(chars[keep])], ["lang", "entropy", "chars"])

    seen = map_batches(sample.where("calibrates").drop("calibrates"), score, "lang long, entropy double, chars double").toArrow()
    lang, entropy, chars = (seen[c].to_numpy() for c in ("lang", "entropy", "chars"))
    for k in range(len(model.langs)):
        e, n = entropy[lang == k], np.minimum(chars[lang == k], STEADY_CHARS)
        if len(e) >= 2:
            by = np.argsort(e)
            model.mean[k] = e[by][np.searchsorted(np.cumsum(n[by]), n.sum() / 2)]
            model.deviation[k] = max(0.5, 1.4826 * np.median(np.abs(e - model.mean[k]) * np.sqrt(n)))
            seen_most = np.quantile(model.strangeness(np.full(len(e), k), e, n), SEEN, method="lower")
            model.limit[k] = max(MOST_DEVIATIONS, BEYOND_SEEN * seen_most)
        else:
            model.mean[k], model.deviation[k] = np.log2(model.n_chars), 1.0
    return model


def languages(docs: DataFrame, model: LanguageModel, holdout: int = 2) -> DataFrame:
    """docs: doc_id long, text string; other columns are ignored.

    Returns doc_id, held_out (crc32(doc_id as text) mod 4 = `holdout`), lang_pred (`und` for null text and
    text without letters), score (0 to 1) and accepted for each row. A null doc_id is not held out;
    equal cross-entropies go to the language first in the alphabet; repeated rows stay; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, accepted = scorer(shared.value).judge(texts_of(batch))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    judged = map_batches(docs, make, "doc_id long, lang_pred string, score double, accepted boolean")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == holdout, F.lit(False))
    return judged.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


def keep_accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of docs whose language is accepted, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(scorer(shared.value).judge(texts_of(batch))[2]))

    return map_batches(docs, make, docs.schema)
