"""Text similarity of reference and hypothesis pairs, from tokens made once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA, EPSILON = 1e-3, 0.1
#: About so many tokens of pairs are counted at once, so a worker's memory doesn't follow the rows of an Arrow batch. A pair is never cut.
TOKENS_AT_ONCE = 100_000


def tokens(text: Column | str) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text; null gives none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.size(words) < n, none).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, n), " ")))


class Grams:
    """N-grams of both sides of a batch's pairs, as whole numbers: a gram of n tokens is the number of its first n - 1 and the last, so equal grams have equal numbers and no others."""

    def __init__(self, ref: pa.Array, hyp: pa.Array):
        self.rows, parts, sides = len(ref), [], []
        for side in (ref, hyp):
            at = side.offsets.to_numpy()
            parts.append(side.values[at[0] : at[-1]])
            sides.append(np.diff(at))
        self.tokens = pa.concat_arrays(parts).dictionary_encode().indices.to_numpy().astype(np.int64)
        self.kinds = int(self.tokens.max(initial=-1)) + 1
        # Where each token's side of a pair ends, and which it is: the first `rows` are references.
        self.side = np.repeat(np.arange(2 * self.rows), np.concatenate(sides))

    def counts(self, most: int) -> Iterator[tuple[np.ndarray, ...]]:
        """For n = 1 to most: pair, number of the gram, times in the reference and in the hypothesis, for each distinct gram of a pair."""
        gram, n = self.tokens, 1
        while True:
            valid = self.side[: len(gram)] == self.side[n - 1 : n - 1 + len(gram)]
            side, own = self.side[: len(gram)][valid], gram[valid]
            width = int(own.max(initial=-1)) + 1
            key, back = np.unique(side % self.rows * width + own, return_inverse=True) if len(own) else (own, own)
            of = side < self.rows
            yield key // max(1, width), key % max(1, width), np.bincount(back[of], minlength=len(key)), np.bincount(back[~of], minlength=len(key))
            if n == most:
                return
            gram = gram[: max(0, len(gram) - 1)] * max(1, self.kinds) + self.tokens[n : n + max(0, len(gram) - 1)]
            gram, n = (np.unique(gram, return_inverse=True)[1] if len(gram) else gram), n + 1


def _overlap_columns(grams: Grams, most: int) -> dict[str, np.ndarray]:
    out = {}
    for n, (row, _, r, h) in enumerate(grams.counts(most), 1):
        for name, v in (("hits", np.minimum(r, h)), ("ref", r), ("hyp", h)):
            out[f"{name}_{n}"] = np.bincount(row, v, grams.rows).astype(np.int64)
    return out


def _divergence_columns(grams: Grams, alpha: float) -> dict[str, np.ndarray]:
    row, _, r, h = next(grams.counts(1))
    kinds, n_r, n_h = (np.bincount(row, v, grams.rows) for v in (np.ones(len(row)), r, h))
    p, q = ((c + alpha) / (n[row] + alpha * kinds[row]) for c, n in ((r, n_r), (h, n_h)))
    half, bits = (p + q) / 2, lambda v: np.where(kinds > 0, np.bincount(row, v, grams.rows) / math.log(2), np.nan)
    return {"kl_bits": bits(p * np.log(p / q)), "js_bits": bits((p * np.log(p / half) + q * np.log(q / half)) / 2)}


def _sliced(r: pa.Array, h: pa.Array, make: Callable[[pa.Array, pa.Array], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """What make gives for the pairs of a batch, a slice of about TOKENS_AT_ONCE tokens at a time."""
    ends = np.cumsum(sum(np.diff(x.offsets.to_numpy()).astype(np.int64) for x in (r, h)))
    parts, at = [], 0
    while at < len(r) or not parts:
        before = int(ends[at - 1]) if at else 0
        n = max(1, int(np.searchsorted(ends, before + TOKENS_AT_ONCE, side="right")) - at)
        parts.append(make(r.slice(at, n), h.slice(at, n)))
        at += n
    return {c: np.concatenate([x[c] for x in parts]) for c in parts[0]}


def _struct(columns: dict[str, np.ndarray]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(v, from_pandas=True) for v in columns.values()], list(columns))


def overlaps(pairs: DataFrame, keep: list[str], ref: str, hyp: str, sizes: tuple[int, ...]) -> DataFrame:
    """A row for each row of pairs, repeated keys too: keep, and for each n hits_n (clipped), ref_n and hyp_n of the n-grams of token columns. Pairs are counted where they are, in Arrow batches."""
    most = max(sizes)

    @F.arrow_udf(", ".join(f"{c}_{n} long" for n in range(1, most + 1) for c in ("hits", "ref", "hyp")))
    def count(r: pa.Array, h: pa.Array) -> pa.Array:
        return _struct(_sliced(r, h, lambda x, y: _overlap_columns(Grams(x, y), most)))

    names = [f"__x.{c}_{n}" for n in sizes for c in ("hits", "ref", "hyp")]
    return pairs.select(*keep, count(ref, hyp).alias("__x")).select(*keep, *names)


def rouge_n(pairs: DataFrame, key: str, ref: str, hyp: str, n: int) -> DataFrame:
    """F1 of clipped n-gram overlap, 0 if either side has none."""
    f1 = F.coalesce(F.try_divide(2.0 * F.col(f"hits_{n}"), F.col(f"ref_{n}") + F.col(f"hyp_{n}")), F.lit(0.0))
    return overlaps(pairs, [key], ref, hyp, (n,)).select(key, f1.alias(f"rouge{n}_f1"))


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a bit for each token of b, all of a row of the table in one whole number."""
    places: dict[str, int] = {}
    for i, token in enumerate(b):
        places[token] = places.get(token, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for token in a:
        if hit := row & places.get(token, 0):
            row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def _lcs_column(a: pa.Array, b: pa.Array) -> dict[str, np.ndarray]:
    return {"lcs": np.array([_lcs(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], np.int32)}


def lcs(a: str, b: str) -> Column:
    """Length of the longest common subsequence of two token columns, in Arrow batches: a token costs one operation on whole numbers of as many bits as the other side has tokens."""

    @F.arrow_udf("int")
    def length(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array(_sliced(left, right, _lcs_column)["lcs"])

    return length(F.col(a), F.col(b))


def rouge_l(pairs: DataFrame, key: str, ref: str, hyp: str) -> DataFrame:
    f1 = F.coalesce(F.try_divide(2.0 * lcs(ref, hyp), F.size(ref) + F.size(hyp)), F.lit(0.0))
    return pairs.select(key, f1.alias("rouge_l_f1"))


def _bleu4(x1: Column, x2: Column, x3: Column, x4: Column, len_r: Column, len_h: Column) -> Column:
    logs = sum((F.ln(F.when(x == 0, F.lit(EPSILON)).otherwise(x.cast("double")) / F.greatest(len_h - (n - 1), F.lit(1))) for n, x in ((2, x2), (3, x3), (4, x4))), F.ln(x1.cast("double") / len_h))
    brevity = F.when(len_h > len_r, 1.0).otherwise(F.exp(1 - len_r.cast("double") / len_h))
    return F.when((len_r == 0) | (len_h == 0) | (x1 == 0), 0.0).otherwise(brevity * F.exp(logs / 4))


def bleu4(pairs: DataFrame, key: str, ref: str, hyp: str) -> DataFrame:
    """Uniform weights to 4-grams; a zero numerator counts as EPSILON, no unigram in common gives 0, so does an empty side."""
    parts = overlaps(pairs, [key], ref, hyp, (1, 2, 3, 4))
    return parts.select(key, _bleu4(*(F.col(f"hits_{n}") for n in (1, 2, 3, 4)), F.col("ref_1"), F.col("hyp_1")).alias("bleu4"))


def divergences(pairs: DataFrame, key: str, ref: str, hyp: str, alpha: float = ALPHA) -> DataFrame:
    """KL(ref || hyp) and Jensen-Shannon divergence in bits of smoothed word shares; null if both sides are empty. A row for each row of pairs."""

    @F.arrow_udf("kl_bits double, js_bits double")
    def bits(r: pa.Array, h: pa.Array) -> pa.Array:
        return _struct(_sliced(r, h, lambda x, y: _divergence_columns(Grams(x, y), alpha)))

    return pairs.select(key, bits(ref, hyp).alias("__x")).select(key, "__x.*")


#: The scores of a pair of texts, null where undefined.
TEXT_SCORES = ("bleu4", "rouge1_f1", "rouge2_f1", "rouge_l_f1", "kl_bits", "js_bits")


def text_scores(rows: DataFrame, key: str, reference: str, response: str, alpha: float = ALPHA) -> DataFrame:
    """rows and all TEXT_SCORES of their reference and response, in one pass over the rows; rows without a response have nulls. Repeated keys are rows of their own."""

    @F.arrow_udf("lcs int, kl_bits double, js_bits double, " + ", ".join(f"{c}_{n} long" for n in range(1, 5) for c in ("hits", "ref", "hyp")))
    def score(r: pa.Array, h: pa.Array) -> pa.Array:
        def made(x: pa.Array, y: pa.Array) -> dict[str, np.ndarray]:
            grams = Grams(x, y)
            return {**_lcs_column(x, y), **_divergence_columns(grams, alpha), **_overlap_columns(grams, 4)}

        return _struct(_sliced(r, h, made))

    made = rows.withColumn("__x", score(tokens(reference), tokens(response)))
    x = lambda name: F.col(f"__x.{name}")
    f1 = lambda hits, r, h: F.coalesce(F.try_divide(2.0 * x(hits), x(r) + x(h)), F.lit(0.0))
    found = {"bleu4": _bleu4(*(x(f"hits_{n}") for n in range(1, 5)), x("ref_1"), x("hyp_1")), "rouge1_f1": f1("hits_1", "ref_1", "hyp_1"), "rouge2_f1": f1("hits_2", "ref_2", "hyp_2"), "rouge_l_f1": f1("lcs", "ref_1", "hyp_1"), "kl_bits": x("kl_bits"), "js_bits": x("js_bits")}
    return made.select(*rows.columns, *(F.when(F.col(response).isNotNull(), c).alias(n) for n, c in found.items()))


def score_means(scored: DataFrame, by: list[str], response: str, names: tuple[str, ...] = TEXT_SCORES) -> DataFrame:
    """Means by group, each over the rows that have the score; n_scored and n_errors count rows with and without a response."""
    return scored.groupBy(*by).agg(F.count(response).alias("n_scored"), F.count_if(F.col(response).isNull()).alias("n_errors"), *(F.avg(n).alias(f"{n}_mean") for n in names))


def term_frequency(texts: DataFrame, by: list[str], text: str, terms: list[str] | None = None) -> DataFrame:
    """Counts of words and their percentage of the group's words (at least 1)."""
    words = texts.select(*by, F.explode(tokens(text)).alias("term"))
    counts = words.groupBy(*by, "term").agg(F.count("*").cast("bigint").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = counts.join(total, by) if by else counts.crossJoin(total)
    out = joined.withColumn("percent", 100.0 * F.col("n") / F.greatest("total", F.lit(1))).drop("total")
    return out if terms is None else out.where(F.col("term").isin(*terms))
