"""Draws with replacement, made where they are used, and the sums of clusters' counts under them.

Nothing drawn is ever a row: a task has a block of clusters and a block of replicates, makes those replicates' draws, keeps the weights of
its clusters and adds up their counts. What is shuffled are the counts, once for each block of replicates, and a row of sums for
each replicate, group and block of clusters, whatever the number of draws.

NumPy's generator can be made to jump, but a bounded draw may reject words of its stream, so where a replicate begins depends on all that were
rejected before. A first pass counts those by blocks of words, all side by side; their prefix sums say where each replicate's draws stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.session import share_code

#: Clusters of a block, draws made at once, and words of the generator's stream in a block (even, as it gives two at a time).
CLUSTERS, AT_ONCE, WORDS = 1 << 16, 1 << 20, 1 << 22


@dataclass(frozen=True)
class Draws:
    """reps replicates of n draws from n clusters."""

    n: int
    reps: int
    seed: int

    def of(self, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
        """For replicates first to last - 1, in this order: the replicate and some of its draws, each of them once."""
        raise NotImplementedError

    def weights(self, first: int, last: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each replicate's numbers of draws of the clusters low to high - 1."""
        now, made = None, np.zeros(high - low, np.int64)
        for rep, idx in self.of(first, last):
            if rep != now:
                if now is not None:
                    yield now, made
                now, made = rep, np.zeros(high - low, np.int64)
            own = idx[(idx >= low) & (idx < high)] - low
            made += np.bincount(own, minlength=high - low)
        if now is not None:
            yield now, made


class MD5Draws(Draws):
    """Draw i of a replicate: the first eight hexadecimal digits of md5(seed:rep:i), modulo n. Any SQL engine can make them."""

    def of(self, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
        for rep in range(first, last):
            for a in range(0, self.n, AT_ONCE):
                made = (int.from_bytes(hashlib.md5(b"%d:%d:%d" % (self.seed, rep, i)).digest()[:4]) for i in range(a, min(self.n, a + AT_ONCE)))
                yield rep, np.fromiter(made, np.int64) % self.n


def _words(seed: int, first: int, count: int) -> np.ndarray:
    """Words of 32 bits of default_rng(seed)'s stream; first and count are even."""
    bits = np.random.PCG64(seed)
    bits.advance(first // 2)
    return bits.random_raw(count // 2).astype("<u8").view("<u4")


def _bounded(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The high halves of words x n, and which of them count: low halves under 2^32 mod n are rejected, so all draws are equally likely."""
    product = words.astype(np.uint64) * np.uint64(n)
    return (product >> np.uint64(32)).astype(np.int64), (product & np.uint64(0xFFFFFFFF)) >= np.uint64((1 << 32) % n)


@dataclass(frozen=True)
class NumpyDraws(Draws):
    """default_rng(seed).integers(0, n, size=n), replicate after replicate. before: draws that stand before each block of words."""

    before: tuple[int, ...] = ()

    def of(self, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
        n = self.n
        if n == 1:  # takes no words
            yield from ((rep, np.zeros(1, np.int64)) for rep in range(first, last))
            return
        at, end = first * n, last * n
        block = int(np.searchsorted(np.array(self.before), at, side="right")) - 1
        while at < end:
            values, counts = _bounded(_words(self.seed, block * WORDS, WORDS), n)
            drawn = values[counts][at - self.before[block] :][: end - at]
            cuts = np.arange(n - at % n, len(drawn), n)
            for part in np.split(drawn, cuts) if len(drawn) else ():
                yield at // n, part
                at += len(part)
            block += 1


def numpy_draws(spark: SparkSession, n: int, reps: int, seed: int = 42) -> NumpyDraws:
    """The places of all replicates in the stream; n below 2^32."""
    if n >= 1 << 32:
        raise ValueError("NumPy draws from that many clusters by 64-bit words")
    if n <= 1:
        return NumpyDraws(n, reps, seed, (0,))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([int(_bounded(_words(seed, b * WORDS, WORDS), n)[1].sum()) for b in blocks], pa.int64())], ["id", "n"])

    # At most every other word is rejected; the stream's end is taken once enough are not.
    share_code(spark)
    blocks = -(-n * reps // WORDS)
    while True:
        found = spark.range(blocks, numPartitions=min(blocks, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(kept, "id long, n long").toArrow().sort_by("id")
        upto = np.cumsum(found["n"].to_numpy())
        if upto[-1] >= n * reps:
            return NumpyDraws(n, reps, seed, (0, *upto[:-1].tolist()))
        blocks += max(1, blocks // 8)


def sums(counts: DataFrame, draws: Draws, by: list[str], names: list[str]) -> DataFrame:
    """by, rep, images (draws of the group's clusters) and the sums of `names` (whole numbers) over draws; replicates without a draw of the group have no row.

    counts: by, idx and names; rows with the same idx add up.
    """
    spark = counts.sparkSession
    share_code(spark)
    blocks = max(1, -(-draws.n // CLUSTERS))
    parts = min(draws.reps, max(1, -(-2 * spark.sparkContext.defaultParallelism // blocks)))
    rows = counts.select(*by, F.col("idx").cast("long").alias("idx"), *(F.col(c).cast("long").alias(c) for c in names))
    rows = rows.withColumn("__block", F.floor(F.col("idx") / CLUSTERS)).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block, part = key[0].as_py(), key[1].as_py()
        low, high = block * CLUSTERS, min(draws.n, (block + 1) * CLUSTERS)
        group = np.zeros(table.num_rows, np.int64)
        for c in by:
            codes = table[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            group = np.unique(group * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[order], prepend=-1))
        idx = table["idx"].to_numpy()[order] - low
        values = np.stack([np.ones(len(idx), np.int64), *(table[c].to_numpy()[order] for c in names)], axis=1)
        made, reps = [], []
        for rep, w in draws.weights(part * draws.reps // parts, (part + 1) * draws.reps // parts, low, high):
            made.append(np.add.reduceat(w[idx][:, None] * values, first, axis=0))
            reps.append(rep)
        shown = table.select(by).take(pa.array(np.tile(order[first], len(reps))))
        total = np.concatenate(made) if made else np.empty((0, 1 + len(names)), np.int64)
        columns = [*shown.columns, pa.array(np.repeat(np.array(reps, np.int64), len(first))), *(pa.array(total[:, k]) for k in range(total.shape[1]))]
        return pa.table(columns, [*by, "rep", "images", *names])

    kinds = ", ".join([*(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in by), "rep long", "images long", *(f"`{c}` long" for c in names)])
    found = rows.groupBy("__block", "__part").applyInArrow(add, kinds)
    return found.groupBy(*by, "rep").agg(*(F.sum(c).alias(c) for c in ("images", *names))).where("images > 0")
