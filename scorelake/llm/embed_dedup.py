"""Near-duplicate embeddings by randomised-rotation binary codes.

Equal vectors fold into one first. A vector is turned by a random rotation; its code is the signs of the turned unit vector,
and f = <code, vector> is its correction factor. The inner product with another unit vector q is estimated without
bias by <code, q> / f, within eps * sqrt((1 - f^2) / (f^2 * (D - 1))) of the truth but for a tail that is
smaller than e^-eps. Code and factor are stored, and so is q in small integers with its largest rounding error, which widens the bound.
Pairs whose upper bound lies under the threshold are dropped; the vectors of all others are fetched and
recomputed exactly, in double precision, and only the exact cosine links.

Candidates come from tables keyed by signs of projections of the small integers. Projections have whole numbers only, so a
key comes out the same wherever it is computed. The tables' number follows from the table size so that a pair at the
threshold meets in one with `recall` chance at least. A pair is looked at in the first table where it
meets; a table's bucket is worked off in blocks. What goes through the tables is codes, factors and small
integers; a block gives back the vectors that have a pair to recompute, and these alone come with
their doubles. What leaves the recomputation is a count and one link a vector, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import cut, join_hot, map_batches
from scorelake.llm.components import connected_components, joined_by_id

#: Vectors a bucket and a block, and rows that one call of a block function gets.
BUCKET, BLOCK, ROWS_AT_ONCE = 192, 1000, 4000
RECALL = 0.999
EPS = 6.0
#: Bits of a key at most; more vectors than 2^MOST_BITS buckets hold make the buckets larger, and blocks work them off.
MOST_BITS = 30
_SEED = 41


def plan(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits a key and number of tables for n vectors."""
    bits = min(MOST_BITS, max(4, round(math.log2(max(2, n) / BUCKET))))
    same = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same))) if same < 1 else 1


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([_SEED, dim]).normal(size=(dim, dim)))[0]


@lru_cache(maxsize=4)
def projections(dim: int, n_bits: int) -> np.ndarray:
    """dim x n_bits whole numbers: the columns of orthogonal matrices, scaled and rounded."""
    rng = np.random.default_rng([_SEED + 1, dim])
    return np.rint(2048 * np.hstack([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(max(1, -(-n_bits // dim)))])[:, :n_bits])


def sketch(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of vectors, a row each: codes (bits), factors, small integers of the turned unit vectors, and the integers' unit."""
    turned = (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]) @ rotation(x.shape[1])
    factor = np.abs(turned).sum(axis=1) / math.sqrt(x.shape[1])
    unit = np.abs(turned).max(axis=1) / 127
    return np.packbits(turned > 0, axis=1), factor, np.rint(turned / unit[:, None]).astype(np.int8), unit


def keys_of(small: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The key of every vector in every table. All sums are of whole numbers below 2^53, so they are exact in any order."""
    signs = (small.astype(np.float64) @ projections(small.shape[1], bits * tables)) > 0
    return signs.reshape(len(small), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, vector (doubles) and digest; the last three null for vectors that link with nothing."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims, data, digests = [], [], []
        for v in batch.column("embedding"):
            x = None if not v.is_valid or v.values.null_count else np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
            with np.errstate(over="ignore"):
                ok = x is not None and len(x) > 0 and np.isfinite(x).all() and x.any()
            if ok:
                x = x + 0.0  # one zero only
                if not np.isfinite(x @ x) or not x @ x > 1e-200:
                    x = x / np.abs(x).max()
            dims.append(len(x) if ok else None)
            data.append(x.tobytes() if ok else None)
            digests.append(xxhash.xxh3_128_digest(x.tobytes()) if ok else None)
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(data, pa.binary()), pa.array(digests, pa.binary())], ["vec_id", "dim", "vector", "digest"])

    picked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return map_batches(picked, make, "vec_id long, dim int, vector binary, digest binary")


def _slots(reps: DataFrame, bits: int, tables: int) -> DataFrame:
    """A row for each class and table: dim, place (table and key), rep, code, factor, small and unit."""

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            for some in np.array_split(at, -(-len(at) * tables // 40_000)):
                x = np.stack([np.frombuffer(batch.column("vector")[int(i)].as_buffer(), np.float64) for i in some])
                code, factor, small, unit = sketch(x)
                place = keys_of(small, bits, tables) + (np.arange(tables, dtype=np.int64) << 40)
                of = pa.array(np.repeat(np.arange(len(some)), tables))
                binary = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary()).take(of)  # noqa: E731, B023
                columns = [pa.array(np.full(len(of), dim, np.int32)), pa.array(place.ravel()), batch.column("rep").take(pa.array(some)).take(of), binary(code), pa.array(factor).take(of), binary(small), pa.array(unit).take(of)]
                yield pa.RecordBatch.from_arrays(columns, ["dim", "place", "rep", "code", "factor", "small", "unit"])

    return map_batches(reps, make, "dim int, place long, rep long, code binary, factor double, small binary, unit double")


def _groups(frame: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[int, int]]]:
    """The rows by (dim, place, b1, b2), and where each group begins and ends."""
    frame = frame.sort_values(["dim", "place", "b1", "b2", "rep"], kind="stable", ignore_index=True)
    by = frame[["dim", "place", "b1", "b2"]].to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], (by[1:] != by[:-1]).any(axis=1), [True]])).tolist()
    return frame, list(zip(cuts[:-1], cuts[1:], strict=True))


def _first_met(small: np.ndarray, a: np.ndarray, b: np.ndarray, table: int, bits: int, tables: int) -> np.ndarray:
    """Whether pairs (a, b) meet in no table before this one; the keys of those in a pair are computed anew."""
    if not table or not len(a):
        return np.ones(len(a), bool)
    used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    keys = keys_of(small[used], bits, tables)[:, :table]
    p, q, out = at[: len(a)], at[len(a) :], np.empty(len(a), bool)
    for s in range(0, len(a), 50_000):
        out[s : s + 50_000] = (keys[p[s : s + 50_000]] != keys[q[s : s + 50_000]]).all(axis=1)
    return out


def _undecided(frame: pd.DataFrame, threshold: float, bits: int, tables: int) -> pd.DataFrame:
    """Of every block, or two blocks, of a bucket: the classes with a pair whose bound reaches the threshold and that first meets here."""
    frame, groups = _groups(frame)
    out = []
    for a, b in groups:
        if b - a < 2:
            continue
        own = frame.iloc[a:b]
        dim, apart = int(own["dim"].iloc[0]), own["b1"].iloc[0] != own["b2"].iloc[0]
        small = np.frombuffer(b"".join(own["small"]), np.int8).reshape(-1, dim)
        signs = np.unpackbits(np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(small), -1), axis=1, count=dim).astype(np.float32) * 2 - 1
        factor, unit = own["factor"].to_numpy(), own["unit"].to_numpy()
        estimate = (signs @ small.T.astype(np.float32)) * unit / (math.sqrt(dim) * factor[:, None])
        slack = EPS * np.sqrt(np.maximum(0, 1 - factor**2) / (factor**2 * max(1, dim - 1)))
        rounding = unit * math.sqrt(dim) / 2
        maybe = np.triu(estimate + slack[:, None] + rounding / factor[:, None] + 1e-6 >= threshold, 1)
        if apart:
            block = own["block"].to_numpy()
            maybe &= block[:, None] != block[None, :]
        p, q = np.nonzero(maybe)
        if len(p):
            first = _first_met(small, p, q, int(own["place"].iloc[0] >> 40), bits, tables)
            keep = np.unique(np.concatenate([p[first], q[first]]))
            out.append(own.iloc[keep][["dim", "place", "b1", "b2", "block", "rep"]])
    return pd.concat(out) if out else frame.iloc[:0][["dim", "place", "b1", "b2", "block", "rep"]]


def _linked(frame: pd.DataFrame, threshold: float, bits: int, tables: int) -> pd.DataFrame:
    """Of every block, or two blocks, of a bucket: each class's links and the smallest class it reaches here."""
    frame, groups = _groups(frame)
    made = []
    for start, stop in groups:
        own = frame.iloc[start:stop]
        ids, times, block = (own[c].to_numpy() for c in ("rep", "times", "block"))
        x = np.stack([np.frombuffer(v, np.float64) for v in own["vector"]])
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        # A product of matrices may round otherwise than the sum of products that decides.
        maybe = np.triu((x / norm[:, None]) @ (x / norm[:, None]).T >= threshold - 1e-9, 1)
        if own["b1"].iloc[0] != own["b2"].iloc[0]:
            maybe &= block[:, None] != block[None, :]
        a, b = np.nonzero(maybe)
        keep = _first_met(sketch(x)[2], a, b, int(own["place"].iloc[0] >> 40), bits, tables)
        a, b = a[keep], b[keep]
        keep = np.empty(len(a), bool)
        for s in range(0, len(a), 50_000):
            p, q = a[s : s + 50_000], b[s : s + 50_000]
            keep[s : s + 50_000] = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= threshold
        a, b = a[keep], b[keep]
        links = np.bincount(a, times[b], len(ids)) + np.bincount(b, times[a], len(ids))
        low = np.arange(len(ids))
        while True:
            before = low.copy()
            np.minimum.at(low, a, before[b])
            np.minimum.at(low, b, before[a])
            if (low == before).all():
                break
        met = links > 0
        made.append(np.stack([ids[met], links[met].astype(np.int64), ids[low[met]]]))
    rep, links, low = np.concatenate(made, axis=1)
    return pd.DataFrame({"rep": rep, "links": links, "low": low})


def near_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = RECALL) -> DataFrame:
    """vectors: vec_id long, embedding array of float or double; other columns are ignored.

    Returns vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable,
    itself included) and kept (vec_id = component_id) for each row. Two vectors of one length are linked if
    their cosine in double precision is at least `threshold`; a pair at the threshold is found with `recall` chance at least.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different
    lengths. Equal vectors link with one another. A null vec_id links with nothing, has the null component and is kept.
    Rows that share a vec_id are one member of components, whatever their vectors: they have one component, and each
    row counts the links of its own vector. An empty table gives an empty one.
    """
    known = cut(_prepared(vectors))
    usable = known.where("digest is not null and vec_id is not null")
    reps = usable.groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("times"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    # A class's number is its place in what is checkpointed, so no two classes share one, whatever their ids.
    reps = cut(reps.withColumn("rep", F.monotonically_increasing_id()))
    n_reps, n_rows = reps.agg(F.count("*"), F.coalesce(F.sum("times"), F.lit(0))).first()
    bits, tables = plan(n_reps, threshold, recall)
    at = ["dim", "place", "b1", "b2"]

    slots = _slots(reps.select("rep", "dim", "vector"), bits, tables)
    counts = slots.groupBy("dim", "place").agg(F.count("*").alias("m")).where("m > 1")
    counts = counts.select(F.xxhash64("dim", "place").alias("slot"), F.col("m").alias("n"), F.ceil(F.col("m") / BLOCK).alias("blocks"))
    met = join_hot(slots.withColumn("slot", F.xxhash64("dim", "place")), counts, "slot", n_reps * tables, "rep")
    met = met.withColumn("block", F.pmod(F.xxhash64("rep", "place"), F.col("blocks"))).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("b1", F.least("block", "with")).withColumn("b2", F.greatest("block", "with"))
    bins = max(1, n_reps * tables // ROWS_AT_ONCE)
    binned = lambda rows, n: rows.withColumn("bin", F.pmod(F.xxhash64(*at), F.lit(n))).groupBy("bin")
    asked = binned(met.select(*at, "block", "rep", "code", "factor", "small", "unit"), bins).applyInPandas(lambda g: _undecided(g, threshold, bits, tables), "dim int, place long, b1 long, b2 long, block long, rep long")
    asked = cut(asked)
    with_vectors = asked.join(reps.select("rep", "times", "vector"), "rep")
    found = binned(with_vectors, max(1, asked.count() // ROWS_AT_ONCE)).applyInPandas(lambda g: _linked(g, threshold, bits, tables), "rep long, links long, low long")
    found = cut(found)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("u"), F.col("low").alias("v")))
    named = reps.select("digest", "rep", "vec_id", "times").join(links, "rep", "left").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    lowest = named.groupBy("component").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    named = join_hot(named, lowest, "component", n_reps, "rep").select("digest", F.col("times").alias("n"), (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("low").alias("component"))
    named = cut(named)
    own = joined_by_id(usable.select(F.col("vec_id").alias("id"), F.col("digest").alias("class")), named.select(F.col("digest").alias("class"), "component"))
    if own is not None:
        named = named.join(own.select(F.col("node").alias("component"), F.col("component").alias("joined")), "component", "left")
        named = named.select("digest", "n", "n_links", F.coalesce("joined", "component").alias("component"))
    # A class gets its facts by its digest; a null vec_id must not.
    rows = known.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest"))
    out = join_hot(rows, named, "digest", n_rows, "vec_id", "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"),
    )
