"""Harmonic packing of token sequences.

A document is cut into pieces of exactly capacity // k tokens (k from 1 up, greedily) until what
remains is at most capacity // FINE; the remainder goes to the class of the largest k whose slot holds
it. A bin of class k takes k pieces, whatever else is in it, so a piece's place follows from its rank in
its class alone: workers count their pieces by class and bucket, the counts' running sums give every
bucket its first rank, and all bins are then filled independently. Fewer than k pieces a class
are left over, at most LEAST_SLOT_K^2 / 2 in all whatever the input; one task packs these by best fit.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import cut, map_batches
from scorelake.llm.wordtok import tokenizer

#: Remainders of at most capacity // FINE tokens are not cut again.
FINE = 16
#: The finest class; smaller remainders take a slot of it.
LEAST_SLOT_K = 128
BUCKET, LEAST_BUCKETS = 20_000, 1024
#: Sequence ids are bin * ID_STEP + class; class 0 has the bins of left-over pieces.
ID_STEP = 256


def cuts(n: int, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, class) of the pieces of n tokens."""
    out, at = [(i * capacity, capacity, 1) for i in range(n // capacity)], n // capacity * capacity
    while (rest := n - at) > 0:
        if rest * FINE > capacity:
            k = capacity // rest
            k += capacity // k > rest
            length = capacity // k
        else:
            k, length = min(LEAST_SLOT_K, capacity // rest), rest
        out.append((at, length, k))
        at += length
    return out


def _pieces(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, ends = tokenizer(path).encode_array(batch.column("text"), end_id)
        rows: list[list] = [[] for _ in range(5)]
        ids, row_of, at, data = [], [], ends.tolist(), memoryview(flat).cast("B") if len(flat) else b""
        for i in range(batch.num_rows):
            first, n = at[i], at[i + 1] - at[i]
            for start, length, k in cuts(n, capacity):
                a, b = first + start, first + start + length
                row_of.append(i)
                for column, value in zip(rows, (start, length, zlib.crc32(data[4 * a : 4 * b]), n, k), strict=True):
                    column.append(value)
                if with_ids:
                    ids.append(flat[a:b].view("<i4"))
        columns = [batch.column("doc_id").take(pa.array(row_of, pa.int64())), *(pa.array(c, pa.int64()) for c in rows)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"]
        if with_ids:
            columns.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class long" + ", ids array<int>" * with_ids
    return map_batches(docs, make, schema)


def _best_fit(capacity: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        free: list[tuple[int, int]] = []
        seq, off, opened = [], [], 0
        for length in rows["length"]:
            at = bisect_left(free, (length, -1))
            if at < len(free):
                room, bin_ = free.pop(at)
            else:
                room, bin_, opened = capacity, opened, opened + 1
            seq.append(bin_)
            off.append(capacity - room)
            insort(free, (room - length, bin_))
        rows["sequence_id"], rows["offset"] = np.array(seq, np.int64) * ID_STEP, np.array(off, np.int64)
        return rows.drop(columns=["class"])

    return pack


def harmonic_pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """docs: doc_id long, text string; other columns are ignored. Null text counts as empty.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens (with the end id),
    sequence_id and offset (and ids, if asked for). Every id of every row lies in exactly one piece;
    the pieces of a sequence follow one another without gaps from offset 0 and fill at most `capacity`.
    An empty text is one piece, the end id. Null doc_ids and rows that share a doc_id are packed like
    any other row. An empty table gives an empty one.
    """
    if not 0 < LEAST_SLOT_K <= capacity:
        raise ValueError(f"capacity must be at least {LEAST_SLOT_K}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = cut(_pieces(docs, tokenizer_path, capacity, end_id, with_ids))
    # A bucket has about BUCKET pieces, whatever one document has.
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(max(LEAST_BUCKETS, pieces.count() // BUCKET))))

    group = Window.partitionBy("class", "bucket")
    counted = pieces.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    of_class = Window.partitionBy("class")
    firsts = counted.select(
        "class", "bucket",
        (F.sum("n").over(of_class.orderBy("bucket")) - F.col("n")).alias("before"),
        F.sum("n").over(of_class).alias("in_class"),
    )
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = (
        pieces.withColumn("rank", F.row_number().over(group.orderBy(*order)) - 1)
        .join(firsts, ["class", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("before"))
        .withColumn("whole", F.col("rank") < F.col("in_class") - F.col("in_class") % F.col("class"))
    )
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    filled = ranked.where("whole").withColumn("sequence_id", F.expr(f"(rank div class) * {ID_STEP} + class"))
    filled = filled.withColumn("offset", F.sum("length").over(Window.partitionBy("sequence_id").orderBy("rank")) - F.col("length"))
    over = ranked.where("not whole").select(*own, "class")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in over.drop("class").schema) + ", sequence_id long, offset long"
    over = over.groupBy().applyInPandas(_best_fit(capacity), schema)
    return filled.select(*own, "sequence_id", "offset").unionByName(over.select(*own, "sequence_id", "offset"))
