"""Token ids in ORC files.

Files hold ascending, disjoint ranges of doc_id and their names ascend with them. Ids are integer columns, which ORC
run-length encodes within its stripes; row indexes every ROW_STRIDE rows and Bloom filters on doc_id let
a reader that asks for some documents skip files, stripes and row groups by metadata alone. Stripes are
the unit of parallel reads.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.llm.common import checkpoint_dir, cut, map_batches
from scorelake.llm.wordtok import tokenizer

ROW_STRIDE = 1000
STRIPE_BYTES = 16 << 20


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1) -> None:
    """Encode every text and write doc_id, ids, part and pos (place within the part) in ascending doc_id order.

    Null text counts as empty (just the end id). Null doc_ids come first; rows that share a doc_id all
    stay, ordered by their text.
    """

    def encode(batches):
        pos, encode_array = 0, tokenizer(tokenizer_path).encode_array
        for batch in batches:
            flat, ends = encode_array(batch.column("text"), end_id)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view("<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, batch.column("part"), pa.array(np.arange(pos, pos + batch.num_rows), pa.int64())], ["doc_id", "ids", "part", "pos"])
            pos += batch.num_rows

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    map_batches(ordered.limit(0), lambda b: b, ordered.schema)  # shares the code with the workers
    (
        ordered.mapInArrow(encode, "doc_id long, ids array<int>, part int, pos long")
        .write.option("orc.compress", "LZ4").option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", ROW_STRIDE)
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .orc(folder)
    )


def read_token_files(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """What write_token_files wrote; with doc_ids, files and stripes without them are skipped."""
    files = spark.read.schema("doc_id long, ids array<int>, part int, pos long").orc(folder)
    return files if doc_ids is None else files.where(F.col("doc_id").isin(doc_ids))


def token_index(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all rows before it), n_tokens and ids_crc32 of every row of the files.

    Running sums are formed within a file and over the files' totals, so no task sees all rows.
    """

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("ids")
        values, ends = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), ids.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("pos"), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "part", "pos", "n_tokens", "ids_crc32"])

    rows = cut(map_batches(files, digest, "doc_id long, part int, pos long, n_tokens long, ids_crc32 long"))
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("pos")) - F.col("n_tokens")
    return rows.withColumn("within", within).join(before, "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
