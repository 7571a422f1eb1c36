"""What the operators of this subpackage share: the checkpoint folder and batch helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.session import share_code


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where it names none, a temporary one in local mode (tests); a cluster must name one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    folder = named or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="scorelake-checkpoint-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, large: bool = True) -> DataFrame:
    """Compute df once, keep it in the checkpoint folder and forget its lineage.

    Where large shuffle files lie behind it, which are of no more use, the cleaner gets a chance to drop them.
    """
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if large:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
    return out


def table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as Parquet in the checkpoint folder, read again, and its folder, which remove_folder deletes. Smaller than a checkpoint of many rows."""
    folder = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


#: At most so many keys are hot, whatever the input; so many rows of a key are none; a hot key's rows are dealt over so many tasks.
MOST_HOT, NEVER_HOT, SALTS = 20_000, 400, 64
#: A table of at most so many times NEVER_HOT rows is joined as it is: looking for hot keys in it takes exchanges, each with a thread of the driver's.
FEW_TIMES = 12


def hot_limit(total: int) -> int:
    """A key with more of `total` rows than this is hot; fewer than MOST_HOT keys can be."""
    return max(NEVER_HOT, total // MOST_HOT)


def join_hot(rows: DataFrame, facts: DataFrame, key: str | list[str], total: int, by: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows and what facts, one row a key with the number of its rows as n, say of their key. counts has key and n as well, where facts are dear to make.

    Rows of hot keys are dealt over SALTS tasks by the column `by`, and those keys' facts are copied to all of them. The
    list of hot keys is broadcast; it has fewer than MOST_HOT entries, as rows has at most `total`.
    """
    limit, keys = hot_limit(total), [key] if isinstance(key, str) else key
    if total <= FEW_TIMES * NEVER_HOT:
        return rows.join(facts.drop("n"), keys, how)
    hot = (facts if counts is None else counts).where(F.col("n") > limit).select(*keys, F.lit(True).alias("__hot"))
    place = F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", place).drop("__hot")
    salts = F.when(F.col("n") > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = facts.withColumn("__salt", F.explode(salts)).drop("n")
    return dealt.join(copied, [*keys, "__salt"], how).drop("__salt")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """mapInArrow over batches of about AT_ONCE bytes at most, whatever Spark's hold; fn gives one batch, several or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _let_go()
        for batch in batches:
            for part in _parts(batch):
                out = fn(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out
                out = None
            batch = part = None
        _give_back()

    share_code(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Bytes of a batch that are worked off at once. Spark's batches hold up to 10,000 rows, however long their texts.
AT_ONCE = 4 << 20


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch's rows in order, in slices of about AT_ONCE bytes, at least a row each."""
    if batch.nbytes <= AT_ONCE:
        yield batch
        return
    rows = max(1, batch.num_rows * AT_ONCE // batch.nbytes)
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as strings; null counts as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


class Memo(dict):
    """A bounded cache: over `most` entries it is emptied, so a worker's memory stays bounded."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def make_room(self) -> None:
        if len(self) > self.most:
            self.clear()


class Recent:
    """A bounded cache of two generations: what was asked for since the last turn, and what was before it."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key: str) -> Any:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.young[key] = found
        return found

    def turn(self) -> None:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}


_holds: list[Any] = []
_stage: list[int] = []


def _let_go() -> None:
    """Where a task of another stage begins, drop what the stage before it held and give its memory back."""
    task = TaskContext.get()
    if task is not None and _stage != [task.stageId()]:
        _stage[:] = [task.stageId()]
        _holds.clear()
        gc.collect()
        _give_back()


def _give_back() -> None:
    """Give the system what is free in Arrow's pool and in the C library's: a worker keeps it otherwise, also while it waits for its next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim is not None:
        trim(0)


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What make gives, kept until another key is asked for.

    Stages share worker processes. A worker holds the caches of one stage at a time, so they don't add up.
    """
    if not _holds or _holds[0] != key:
        _holds.clear()
        _holds.extend((key, make()))
    return _holds[1]
