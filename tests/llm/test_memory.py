"""What a worker holds at once follows bytes, not Spark's batches, and what it has let go of goes back to the system."""

import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scorelake.llm import common, langid


def test_batches_of_long_texts_come_in_slices(spark):
    docs = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.concat(F.lit("é"), F.col("id").cast("string")), 1000).alias("text"))

    def seen(batch):
        ids, texts = batch.column("id").to_pylist(), common.texts_of(batch)
        assert texts == [f"é{i}" * 1000 for i in ids]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([ids[0]], [ids[-1]], [len(ids)], [batch.nbytes])], ["first", "last", "n", "size"])

    rows = common.map_batches(docs, seen, "first long, last long, n long, size long").collect()
    assert sum(r.n for r in rows) == 3000 and [r.first for r in rows][1:] == [r.last + 1 for r in rows][:-1]
    assert len(rows) > 2 and max(r.size for r in rows) < 1.2 * common.AT_ONCE


def test_slices_of_any_batch():
    assert [p.num_rows for p in common._parts(pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["text"]))] == [0]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * common.AT_ONCE, None, "y" * (2 * common.AT_ONCE)])], ["text"])
    assert [p.num_rows for p in common._parts(batch)] == [1, 1, 1] and pa.Table.from_batches(common._parts(batch)).equals(pa.Table.from_batches([batch]))


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_free_memory_goes_back():
    anonymous = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024
    blocks = [b"%d" % i * 400 for i in range(60_000)]
    last = [b"." * 2000 for _ in range(100)]  # above them, so the heap can't shrink by itself
    full = anonymous()
    blocks.clear()
    common._give_back()
    assert full - anonymous() > 60 and len(last) == 100


def test_new_words_are_scored_a_few_at_a_time(monkeypatch):
    R = random.Random(5)
    word = lambda: "".join(R.choice("abcdefgh") for _ in range(R.randint(1, 9)))
    model = langid.fit({lang: Counter(word() for _ in range(300)) for lang in ("a", "b", "c")})
    texts = [" ".join(word() for _ in range(R.randint(0, 60))) for _ in range(40)]
    whole = langid.Scorer(model).sums(texts)
    asked = []
    score = langid.LanguageModel.word_bits
    monkeypatch.setattr(langid.LanguageModel, "word_bits", lambda self, words: asked.append(len(words)) or score(self, words))
    monkeypatch.setattr(langid, "NUMBERS_AT_ONCE", 40, raising=False)
    assert np.array_equal(langid.Scorer(model).sums(texts), whole) and max(asked) == 10 and sum(asked) > 500
