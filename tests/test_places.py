"""Places by range partitions, quantiles from them, lists in order, and Python's shuffle from its swaps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.operators import findings, select


def test_places(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(40)])) for _ in range(500)]
    got = select.places(spark.createDataFrame(rows, "g string, v int").repartition(7), ["g"], ["v"]).collect()
    for g in ("a", "b", None):
        own = sorted((x.place, x.v) for x in got if x.g == g)
        want = sorted((v for h, v in rows if h == g), key=lambda v: (v is not None, v or 0))
        assert [v for _, v in own] == want and [p for p, _ in own] == list(range(len(want)))
        assert {x.size for x in got if x.g == g} == {len(want)}
    assert select.places(spark.createDataFrame([], "v int"), [], ["v"]).count() == 0


def test_quantiles_equal_numpys(spark):
    r = random.Random(2)
    rows = [(g, r.choice([r.random() * 100, 5.0])) for g, n in (("a", 101), ("b", 2), ("c", 1), (None, 40)) for _ in range(n)] + [("a", None), ("a", float("nan")), ("d", None)]
    wanted = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p": 0.975, "top": 1.0}
    got = {x.g: x for x in select.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", wanted).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g in got:
        own = [v for h, v in rows if h == g and v is not None and v == v]
        assert [got[g][k] for k in wanted] == pytest.approx([np.quantile(own, q) for q in wanted.values()])


def test_lists_in_order(spark):
    base = [("m1", i, i) for i in range(60)]
    same, turned, other = [("m2", i, 5 * i + 1) for i in range(60)], [("m2", i, -i) for i in range(60)], [("m2", i, i) for i in range(59)] + [("m2", 99, 59)]
    for second, want in ((same, True), (turned, False), (other, False), (same[:-1], False)):
        assert findings.aligned(spark.createDataFrame(base + second, "m string, image int, pos int"), [], "m", "image", "pos").first().aligned == want
    assert not findings.aligned(spark.createDataFrame(base, "m string, image int, pos int"), [], "m", "image", "pos").first().aligned


@pytest.mark.parametrize("seed", [0, 7, 42, 12345])
def test_shuffle_from_its_swaps(seed):
    for n in (0, 1, 2, 9, 10, 11, 257, 1000):
        pool = list(range(n))
        random.Random(seed).shuffle(pool)
        assert select.shuffled(n, 10, seed) == pool[:10]


@pytest.mark.parametrize("seed", [3, 42])
def test_audit_as_shuffled(spark, seed):
    ids = [f"c{i:03d}" for i in range(120)]
    images = spark.createDataFrame([(i,) for i in ids], "case string").repartition(4)
    hard = spark.createDataFrame([("c050", "x", 1), ("c007", "y", 0)], "case string, role string, ord int")
    got = sorted(select.audit_as_shuffled(images, hard, "case", [], 10, seed).collect(), key=lambda r: r.ord)
    pool = [k for k in range(120) if k not in (7, 50)]
    random.Random(seed).shuffle(pool)
    assert [(r.case, r.role) for r in got] == [("c007", "y"), ("c050", "x"), *((ids[k], None) for k in pool[:8])]
    few = select.audit_as_shuffled(images.where(F.col("case") < "c003"), hard.limit(0), "case", [], 10, seed).collect()
    assert len(few) == 3
