"""Findings as bits give what the sets of findings give."""

import random

import pytest
from pyspark.sql import functions as F

from scorelake.operators import findings, packed

GRID = packed.Grid(tuple(range(11, 19)), ("a", "b", "c"))


def _rows(seed, n=400):
    r = random.Random(seed)
    return [(r.choice(["x", "y"]), r.randint(0, 30), r.choice(GRID.locations), r.choice(GRID.conditions), r.random() < 0.5) for _ in range(n)]


def _same(a, b):
    key = lambda r: tuple(sorted((k, str(round(v, 9) if isinstance(v, float) else v)) for k, v in r.asDict().items()))
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def test_packed_sets_equal_sets(spark):
    rows = spark.createDataFrame(_rows(1), "model string, image int, loc int, cond string, t boolean")
    image = ["model", "image"]
    images = rows.select(*image).distinct().unionByName(spark.createDataFrame([("x", 99)], "model string, image int"))
    bits = packed.pack(rows.unionByName(images.select(*image, F.lit(None).cast("int").alias("loc"), F.lit(None).cast("string").alias("cond"), F.lit(None).cast("boolean").alias("t"))), image, "loc", "cond", "t", GRID)
    assert bits._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2  # one, shown in the first and the final plan
    matches = findings.match(rows.where("t"), rows.where("not t"), [*image, "loc", "cond"])
    _same(packed.summary(bits, ["model"], GRID), findings.summary(images, matches, ["model"], image, GRID.slots))
    _same(packed.image_rows(bits, image, GRID), findings.image_rows(images, matches, image, GRID.slots, "loc", "cond"))
    _same(packed.location_breakdown(bits, ["model"], GRID), findings.location_breakdown(findings.located(matches, image, "loc", "cond"), ["model"]))
    n = images.where("model = 'y'").count()
    whole = findings.by_condition(matches.where("model = 'y'"), n * len(GRID.locations), ["cond"])
    _same(packed.by_condition(bits.where("model = 'y'"), [], "cond", GRID), whole.withColumn("tn", F.col("tn").cast("bigint")))


def test_all_64_locations(spark):
    grid = packed.Grid(tuple(range(64)), ("a",))
    rows = spark.createDataFrame([(1, i, "a", t) for i in (0, 62, 63) for t in (True, False)] + [(1, 63, "a", True)], "image int, loc int, cond string, t boolean")
    row = packed.image_rows(packed.pack(rows, ["image"], "loc", "cond", "t", grid), ["image"], grid).first()
    assert (row.tp, row.fp, row.fn, row.tn, row.tp_set) == (3, 0, 0, 61, "0|a; 62|a; 63|a")


@pytest.mark.parametrize(("loc", "cond", "what"), [(99, "a", "no such location: 99"), (11, "z", "no such condition: z"), (11, None, "no such condition: null")])
def test_findings_beyond_the_grid_are_errors(spark, loc, cond, what):
    rows = spark.createDataFrame([(1, loc, cond, True)], "image int, loc int, cond string, t boolean")
    with pytest.raises(Exception, match=what):
        packed.pack(rows, ["image"], "loc", "cond", "t", GRID).collect()


def test_no_findings(spark):
    none = spark.createDataFrame([], "image int, loc int, cond string, t boolean")
    bits = packed.pack(none, ["image"], "loc", "cond", "t", GRID)
    assert packed.image_rows(bits, ["image"], GRID).count() == 0 and packed.by_condition(bits, [], "cond", GRID).count() == 0
