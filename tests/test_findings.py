"""Hand-computed cases of the finding-level metrics, and the bootstrap's properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.functions import rates
from scorelake.operators import confusion, findings, resample, select

KEYS = ["image", "loc", "cond"]


def _matches(spark, truth, told):
    made = lambda rows: spark.createDataFrame(rows, "image string, loc string, cond string")
    return findings.match(made(truth), made(told), KEYS)


def _summary(spark, truth, told, slots, images=("im",)):
    frame = spark.createDataFrame([("m", i) for i in images], "model string, image string")
    return findings.summary(frame, _matches(spark, truth, told).withColumn("model", F.lit("m")), ["model"], ["image"], slots).first()


def test_brief(spark):
    r = _summary(spark, [("im", "1", "caries"), ("im", "1", "missing")], [("im", "1", "caries"), ("im", "1", "lesion"), ("im", "1", "fracture")], 100)
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 2, 1, 96)
    assert r.precision == pytest.approx(1 / 3) and r.recall == pytest.approx(1 / 2) and r.f1 == pytest.approx(0.4) and r.chr == pytest.approx(2 / 3)


def test_true_negatives(spark):
    r = _summary(spark, [("im", "t", "A")], [("im", "t", "A"), ("im", "t", "B")], 4)
    assert r.tn == 2 and r.specificity == pytest.approx(2 / 3) and r.fpr == pytest.approx(1 / 3) and r.accuracy == pytest.approx(3 / 4)


def test_nothing_told(spark):
    r = _summary(spark, [("im", "1", "caries")], [], 100)
    assert r.chr is None and r.precision is None and r.f1 is None and r.recall == 0 and r.image_rate == 0


def test_no_truth_and_image_without_findings(spark):
    r = _summary(spark, [], [("im", "1", "caries"), ("im", "2", "caries")], 100, ("im", "other"))
    assert (r.fp, r.chr, r.images, r.image_rate) == (2, 1, 2, 0.5)


def test_location_priority(spark):
    m = _matches(spark, [("im", "26", "Caries"), ("im", "11", "Impacted")], [("im", "16", "Caries"), ("im", "11", "Impacted"), ("im", "11", "Lesion"), ("im", "37", "Deep")])
    got = {r.bucket: (r.n, r.rate) for r in findings.location_breakdown(findings.located(m, ["image"], "loc", "cond"), []).collect()}
    assert got == {b: (1, 0.25) for b in ("correct", "wrong_location", "wrong_condition", "unsupported")}


def test_conditions(spark):
    m = _matches(spark, [("a", "26", "Caries"), ("b", "11", "Impacted")], [("a", "26", "Caries"), ("a", "15", "Impacted"), ("b", "12", "Impacted"), ("b", "30", "Caries")])
    got = {r.cond: r for r in findings.by_condition(m, 64, ["cond"]).collect()}
    assert (got["Caries"].tp, got["Caries"].fp, got["Caries"].fn, got["Caries"].tn) == (1, 1, 0, 62)
    assert got["Impacted"].fp_share == pytest.approx(200 / 3)


def test_policies(spark):
    row = spark.range(1).select(*(rates.ratio(F.lit(1), F.lit(0), p).alias(p) for p in (rates.NULL, rates.ZERO, rates.NAN))).first()
    assert row[0] is None and row[1] == 0 and np.isnan(row[2])


def test_bootstrap_is_resampling_of_slots(spark):
    rng = np.random.default_rng(3)
    t, p = rng.integers(0, 2, (12, 32)), rng.integers(0, 2, (12, 32))
    rows = spark.createDataFrame([(c, int(t[c, s]), int(p[c, s])) for c in range(12) for s in range(32)], "case int, t int, p int")
    counts = resample.clusters(confusion.binary_counts(rows, ["case"], "t", "p"), [], "case")
    got = {r.rep: r for r in resample.replicates(counts, resample.numpy_draws(spark, 12, 20, 5), []).collect()}
    g = np.random.default_rng(5)
    for rep in range(20):
        pick = g.integers(0, 12, size=12)
        assert got[rep].tp == int(((t[pick] == 1) & (p[pick] == 1)).sum()) and got[rep].fn == int(((t[pick] == 1) & (p[pick] == 0)).sum())
    ci = resample.macro_f1_interval(counts, resample.md5_draws(spark, 12, 50), []).first()
    assert ci.low <= ci["mean"] <= ci.high and ci.n_boot == 50


def test_example_metrics_of_empty_sets(spark):
    rows = spark.createDataFrame([("m", [], []), ("m", ["a"], []), ("m", ["a", "b"], ["a"])], "m string, g array<string>, h array<string>")
    r = confusion.example_metrics(rows, ["m"], "g", "h", 2).first()
    assert r.jaccard == pytest.approx((1 + 0 + 0.5) / 3) and r.subset_accuracy == pytest.approx(1 / 3) and r.hamming == pytest.approx(2 / 6) and r.n_any == 2


def test_findings_intervals_by_hand(spark):
    rows = spark.createDataFrame([("m", 0, 1, 0, 0), ("m", 1, 0, 2, 1), ("m", 2, 0, 0, 0)], "model string, idx long, tp long, fp long, fn long")
    draws = spark.createDataFrame([(0, 0, 3), (1, 1, 2), (1, 2, 1), (2, 2, 3)], "rep long, idx long, w long")
    got = {r.metric: r for r in resample.finding_intervals(rows, draws, ["model"]).collect()}
    assert got["precision"].point == pytest.approx(1 / 3) and got["precision"].n_boot == 2 and got["image_rate"].n_boot == 3  # undefined where nothing is told
    assert got["chr"]["mean"] == pytest.approx(0.5) and got["f1"].n_boot == 1 and got["image_rate"].point == pytest.approx(1 / 3)


def test_paired_findings_by_hand(spark):
    rows = [("a", 0, 1, 1), ("a", 1, 0, 0), ("b", 0, 1, 0), ("b", 1, 0, 2)]
    images = spark.createDataFrame(rows, "model string, idx long, tp long, fp long")
    draws = spark.createDataFrame([(0, 0, 2), (1, 1, 2)], "rep long, idx long, w long")
    r = resample.paired_findings(images, draws, "model", "a", "b").first()
    assert (r.chr_a, r.chr_b, r.fp_per_image_a, r.fp_per_image_b) == (0.5, pytest.approx(2 / 3), 0.5, 1.0)
    assert (r.chr_delta_low, r.chr_delta_high) == (0.5, 0.5)  # the second replicate has no CHR of a
    assert r.fp_per_image_delta_low == pytest.approx(1 - 3 * 0.975) and r.images == 2


def test_clusters_of_groups(spark):
    rows = spark.createDataFrame([(g, f"c{i:02d}") for g in "ab" for i in range(17) for _ in range(2)], "g string, c string")
    assert {(r.g, r.c): r.idx for r in resample.clusters(rows, ["g"], "c").collect()} == {(g, f"c{i:02d}"): i for g in "ab" for i in range(17)}
    assert [r.idx for r in resample.clusters(rows.select("c"), [], "c").distinct().orderBy("c").collect()] == list(range(17))


def test_alignment_needs_the_order(spark):
    rows = [("m", "i1", 0), ("m", "i2", 1), ("n", "i1", 10), ("n", "i2", 20)]
    made = lambda r: findings.aligned(spark.createDataFrame(r, "model string, image string, pos int"), [], "model", "image", "pos").first().aligned
    assert made(rows) and not made([*rows[:2], ("n", "i2", 0), ("n", "i1", 1)]) and not made(rows[:2])


def test_hard_cases_and_strategy(spark):
    images = spark.createDataFrame([("a", 0, 2), ("b", 1, 0), ("c", 1, 3)], "image string, g int, p int")
    g, p = F.col("g"), F.col("p")
    hard = select.hard_cases(images, {"empty_gt_pred": (g == 0) & (p > 0), "over_predict": (p > g) & (g > 0), "never": g > 9}, ["image"])
    assert {(r.image, r.role) for r in select.audit_cases(images, hard, "image", 3).collect()} == {("a", "empty_gt_pred"), ("b", None), ("c", "over_predict")}
    done = spark.createDataFrame([("m", "cot")], "model string, strategy string")
    assert select.same_strategy(done, "strategy", "cot").count() == 1
    with pytest.raises(Exception, match="this run uses few_shot"):
        select.same_strategy(done, "strategy", "few_shot").collect()


def test_too_many_labels(spark):
    rows = spark.createDataFrame([("x", 1, 1)], "g string, t int, p int")
    with pytest.raises(Exception, match="labels"):
        confusion.matrix(rows, ["g"], "t", "p", spark.range(1001).select(F.col("id").cast("int").alias("label"))).collect()
