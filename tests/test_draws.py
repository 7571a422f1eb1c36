"""Draws made in blocks against NumPy's own and against a plain sum over draws; pairs of models; all text scores in one pass."""

import hashlib
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from scorelake.operators import draws, resample, textsim
from scorelake.plans import catalogue


@pytest.mark.parametrize(("n", "reps"), [(12, 40), (1, 3), (1000, 37)])
def test_numpys_stream_in_many_tasks(spark, n, reps, monkeypatch):
    monkeypatch.setattr(draws, "WORDS", 1 << 10)
    made, rng = draws.numpy_draws(spark, n, reps, 5), np.random.default_rng(5)
    want = [np.bincount(rng.integers(0, n, size=n), minlength=n).tolist() for _ in range(reps)]
    assert n * reps < 1 << 10 or len(made.before) > 1
    got = {rep: w.tolist() for a in range(0, reps, 7) for rep, w in made.weights(a, min(reps, a + 7), 0, n)}
    assert [got[r] for r in range(reps)] == want


def test_rejected_words():
    n = (1 << 31) + 5  # nearly half of the words are rejected
    values, counts = draws._bounded(draws._words(5, 0, 4096), n)
    assert 0.4 < counts.mean() < 0.6
    assert values[counts][:1000].tolist() == np.random.default_rng(5).integers(0, n, size=1000).tolist()


@pytest.mark.parametrize("size", [4, 1 << 16])
def test_sums_by_blocks_of_clusters(spark, size, monkeypatch):
    rnd = random.Random(3)
    rows = [(g, i, rnd.randint(0, 9), rnd.randint(0, 9)) for g in ("a", "b", None) for i in range(10) if rnd.random() < 0.7] + [("a", 0, 5, 5)]
    counts = spark.createDataFrame(rows, "g string, idx int, tp int, fp long")
    made = draws.MD5Draws(10, 30, 42)
    drawn = {rep: Counter(int(hashlib.md5(f"42:{rep}:{i}".encode()).hexdigest()[:8], 16) % 10 for i in range(10)) for rep in range(30)}
    want = {}
    for g in ("a", "b", None):
        for rep, w in drawn.items():
            own = [(w[i], tp, fp) for h, i, tp, fp in rows if h == g]
            if any(k for k, *_ in own):
                want[g, rep] = (sum(k for k, *_ in own), sum(k * tp for k, tp, _ in own), sum(k * fp for k, _, fp in own))
    monkeypatch.setattr(draws, "CLUSTERS", size)
    got = {(r.g, r.rep): (r.images, r.tp, r.fp) for r in draws.sums(counts, made, ["g"], ["tp", "fp"]).collect()}
    assert got == want


def test_all_pairs_by_hand(spark):
    rows = [("r", m, o, i, tp, fp) for m, o, cells in (("x", 2, [(1, 1), (0, 2)]), ("y", 1, [(2, 0), (1, 1)]), ("z", 9, [(0, 0), (0, 0)])) for i, (tp, fp) in enumerate(cells)]
    images = spark.createDataFrame(rows, "run string, model string, ord int, idx long, tp long, fp long")
    drawn = spark.createDataFrame([(0, 0, 2), (1, 1, 2)], "rep long, idx long, w long")
    got = {(r.model_a, r.model_b): r for r in resample.all_pairs(images, drawn, ["run"], "model", "ord", spark.createDataFrame([("r", True)], "run string, aligned boolean")).collect()}
    assert sorted(got) == [("x", "z"), ("y", "x"), ("y", "z")]
    r = got["y", "x"]
    assert (r.paired, r.n_images, r.chr_a, r.chr_b, r.fp_per_image_a, r.fp_per_image_b) == (True, 2, 0.25, 0.75, 0.5, 1.5)
    # Replicates: y has CHR 0 and 1/2, x has 1/2 and 1.
    assert (r.chr_delta_low, r.chr_delta_high) == (-0.5, -0.5)
    assert r.fp_per_image_delta_low == pytest.approx(-1.0) and r.fp_per_image_delta_high == pytest.approx(-1.0)
    assert got["y", "z"].chr_b is None and got["y", "z"].chr_delta_low is None and got["y", "z"].fp_per_image_delta == 0.5
    none = resample.all_pairs(images, drawn, ["run"], "model", "ord", spark.createDataFrame([("r", False)], "run string, aligned boolean")).collect()
    assert len(none) == 3 and all(not r.paired and r.n_images is None and r.chr_delta is None for r in none)


def test_all_scores_in_one_pass(spark):
    rnd = random.Random(4)
    words = lambda: " ".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 12)))
    rows = [(i, words(), words() if i % 6 else None) for i in range(60)] + [(60, None, ""), (61, "a b", "a b")]
    made = textsim.text_scores(spark.createDataFrame(rows, "k int, ref string, hyp string"), "k", "ref", "hyp")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r for r in made.collect()}
    assert all(got[i].bleu4 is None and got[i].rouge1_f1 is None for i, _, h in rows if h is None)
    for i, ref, hyp in rows:
        if hyp is None:
            continue
        a, b = (ref or "").split(), hyp.split()
        for n, score in ((1, got[i].rouge1_f1), (2, got[i].rouge2_f1)):
            x, y = (Counter(tuple(s[k : k + n]) for k in range(len(s) - n + 1)) for s in (a, b))
            assert score == pytest.approx(2 * (x & y).total() / max(1, x.total() + y.total()))
        p, q, v = Counter(a), Counter(b), len({*a, *b})
        share = lambda c, n, w, v=v: (c[w] + 1e-3) / (n + 1e-3 * v)
        if v:
            want = sum(share(p, len(a), w) * np.log2(share(p, len(a), w) / share(q, len(b), w)) for w in {*a, *b})
            assert got[i].kl_bits == pytest.approx(want)
        else:
            assert got[i].kl_bits is None and got[i].js_bits is None
    assert got[61].rouge_l_f1 == 1 and got[61].js_bits == 0 and got[60].bleu4 == 0


def test_pairs_are_counted_a_slice_at_a_time(monkeypatch):
    """A worker holds the grams of TOKENS_AT_ONCE tokens at a time, and scores don't depend on the slices."""
    rnd = random.Random(5)
    words = lambda n: [rnd.choice("abcdefg") for _ in range(rnd.randint(0, n))]
    r, h = (pa.array([[], *(words(30) for _ in range(50)), ["a"] * 500, []], pa.list_(pa.string())) for _ in range(2))
    seen = []

    def make(x, y):
        grams = textsim.Grams(x, y)
        seen.append((len(grams.tokens), len(x)))
        return textsim._divergence_columns(grams, 1e-3) | textsim._overlap_columns(grams, 4)

    for part in ((r, h), (r[3:20], h[3:20]), (r[:0], h[:0])):
        whole = textsim._sliced(*part, make)
        monkeypatch.setattr(textsim, "TOKENS_AT_ONCE", 100)
        seen.clear()
        sliced = textsim._sliced(*part, make)
        monkeypatch.undo()
        assert all(n <= 100 or rows == 1 for n, rows in seen) and sum(rows for _, rows in seen) == len(part[0])
        for c in whole:
            np.testing.assert_allclose(sliced[c], whole[c], rtol=1e-12)


def test_means_of_scores_are_rounded_once(spark):
    """The SQL rounds each score to six digits and the mean to four; a mean between 0.xxxx4995 and 0.xxxx5 must not go up."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet'")
    want = con.execute(catalogue.ORACLE_SQL["text_score_means"]).fetchdf().sort_values("turn").reset_index(drop=True)
    got = catalogue.QUERIES["text_score_means"](spark, folder).toPandas().sort_values("turn").reset_index(drop=True)
    for c in want.columns:
        np.testing.assert_allclose(got[c], want[c], rtol=0, atol=1e-9)
