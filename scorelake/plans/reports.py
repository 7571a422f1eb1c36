"""More queries over the test tables: scores of cases and labels, report rows, intervals over images, text scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.operators import confusion, findings, resample, select, textsim
from scorelake.plans import catalogue as base
from scorelake.plans.catalogue import _BIN, _CLS, _CNT, _EV, _MF1, _MM, _PL, _S, _SETS, _Z, LOCATIONS, _query, _rounded, _t

_R6 = lambda x, a: f"round({x}, 6) AS {a}"
_BAL = f"(({_Z('tp', 'tp + fn')} + {_Z('tn', 'tn + fp')}) / 2)"
_SCORES = {
    "precision": _Z("tp", "tp + fp"), "recall": _Z("tp", "tp + fn"), "f1": _Z("2 * tp", "2 * tp + fp + fn"), "macro_f1": _MF1,
    "accuracy": _Z("tp + tn", "tp + fp + fn + tn"), "specificity": _Z("tn", "tn + fp"), "balanced_accuracy": _BAL, "npv": _Z("tn", "tn + fn"),
}
_CASES = f"WITH {_S}, c AS (SELECT lang, source, {_BIN} FROM s GROUP BY ALL)"


@_query(f"{_CASES} SELECT *, tp + fn AS support, {', '.join(_R6(x, n) for n, x in _SCORES.items())} FROM c")
def case_scores(spark, sf_dir) -> DataFrame:
    return _rounded(confusion.case_scores(base._slots(spark, sf_dir), ["lang"], "source", "t", "p"))


@_query(f"{_CASES} SELECT lang, CAST(count(*) AS BIGINT) AS cases, {', '.join(_R6(f'avg({x})', f'mean_{n}') for n, x in _SCORES.items())} FROM c GROUP BY lang")
def case_mean_all_scores(spark, sf_dir) -> DataFrame:
    return _rounded(confusion.case_mean(base._slots(spark, sf_dir), ["lang"], "source", "t", "p", confusion.CASE_SCORES))


def _labelled(spark, sf_dir) -> DataFrame:
    return base._per_label(spark, sf_dir).join(base._slots(spark, sf_dir).select("doc_id", "source"), "doc_id")


_BINP = _BIN.replace("t = 1", "pl.t = 1").replace("p = 1", "pl.p = 1").replace("t <> 1", "pl.t <> 1").replace("p <> 1", "pl.p <> 1")
_BY_SOURCE = f"WITH {_PL}, c AS (SELECT s.source, cond, {_BINP} FROM pl JOIN s USING (doc_id) GROUP BY ALL)"


@_query(f"{_BY_SOURCE} SELECT cond, {_R6('avg(' + _SCORES['precision'] + ')', 'precision')}, {_R6('avg(' + _SCORES['recall'] + ')', 'recall')}, {_R6('avg(' + _SCORES['f1'] + ')', 'f1')}, {_R6('avg(tp + fn)', 'support')} FROM c GROUP BY cond")
def label_case_means(spark, sf_dir) -> DataFrame:
    return _rounded(confusion.label_means(_labelled(spark, sf_dir), [], "source", "cond", "t", "p"))


_NONE = f"{_PL}, nf AS (SELECT doc_id, lang, cond, t, p FROM pl UNION ALL SELECT doc_id, lang, 'none', 1 - max(t), 1 - max(p) FROM pl GROUP BY doc_id, lang)"


@_query(f"WITH {_NONE}, c AS (SELECT lang, cond, {_BIN} FROM nf GROUP BY ALL) SELECT *, {_R6(_SCORES['precision'], 'precision')}, {_R6(_SCORES['recall'], 'recall')}, {_R6(_SCORES['f1'], 'f1')} FROM c")
def labels_and_none(spark, sf_dir) -> DataFrame:
    rows = confusion.with_none(base._per_label(spark, sf_dir), ["doc_id", "lang"], "cond", "t", "p", "none")
    z = confusion.rates.ZERO
    counts = confusion.binary_counts(rows, ["lang", "cond"], "t", "p")
    f1 = confusion.rates.f1_of_counts(F.col("tp"), F.col("fp"), F.col("fn"))
    return _rounded(counts.select("*", confusion.rates.precision(z).alias("precision"), confusion.rates.recall(z).alias("recall"), f1.alias("f1")))


_X = lambda a, b: f"round(({a}) / nullif(CAST({b} AS DOUBLE), 0), 6)"


@_query(f"WITH {_PL}, c AS (SELECT lang, cond, {_BIN} FROM pl GROUP BY ALL) SELECT *, {_X('tp', 'tp + fn')} AS sensitivity, {_X('tn', 'tn + fp')} AS specificity, {_X('tp', 'tp + fp')} AS ppv, {_X('tn', 'tn + fn')} AS npv FROM c")
def confusion_ppv_npv(spark, sf_dir) -> DataFrame:
    return confusion.confusion_table(confusion.binary_counts(base._per_label(spark, sf_dir), ["lang", "cond"], "t", "p"))


_F1 = _SCORES["f1"]


@_query(f"WITH {_PL}, c AS (SELECT lang, cond, {_BIN} FROM pl GROUP BY ALL) SELECT lang, {_R6(_Z('2 * sum(tp)', '2 * sum(tp) + sum(fp) + sum(fn)'), 'micro_f1')}, {_R6(f'avg({_F1})', 'macro_f1')}, {_R6(_Z(f'sum({_F1} * (tp + fn))', 'sum(tp + fn)'), 'weighted_f1')} FROM c GROUP BY lang")
def multilabel_averaged_f1(spark, sf_dir) -> DataFrame:
    return _rounded(confusion.averaged_f1(confusion.binary_counts(base._per_label(spark, sf_dir), ["lang", "cond"], "t", "p"), ["lang"]))


@_query(f"WITH {_CLS} SELECT lang, {_R6(_Z('2 * sum(tp)', '2 * sum(tp) + sum(fp) + sum(fn)'), 'micro_f1')}, {_R6('avg(f1)', 'macro_f1')}, {_R6(_Z('sum(f1 * support)', 'sum(support)'), 'weighted_f1')} FROM r GROUP BY lang")
def binary_averaged_f1(spark, sf_dir) -> DataFrame:
    return _rounded(confusion.averaged_f1(confusion.one_vs_rest(base._slots(spark, sf_dir), ["lang"], "t", "p", [0, 1]), ["lang"]))


@_query(f"WITH {_SETS}, i AS (SELECT w.lang, s.source, bool_and(list_sort(g) = list_sort(h)) AS same FROM w JOIN s USING (doc_id) GROUP BY ALL) SELECT lang, CAST(count(*) AS BIGINT) AS images, round(avg(CAST(same AS INT)), 6) AS image_subset_accuracy FROM i GROUP BY lang")
def image_subset_accuracy(spark, sf_dir) -> DataFrame:
    rows = base._sets(spark, sf_dir).join(base._slots(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return _rounded(confusion.image_subset_accuracy(rows, ["lang"], "source", "g", "h"))


@_query(f"""WITH {_EV}, d AS (SELECT DISTINCT image, loc, cond, is_truth FROM ev),
i AS (SELECT image, count(DISTINCT loc) FILTER (is_truth) AS ts, count(DISTINCT loc) FILTER (NOT is_truth) AS ps, count(*) FILTER (is_truth) AS tl, count(*) FILTER (NOT is_truth) AS pl FROM d GROUP BY image),
v AS (SELECT user_id AS image, avg(value) AS sec FROM events GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS cases, round(avg(ps), 6) AS mean_predicted_slots, round(avg(ts), 6) AS mean_truth_slots, round(avg(pl), 6) AS mean_predicted_labels, round(avg(tl), 6) AS mean_truth_labels, round(avg(sec), 6) AS mean_seconds FROM i JOIN v USING (image)""")
def mean_case_sizes(spark, sf_dir) -> DataFrame:
    e = base._events(spark, sf_dir)
    per = e.groupBy("image", "is_truth", "loc").agg(F.collect_set("cond").alias("labels")).groupBy("image", "is_truth").agg(F.map_from_entries(F.collect_list(F.struct("loc", "labels"))).alias("m"))
    none = F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<array<string>>"))
    side = lambda test, a: F.coalesce(F.first(F.when(test, F.col("m")), ignorenulls=True), none).alias(a)
    cases = per.groupBy("image").agg(side(F.col("is_truth"), "g"), side(~F.col("is_truth"), "h"))
    seconds = _t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("image")).agg(F.avg("value").alias("seconds"))
    return _rounded(confusion.mean_sizes(cases.join(seconds, "image"), [], "g", "h", "seconds"))


# Report rows.

_CELL = lambda v, k, a: f"round(max({v}) FILTER (label = {k} AND support > 0), 6) AS {a}"
_WIDE = ", ".join(_CELL(v, k, f'"{k}_{e}"') for k in (1, 0) for v, e in (("precision", "P"), ("recall", "R"), ("f1", "F1")))
_MACRO = "round(avg({0}) FILTER (support > 0), 6)"
_USED = "coalesce(string_agg(label, ',' ORDER BY label) FILTER (support {0} 0), '')"


@_query(f"""WITH {_CLS} SELECT lang, {_WIDE}, {_MACRO.format('precision')} AS "Macro_P", {_MACRO.format('recall')} AS "Macro_R", {_MACRO.format('f1')} AS "Macro_F1", {_USED.format('>')} AS "Macro_classes_used", {_USED.format('=')} AS "Macro_classes_undefined",
round(max(accuracy) FILTER (label = 1), 6) AS "Accuracy", round(max(balanced_accuracy) FILTER (label = 1), 6) AS "Balanced_Accuracy" FROM r GROUP BY lang""")
def report_binary(spark, sf_dir) -> DataFrame:
    rows = base._class_rates(spark, sf_dir)
    wide = confusion.wide_report(rows, ["lang"], ["1", "0"]).join(confusion.macro_report(rows, ["lang"]), "lang")
    return _rounded(wide.join(confusion.overall_report(rows, ["lang"], "1"), "lang"))


@_query(f"""WITH {_CLS} SELECT lang, {_CELL('f1', 1, '"1_F1"')}, {_CELL('f1', 0, '"0_F1"')}, {_MACRO.format('f1')} AS "Macro_F1", {_USED.format('>')} AS "Macro_classes_used", {_USED.format('=')} AS "Macro_classes_undefined" FROM r GROUP BY lang""")
def report_binary_main(spark, sf_dir) -> DataFrame:
    rows = base._class_rates(spark, sf_dir)
    return _rounded(confusion.wide_report(rows, ["lang"], ["1", "0"], ("f1",)).join(confusion.macro_report(rows, ["lang"], values=("f1",)), "lang"))


_PATH = f"WITH {_PL}, c AS (SELECT lang, cond AS label, {_BIN} FROM pl GROUP BY ALL), r AS (SELECT *, {_SCORES['precision']} AS precision, {_SCORES['recall']} AS recall, {_F1} AS f1, tp + fn AS support FROM c)"
_PCELL = lambda v, k, e: f"round(max({v}) FILTER (label = '{k}' AND support > 0), 6) AS \"{k}_{e}\""
_PWIDE = lambda vs: ", ".join(_PCELL(v, k, e) for k in ("quality", "toxic") for v, e in vs)


def _pathology(spark, sf_dir) -> DataFrame:
    counts = confusion.binary_counts(base._per_label(spark, sf_dir), ["lang", "cond"], "t", "p").withColumnRenamed("cond", "label")
    return confusion.class_rates(counts)


@_query(f"""{_PATH} SELECT lang, {_PWIDE([('precision', 'P'), ('recall', 'R'), ('f1', 'F1')])}, {_MACRO.format('precision')} AS "Macro4_P", {_MACRO.format('recall')} AS "Macro4_R", {_MACRO.format('f1')} AS "Macro4_F1", {_USED.format('>')} AS "Macro4_classes_used", {_USED.format('=')} AS "Macro4_classes_undefined" FROM r GROUP BY lang""")
def report_pathology(spark, sf_dir) -> DataFrame:
    rows = _pathology(spark, sf_dir)
    return _rounded(confusion.wide_report(rows, ["lang"], ["quality", "toxic"]).join(confusion.macro_report(rows, ["lang"], "Macro4"), "lang"))


@_query(f"""{_PATH} SELECT lang, {_PWIDE([('f1', 'F1')])}, {_MACRO.format('f1')} AS "Macro4_F1", {_USED.format('>')} AS "Macro4_classes_used", {_USED.format('=')} AS "Macro4_classes_undefined" FROM r GROUP BY lang""")
def report_pathology_main(spark, sf_dir) -> DataFrame:
    rows = _pathology(spark, sf_dir)
    return _rounded(confusion.wide_report(rows, ["lang"], ["quality", "toxic"], ("f1",)).join(confusion.macro_report(rows, ["lang"], "Macro4", values=("f1",)), "lang"))


_SUPPORT = ", ".join(f"CAST(coalesce(max(support) FILTER (label = '{k}'), 0) AS BIGINT) AS \"{k}_support\", coalesce(max(support) FILTER (label = '{k}'), 0) = 0 AS \"{k}_undefined\"" for k in ("quality", "toxic"))


@_query(f"""{_PATH} SELECT lang, {_PWIDE([('precision', 'P'), ('recall', 'R'), ('f1', 'F1')])}, {_SUPPORT} FROM r GROUP BY lang""")
def report_multiclass(spark, sf_dir) -> DataFrame:
    return _rounded(confusion.wide_report(_pathology(spark, sf_dir), ["lang"], ["quality", "toxic"], support=True))


# Intervals over images.

IMAGE_REPS = 1000
_IMG = f"{_MM}, ids AS (SELECT image, row_number() OVER (ORDER BY image) - 1 AS idx FROM (SELECT DISTINCT user_id AS image FROM events)), x AS (SELECT model, idx, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM ii JOIN ids USING (image) LEFT JOIN mi USING (model, image))"
_DRAWN = f"dr AS (SELECT rep, idx, count(*) AS w FROM (SELECT r.range AS rep, CAST('0x' || substr(md5('42:' || r.range || ':' || i.range), 1, 8) AS BIGINT) % (SELECT count(*) FROM ids) AS idx FROM range({IMAGE_REPS}) r, range((SELECT count(*) FROM ids)) i) GROUP BY ALL)"
_P_, _R_ = "tp / nullif(CAST(tp + fp AS DOUBLE), 0)", "tp / nullif(CAST(tp + fn AS DOUBLE), 0)"
_METRICS = {"precision": _P_, "recall": _R_, "f1": f"2 * ({_P_}) * ({_R_}) / nullif(({_P_}) + ({_R_}), 0)", "chr": "fp / nullif(CAST(tp + fp AS DOUBLE), 0)", "image_rate": "hit / nullif(CAST(images AS DOUBLE), 0)"}
_LONG = lambda t: " UNION ALL ".join(f"SELECT model, '{n}' AS metric, {x} AS v FROM {t}" for n, x in _METRICS.items())


def _image_counts(spark, sf_dir) -> tuple[DataFrame, int]:
    images, matches = base._model_matches(spark, sf_dir)
    counts = matches.groupBy("model", "image").agg(*findings.counted())
    rows = images.join(counts, ["model", "image"], "left").fillna(0, ["tp", "fp", "fn"])
    ids = resample.clusters(images.select("image").distinct(), [], "image")
    return rows.join(ids, "image"), base._n_images(spark, sf_dir)


@_query(f"""WITH {_IMG}, {_DRAWN}, a AS (SELECT model, count(*) AS images, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, count(*) FILTER (fp > 0) AS hit FROM x GROUP BY model),
b AS (SELECT model, rep, sum(w) AS images, sum(w * tp) AS tp, sum(w * fp) AS fp, sum(w * fn) AS fn, sum(w * CAST(fp > 0 AS INT)) AS hit FROM x JOIN dr USING (idx) GROUP BY ALL),
pt AS ({_LONG('a')}), bt AS ({_LONG('b')})
SELECT pt.model, pt.metric, round(pt.v, 6) AS point, round(quantile_cont(bt.v, 0.025), 6) AS low, round(quantile_cont(bt.v, 0.975), 6) AS high, round(avg(bt.v), 6) AS mean, CAST(count(bt.v) AS BIGINT) AS n_boot
FROM pt JOIN bt ON bt.model = pt.model AND bt.metric = pt.metric GROUP BY pt.model, pt.metric, pt.v""")
def finding_intervals_md5(spark, sf_dir) -> DataFrame:
    rows, n = _image_counts(spark, sf_dir)
    return _rounded(resample.finding_intervals(rows, resample.md5_draws(spark, n, IMAGE_REPS), ["model"]))


_TWO = "SELECT count(*) AS images, sum(a.tp) AS ta, sum(a.fp) AS fa, sum(b.tp) AS tb, sum(b.fp) AS fb FROM x a JOIN x b ON a.idx = b.idx AND a.model = 0 AND b.model = 1"
_PAIR = lambda t: f"SELECT images, fa / nullif(CAST(ta + fa AS DOUBLE), 0) AS ca, fb / nullif(CAST(tb + fb AS DOUBLE), 0) AS cb, fa / CAST(images AS DOUBLE) AS ha, fb / CAST(images AS DOUBLE) AS hb FROM {t}"


@_query(f"""WITH {_IMG}, {_DRAWN}, a AS ({_TWO}), ap AS ({_PAIR('a')}),
b AS (SELECT rep, sum(w) AS images, sum(w * a.tp) AS ta, sum(w * a.fp) AS fa, sum(w * b.tp) AS tb, sum(w * b.fp) AS fb FROM x a JOIN x b ON a.idx = b.idx AND a.model = 0 AND b.model = 1 JOIN dr ON dr.idx = a.idx GROUP BY rep), bp AS ({_PAIR('b')}),
q AS (SELECT quantile_cont(ca - cb, 0.025) AS c1, quantile_cont(ca - cb, 0.975) AS c2, quantile_cont(ha - hb, 0.025) AS h1, quantile_cont(ha - hb, 0.975) AS h2 FROM bp)
SELECT CAST(images AS BIGINT) AS images, round(ca, 6) AS chr_a, round(cb, 6) AS chr_b, round(ha, 6) AS fp_per_image_a, round(hb, 6) AS fp_per_image_b, round(ca - cb, 6) AS chr_delta, round(ha - hb, 6) AS fp_per_image_delta,
  round(c1, 6) AS chr_delta_low, round(c2, 6) AS chr_delta_high, round(h1, 6) AS fp_per_image_delta_low, round(h2, 6) AS fp_per_image_delta_high FROM ap, q""")
def paired_findings_md5(spark, sf_dir) -> DataFrame:
    rows, n = _image_counts(spark, sf_dir)
    return _rounded(resample.paired_findings(rows, resample.md5_draws(spark, n, IMAGE_REPS), "model", 0, 1))


_ORD = "CASE model WHEN 2 THEN 1 WHEN 0 THEN 2 ELSE 999 END"
_NAMES = ("images", "chr_a", "chr_b", "chr_delta", "chr_delta_low", "chr_delta_high", "fp_per_image_a", "fp_per_image_b", "fp_per_image_delta", "fp_per_image_delta_low", "fp_per_image_delta_high")


@_query(f"""WITH {_IMG}, {_DRAWN}, y AS (SELECT *, {_ORD} AS ord FROM x),
pw AS (SELECT model, ord, count(*) AS images, sum(fp) / nullif(CAST(sum(tp + fp) AS DOUBLE), 0) AS c, sum(fp) / CAST(count(*) AS DOUBLE) AS h FROM y GROUP BY ALL),
pd AS (SELECT model, rep, sum(w * fp) / nullif(CAST(sum(w * (tp + fp)) AS DOUBLE), 0) AS c, sum(w * fp) / CAST(sum(w) AS DOUBLE) AS h FROM y JOIN dr USING (idx) GROUP BY ALL),
pp AS (SELECT a.model AS model_a, b.model AS model_b, a.images, a.c AS ca, b.c AS cb, a.h AS ha, b.h AS hb FROM pw a JOIN pw b ON a.ord < b.ord OR (a.ord = b.ord AND a.model < b.model)),
pq AS (SELECT model_a, model_b, quantile_cont(x.c - y.c, 0.025) AS c1, quantile_cont(x.c - y.c, 0.975) AS c2, quantile_cont(x.h - y.h, 0.025) AS h1, quantile_cont(x.h - y.h, 0.975) AS h2
  FROM pp JOIN pd x ON x.model = model_a JOIN pd y ON y.model = model_b AND y.rep = x.rep GROUP BY ALL)
SELECT 'same' AS grp, model_a, model_b, true AS paired, CAST(images AS DOUBLE) AS n_images, round(ca, 6) AS chr_a, round(cb, 6) AS chr_b, round(ca - cb, 6) AS chr_delta, round(c1, 6) AS chr_delta_low, round(c2, 6) AS chr_delta_high,
  round(ha, 6) AS fp_per_image_a, round(hb, 6) AS fp_per_image_b, round(ha - hb, 6) AS fp_per_image_delta, round(h1, 6) AS fp_per_image_delta_low, round(h2, 6) AS fp_per_image_delta_high FROM pp JOIN pq USING (model_a, model_b)
UNION ALL SELECT 'turned', model_a, model_b, false, {', '.join(['NULL'] * len(_NAMES))} FROM pp""")
def paired_findings_all(spark, sf_dir) -> DataFrame:
    """All pairs of models, 2 and 0 first; in the group `turned` model 1 lists the images the other way round, so its pairs aren't compared."""
    rows, n = _image_counts(spark, sf_dir)
    rows = select.ordered_models(rows, "model", [2, 0])
    both = rows.select(F.lit("same").alias("grp"), "*").union(rows.select(F.lit("turned"), "*"))
    places = both.select("grp", "model", "image", F.when((F.col("grp") == "turned") & (F.col("model") == 1), -F.col("idx")).otherwise(F.col("idx")).alias("pos"))
    same = findings.aligned(places, ["grp"], "model", "image", "pos")
    return _rounded(resample.all_pairs(both, resample.md5_draws(spark, n, IMAGE_REPS), ["grp"], "model", "ord", same)).withColumn("n_images", F.col("n_images").cast("double"))


_ARMS = f"""{_PL}, cl AS (SELECT DISTINCT source, dense_rank() OVER (ORDER BY source) - 1 AS idx FROM s),
two AS (SELECT 'a' AS arm, doc_id, cond, t, p FROM pl UNION ALL SELECT 'b', doc_id, cond, t, 1 - p FROM pl),
k AS (SELECT arm, cond, idx, count(*) FILTER (two.t = 1 AND two.p = 1) AS tp, count(*) FILTER (two.t <> 1 AND two.p = 1) AS fp, count(*) FILTER (two.t = 1 AND two.p <> 1) AS fn FROM two JOIN s USING (doc_id) JOIN cl USING (source) GROUP BY ALL),
d2 AS (SELECT r.range AS rep, CAST('0x' || substr(md5('42:' || r.range || ':' || i.range), 1, 8) AS BIGINT) % (SELECT count(*) FROM cl) AS idx FROM range({IMAGE_REPS}) r, range((SELECT count(*) FROM cl)) i)"""
_M4 = f"avg({_F1}) FILTER (tp + fn > 0)"


@_query(f"""WITH {_ARMS}, rs AS (SELECT arm, rep, cond, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM k JOIN d2 USING (idx) GROUP BY ALL), m AS (SELECT arm, rep, {_M4} AS f FROM rs GROUP BY ALL),
v AS (SELECT rep, max(f) FILTER (arm = 'a') - max(f) FILTER (arm = 'b') AS v FROM m GROUP BY rep), w0 AS (SELECT arm, cond, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM k GROUP BY ALL), pm AS (SELECT arm, {_M4} AS f FROM w0 GROUP BY arm)
SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, round(avg(v), 6) AS mean, CAST(count(v) AS BIGINT) AS n_boot, round((SELECT max(f) FILTER (arm = 'a') - max(f) FILTER (arm = 'b') FROM pm), 6) AS delta FROM v""")
def paired_macro_md5(spark, sf_dir) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    arms = rows.select(F.lit("a").alias("arm"), "source", "cond", "t", "p").union(rows.select(F.lit("b"), "source", "cond", "t", 1 - F.col("p")))
    ids = resample.clusters(rows.select("source").distinct(), [], "source")
    counts = confusion.binary_counts(arms, ["arm", "source", "cond"], "t", "p").join(ids, "source")
    return _rounded(resample.paired_macro_interval(counts, resample.md5_draws(spark, ids.count(), IMAGE_REPS), "arm", "a", "b", "cond"))


@_query(f"WITH fi AS ({base.ORACLE_SQL['finding_intervals_md5']}) SELECT *, round(greatest(point - low, 0e0), 5) AS arm_low, round(greatest(high - point, 0e0), 5) AS arm_high FROM fi")
def interval_arms(spark, sf_dir) -> DataFrame:
    arms = confusion.half_widths(finding_intervals_md5(spark, sf_dir), "point", "low", "high")
    return arms.withColumn("arm_low", F.round("arm_low", 5)).withColumn("arm_high", F.round("arm_high", 5))


@_query(f"""WITH fi AS ({base.ORACLE_SQL['finding_intervals_md5']}), su AS ({base.ORACLE_SQL['finding_model_summary']}), bc AS (WITH {_MM.replace('AS image, gm.image IS NOT NULL AS is_gt', 'AS image, coalesce(gm.cond, pm.cond) AS cond, gm.image IS NOT NULL AS is_gt')} SELECT model, cond, {_CNT} FROM mm GROUP BY ALL)
SELECT bc.model, bc.cond, bc.fp, su.chr, fi.low AS chr_low, fi.high AS chr_high FROM bc JOIN su USING (model) LEFT JOIN fi ON fi.model = bc.model AND fi.metric = 'chr'""")
def merged_finding_report(spark, sf_dir) -> DataFrame:
    _, matches = base._model_matches(spark, sf_dir)
    conditions = findings.by_condition(matches, 0, ["model", "cond"]).select("model", "cond", "fp")
    intervals = finding_intervals_md5(spark, sf_dir).where("metric = 'chr'").select("model", F.col("low").alias("chr_low"), F.col("high").alias("chr_high"))
    return findings.merged_report(_rounded(base._summary(spark, sf_dir)).select("model", "chr"), conditions, intervals, ["model"])


# Text scores of a group.


@_query(f"""WITH r1 AS ({base.ORACLE_SQL['rouge1_f1']}), r2 AS ({base.ORACLE_SQL['rouge2_f1']}), rl AS ({base.ORACLE_SQL['rouge_l_f1']}), b4 AS ({base.ORACLE_SQL['bleu4']}), kl AS ({base.ORACLE_SQL['kl_divergence']}), js AS ({base.ORACLE_SQL['js_divergence']})
SELECT CAST(split_part(key, ':', 2) AS BIGINT) AS turn, CAST(count(ok) AS BIGINT) AS n_scored, CAST(count(*) FILTER (ok IS NULL) AS BIGINT) AS n_errors, round(avg(bleu4) FILTER (ok), 4) AS bleu4_mean, round(avg(rouge1_f1) FILTER (ok), 4) AS rouge1_f1_mean, round(avg(rouge2_f1) FILTER (ok), 4) AS rouge2_f1_mean, round(avg(rouge_l_f1) FILTER (ok), 4) AS rouge_l_f1_mean,
  round(avg(kl_bits) FILTER (ok), 4) AS kl_bits_mean, round(avg(js_bits) FILTER (ok), 4) AS js_bits_mean FROM (SELECT *, CASE WHEN CAST(split_part(key, ':', 1) AS BIGINT) % 7 <> 0 THEN true END AS ok FROM r1) JOIN r2 USING (key) JOIN rl USING (key) JOIN b4 USING (key) JOIN kl USING (key) JOIN js USING (key) GROUP BY 1""")
def text_score_means(spark, sf_dir) -> DataFrame:
    """Every seventh conversation counts as failed: it has no responses."""
    c = _t(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.when(F.col("conv_id") % 7 != 0, F.coalesce("text", F.lit(""))).alias("response"))
    rows = u.join(a, ["conv_id", "turn"]).withColumn("key", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    scored = textsim.text_scores(rows, "key", "reference", "response").withColumn("turn", F.col("turn").cast("bigint"))
    return _rounded(textsim.score_means(_rounded(scored), ["turn"], "response"), 4)


# Selections.


@_query("SELECT p_brand, id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY id) AS INT) AS rank FROM (SELECT p_brand, 'train_' || p_partkey AS id FROM part)")
def plain_sort_rank(spark, sf_dir) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select("p_brand", F.concat(F.lit("train_"), F.col("p_partkey").cast("string")).alias("id"))
    return select.ranked(rows, ["p_brand"], select.plain_order("id"))


@_query("SELECT c_custkey, c_name FROM customer ORDER BY c_name DESC, c_custkey LIMIT 20")
def first_n_cases(spark, sf_dir) -> DataFrame:
    return select.first_cases(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), [F.desc("c_name"), "c_custkey"], 20)


@_query("SELECT o_orderstatus, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 1 ELSE 2 END, o_orderkey) AS r FROM orders WHERE o_orderpriority IN ('5-LOW', '2-HIGH') AND o_totalprice > 250000) WHERE r = 1")
def first_match_of_models(spark, sf_dir) -> DataFrame:
    o = _t(spark, sf_dir, "orders").where("o_totalprice > 250000").select("o_orderstatus", "o_orderpriority", "o_orderkey")
    return select.first_of_models(o, "o_orderpriority", ["5-LOW", "2-HIGH"], ["o_orderstatus"], ["o_orderkey"])


_HARD = f"""{_EV}, i AS (SELECT image, count(*) FILTER (is_gt) AS g, count(*) FILTER (is_pred) AS p FROM m GROUP BY image),
pk AS (SELECT min(image) FILTER (g = 0 AND p > 0) AS a, min(image) FILTER (g > 0 AND p = 0) AS b, min(image) FILTER (p > g AND g > 0) AS c FROM i),
h AS (SELECT image, arg_max(role, ord) AS role FROM (SELECT a AS image, 'empty_gt_pred' AS role, 0 AS ord FROM pk UNION ALL SELECT b, 'empty_pred', 1 FROM pk UNION ALL SELECT c, 'over_predict', 2 FROM pk) WHERE image IS NOT NULL GROUP BY image),
al AS (SELECT image, role, 0 AS o FROM h UNION ALL SELECT image, NULL, 1 FROM (SELECT DISTINCT image FROM i) WHERE image NOT IN (SELECT image FROM h))"""


@_query(f"WITH {_HARD} SELECT image, role FROM al ORDER BY o, md5('42:' || image), image LIMIT 10")
def audit_with_hard_cases(spark, sf_dir) -> DataFrame:
    images = base._matches(spark, sf_dir).groupBy("image").agg(F.count_if("is_gt").alias("g"), F.count_if("is_pred").alias("p"))
    g, p = F.col("g"), F.col("p")
    hard = select.hard_cases(images, {"empty_gt_pred": (g == 0) & (p > 0), "empty_pred": (g > 0) & (p == 0), "over_predict": (p > g) & (g > 0)}, ["image"])
    return select.audit_cases(images, hard, "image")


@_query()
def audit_as_shuffled(spark, sf_dir) -> DataFrame:
    """The hard cases, then others as a seeded shuffle of the users deals them. tests/test_places.py has the same from a list."""
    images = base._matches(spark, sf_dir).groupBy("image").agg(F.count_if("is_gt").alias("g"), F.count_if("is_pred").alias("p"))
    g, p = F.col("g"), F.col("p")
    hard = select.hard_cases(images, {"empty_gt_pred": (g == 0) & (p > 0), "empty_pred": (g > 0) & (p == 0), "over_predict": (p > g) & (g > 0)}, ["image"])
    return select.audit_as_shuffled(images, hard.withColumn("ord", F.col("image")), "image", [])


_LISTS = "us AS (SELECT DISTINCT user_id AS image FROM events), ls AS (SELECT 3 AS n, 0 AS model, image, image AS pos FROM us UNION ALL SELECT 3, 1, image, image * 3 + 1 FROM us UNION ALL SELECT 3, 2, image, -image FROM us)"


@_query(f"WITH {_LISTS}, al AS (SELECT * FROM ls UNION ALL SELECT 2, model, image, pos FROM ls WHERE model < 2), sh AS (SELECT n, model, list(image ORDER BY pos) AS shown FROM al GROUP BY ALL) SELECT CAST(count(*) AS BIGINT) AS models, count(DISTINCT shown) = 1 AS aligned FROM sh GROUP BY n")
def alignment_of_lists(spark, sf_dir) -> DataFrame:
    """Models 0 and 1 list the users in ascending order at different positions; model 2 turns the order round."""
    users = _t(spark, sf_dir, "events").select(F.col("user_id").alias("image")).distinct()
    side = lambda model, pos: users.select(F.lit(model).alias("model"), "image", pos.alias("pos"))
    two = side(0, F.col("image")).union(side(1, F.col("image") * 3 + 1))
    three = two.union(side(2, -F.col("image")))
    return findings.aligned(three, [], "model", "image", "pos").union(findings.aligned(two, [], "model", "image", "pos"))


@_query(f"WITH {_EV} SELECT cond, CAST(count(DISTINCT image) AS BIGINT) AS n FROM ev GROUP BY cond")
def stratum_counts(spark, sf_dir) -> DataFrame:
    return base._events(spark, sf_dir).groupBy("cond").agg(F.count_distinct("image").alias("n"))


@_query("SELECT event_type, CAST(count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers, round(min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low, round(max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high FROM events JOIN (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) USING (event_type) GROUP BY event_type")
def whiskers_by_group(spark, sf_dir) -> DataFrame:
    return _rounded(select.whiskers(_t(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value"))


assert LOCATIONS == 8  # the SQL above says so
