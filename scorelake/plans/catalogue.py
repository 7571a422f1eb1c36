"""The registered queries and, for each, SQL that makes the same rows.

The test tables hold no annotations, so each operator runs on tables of the same shape: users as images, hours
as locations and event types as conditions; documents' labels as truth and rules on their length as
predictions; turns of conversations as reference and hypothesis.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions import parsing, rates
from scorelake.operators import confusion, findings, packed, resample, select, textsim
from scorelake.sources import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
LOCATIONS, KINDS = 8, ["click", "error", "purchase", "signup", "view"]
GRID = packed.Grid(tuple(range(LOCATIONS)), tuple(KINDS))


def _query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


# Findings: events.


def _events(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    e = e.select(F.col("user_id").alias("image"), (F.hour("ts") % LOCATIONS).cast("bigint").alias("loc"), F.col("event_type").alias("cond"), (F.col("event_id") % 3).alias("model"), (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("is_truth"))
    return e


def _matches(spark, sf_dir):
    e = _events(spark, sf_dir)
    return findings.match(e.where("is_truth"), e.where("not is_truth"), ["image", "loc", "cond"])


def _packed(spark, sf_dir):
    return packed.pack(_events(spark, sf_dir), ["image"], "loc", "cond", "is_truth", GRID)


def _n_images(spark, sf_dir) -> int:
    return _t(spark, sf_dir, "events").agg(F.count_distinct("user_id")).first()[0]


_EV = """
ev AS (SELECT user_id AS image, CAST(hour(ts) % 8 AS BIGINT) AS loc, event_type AS cond, event_id % 3 AS model, ts < TIMESTAMP '2024-01-16' AS is_truth FROM events),
g AS (SELECT DISTINCT image, loc, cond FROM ev WHERE is_truth),
p AS (SELECT DISTINCT image, loc, cond FROM ev WHERE NOT is_truth),
m AS (SELECT coalesce(g.image, p.image) AS image, coalesce(g.loc, p.loc) AS loc, coalesce(g.cond, p.cond) AS cond, g.image IS NOT NULL AS is_gt, p.image IS NOT NULL AS is_pred
  FROM g FULL JOIN p ON g.image = p.image AND g.loc = p.loc AND g.cond = p.cond),
imgs AS (SELECT count(DISTINCT user_id) AS n FROM events)
"""
_CNT = "CAST(count(*) FILTER (is_gt AND is_pred) AS BIGINT) AS tp, CAST(count(*) FILTER (NOT is_gt AND is_pred) AS BIGINT) AS fp, CAST(count(*) FILTER (is_gt AND NOT is_pred) AS BIGINT) AS fn"
_P, _R = "(tp / nullif(CAST(tp + fp AS DOUBLE), 0))", "(tp / nullif(CAST(tp + fn AS DOUBLE), 0))"
_F = f"(2 * {_P} * {_R} / nullif({_P} + {_R}, 0))"

_BYCOND = f"""
WITH {_EV}, c AS (SELECT cond, {_CNT} FROM m GROUP BY cond), t AS (SELECT c.*, CAST((SELECT n FROM imgs) * 8 - tp - fp - fn AS BIGINT) AS tn FROM c)
SELECT *, round({_P}, 6) AS precision, round({_R}, 6) AS recall, round({_F}, 6) AS f1, round(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 6) AS fpr,
  round(fp / nullif(CAST(tp + fp AS DOUBLE), 0), 6) AS chr, round(100 * fp / nullif(CAST(sum(fp) OVER () AS DOUBLE), 0), 6) AS fp_share FROM t
"""


def _by_condition(spark, sf_dir):
    return packed.by_condition(_packed(spark, sf_dir), [], "cond", GRID)


@_query(_BYCOND)
def finding_confusion_by_condition(spark, sf_dir):
    return _rounded(_by_condition(spark, sf_dir))


@_query(f"SELECT cond, fp, fp_share FROM ({_BYCOND})")
def finding_condition_share(spark, sf_dir):
    return _rounded(_by_condition(spark, sf_dir)).select("cond", "fp", "fp_share")


@_query(f"SELECT cond, fp FROM ({_BYCOND}) ORDER BY fp DESC, cond LIMIT 10")
def finding_top_conditions(spark, sf_dir):
    return findings.top_conditions(_by_condition(spark, sf_dir), "cond", 10)


def _model_matches(spark, sf_dir):
    """Each model's predictions against the one truth."""
    e = _events(spark, sf_dir)
    models = spark.range(3).select(F.col("id").alias("model"))
    truth = e.where("is_truth").select("image", "loc", "cond").distinct().crossJoin(F.broadcast(models))
    images = e.select("image").distinct().crossJoin(F.broadcast(models))
    return images, findings.match(truth, e.where("not is_truth"), ["model", "image", "loc", "cond"])


_MM = f"""{_EV}, mods AS (SELECT CAST(range AS BIGINT) AS model FROM range(3)),
gm AS (SELECT model, g.* FROM g, mods), pm AS (SELECT DISTINCT model, image, loc, cond FROM ev WHERE NOT is_truth),
mm AS (SELECT coalesce(gm.model, pm.model) AS model, coalesce(gm.image, pm.image) AS image, gm.image IS NOT NULL AS is_gt, pm.image IS NOT NULL AS is_pred
  FROM gm FULL JOIN pm ON gm.model = pm.model AND gm.image = pm.image AND gm.loc = pm.loc AND gm.cond = pm.cond),
mi AS (SELECT model, image, {_CNT} FROM mm GROUP BY ALL),
ii AS (SELECT DISTINCT model, user_id AS image FROM events, mods),
r AS (SELECT ii.model, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM ii LEFT JOIN mi USING (model, image)),
s AS (SELECT model, CAST(count(*) AS BIGINT) AS images, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(40 - tp - fp - fn) AS BIGINT) AS tn, CAST(count(*) FILTER (fp > 0) AS BIGINT) AS images_with_fp FROM r GROUP BY model)
"""
_SUM = f"""
WITH {_MM} SELECT *, round((tp + tn) / nullif(CAST(tp + fp + fn + tn AS DOUBLE), 0), 6) AS accuracy, round({_P}, 6) AS precision, round({_R}, 6) AS recall, round({_F}, 6) AS f1,
  round(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 6) AS specificity, round(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 6) AS fpr, round(fn / nullif(CAST(fn + tp AS DOUBLE), 0), 6) AS fnr, round(fp / nullif(CAST(tp + fp AS DOUBLE), 0), 6) AS chr,
  round(fp / CAST(images AS DOUBLE), 6) AS fp_per_image, round(images_with_fp / CAST(images AS DOUBLE), 6) AS image_rate, round((tp + fp) / CAST(images AS DOUBLE), 6) AS predictions_per_image, round(tp / CAST(images AS DOUBLE), 6) AS correct_per_image FROM s
"""


def _summary(spark, sf_dir):
    # Every model has the truth, its own predictions, and all images.
    e = _events(spark, sf_dir).withColumn("of", F.col("model")).withColumn("model", F.explode(F.array(*(F.lit(m).cast("bigint") for m in range(3)))))
    own = F.when(F.col("is_truth") | (F.col("model") == F.col("of")), F.col("loc"))
    return packed.summary(packed.pack(e.withColumn("loc", own), ["model", "image"], "loc", "cond", "is_truth", GRID), ["model"], GRID)


@_query(_SUM)
def finding_model_summary(spark, sf_dir):
    return _rounded(_summary(spark, sf_dir))


@_query(f"WITH s AS ({_SUM}) SELECT a.model AS model_a, b.model AS model_b, a.chr AS chr_a, b.chr AS chr_b, a.fp_per_image AS fp_per_image_a, b.fp_per_image AS fp_per_image_b, round(a.chr - b.chr, 4) AS chr_delta, round(a.fp_per_image - b.fp_per_image, 4) AS fp_per_image_delta FROM s a JOIN s b ON a.model < b.model")
def pairwise_delta(spark, sf_dir):
    pairs = findings.pairwise_delta(_rounded(_summary(spark, sf_dir)), [], "model", ["chr", "fp_per_image"])
    return pairs.withColumn("chr_delta", F.round("chr_delta", 4)).withColumn("fp_per_image_delta", F.round("fp_per_image_delta", 4))


@_query(f"""
WITH {_EV}, n AS (SELECT *, loc || '|' || cond AS name FROM m)
SELECT image, coalesce(string_agg(name, '; ' ORDER BY name) FILTER (is_gt), '') AS gt_set, coalesce(string_agg(name, '; ' ORDER BY name) FILTER (is_pred), '') AS pred_set,
  coalesce(string_agg(name, '; ' ORDER BY name) FILTER (is_gt AND is_pred), '') AS tp_set, coalesce(string_agg(name, '; ' ORDER BY name) FILTER (NOT is_gt AND is_pred), '') AS fp_set,
  coalesce(string_agg(name, '; ' ORDER BY name) FILTER (is_gt AND NOT is_pred), '') AS fn_set, {_CNT}, CAST(40 - count(*) AS BIGINT) AS tn,
  round(count(*) FILTER (NOT is_gt AND is_pred) / nullif(CAST(count(*) FILTER (is_pred) AS DOUBLE), 0), 6) AS hallucination_rate FROM n GROUP BY image
""")
def finding_image_rows(spark, sf_dir):
    return _rounded(packed.image_rows(_packed(spark, sf_dir), ["image"], GRID))


_LOC = f"""{_EV}, l AS (SELECT image, loc, cond, CASE WHEN is_gt THEN 'correct' WHEN EXISTS (SELECT 1 FROM g WHERE g.image = m.image AND g.cond = m.cond) THEN 'wrong_location'
  WHEN EXISTS (SELECT 1 FROM g WHERE g.image = m.image AND g.loc = m.loc) THEN 'wrong_condition' ELSE 'unsupported' END AS bucket FROM m WHERE is_pred)"""


@_query(f"WITH {_LOC} SELECT bucket, CAST(count(*) AS BIGINT) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS rate FROM l GROUP BY bucket")
def finding_location_breakdown(spark, sf_dir):
    return _rounded(packed.location_breakdown(_packed(spark, sf_dir), [], GRID))


@_query(f"WITH {_LOC}, k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY image, loc, cond) AS rank FROM l) SELECT image, loc, cond, bucket, CAST(rank AS INT) AS rank FROM k WHERE rank <= 20")
def finding_location_examples(spark, sf_dir):
    return findings.examples(findings.located(_matches(spark, sf_dir), ["image"], "loc", "cond"), ["image", "loc", "cond"])


@_query("""WITH f AS (SELECT event_id % 3 AS model, user_id AS image, min(event_id) AS pos FROM events GROUP BY ALL), l AS (SELECT model, string_agg(image, ',' ORDER BY pos) AS x FROM f GROUP BY model)
SELECT CAST(count(*) AS BIGINT) AS models, count(DISTINCT x) = 1 AND count(*) > 1 AS aligned FROM l""")
def alignment_check(spark, sf_dir):
    """Each model's users in the order of their first events."""
    rows = _t(spark, sf_dir, "events").groupBy((F.col("event_id") % 3).alias("model"), F.col("user_id").alias("image")).agg(F.min("event_id").alias("pos"))
    return findings.aligned(rows, [], "model", "image", "pos")


# Slots: labels and documents.


def _slots(spark, sf_dir):
    d, lab = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    return lab.join(d, "doc_id").select("doc_id", F.col("quality").cast("int").alias("t"), (F.col("n_chars") >= 1000).cast("int").alias("p"), "lang", "source", F.col("toxic").cast("int").alias("toxic"), "n_chars")


_S = "s AS (SELECT doc_id, CAST(quality AS INT) AS t, CAST(n_chars >= 1000 AS INT) AS p, lang, source, CAST(toxic AS INT) AS toxic, n_chars FROM labels JOIN documents USING (doc_id))"
_OVR = "CAST(count(*) FILTER (t = label AND p = label) AS BIGINT) AS tp, CAST(count(*) FILTER (t <> label AND p = label) AS BIGINT) AS fp, CAST(count(*) FILTER (t = label AND p <> label) AS BIGINT) AS fn, CAST(count(*) FILTER (t <> label AND p <> label) AS BIGINT) AS tn"
_Z = lambda a, b: f"coalesce(({a}) / nullif(CAST({b} AS DOUBLE), 0), 0e0)"
_CLS = f"""{_S}, k AS (SELECT CAST(range AS INT) AS label FROM range(2)), c AS (SELECT lang, label, {_OVR} FROM s, k GROUP BY lang, label),
r AS (SELECT *, {_Z("tp", "tp + fp")} AS precision, {_Z("tp", "tp + fn")} AS recall, {_Z("2 * tp", "2 * tp + fp + fn")} AS f1, {_Z("tn", "tn + fp")} AS specificity, {_Z("tp + tn", "tp + fp + fn + tn")} AS accuracy,
  ({_Z("tp", "tp + fn")} + {_Z("tn", "tn + fp")}) / 2 AS balanced_accuracy, tp + fn AS support, tp + fn = 0 AS undefined FROM c)"""


def _class_rates(spark, sf_dir):
    return confusion.class_rates(confusion.one_vs_rest(_slots(spark, sf_dir), ["lang"], "t", "p", [0, 1]))


@_query(f"WITH {_S}, k AS (SELECT CAST(range AS INT) AS label FROM range(2)) SELECT lang, label, {_OVR} FROM s, k GROUP BY lang, label")
def pooled_binary_confusion(spark, sf_dir):
    return confusion.one_vs_rest(_slots(spark, sf_dir), ["lang"], "t", "p", [0, 1])


@_query(f"WITH {_CLS} SELECT lang, label, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(specificity, 6) AS specificity, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, support, undefined FROM r")
def pooled_binary_rates(spark, sf_dir):
    return _rounded(_class_rates(spark, sf_dir))


@_query(f"WITH {_CLS} SELECT lang, round(avg(precision) FILTER (support > 0), 6) AS macro_precision, round(avg(recall) FILTER (support > 0), 6) AS macro_recall, round(avg(f1) FILTER (support > 0), 6) AS macro_f1, coalesce(string_agg(label, ',' ORDER BY label) FILTER (support > 0), '') AS used, coalesce(string_agg(label, ',' ORDER BY label) FILTER (support = 0), '') AS skipped FROM r GROUP BY lang")
def per_class_macro_skip_zero(spark, sf_dir):
    return _rounded(confusion.macro(_class_rates(spark, sf_dir), ["lang"], skip_zero=True))


@_query(f"WITH {_CLS} SELECT lang, round(max(f1) FILTER (label = 0 AND support > 0), 6) AS f1_0, round(max(f1) FILTER (label = 1 AND support > 0), 6) AS f1_1 FROM r GROUP BY lang")
def pivot_class_report(spark, sf_dir):
    return _rounded(confusion.pivot_report(_class_rates(spark, sf_dir).withColumn("label", F.col("label").cast("string")), ["lang"], ["0", "1"], "f1"))


_BIN = "CAST(count(*) FILTER (t = 1 AND p = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (t <> 1 AND p = 1) AS BIGINT) AS fp, CAST(count(*) FILTER (t = 1 AND p <> 1) AS BIGINT) AS fn, CAST(count(*) FILTER (t <> 1 AND p <> 1) AS BIGINT) AS tn"
_MF1 = f"(({_Z('2 * tp', '2 * tp + fp + fn')} + {_Z('2 * tn', '2 * tn + fp + fn')}) / 2)"


@_query(f"WITH {_S}, c AS (SELECT lang, source, {_BIN} FROM s GROUP BY ALL) SELECT lang, CAST(count(*) AS BIGINT) AS cases, round(avg({_Z('tp', 'tp + fp')}), 6) AS mean_precision, round(avg({_Z('tp', 'tp + fn')}), 6) AS mean_recall, round(avg({_Z('2 * tp', '2 * tp + fp + fn')}), 6) AS mean_f1, round(avg({_MF1}), 6) AS mean_macro_f1, round(avg({_Z('tp + tn', 'tp + fp + fn + tn')}), 6) AS mean_accuracy FROM c GROUP BY lang")
def patient_mean_metrics(spark, sf_dir):
    return _rounded(confusion.case_mean(_slots(spark, sf_dir), ["lang"], "source", "t", "p"))


@_query(f"WITH {_S}, a AS (SELECT lang, source, max(toxic) AS t, max(CAST(n_chars % 7 = 0 AS INT)) AS p FROM s GROUP BY ALL) SELECT lang, {_BIN} FROM a GROUP BY lang")
def image_level_any(spark, sf_dir):
    rows = _slots(spark, sf_dir).select("lang", "source", F.col("toxic").alias("t"), (F.col("n_chars") % 7 == 0).cast("int").alias("p"))
    return confusion.binary_counts(confusion.any_positive(rows, ["lang"], "source", "t", "p"), ["lang"], "t", "p")


def _sets(spark, sf_dir):
    """Each document's label sets: truth by its labels, prediction by its length."""
    made = lambda a, b: F.filter(F.array(F.when(a, F.lit("quality")), F.when(b, F.lit("toxic"))), lambda x: x.isNotNull())
    s = _slots(spark, sf_dir)
    return s.select("doc_id", "lang", made(F.col("t") == 1, F.col("toxic") == 1).alias("g"), made(F.col("p") == 1, F.col("n_chars") % 3 == 0).alias("h"))


_SETS = _S + """, w AS (SELECT doc_id, lang, list_filter([CASE WHEN t = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS g,
  list_filter([CASE WHEN p = 1 THEN 'quality' END, CASE WHEN n_chars % 3 = 0 THEN 'toxic' END], lambda x: x IS NOT NULL) AS h FROM s)"""


def _per_label(spark, sf_dir):
    w = _sets(spark, sf_dir).withColumn("cond", F.explode(F.array(F.lit("quality"), F.lit("toxic"))))
    has = lambda c: F.array_contains(c, F.col("cond")).cast("int")
    return w.select("doc_id", "lang", "cond", has("g").alias("t"), has("h").alias("p"))


_PL = _SETS + ", pl AS (SELECT doc_id, lang, cond, CAST(list_contains(g, cond) AS INT) AS t, CAST(list_contains(h, cond) AS INT) AS p FROM w, (SELECT unnest(['quality', 'toxic']) AS cond))"


@_query(f"WITH {_PL}, c AS (SELECT lang, cond, {_BIN} FROM pl GROUP BY ALL) SELECT lang, round(avg({_Z('2 * tp', '2 * tp + fp + fn')}) FILTER (tp + fn > 0), 6) AS macro_f1, round(avg({_Z('tp', 'tp + fn')}) FILTER (tp + fn > 0), 6) AS balanced_accuracy FROM c GROUP BY lang")
def ovr_multilabel_macro(spark, sf_dir):
    c = confusion.binary_counts(_per_label(spark, sf_dir), ["lang", "cond"], "t", "p").withColumnRenamed("cond", "label")
    shown = confusion.macro(confusion.class_rates(c), ["lang"], skip_zero=True)
    return _rounded(shown.select("lang", "macro_f1", F.col("macro_recall").alias("balanced_accuracy")))


_EX = _SETS + """, x AS (SELECT lang, CASE WHEN list_contains(g, 'toxic') THEN 'toxic' WHEN list_contains(g, 'quality') THEN 'quality' ELSE 'none' END AS t,
  CASE WHEN list_contains(h, 'toxic') THEN 'toxic' WHEN list_contains(h, 'quality') THEN 'quality' ELSE 'none' END AS p FROM w),
k AS (SELECT unnest(['toxic', 'quality', 'none']) AS label),
mx AS (SELECT l.lang, a.label AS true_label, b.label AS pred_label, CAST(count(x.lang) AS BIGINT) AS n FROM (SELECT DISTINCT lang FROM x) l, k a, k b LEFT JOIN x ON x.lang = l.lang AND x.t = a.label AND x.p = b.label GROUP BY ALL)"""


def _matrix(spark, sf_dir):
    order = ["toxic", "quality"]
    w = _sets(spark, sf_dir).select("lang", confusion.exclusive_class(F.col("g"), order, "none").alias("t"), confusion.exclusive_class(F.col("h"), order, "none").alias("p"))
    return confusion.matrix(w, ["lang"], "t", "p", spark.createDataFrame([(x,) for x in (*order, "none")], "label string"))


@_query(f"WITH {_EX} SELECT * FROM mx")
def exclusive_multiclass_confusion(spark, sf_dir):
    return _matrix(spark, sf_dir)


@_query(f"WITH {_EX} SELECT *, round(n / CAST(greatest(sum(n) OVER (PARTITION BY lang, true_label), 1) AS DOUBLE), 6) AS share FROM mx")
def row_normalised_confusion(spark, sf_dir):
    return _rounded(confusion.row_normalised(_matrix(spark, sf_dir), ["lang"]))


_EM = """SELECT lang, CAST(count(*) AS BIGINT) AS n, round(sum(ng + np - 2 * b) / CAST(count(*) * {k} AS DOUBLE), 6) AS hamming, round(avg(CASE WHEN b = ng AND b = np THEN 1e0 ELSE 0e0 END), 6) AS subset_accuracy,
  round(avg(CASE WHEN ng + np = 0 THEN 1e0 ELSE coalesce(b / nullif(CAST(ng + np - b AS DOUBLE), 0), 0) END), 6) AS jaccard, round(avg(CASE WHEN ng + np = 0 THEN 1e0 ELSE coalesce(b / nullif(CAST(np AS DOUBLE), 0), 0) END), 6) AS example_precision,
  round(avg(CASE WHEN ng + np = 0 THEN 1e0 ELSE coalesce(b / nullif(CAST(ng AS DOUBLE), 0), 0) END), 6) AS example_recall, round(avg(CASE WHEN ng + np = 0 THEN 1e0 ELSE coalesce(2 * b / nullif(CAST(ng + np AS DOUBLE), 0), 0) END), 6) AS example_f1,
  CAST(count(*) FILTER (ng + np > 0) AS BIGINT) AS n_any, round(sum(ng + np - 2 * b) / nullif(CAST(count(*) FILTER (ng + np > 0) * {k} AS DOUBLE), 0), 6) AS hamming_any FROM z GROUP BY lang"""


@_query(f"WITH {_SETS}, z AS (SELECT lang, len(g) AS ng, len(h) AS np, len(list_intersect(g, h)) AS b FROM w) " + _EM.format(k=2))
def multilabel_example_metrics(spark, sf_dir):
    return _rounded(confusion.example_metrics(_sets(spark, sf_dir), ["lang"], "g", "h", 2))


@_query(f"WITH {_SETS}, v AS (SELECT lang, list_filter(g, lambda x: x = 'toxic') AS g, list_filter(h, lambda x: x = 'toxic') AS h FROM w), z AS (SELECT lang, len(g) AS ng, len(h) AS np, len(list_intersect(g, h)) AS b FROM v) " + _EM.format(k=1))
def binary_example_metrics(spark, sf_dir):
    only = lambda c: F.filter(c, lambda x: x == "toxic").alias(c)
    return _rounded(confusion.example_metrics(_sets(spark, sf_dir).select("lang", only("g"), only("h")), ["lang"], "g", "h", 1))


@_query("SELECT e.event_type AS cond, CAST(count(*) FILTER (ts < TIMESTAMP '2024-01-03') AS BIGINT) AS support FROM events e GROUP BY 1")
def support_counts(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("cond", F.col("event_type"))
    dim = spark.createDataFrame([(k,) for k in KINDS], "cond string")
    return confusion.support(e, dim, "cond", F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz"))


@_query(f"WITH {_EV}, a AS (SELECT count(*) AS n FROM (SELECT DISTINCT image, loc FROM g)) SELECT CAST(a.n AS BIGINT) AS abnormal, CAST(imgs.n * 8 - a.n AS BIGINT) AS clear, CAST(imgs.n * 8 AS BIGINT) AS slots FROM a, imgs")
def support_partition_check(spark, sf_dir):
    e = _events(spark, sf_dir)
    return findings.slot_inventory(e.where("is_truth"), e.select("image"), ["image"], "loc", LOCATIONS).select("abnormal", "clear", "slots")


@_query(f"WITH {_EV}, a AS (SELECT image, loc, count(*) AS labels FROM g GROUP BY ALL) SELECT CAST(labels AS BIGINT) AS labels, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY 1")
def labels_per_slot_histogram(spark, sf_dir):
    return findings.labels_per_slot(_events(spark, sf_dir).where("is_truth"), ["image"], "loc", "cond")


@_query(f"WITH {_EV}, i AS (SELECT DISTINCT image FROM ev), x AS (SELECT i.image, (SELECT count(*) FROM p WHERE p.image = i.image AND p.cond = 'error') AS n FROM i) SELECT round(avg(CASE WHEN n = 0 THEN 1e2 ELSE 0e0 END), 6) AS abstained_percent, CAST(count(*) AS BIGINT) AS images FROM x")
def abstention_rate(spark, sf_dir):
    e = _events(spark, sf_dir)
    per = e.groupBy("image").agg(F.count_if(~F.col("is_truth") & (F.col("cond") == "error")).alias("n"))
    return _rounded(per.agg(F.avg(F.when(F.col("n") == 0, 100.0).otherwise(0.0)).alias("abstained_percent"), F.count("*").alias("images")))


@_query(f"WITH {_MM.replace('AS image, gm.image IS NOT NULL AS is_gt', 'AS image, coalesce(gm.loc, pm.loc) AS loc, gm.image IS NOT NULL AS is_gt')}, q AS (SELECT model, loc, count(*) FILTER (is_gt AND is_pred) / nullif(CAST(count(*) FILTER (is_gt) AS DOUBLE), 0) AS recall, count(*) FILTER (is_gt) AS n FROM mm GROUP BY ALL) SELECT loc, round(avg(recall), 6) AS recall, CAST(max(n) AS BIGINT) AS truth FROM q GROUP BY loc")
def per_location_recall(spark, sf_dir):
    _, m = _model_matches(spark, sf_dir)
    per = m.groupBy("model", "loc").agg(*findings.counted()).select("model", "loc", rates.recall().alias("recall"), (F.col("tp") + F.col("fn")).alias("n"))
    return _rounded(per.groupBy("loc").agg(F.avg("recall").alias("recall"), F.max("n").alias("truth")))


@_query(f"WITH {_S}, d AS (SELECT * FROM (SELECT DISTINCT source FROM s), (SELECT DISTINCT lang FROM s)), x AS (SELECT source, lang, max(toxic) AS m FROM s GROUP BY ALL) SELECT d.source, d.lang, coalesce(CAST(x.m AS INT), 0) AS flag FROM d LEFT JOIN x USING (source, lang)")
def dense_slot_grid(spark, sf_dir):
    s = _slots(spark, sf_dir)
    marked = s.where("toxic = 1").select("source", "lang").distinct()
    return confusion.dense(s.select("source").distinct(), s.select("lang").distinct(), marked, ["source", "lang"], "flag")


# Resampling: sources as clusters.

REPS = 200
_DRAW = f"draws AS (SELECT r.range AS rep, CAST('0x' || substr(md5('42:' || r.range || ':' || i.range), 1, 8) AS BIGINT) % (SELECT count(*) FROM cl) AS idx FROM range({REPS}) r, range((SELECT count(*) FROM cl)) i)"
_CL = f"{_S}, cl AS (SELECT *, row_number() OVER (ORDER BY source) - 1 AS idx FROM (SELECT source, {_BIN} FROM s GROUP BY source))"
_REP = "rp AS (SELECT rep, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn FROM draws JOIN cl USING (idx) GROUP BY rep)"
_CI = "SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, round(avg(v), 6) AS mean, CAST(count(v) AS BIGINT) AS n_boot FROM v"


def _cluster_counts(spark, sf_dir):
    return resample.clusters(confusion.binary_counts(_slots(spark, sf_dir), ["source"], "t", "p"), [], "source")


@_query(f"WITH {_CL}, {_DRAW}, {_REP}, v AS (SELECT {_MF1} AS v FROM rp) {_CI}")
def bootstrap_ci_md5(spark, sf_dir):
    c = _cluster_counts(spark, sf_dir)
    return _rounded(resample.macro_f1_interval(c, resample.md5_draws(spark, c.count(), REPS), []))


def _stream_sql(seed: int, reps: int, doublings: int) -> str:
    """NumPy's draws in SQL. The generator's state s goes to A s + C modulo 2^128, so the states from 2^k on are those from 0 on, multiplied by A^(2^k) and moved: each step of the
    recursion doubles them. Numbers of 128 bits are limbs of 32. A state's halves, xored and rotated by its top six bits, are two words; a word
    times n gives a draw, unless its low half is under 2^32 mod n.
    """
    import numpy as np

    state, whole = np.random.PCG64(seed).state["state"], 1 << 128
    a, c = 0x2360ED051FC65DA44385DF649FCCF645, state["inc"]  # the multiplier is a fixed value of PCG64
    limbs = lambda x: ", ".join(f"{x >> 32 * i & 0xFFFFFFFF}::UHUGEINT" for i in range(4))
    first, jumps = (a * state["state"] + c) % whole, []
    for k in range(doublings):
        jumps.append(f"({k}, {limbs(a)}, {limbs(c)})")
        a, c = a * a % whole, (a * c + c) % whole
    parts = [" + ".join([*(f"s{i} * a{k - i}" for i in range(k + 1)), f"c{k}"]) for k in range(4)]
    return f"""jumps(k, a0, a1, a2, a3, c0, c1, c2, c3) AS (VALUES {', '.join(jumps)}),
states(k, i, s0, s1, s2, s3) AS (
  SELECT 0, 0::BIGINT, {limbs(first)}
  UNION ALL
  SELECT k, i, CASE WHEN far THEN t0 & 4294967295 ELSE s0 END, CASE WHEN far THEN t1 & 4294967295 ELSE s1 END, CASE WHEN far THEN t2 & 4294967295 ELSE s2 END, CASE WHEN far THEN t3 & 4294967295 ELSE s3 END FROM (
    SELECT *, {parts[3]} + (t2 >> 32) AS t3 FROM (SELECT *, {parts[2]} + (t1 >> 32) AS t2 FROM (SELECT *, {parts[1]} + (t0 >> 32) AS t1 FROM (SELECT *, {parts[0]} AS t0 FROM (
      SELECT s.k + 1 AS k, s.i + CASE WHEN far THEN 1::BIGINT << s.k ELSE 0 END AS i, far, s0, s1, s2, s3, a0, a1, a2, a3, c0, c1, c2, c3
      FROM states s JOIN jumps j ON j.k = s.k CROSS JOIN (VALUES (false), (true)) f(far)))))
  )
),
halves AS (SELECT i, xor(s2, s0) + (xor(s3, s1) << 32) AS x, s3 >> 26 AS r FROM states WHERE k = {doublings}),
turned AS (SELECT i, ((x >> r) | (x << (64::UHUGEINT - r))) & 18446744073709551615::UHUGEINT AS x FROM halves),
words AS (SELECT 2 * i + h AS j, CAST((x >> (32 * h)::UHUGEINT) & 4294967295 AS BIGINT) AS w FROM turned, range(2) t(h)),
many AS (SELECT count(*) AS n FROM cl),
kept AS (SELECT row_number() OVER (ORDER BY j) - 1 AS d, CAST((w::HUGEINT * n) >> 32 AS BIGINT) AS idx, n FROM words, many WHERE (w::HUGEINT * n) & 4294967295 >= 4294967296 % n),
draws AS (SELECT d // n AS rep, idx FROM kept WHERE d < {reps} * n)"""


@_query(f"WITH RECURSIVE {_CL}, {_stream_sql(42, REPS, 12)}, {_REP}, v AS (SELECT {_MF1} AS v FROM rp) {_CI}")
def bootstrap_ci_numpy(spark, sf_dir):
    c = _cluster_counts(spark, sf_dir)
    return _rounded(resample.macro_f1_interval(c, resample.numpy_draws(spark, c.count(), REPS), []))


_CLX = "cl AS (SELECT DISTINCT source, dense_rank() OVER (ORDER BY source) - 1 AS idx FROM s), cx AS (SELECT cond, idx, tp, fp, fn, tn FROM (SELECT source, cond, {b} FROM pl JOIN s USING (doc_id) GROUP BY ALL) JOIN cl USING (source))"


@_query(f"WITH {_PL}, {_CLX.format(b=_BIN.replace('t = 1', 'pl.t = 1').replace('p = 1', 'pl.p = 1').replace('t <> 1', 'pl.t <> 1').replace('p <> 1', 'pl.p <> 1'))}, {_DRAW}, rc AS (SELECT rep, cond, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM draws JOIN cx USING (idx) GROUP BY ALL), v AS (SELECT rep, avg({_Z('2 * tp', '2 * tp + fp + fn')}) FILTER (tp + fn > 0) AS v FROM rc GROUP BY rep) {_CI}")
def bootstrap_macro_ci_md5(spark, sf_dir):
    ids, c = _macro_counts(spark, sf_dir)
    return _rounded(resample.macro_over_conditions(c, resample.md5_draws(spark, ids.count(), REPS), "cond"))


def _macro_counts(spark, sf_dir):
    rows = _per_label(spark, sf_dir).join(_slots(spark, sf_dir).select("doc_id", "source"), "doc_id")
    ids = resample.clusters(rows.select("source").distinct(), [], "source")
    return ids, confusion.binary_counts(rows, ["source", "cond"], "t", "p").join(ids, "source")


@_query(f"WITH {_S}, cl AS (SELECT DISTINCT source, dense_rank() OVER (ORDER BY source) - 1 AS idx FROM s), two AS (SELECT source, 'a' AS arm, t, p FROM s UNION ALL SELECT source, 'b' AS arm, t, CAST(n_chars >= 300 AS INT) AS p FROM s), cx AS (SELECT arm, idx, tp, fp, fn, tn FROM (SELECT source, arm, {_BIN} FROM two GROUP BY ALL) JOIN cl USING (source)), {_DRAW}, ra AS (SELECT rep, arm, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM draws JOIN cx USING (idx) GROUP BY ALL), f AS (SELECT rep, arm, {_MF1} AS f FROM ra), v AS (SELECT rep, max(f) FILTER (arm = 'a') - max(f) FILTER (arm = 'b') AS v FROM f GROUP BY rep) {_CI}")
def paired_bootstrap_md5(spark, sf_dir):
    ids, c = _arm_counts(spark, sf_dir)
    return _rounded(resample.paired_interval(c, resample.md5_draws(spark, ids.count(), REPS), "arm", "a", "b"))


def _arm_counts(spark, sf_dir):
    s = _slots(spark, sf_dir)
    two = s.select("source", F.lit("a").alias("arm"), "t", "p").union(s.select("source", F.lit("b"), "t", (F.col("n_chars") >= 300).cast("int")))
    ids = resample.clusters(s.select("source").distinct(), [], "source")
    return ids, confusion.binary_counts(two, ["source", "arm"], "t", "p").join(ids, "source")


# The same with the reference's number of replicates, under names of their own: the SQL above is fixed at REPS.

FULL_REPS = 5000


def _full(sql: str) -> str:
    return sql.replace(f"range({REPS})", f"range({FULL_REPS})")


@_query(_full(ORACLE_SQL["bootstrap_ci_md5"]))
def bootstrap_ci_md5_5000(spark, sf_dir):
    c = _cluster_counts(spark, sf_dir)
    return _rounded(resample.macro_f1_interval(c, resample.md5_draws(spark, c.count(), FULL_REPS), []))


@_query(f"WITH RECURSIVE {_CL}, {_stream_sql(42, FULL_REPS, 17)}, {_REP}, v AS (SELECT {_MF1} AS v FROM rp) {_CI}")
def bootstrap_ci_numpy_5000(spark, sf_dir):
    c = _cluster_counts(spark, sf_dir)
    return _rounded(resample.macro_f1_interval(c, resample.numpy_draws(spark, c.count(), FULL_REPS), []))


@_query(_full(ORACLE_SQL["bootstrap_macro_ci_md5"]))
def bootstrap_macro_ci_md5_5000(spark, sf_dir):
    ids, c = _macro_counts(spark, sf_dir)
    return _rounded(resample.macro_over_conditions(c, resample.md5_draws(spark, ids.count(), FULL_REPS), "cond"))


@_query(_full(ORACLE_SQL["paired_bootstrap_md5"]))
def paired_bootstrap_md5_5000(spark, sf_dir):
    ids, c = _arm_counts(spark, sf_dir)
    return _rounded(resample.paired_interval(c, resample.md5_draws(spark, ids.count(), FULL_REPS), "arm", "a", "b"))


# Text: a user's turn and the answer to it.


def _pairs(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("ref"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key")
    return u.join(a, ["conv_id", "turn"]).select(key, textsim.tokens("ref").alias("r"), textsim.tokens("hyp").alias("h"))


_PAIRS = """pairs AS (SELECT u.conv_id || ':' || u.turn AS key, regexp_extract_all(lower(coalesce(u.text, '')), '[a-z0-9]+') AS r, regexp_extract_all(lower(coalesce(a.text, '')), '[a-z0-9]+') AS h
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def _grams_sql(n: int) -> str:
    g = lambda c: f"SELECT key, unnest(list_transform(range(1, len({c}) - {n - 2}), lambda i: array_to_string({c}[i : i + {n - 1}], ' '))) AS g FROM pairs WHERE len({c}) >= {n}"
    return f"""gr{n} AS (SELECT key, g, count(*) AS r FROM ({g('r')}) GROUP BY ALL), gh{n} AS (SELECT key, g, count(*) AS h FROM ({g('h')}) GROUP BY ALL),
b{n} AS (SELECT coalesce(x.key, y.key) AS key, coalesce(r, 0) AS r, coalesce(h, 0) AS h FROM gr{n} x FULL JOIN gh{n} y ON x.key = y.key AND x.g = y.g),
o{n} AS (SELECT p.key, coalesce(sum(least(b{n}.r, b{n}.h)), 0) AS hits, coalesce(sum(b{n}.r), 0) AS nr, coalesce(sum(b{n}.h), 0) AS nh FROM pairs p LEFT JOIN b{n} ON b{n}.key = p.key GROUP BY p.key)"""


def _rouge_sql(n: int) -> str:
    return f"WITH {_PAIRS}, {_grams_sql(n)} SELECT key, round(coalesce(2 * hits / nullif(CAST(nr + nh AS DOUBLE), 0), 0), 6) AS rouge{n}_f1 FROM o{n}"


@_query(_rouge_sql(1))
def rouge1_f1(spark, sf_dir):
    return _rounded(textsim.rouge_n(_pairs(spark, sf_dir), "key", "r", "h", 1))


@_query(_rouge_sql(2))
def rouge2_f1(spark, sf_dir):
    return _rounded(textsim.rouge_n(_pairs(spark, sf_dir), "key", "r", "h", 2))


@_query(f"""WITH RECURSIVE {_PAIRS}, st AS (SELECT key, r, h, 0 AS i, list_transform(range(len(h) + 1), lambda t: CAST(0 AS BIGINT)) AS row FROM pairs
UNION ALL SELECT key, r, h, i + 1, list_reduce(list_transform(range(1, len(h) + 1), lambda j: {{'hit': h[j] = r[i + 1], 'corner': row[j], 'over': row[j + 1], 'acc': CAST([0] AS BIGINT[])}}), lambda a, z: {{'hit': z.hit, 'corner': z.corner, 'over': z.over, 'acc': list_append(a.acc, CASE WHEN z.hit THEN z.corner + 1 ELSE greatest(z.over, a.acc[-1]) END)}}, {{'hit': false, 'corner': CAST(0 AS BIGINT), 'over': CAST(0 AS BIGINT), 'acc': CAST([0] AS BIGINT[])}}).acc FROM st WHERE i < len(r))
SELECT key, round(coalesce(2 * row[-1] / nullif(CAST(len(r) + len(h) AS DOUBLE), 0), 0), 6) AS rouge_l_f1 FROM st WHERE i = len(r)""")
def rouge_l_f1(spark, sf_dir):
    return _rounded(textsim.rouge_l(_pairs(spark, sf_dir), "key", "r", "h"))


@_query(f"""WITH {_PAIRS}, {', '.join(_grams_sql(n) for n in (1, 2, 3, 4))}
SELECT p.key, round(CASE WHEN len(r) = 0 OR len(h) = 0 OR o1.hits = 0 THEN 0e0 ELSE (CASE WHEN len(h) > len(r) THEN 1e0 ELSE exp(1 - len(r) / CAST(len(h) AS DOUBLE)) END) * exp((ln(o1.hits / CAST(len(h) AS DOUBLE))
  + {' + '.join(f"ln((CASE WHEN o{n}.hits = 0 THEN 1e-1 ELSE CAST(o{n}.hits AS DOUBLE) END) / greatest(len(h) - {n - 1}, 1))" for n in (2, 3, 4))}) / 4) END, 6) AS bleu4
FROM pairs p JOIN o1 ON o1.key = p.key JOIN o2 ON o2.key = p.key JOIN o3 ON o3.key = p.key JOIN o4 ON o4.key = p.key""")
def bleu4(spark, sf_dir):
    return _rounded(textsim.bleu4(_pairs(spark, sf_dir), "key", "r", "h"))


_DIV = f"""{_PAIRS}, {_grams_sql(1)}, z AS (SELECT key, sum(r) AS nr, sum(h) AS nh, count(*) AS v FROM b1 GROUP BY key),
sh AS (SELECT key, (r + 1e-3) / (nr + 1e-3 * v) AS p, (h + 1e-3) / (nh + 1e-3 * v) AS q FROM b1 JOIN z USING (key))"""


@_query(f"WITH {_DIV}, k AS (SELECT key, sum(p * ln(p / q)) / ln(2) AS x FROM sh GROUP BY key) SELECT pairs.key, round(x, 6) AS kl_bits FROM pairs LEFT JOIN k ON k.key = pairs.key")
def kl_divergence(spark, sf_dir):
    return _rounded(textsim.divergences(_pairs(spark, sf_dir), "key", "r", "h").select("key", "kl_bits"))


@_query(f"WITH {_DIV}, k AS (SELECT key, (sum(p * ln(2 * p / (p + q))) + sum(q * ln(2 * q / (p + q)))) / (2 * ln(2)) AS x FROM sh GROUP BY key) SELECT pairs.key, round(x, 6) AS js_bits FROM pairs LEFT JOIN k ON k.key = pairs.key")
def js_divergence(spark, sf_dir):
    return _rounded(textsim.divergences(_pairs(spark, sf_dir), "key", "r", "h").select("key", "js_bits"))


@_query("WITH w AS (SELECT role, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM conversations), c AS (SELECT role, term, count(*) AS n FROM w GROUP BY ALL) SELECT role, term, CAST(n AS BIGINT) AS n, round(100e0 * n / greatest(sum(n) OVER (PARTITION BY role), 1), 6) AS percent FROM c")
def tokens_term_frequency(spark, sf_dir):
    return _rounded(textsim.term_frequency(_t(spark, sf_dir, "conversations"), ["role"], "text"))


@_query("SELECT role, CAST(count(*) AS BIGINT) AS n, CAST(count(text) AS BIGINT) AS n_scored, CAST(count(*) - count(text) AS BIGINT) AS n_errors, round(avg(length(text)), 6) AS mean_chars FROM conversations GROUP BY role")
def text_summary_by_role(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    return _rounded(c.groupBy("role").agg(F.count("*").alias("n"), F.count("text").alias("n_scored"), F.count_if(F.col("text").isNull()).alias("n_errors"), F.avg(F.length("text")).alias("mean_chars")))


@_query("SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def quartiles_by_group(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_type", "value")
    q = select.quantiles(e, ["event_type"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return _rounded(q.join(e.groupBy("event_type").agg(F.avg("value").alias("mean")), "event_type"))


@_query("SELECT event_type, round(regr_slope(value, user_id), 6) AS slope, round(regr_intercept(value, user_id), 6) AS intercept FROM events GROUP BY event_type")
def trend_slope(spark, sf_dir):
    x, y = F.col("user_id").cast("double"), F.col("value")
    return _rounded(_t(spark, sf_dir, "events").groupBy("event_type").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")))


# Parsers: replies made of numbers in the tables.

_REPLY = "'Total missing: 9' || chr(10) || 'Missing teeth: ' || CASE WHEN event_id % 11 = 0 THEN 'none' ELSE CAST(event_id % 40 AS VARCHAR) || ', ' || CAST(user_id % 33 AS VARCHAR) || ' and 7' END || chr(10) || 'Confidence: ' || CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'LOW' ELSE 'unsure' END"


def _replies(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", F.expr(_REPLY.replace("chr(10)", "'\\n'").replace("VARCHAR", "STRING")).alias("reply"))


_TEETH = "array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({x}, '\\b([0-9]+)\\b', 1), lambda v: TRY_CAST(v AS INT)), lambda v: v BETWEEN 1 AND 32)))[1:28], ',')"
_RE = f"x AS (SELECT event_id, {_REPLY} AS reply FROM events), y AS (SELECT *, regexp_replace(reply, 'Total missing:\\s*[^\\n]*', ' ', 'gi') AS t, regexp_extract(reply, 'Missing teeth:\\s*([^\\n]+)', 1) AS line FROM x)"


@_query(f"WITH {_RE} SELECT event_id, CASE WHEN contains(line, 'none') THEN '' ELSE {_TEETH.format(x='line')} END AS teeth FROM y")
def strict_list_parser(spark, sf_dir):
    return _replies(spark, sf_dir).select("event_id", F.array_join(parsing.listed_teeth("reply"), ",").alias("teeth"))


@_query(f"WITH {_RE} SELECT event_id, {_TEETH.format(x='t')} AS teeth FROM y")
def loose_list_parser(spark, sf_dir):
    return _replies(spark, sf_dir).select("event_id", F.array_join(parsing.listed_teeth("reply", strict=False), ",").alias("teeth"))


@_query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' ELSE 'Medium' END AS confidence FROM events")
def confidence_extract(spark, sf_dir):
    return _replies(spark, sf_dir).select("event_id", parsing.confidence("reply").alias("confidence"))


_SLOT = "((user_id % 4 + 1) * 10 + hour(ts) % 8 + 1)"
_SAID = "(['Impacted', 'Caries', 'Deep Caries', 'Periapical Lesion'])[CAST({0} % 4 AS INT) + 1]"


@_query(f"""SELECT event_id, '{{"' || {_SLOT} || '":["' || {_SAID.format('event_id')} || '"' || CASE WHEN event_id % 4 <> user_id % 4 THEN ',"' || {_SAID.format('user_id')} || '"' ELSE '' END || ']}}' AS findings FROM events""")
def finding_text_parser(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    slot = (F.col("user_id") % 4 + 1) * 10 + F.hour("ts") % 8 + 1
    names = F.array(*map(F.lit, parsing.CONDITIONS))
    reply = F.format_string("Findings:\n%d: %s, then %s", slot.cast("int"), F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")), F.element_at(names, (F.col("user_id") % 4 + 1).cast("int")))
    return parsing.parse_findings(e.select("event_id", reply.alias("response"))).select("event_id", F.to_json("findings").alias("findings"))


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'mixed_dentition' WHEN o_orderstatus = 'F' THEN 'impacted' WHEN o_orderpriority LIKE '1%' THEN 'periapical' WHEN o_custkey % 2 = 0 THEN 'caries' ELSE 'other' END AS stratum,
  CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority ELSE 'Nil .' END AS caries FROM orders""")
def field_extract_strata(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    line = lambda name, test, value: F.concat(F.lit(f"{name}: "), F.when(test, value).otherwise(F.lit("Nil .")), F.lit("\n"))
    report = F.concat(
        F.when(F.col("o_orderkey") % 13 == 0, "Mixed Dentition\n").otherwise(""), line("Caries present", F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")),
        line("Periapical changes", F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")), line("Impacted tooth", F.col("o_orderstatus") == "F", F.col("o_orderstatus")),
    )
    return o.select("o_orderkey", report.alias("report")).select("o_orderkey", parsing.stratum(F.col("report")).alias("stratum"), parsing.report_field(F.col("report"), "Caries present").alias("caries"))


# Orders and selections.


@_query("WITH x AS (SELECT p_brand, CASE WHEN p_partkey % 5 = 0 THEN 'n' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS id FROM part) SELECT p_brand, id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY NOT regexp_full_match(id, '\\d+'), TRY_CAST(id AS BIGINT), id) AS INT) AS rank FROM x")
def numeric_aware_sort_rank(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    rows = _t(spark, sf_dir, "part").select("p_brand", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("n"), key)).otherwise(key).alias("id"))
    return select.ranked(rows, ["p_brand"], select.numeric_order("id"))


@_query("WITH x AS (SELECT p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'train_' ELSE 'val_' END || p_partkey AS id FROM part) SELECT p_brand, id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY split_part(id, '_', 1), CAST(split_part(id, '_', 2) AS BIGINT)) AS INT) AS rank FROM x")
def tail_sort_rank(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select("p_brand", F.concat(F.when(F.col("p_partkey") % 2 == 0, "train_").otherwise("val_"), F.col("p_partkey").cast("string")).alias("id"))
    return select.ranked(rows, ["p_brand"], select.tail_order("id"))


@_query("SELECT o_orderpriority, o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders WHERE o_totalprice > 200000) WHERE r = 1")
def first_match_per_category(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").where("o_totalprice > 200000").select("o_orderpriority", "o_orderkey", "o_custkey")
    return select.first_match(o, ["o_orderpriority"], ["o_orderkey"])


_HELD = "picks AS (SELECT min(c_custkey) FILTER (c_acctbal < 0) AS a, min(c_custkey) FILTER (c_mktsegment = 'BUILDING') AS b, min(c_custkey) FILTER (c_nationkey = 3) AS c FROM customer), held AS (SELECT c_custkey, arg_min(role, ord) AS role FROM (SELECT a AS c_custkey, 'negative' AS role, 0 AS ord FROM picks UNION ALL SELECT b, 'building', 1 FROM picks UNION ALL SELECT c, 'nation', 2 FROM picks) WHERE c_custkey IS NOT NULL GROUP BY c_custkey)"


def _held(spark, sf_dir):
    roles = {"negative": F.col("c_acctbal") < 0, "building": F.col("c_mktsegment") == "BUILDING", "nation": F.col("c_nationkey") == 3}
    return select.held_out(_t(spark, sf_dir, "customer"), roles, "c_custkey")


@_query(f"WITH {_HELD} SELECT * FROM held")
def heldout_selection(spark, sf_dir):
    return _held(spark, sf_dir)


@_query(f"WITH {_HELD} SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM held)")
def heldout_anti_join(spark, sf_dir):
    return _t(spark, sf_dir, "customer").join(_held(spark, sf_dir), "c_custkey", "left_anti").select("c_custkey", "c_name")


@_query("SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_right_wins(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return select.right_wins(c, _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), ["k"])


@_query("SELECT o_orderpriority AS strategy, strftime(max(o_orderdate), '%Y%m%d') AS run FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def latest_complete_run(spark, sf_dir):
    runs = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("strategy"), F.date_format("o_orderdate", "yyyyMMdd").alias("run"), "o_orderstatus")
    return select.latest_complete(runs, ["strategy"], "run", F.col("o_orderstatus") == "F")


@_query("WITH p AS (SELECT l_returnflag AS s, count(DISTINCT l_linestatus) AS n, bool_and(l_quantity > 0) AS done FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS strategies, coalesce(count(*) = 3 AND bool_and(n >= 2 AND done), false) AS ready FROM p")
def completed_matrix_gate(spark, sf_dir):
    return select.full_matrix(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", F.col("l_quantity") > 0, ["A", "N", "R"], 2)


@_query("SELECT r_name, n_name, CAST(count(DISTINCT c_custkey) AS BIGINT) AS customers, CAST(count(l_orderkey) AS BIGINT) AS items FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def hierarchical_dims_findings(spark, sf_dir):
    per_order = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = _t(spark, sf_dir, "orders").join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.sum("n").alias("n"))
    c = _t(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    dims = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(dims, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.count_distinct("c_custkey").alias("customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"))


@_query("SELECT user_id, array_to_string(list_sort(list_filter(range(0, 24), lambda h: NOT list_contains(list(DISTINCT hour(ts)), h))), ',') AS missing FROM events GROUP BY user_id")
def complement_of_detected(spark, sf_dir):
    seen = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.hour("ts")).alias("seen"))
    return seen.select("user_id", F.array_join(ingest.complement("seen", 0, 23), ",").alias("missing"))


@_query("SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events")
def json_map_explode(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.explode_outer(F.from_json("props", "map<string,bigint>")).alias("key", "value"))


@_query("SELECT doc_id, CAST('0x' || substr(md5(source || ':' || doc_id), 1, 8) AS BIGINT) % 2147483648 AS seed FROM documents")
def md5_seed(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", rates.seed_of(F.concat_ws(":", "source", F.col("doc_id").cast("string"))).alias("seed"))


@_query("SELECT lang, doc_id, CAST(rank AS INT) AS rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 10")
def audit_sample(spark, sf_dir):
    return select.audit_sample(_t(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 10)


@_query("SELECT lang, round(avg(n_chars) FILTER (source = 'src1'), 6) AS plain, round(avg(n_chars) FILTER (source = 'src2'), 6) AS reinforced, round(avg(n_chars) FILTER (source = 'src2') - avg(n_chars) FILTER (source = 'src1'), 6) AS delta FROM documents WHERE source IN ('src1', 'src2') GROUP BY lang")
def reinforce_delta(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    run = lambda s, a: d.where(F.col("source") == s).groupBy("lang").agg(F.avg("n_chars").alias(a))
    return _rounded(run("src1", "plain").join(run("src2", "reinforced"), "lang", "full_outer").select("lang", "plain", "reinforced", (F.col("reinforced") - F.col("plain")).alias("delta")))


@_query("SELECT o_orderpriority AS model, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 999 END AS ord FROM orders GROUP BY 1")
def model_order(spark, sf_dir):
    models = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model")).distinct()
    return select.ordered_models(models, "model", ["5-LOW", "1-URGENT"])


@_query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def resume_pending(spark, sf_dir):
    done = _t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("s_suppkey"))
    return select.pending(_t(spark, sf_dir, "supplier").select("s_suppkey"), done, ["s_suppkey"])


@_query("SELECT event_type, CAST(max(value) AS DOUBLE) AS best FROM events GROUP BY event_type")
def best_by_group(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.max("value").alias("best"))
