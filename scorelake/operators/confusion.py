"""Slot-level confusion: pooled, per case, image level, multi-label and exclusive classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions import rates


#: A table of labels or slots may be broadcast up to so many rows; more are an error.
MOST_LABELS = 1000


def one_vs_rest(rows: DataFrame, by: list[str], true: str, pred: str, labels: list) -> DataFrame:
    """tp, fp, fn, tn of every label against the others, in one aggregation; labels that never occur stay."""
    t, p = F.col(true), F.col(pred)
    count = lambda hit: F.count_if(hit).cast("bigint")
    cells = F.array(*(F.struct(F.lit(x).alias("label"), count((t == x) & (p == x)).alias("tp"), count((t != x) & (p == x)).alias("fp"), count((t == x) & (p != x)).alias("fn"), count((t != x) & (p != x)).alias("tn")) for x in labels))
    return rows.groupBy(*by).agg(cells.alias("cells")).select(*by, F.explode("cells").alias("c")).select(*by, "c.*")


def class_rates(cells: DataFrame, policy: str = rates.ZERO) -> DataFrame:
    r, s = rates.recall(policy), rates.specificity(policy)
    return cells.select(
        "*", rates.precision(policy).alias("precision"), r.alias("recall"), rates.f1_of_counts(F.col("tp"), F.col("fp"), F.col("fn"), policy).alias("f1"), s.alias("specificity"),
        rates.accuracy(policy).alias("accuracy"), rates.balanced(r, s).alias("balanced_accuracy"), (F.col("tp") + F.col("fn")).alias("support"), (F.col("tp") + F.col("fn") == 0).alias("undefined"),
    )


def macro(class_rates_: DataFrame, by: list[str], skip_zero: bool = False) -> DataFrame:
    """Means over classes (f1 too: the mean of the classes' f1). With skip_zero, classes without support are left out; if all are, the means are null."""
    used = (F.col("support") > 0) if skip_zero else F.lit(True)
    mean = lambda c: F.avg(F.when(used, F.col(c))).alias(f"macro_{c}")
    named = lambda hit, a: F.array_join(F.array_sort(F.collect_list(F.when(hit, F.col("label").cast("string")))), ",").alias(a)
    return class_rates_.groupBy(*by).agg(mean("precision"), mean("recall"), mean("f1"), named(used, "used"), named(~used, "skipped"))


def matrix(rows: DataFrame, by: list[str], true: str, pred: str, labels: DataFrame) -> DataFrame:
    """All cells, zeros too; labels: a table with the column label, at most MOST_LABELS rows."""
    labels = labels.limit(MOST_LABELS + 1).withColumn("label", F.when(F.count("*").over(Window.partitionBy(F.lit(0))) > MOST_LABELS, F.raise_error(F.lit(f"more than {MOST_LABELS} labels")).cast(labels.schema["label"].dataType)).otherwise(F.col("label")))
    grid = rows.select(*by).distinct().crossJoin(F.broadcast(labels.select(F.col("label").alias("true_label")))).crossJoin(F.broadcast(labels.select(F.col("label").alias("pred_label"))))
    seen = rows.groupBy(*by, F.col(true).alias("true_label"), F.col(pred).alias("pred_label")).agg(F.count("*").alias("n"))
    return grid.join(seen, [*by, "true_label", "pred_label"], "left").select(*by, "true_label", "pred_label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def row_normalised(cells: DataFrame, by: list[str]) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(*by, "true_label"))
    return cells.withColumn("share", F.col("n") / F.greatest(total, F.lit(1)))


def binary_counts(rows: DataFrame, by: list[str], true: str, pred: str) -> DataFrame:
    """tp, fp, fn, tn of the class 1; the counts of class 0 are the same, crosswise."""
    t, p = F.col(true) == 1, F.col(pred) == 1
    count = lambda hit, a: F.count_if(hit).cast("bigint").alias(a)
    return rows.groupBy(*by).agg(count(t & p, "tp"), count(~t & p, "fp"), count(t & ~p, "fn"), count(~t & ~p, "tn"))


def macro_f1() -> Column:
    """Of both classes, from the counts of class 1."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (rates.f1_of_counts(tp, fp, fn) + rates.f1_of_counts(tn, fn, fp)) / 2


#: The scores of one case, and of the mean over cases.
CASE_SCORES = ("precision", "recall", "f1", "macro_f1", "accuracy", "specificity", "balanced_accuracy", "npv")


def case_scores(rows: DataFrame, by: list[str], case: str, true: str, pred: str) -> DataFrame:
    """A row for each case: tp, fp, fn, tn, support and the scores of class 1, undefined ones 0."""
    z = rates.ZERO
    r, s = rates.recall(z), rates.specificity(z)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    scores = (rates.precision(z), r, rates.f1_of_counts(tp, fp, fn), macro_f1(), rates.accuracy(z), s, rates.balanced(r, s), rates.ratio(tn, tn + fn, z))
    return binary_counts(rows, [*by, case], true, pred).select("*", (tp + fn).alias("support"), *(x.alias(n) for x, n in zip(scores, CASE_SCORES, strict=True)))


def case_mean(rows: DataFrame, by: list[str], case: str, true: str, pred: str, names: tuple[str, ...] = CASE_SCORES[:5]) -> DataFrame:
    """Means over cases of each case's scores, and the summed counts."""
    per = case_scores(rows, by, case, true, pred)
    return per.groupBy(*by).agg(F.count("*").cast("bigint").alias("cases"), *(F.avg(n).alias(f"mean_{n}") for n in names))


def label_means(rows: DataFrame, by: list[str], case: str, label: str, true: str, pred: str) -> DataFrame:
    """One-vs-rest by label, averaged over cases: precision, recall, f1 and support."""
    per = case_scores(rows, [*by, label], case, true, pred)
    return per.groupBy(*by, label).agg(*(F.avg(n).alias(n) for n in ("precision", "recall", "f1", "support")))


def with_none(rows: DataFrame, keys: list[str], label: str, true: str, pred: str, none: str) -> DataFrame:
    """One-vs-rest rows and, for each of keys, one of the class `none`: 1 where no label holds."""
    empty = rows.groupBy(*keys).agg((1 - F.max(true)).alias(true), (1 - F.max(pred)).alias(pred)).withColumn(label, F.lit(none))
    return rows.select(*keys, label, true, pred).unionByName(empty.select(*keys, label, true, pred))


def mean_sizes(cases: DataFrame, by: list[str], truth: str, predicted: str, seconds: str) -> DataFrame:
    """Means over cases of the keys and of the labels of two maps from slot to labels, and of the seconds."""
    labels = lambda c: F.aggregate(F.map_values(c), F.lit(0), lambda n, x: n + F.size(x))
    mean = lambda c, a: F.avg(c).alias(a)
    return cases.groupBy(*by).agg(
        F.count("*").alias("cases"), mean(F.size(predicted), "mean_predicted_slots"), mean(F.size(truth), "mean_truth_slots"),
        mean(labels(predicted), "mean_predicted_labels"), mean(labels(truth), "mean_truth_labels"), mean(F.col(seconds), "mean_seconds"),
    )


def confusion_table(counts: DataFrame) -> DataFrame:
    """counts with sensitivity, specificity, PPV and NPV to six digits; undefined is null."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select("*", *(F.round(x, 6).alias(n) for x, n in ((rates.recall(), "sensitivity"), (rates.specificity(), "specificity"), (rates.precision(), "ppv"), (rates.ratio(tn, tn + fn), "npv"))))


def averaged_f1(cells: DataFrame, by: list[str]) -> DataFrame:
    """Micro, macro and support-weighted F1 over the labels of one-vs-rest counts; macro over all labels."""
    f1 = rates.f1_of_counts(F.col("tp"), F.col("fp"), F.col("fn"))
    support = F.col("tp") + F.col("fn")
    return cells.groupBy(*by).agg(
        rates.f1_of_counts(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"), F.avg(f1).alias("macro_f1"), rates.ratio(F.sum(f1 * support), F.sum(support), rates.ZERO).alias("weighted_f1"),
    )


def image_subset_accuracy(rows: DataFrame, by: list[str], image: str, truth: str, predicted: str) -> DataFrame:
    """The share of images all of whose slots have just the true labels."""
    same = (F.size(F.array_except(truth, predicted)) == 0) & (F.size(F.array_except(predicted, truth)) == 0)
    per = rows.groupBy(*by, image).agg(F.bool_and(same).alias("same"))
    return per.groupBy(*by).agg(F.count("*").alias("images"), F.avg(F.col("same").cast("double")).alias("image_subset_accuracy"))


def half_widths(table: DataFrame, point: str, low: str, high: str) -> DataFrame:
    """Lengths of an interval's arms, at least 0."""
    return table.select("*", F.greatest(F.col(point) - F.col(low), F.lit(0.0)).alias("arm_low"), F.greatest(F.col(high) - F.col(point), F.lit(0.0)).alias("arm_high"))


def any_positive(rows: DataFrame, by: list[str], case: str, true: str, pred: str) -> DataFrame:
    """Case level: is there any positive, and was any told."""
    return rows.groupBy(*by, case).agg(F.max(true).alias(true), F.max(pred).alias(pred))


def dense(cases: DataFrame, slots: DataFrame, marked: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """case x slot with 0/1; slots is a fixed dimension of at most MOST_LABELS rows."""
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    slots = slots.limit(MOST_LABELS + 1).withColumn("__n", F.when(n > MOST_LABELS, F.raise_error(F.lit(f"more than {MOST_LABELS} slots")).cast("bigint")).otherwise(n)).where("__n > 0").drop("__n")
    return cases.crossJoin(F.broadcast(slots)).join(marked.withColumn(flag, F.lit(1)), keys, "left").fillna(0, [flag])


def support(rows: DataFrame, conditions: DataFrame, by: str, flag: Column) -> DataFrame:
    counts = rows.where(flag).groupBy(by).agg(F.count("*").alias("support"))
    return conditions.join(counts, by, "left").select(by, F.coalesce("support", F.lit(0)).cast("bigint").alias("support"))


def exclusive_class(labels: Column, order: list[str], none: str) -> Column:
    """The first label in the given order that the array holds."""
    out = F
    for name in order:
        out = out.when(F.array_contains(labels, name), F.lit(name))
    return out.otherwise(F.lit(none))


def example_metrics(rows: DataFrame, by: list[str], truth: str, predicted: str, n_labels: int) -> DataFrame:
    """Example-based multi-label metrics; two empty sets agree fully, one empty set gives 0."""
    g, p = F.col(truth), F.col(predicted)
    both, n_g, n_p = F.size(F.array_intersect(g, p)), F.size(g), F.size(p)
    empty = (n_g == 0) & (n_p == 0)
    one = lambda value: F.when(empty, F.lit(1.0)).otherwise(F.coalesce(value, F.lit(0.0)))
    return rows.groupBy(*by).agg(
        F.count("*").cast("bigint").alias("n"),
        (F.sum(n_g + n_p - 2 * both) / (F.count("*") * n_labels)).alias("hamming"),
        F.avg(F.when((both == n_g) & (both == n_p), 1.0).otherwise(0.0)).alias("subset_accuracy"),
        F.avg(one(F.try_divide(both.cast("double"), n_g + n_p - both))).alias("jaccard"),
        F.avg(one(F.try_divide(both.cast("double"), n_p))).alias("example_precision"),
        F.avg(one(F.try_divide(both.cast("double"), n_g))).alias("example_recall"),
        F.avg(one(F.try_divide(2.0 * both, n_g + n_p))).alias("example_f1"),
        F.count_if(~empty).cast("bigint").alias("n_any"),
        F.try_divide(F.sum(n_g + n_p - 2 * both), F.count_if(~empty) * n_labels).alias("hamming_any"),
    )


def pivot_report(class_rates_: DataFrame, by: list[str], labels: list[str], value: str) -> DataFrame:
    """A wide row of one value a class; no support gives null."""
    shown = F.when(F.col("support") > 0, F.col(value))
    return class_rates_.groupBy(*by).pivot("label", labels).agg(F.first(shown)).select(*by, *(F.col(x).alias(f"{value}_{x.replace(' ', '_')}") for x in labels))


#: What a class contributes to a report, and under which ending.
ENDINGS = {"precision": "P", "recall": "R", "f1": "F1"}


def wide_report(class_rates_: DataFrame, by: list[str], labels: list[str], values: tuple[str, ...] = ("precision", "recall", "f1"), blank: bool = True, support: bool = False) -> DataFrame:
    """One row a group: `<label>_P`, `_R` and `_F1` (or those of them in values) for each label, spaces in names as `_`.

    With blank, a label without support has nulls, which writers render as N/A. With support, its support and whether it is undefined follow.
    """
    cell = lambda name, value: F.max(F.when(F.col("label").cast("string") == name, value))
    shown = lambda v: F.when((F.col("support") > 0) if blank else F.lit(True), F.col(v))
    columns = []
    for name in labels:
        key = name.replace(" ", "_")
        columns += [cell(name, shown(v)).alias(f"{key}_{ENDINGS[v]}") for v in values]
        if support:
            n = F.coalesce(cell(name, F.col("support")), F.lit(0)).cast("bigint")
            columns += [n.alias(f"{key}_support"), (n == 0).alias(f"{key}_undefined")]
    return class_rates_.groupBy(*by).agg(*columns)


def macro_report(class_rates_: DataFrame, by: list[str], prefix: str = "Macro", skip_zero: bool = True, values: tuple[str, ...] = ("precision", "recall", "f1")) -> DataFrame:
    """The macro columns that stand beside a wide report."""
    names = [F.col(f"macro_{v}").alias(f"{prefix}_{ENDINGS[v]}") for v in values]
    return macro(class_rates_, by, skip_zero).select(*by, *names, F.col("used").alias(f"{prefix}_classes_used"), F.col("skipped").alias(f"{prefix}_classes_undefined"))


def overall_report(cells: DataFrame, by: list[str], positive: str) -> DataFrame:
    """Accuracy and balanced accuracy of a binary table, from the counts of its positive class."""
    r, s = rates.recall(rates.ZERO), rates.specificity(rates.ZERO)
    return cells.where(F.col("label").cast("string") == positive).select(*by, rates.accuracy(rates.ZERO).alias("Accuracy"), rates.balanced(r, s).alias("Balanced_Accuracy"))
