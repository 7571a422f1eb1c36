"""Ratios and scores from counts. Undefined is null inside; `defined` renders it at the edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL, ZERO, NAN = "null", "zero", "nan"


def defined(value: Column, policy: str = NULL) -> Column:
    """null, 0.0 or NaN in place of what is undefined."""
    if policy == NULL:
        return value
    return F.coalesce(value, F.lit(0.0 if policy == ZERO else float("nan")))


def ratio(top: Column | str, bottom: Column | str, policy: str = NULL) -> Column:
    top, bottom = (F.col(c) if isinstance(c, str) else c for c in (top, bottom))
    return defined(F.try_divide(top.cast("double"), bottom.cast("double")), policy)


def precision(policy: str = NULL) -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fp"), policy)


def recall(policy: str = NULL) -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fn"), policy)


def specificity(policy: str = NULL) -> Column:
    return ratio(F.col("tn"), F.col("tn") + F.col("fp"), policy)


def accuracy(policy: str = NULL) -> Column:
    return ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), policy)


def f1_of_counts(tp: Column, fp: Column, fn: Column, policy: str = ZERO) -> Column:
    """2 tp / (2 tp + fp + fn)."""
    return ratio(2 * tp, 2 * tp + fp + fn, policy)


def f1_of_rates(policy: str = NULL) -> Column:
    """The harmonic mean; undefined unless precision and recall are defined and not both 0."""
    p, r = precision(), recall()
    return defined(F.try_divide(2 * p * r, p + r), policy)


def balanced(recall_: Column, specificity_: Column) -> Column:
    return (recall_ + specificity_) / 2


def condition_rates() -> list[Column]:
    """Of one condition's tp, fp, fn and tn."""
    fp, tp, tn = F.col("fp"), F.col("tp"), F.col("tn")
    return [precision().alias("precision"), recall().alias("recall"), f1_of_rates().alias("f1"), ratio(fp, fp + tn).alias("fpr"), ratio(fp, tp + fp).alias("chr")]


def finding_rates() -> list[Column]:
    """Of totals over images: tp, fp, fn, tn, images and images_with_fp."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    shares = {"fpr": (fp, fp + tn), "fnr": (fn, fn + tp), "chr": (fp, tp + fp)}
    an_image = {"fp_per_image": fp, "image_rate": F.col("images_with_fp"), "predictions_per_image": tp + fp, "correct_per_image": tp}
    whole = [accuracy().alias("accuracy"), precision().alias("precision"), recall().alias("recall"), f1_of_rates().alias("f1"), specificity().alias("specificity")]
    return [*whole, *(ratio(a, b).alias(n) for n, (a, b) in shares.items()), *(ratio(a, F.col("images")).alias(n) for n, a in an_image.items())]


def seed_of(key: Column | str) -> Column:
    """First eight hex digits of the md5 of the key, modulo 2^31."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(1 << 31))
