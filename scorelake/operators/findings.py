"""Finding-level scoring: sets of (image, location, condition) against one another.

True negatives are the grid less what is in either set; the grid itself is never built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions import rates
from scorelake.operators import select

COUNTS = ("tp", "fp", "fn")


def match(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, is_gt and is_pred: a full outer join of the two sets."""
    left = truth.select(*keys).distinct().withColumn("__g", F.lit(True))
    right = predicted.select(*keys).distinct().withColumn("__p", F.lit(True))
    both = left.join(right, keys, "full_outer")
    return both.select(*keys, F.col("__g").isNotNull().alias("is_gt"), F.col("__p").isNotNull().alias("is_pred"))


def counted() -> list:
    count = lambda hit, name: F.count_if(hit).cast("bigint").alias(name)
    g, p = F.col("is_gt"), F.col("is_pred")
    return [count(g & p, "tp"), count(~g & p, "fp"), count(g & ~p, "fn")]


def by_condition(matches: DataFrame, grid: int, by: list[str], conditions: DataFrame | None = None, of_all: list[str] | None = None) -> DataFrame:
    """Counts, rates and the share of all false positives (over `of_all`) by condition; grid: images x locations."""
    out = matches.groupBy(*by).agg(*counted())
    if conditions is not None:
        out = conditions.join(out, by, "left").fillna(0, list(COUNTS))
    out = out.withColumn("tn", F.lit(grid) - F.col("tp") - F.col("fp") - F.col("fn"))
    share = rates.ratio(100 * F.col("fp"), F.sum("fp").over(Window.partitionBy(*(of_all or [F.lit(0)]))))
    return out.select("*", *rates.condition_rates(), share.alias("fp_share"))


def image_rows(images: DataFrame, matches: DataFrame, image: list[str], slots: int, location: str, condition: str) -> DataFrame:
    """A row for each image, also without findings: serialised sets, counts and the hallucination rate."""
    name = F.concat_ws("|", F.col(location).cast("string"), condition)
    g, p = F.col("is_gt"), F.col("is_pred")
    kept = lambda hit, alias: F.array_join(F.array_sort(F.collect_list(F.when(hit, name))), "; ").alias(alias)
    sets = matches.groupBy(*image).agg(kept(g, "gt_set"), kept(p, "pred_set"), kept(g & p, "tp_set"), kept(~g & p, "fp_set"), kept(g & ~p, "fn_set"), *counted())
    out = images.select(*image).distinct().join(sets, image, "left").fillna(0, list(COUNTS)).fillna("", ["gt_set", "pred_set", "tp_set", "fp_set", "fn_set"])
    out = out.withColumn("tn", F.lit(slots) - F.col("tp") - F.col("fp") - F.col("fn"))
    return out.withColumn("hallucination_rate", rates.ratio(F.col("fp"), F.col("tp") + F.col("fp")))


def summary(images: DataFrame, matches: DataFrame, by: list[str], image: list[str], slots: int) -> DataFrame:
    """Totals and rates over images by `by`; images without any finding count."""
    rows = images.select(*by, *image).distinct().join(matches.groupBy(*by, *image).agg(*counted()), [*by, *image], "left").fillna(0, list(COUNTS))
    long = lambda c, a: c.cast("bigint").alias(a)
    out = rows.groupBy(*by).agg(
        long(F.count("*"), "images"), *(long(F.sum(c), c) for c in COUNTS), long(F.sum(F.lit(slots) - F.col("tp") - F.col("fp") - F.col("fn")), "tn"), long(F.count_if(F.col("fp") > 0), "images_with_fp")
    )
    return out.select("*", *rates.finding_rates())


def located(matches: DataFrame, image: list[str], location: str, condition: str) -> DataFrame:
    """Predicted findings and their bucket: correct, wrong_location, wrong_condition or unsupported, the first that holds."""
    truth = matches.where("is_gt")
    same_condition = truth.select(*image, condition).distinct().withColumn("__c", F.lit(True))
    same_location = truth.select(*image, location).distinct().withColumn("__l", F.lit(True))
    told = matches.where("is_pred").join(same_condition, [*image, condition], "left").join(same_location, [*image, location], "left")
    bucket = F.when(F.col("is_gt"), "correct").when(F.col("__c"), "wrong_location").when(F.col("__l"), "wrong_condition").otherwise("unsupported")
    return told.select(*image, location, condition, bucket.alias("bucket"))


def location_breakdown(located_: DataFrame, by: list[str]) -> DataFrame:
    out = located_.groupBy(*by, "bucket").agg(F.count("*").cast("bigint").alias("n"))
    return out.withColumn("rate", rates.ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)])))))


def examples(located_: DataFrame, order: list[str], most: int = 20) -> DataFrame:
    """The first `most` predicted findings of each bucket."""
    return located_.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).where(F.col("rank") <= most)


def top_conditions(by_condition_: DataFrame, condition: str, n: int = 10) -> DataFrame:
    return by_condition_.groupBy(condition).agg(F.sum("fp").cast("bigint").alias("fp")).orderBy(F.desc("fp"), condition).limit(n)


def pairwise_delta(summaries: DataFrame, by: list[str], model: str, value: list[str]) -> DataFrame:
    """Differences of every ordered pair of models: a self-join with a before b."""
    side = lambda x: summaries.select(*by, F.col(model).alias(f"model_{x}"), *(F.col(v).alias(f"{v}_{x}") for v in value))
    joined = side("a").join(side("b"), by) if by else side("a").join(side("b"), F.col("model_a") < F.col("model_b"))
    pairs = joined.where("model_a < model_b")
    return pairs.select("*", *((F.col(f"{v}_a") - F.col(f"{v}_b")).alias(f"{v}_delta") for v in value))


def aligned(rows: DataFrame, by: list[str], model: str, image: str, position: str) -> DataFrame:
    """Whether the models of a group (two at least) have the same images in the same order: each one's images are
    placed (select.places, so a model's list lies in many tasks), and a digest of (place, image) pairs is compared."""
    placed = select.places(rows.select(*by, model, position, image), [*by, model], [position, image])
    pair = F.xxhash64("place", image)
    lists = placed.groupBy(*by, model).agg(F.count("*").alias("n"), F.bit_xor(pair).alias("x"), F.sum(F.shiftright(pair, 34)).alias("s"))
    return lists.groupBy(*by).agg(F.count("*").cast("bigint").alias("models"), ((F.count_distinct("n", "x", "s") == 1) & (F.count("*") > 1)).alias("aligned"))


def merged_report(summaries: DataFrame, conditions: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by condition beside their run's summary and intervals; runs without intervals stay."""
    return conditions.join(summaries, keys).join(intervals, keys, "left")


def slot_inventory(truth: DataFrame, images: DataFrame, image: list[str], location: str, slots: int) -> DataFrame:
    """One row: images, all their slots, those with a finding and those without."""
    n = images.agg(F.count_distinct(*image).alias("images"))
    abnormal = truth.select(*image, location).distinct().agg(F.count("*").alias("abnormal"))
    return abnormal.crossJoin(n).select("images", (F.col("images") * slots).alias("slots"), "abnormal", (F.col("images") * slots - F.col("abnormal")).alias("clear"))


def labels_per_slot(truth: DataFrame, image: list[str], location: str, condition: str) -> DataFrame:
    """How many slots have how many labels."""
    per = truth.select(*image, location, condition).distinct().groupBy(*image, location).agg(F.count("*").alias("labels"))
    return per.groupBy("labels").agg(F.count("*").alias("n"))
