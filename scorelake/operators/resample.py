"""Cluster bootstrap on sufficient statistics.

Counts add up over a cluster's slots, so a replicate is a weighted sum of one row a cluster. Draws are by md5, reproducible
in any SQL engine, or by NumPy's generator (`draws`); they are made in the tasks that use them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.functions import rates
from scorelake.operators.confusion import macro_f1
from scorelake.operators.draws import Draws, MD5Draws, numpy_draws, sums  # noqa: F401


def clusters(rows: DataFrame, by: list[str], cluster: str) -> DataFrame:
    """Rows with idx: the cluster's place in its group, from 0.

    The distinct clusters are sorted by range partitions and numbered within each; the partitions' counts give the rest, so no task sees all.
    """
    keys = rows.select(*by, cluster).distinct().repartitionByRange(*by, cluster).sortWithinPartitions(*by, cluster)
    # Ids are partition << 33 | place, so they ascend as the clusters do.
    keys = keys.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
    sizes = keys.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part")) - F.col("__n")).alias("__before"))
    keys = keys.join(F.broadcast(before), "__part").withColumn("__place", F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1)).select(*by, cluster, "__place")
    if by:
        keys = keys.join(keys.groupBy(*by).agg(F.min("__place").alias("__first")), by).withColumn("__place", F.col("__place") - F.col("__first")).drop("__first")
    return rows.join(keys.withColumnRenamed("__place", "idx"), [*by, cluster])


def md5_draws(spark: SparkSession, n: int, reps: int, seed: int = 42) -> MD5Draws:
    """n draws with replacement of each replicate, by md5."""
    return MD5Draws(n, reps, seed)


def summed(counts: DataFrame, drawn: Draws | DataFrame, by: list[str], names: tuple[str, ...]) -> DataFrame:
    """by, rep, images and the sums of names over each replicate's draws; drawn may be a table (rep, idx, w), too."""
    if isinstance(drawn, Draws):
        return sums(counts, drawn, by, list(names))
    return counts.join(drawn, "idx").groupBy(*by, "rep").agg(F.sum("w").alias("images"), *(F.sum(F.col("w") * F.col(c)).cast("bigint").alias(c) for c in names))


def replicates(counts: DataFrame, draws: Draws | DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn of every replicate; counts has by, idx and these."""
    return summed(counts, draws, by, ("tp", "fp", "fn", "tn")).drop("images")


def interval(values: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Mean, 2.5 and 97.5 percentiles (linear) and the number of defined replicates."""
    q = lambda p, a: F.percentile("__v", F.lit(p)).alias(a)
    return values.withColumn("__v", value).groupBy(*by).agg(q(0.025, "low"), q(0.975, "high"), F.avg("__v").alias("mean"), F.count("__v").cast("bigint").alias("n_boot"))


def macro_f1_interval(counts: DataFrame, draws: Draws | DataFrame, by: list[str]) -> DataFrame:
    return interval(replicates(counts, draws, by), by, macro_f1())


def macro_over_conditions(counts: DataFrame, draws: Draws | DataFrame, condition: str) -> DataFrame:
    """Macro F1 over conditions; one without support in a replicate is left out there, a replicate without any is dropped."""
    per = replicates(counts, draws, [condition])
    f1 = F.when(F.col("tp") + F.col("fn") > 0, rates.f1_of_counts(F.col("tp"), F.col("fp"), F.col("fn")))
    return interval(per.withColumn("f1", f1).groupBy("rep").agg(F.avg("f1").alias("f1")), [], F.col("f1"))


def paired_interval(counts: DataFrame, draws: Draws | DataFrame, arm: str, first: str, second: str) -> DataFrame:
    """Interval of macro F1 of `first` less `second`, both under the same draws."""
    per = replicates(counts, draws, [arm]).withColumn("f1", macro_f1())
    wide = per.groupBy("rep").agg(F.max(F.when(F.col(arm) == first, F.col("f1"))).alias("a"), F.max(F.when(F.col(arm) == second, F.col("f1"))).alias("b"))
    return interval(wide, [], F.col("a") - F.col("b"))


#: Scores of findings over images; undefined ones are null and drop out of their own interval only.
FINDING_SCORES = ("precision", "recall", "f1", "chr", "image_rate")


def _finding_scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: tp, fp, fn, hit (images with a false finding) and images, summed."""
    chr_ = rates.ratio(F.col("fp"), F.col("tp") + F.col("fp"))
    scores = (rates.precision(), rates.recall(), rates.f1_of_rates(), chr_, rates.ratio(F.col("hit"), F.col("images")))
    return rows.select(*by, *(x.alias(n) for x, n in zip(scores, FINDING_SCORES, strict=True)))


def finding_intervals(images: DataFrame, draws: Draws | DataFrame, by: list[str]) -> DataFrame:
    """images: by, idx, tp, fp and fn of each image. Returns by, metric, point, low, high, mean and n_boot, all of an image's findings staying together."""
    images = images.withColumn("hit", (F.col("fp") > 0).cast("int"))
    long = lambda rows: rows.select(*by, F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in FINDING_SCORES))).alias("x")).select(*by, "x.*")
    point = long(_finding_scores(images.groupBy(*by).agg(F.count("*").alias("images"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "hit"))), by)).withColumnRenamed("v", "point")
    drawn = long(_finding_scores(summed(images, draws, by, ("tp", "fp", "fn", "hit")), by))
    return point.join(interval(drawn, [*by, "metric"], F.col("v")), [*by, "metric"], "left").fillna(0, ["n_boot"])


def paired_findings(images: DataFrame, draws: Draws | DataFrame, model: str, first: str, second: str) -> DataFrame:
    """One row: CHR and false findings an image of two models on the same images (by idx), their differences and the intervals of these.

    A replicate in which either CHR is undefined is left out of that interval alone.
    """
    side = lambda x: images.where(F.col(model) == x)
    both = side(first).select("idx", F.col("tp").alias("tp_a"), F.col("fp").alias("fp_a")).join(side(second).select("idx", F.col("tp").alias("tp_b"), F.col("fp").alias("fp_b")), "idx")
    names = ("tp_a", "fp_a", "tp_b", "fp_b")

    def scored(rows: DataFrame) -> DataFrame:
        chr_ = lambda s: rates.ratio(F.col(f"fp_{s}"), F.col(f"tp_{s}") + F.col(f"fp_{s}")).alias(f"chr_{s}")
        out = rows.select("images", chr_("a"), chr_("b"), *(rates.ratio(F.col(f"fp_{s}"), F.col("images")).alias(f"fp_per_image_{s}") for s in "ab"))
        return out.select("*", (F.col("chr_a") - F.col("chr_b")).alias("chr_delta"), (F.col("fp_per_image_a") - F.col("fp_per_image_b")).alias("fp_per_image_delta"))

    point = scored(both.agg(F.count("*").alias("images"), *(F.sum(c).alias(c) for c in names)))
    q = lambda c, p, a: F.percentile(c, F.lit(p)).alias(f"{c}_{a}")
    drawn = scored(summed(both, draws, [], names))
    return point.crossJoin(drawn.agg(*(q(c, p, a) for c in ("chr_delta", "fp_per_image_delta") for p, a in ((0.025, "low"), (0.975, "high")))))


def paired_macro_interval(counts: DataFrame, draws: Draws | DataFrame, arm: str, first: str, second: str, condition: str) -> DataFrame:
    """Interval of macro F1 over conditions of `first` less `second`, both under the same draws, and the difference itself.

    A condition without support in a replicate is left out there; the truth is the arms' own, so both leave out the same.
    """
    f1 = F.avg(F.when(F.col("tp") + F.col("fn") > 0, rates.f1_of_counts(F.col("tp"), F.col("fp"), F.col("fn")))).alias("f1")
    of = lambda x: F.max(F.when(F.col(arm) == x, F.col("f1")))
    drawn = replicates(counts, draws, [arm, condition]).groupBy(arm, "rep").agg(f1).groupBy("rep").agg(of(first).alias("a"), of(second).alias("b"))
    whole = counts.groupBy(arm, condition).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).groupBy(arm).agg(f1).agg((of(first) - of(second)).alias("delta"))
    return interval(drawn, [], F.col("a") - F.col("b")).crossJoin(whole)


def all_pairs(images: DataFrame, draws: Draws | DataFrame, by: list[str], model: str, order: str, aligned: DataFrame) -> DataFrame:
    """Every pair of a group's models, the earlier in `order` (then by name) first: scores, differences and the intervals of these.

    images: by, model, order, idx, tp and fp of each image (the groups have the same number of them). aligned: by and `aligned`; the pairs of a group
    that isn't have nulls. All models have the same draws: each one's sums by replicate are an array, and a pair is a row with both arrays, so no replicate is
    joined. A replicate in which either CHR is undefined is left out of that interval alone.
    """
    names = ("tp", "fp")
    whole = images.groupBy(*by, model).agg(F.min(order).alias("ord"), F.count("*").alias("n"), *(F.sum(c).alias(c) for c in names))
    drawn = summed(images, draws, [*by, model], names)
    chr_ = rates.ratio(F.col("fp"), F.col("tp") + F.col("fp"))
    drawn = drawn.groupBy(*by, model).agg(F.array_sort(F.collect_list(F.struct("rep", chr_.alias("c"), rates.ratio(F.col("fp"), F.col("images")).alias("h")))).alias("drawn"))
    told = whole.join(drawn, [*by, model]).withColumn("c", chr_).withColumn("h", rates.ratio(F.col("fp"), F.col("n")))
    side = lambda s: told.select(*by, *(F.col(c).alias(f"{c}_{s}") for c in (model, "ord", "n", "c", "h", "drawn")))
    a, b = side("a"), side("b")
    after = (F.col("ord_a") < F.col("ord_b")) | ((F.col("ord_a") == F.col("ord_b")) & (F.col(f"{model}_a") < F.col(f"{model}_b")))
    pairs = a.join(b, by).where(after).join(aligned.select(*by, F.col("aligned").alias("paired")), by)
    shown = lambda c, name: F.when(F.col("paired"), c).alias(name)
    delta = lambda k: F.array_sort(F.filter(F.zip_with("drawn_a", "drawn_b", lambda x, y: x[k] - y[k]), lambda v: v.isNotNull())).alias(f"d_{k}")
    out = pairs.select(*by, f"{model}_a", f"{model}_b", "paired", "n_a", "c_a", "c_b", "h_a", "h_b", delta("c"), delta("h"))
    return out.select(
        *by, f"{model}_a", f"{model}_b", "paired", shown(F.col("n_a"), "n_images"), shown(F.col("c_a"), "chr_a"), shown(F.col("c_b"), "chr_b"), shown(F.col("c_a") - F.col("c_b"), "chr_delta"),
        shown(_linear("d_c", 0.025), "chr_delta_low"), shown(_linear("d_c", 0.975), "chr_delta_high"), shown(F.col("h_a"), "fp_per_image_a"), shown(F.col("h_b"), "fp_per_image_b"),
        shown(F.col("h_a") - F.col("h_b"), "fp_per_image_delta"), shown(_linear("d_h", 0.025), "fp_per_image_delta_low"), shown(_linear("d_h", 0.975), "fp_per_image_delta_high"),
    )


def _linear(ascending: str, q: float) -> Column:
    """The quantile of a sorted array by linear interpolation; null if it is empty."""
    at = (F.size(ascending) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    value = lambda i: F.get(F.col(ascending), i)
    return value(low) + (value(F.least(low + 1, F.size(ascending) - 1)) - value(low)) * (at - low)
