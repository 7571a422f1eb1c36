"""Findings as bits: an image's locations by condition are masks, so sets are matched, counted and told apart where the image is.

`pack` makes one row for each image from one shuffle by image, in which every finding is one bit of a mask; masks are merged before the
shuffle, too. All that follows is bit arithmetic on that row, and sums of few rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions import rates

COUNTS = ("tp", "fp", "fn")
BUCKETS = ("correct", "wrong_location", "wrong_condition", "unsupported")


@dataclass(frozen=True)
class Grid:
    """The locations (at most 64) and conditions that findings can have."""

    locations: tuple
    conditions: tuple[str, ...]

    @property
    def slots(self) -> int:
        return len(self.locations) * len(self.conditions)

    def bit(self, location: Column) -> Column:
        at = F.array_position(F.array(*(F.lit(str(x)) for x in self.locations)), location.cast("string")).cast("int")
        wrong = F.raise_error(F.concat(F.lit("no such location: "), location.cast("string"))).cast("long")
        return F.when(location.isNull(), F.lit(0).cast("long")).when(at > 0, F.call_function("shiftleft", F.lit(1).cast("long"), at - 1)).otherwise(wrong)


def pack(rows: DataFrame, image: list[str], location: str, condition: str, truth: str, grid: Grid) -> DataFrame:
    """image, g and p: for each condition the masks of its locations in the truth and in the prediction.

    rows: image, location, condition and a boolean that says which side a finding is of. Rows without a location just name their image, so that images
    without findings can be given; repeated findings count once. A location or condition beyond the grid is an error.
    """
    bit = grid.bit(F.col(location))
    known = F.col(location).isNull() | F.coalesce(F.col(condition).isin(*grid.conditions), F.lit(False))
    bit = F.when(known, bit).otherwise(F.raise_error(F.concat(F.lit("no such condition: "), F.coalesce(F.col(condition), F.lit("null")))).cast("long"))
    marked = rows.select(*image, F.col(condition).alias("__c"), F.col(truth).alias("__t"), bit.alias("__b"))
    side = lambda c, t: F.bit_or(F.when((F.col("__c") == c) & (F.col("__t") == t), F.col("__b")).otherwise(F.lit(0).cast("long")))
    names = {s: [f"__{s}{i}" for i in range(len(grid.conditions))] for s in "gp"}
    made = marked.groupBy(*image).agg(*(side(c, s == "g").alias(n) for s in "gp" for c, n in zip(grid.conditions, names[s], strict=True)))
    return made.select(*image, *(F.array(*names[s]).alias(s) for s in "gp"))


def _masks(i: int) -> dict[str, Column]:
    g, p = F.get("g", F.lit(i)), F.get("p", F.lit(i))
    return {"tp": g.bitwiseAND(p), "fp": p.bitwiseAND(F.bitwise_not(g)), "fn": g.bitwiseAND(F.bitwise_not(p)), "g": g, "p": p}


def _counts(grid: Grid) -> list[Column]:
    return [reduce(add, (F.bit_count(_masks(i)[c]) for i in range(len(grid.conditions)))).cast("long").alias(c) for c in COUNTS]


def summary(packed: DataFrame, by: list[str], grid: Grid) -> DataFrame:
    """Totals and rates over images by `by`."""
    rows = packed.select(*by, *_counts(grid))
    long = lambda c, a: c.cast("bigint").alias(a)
    tn = F.lit(grid.slots) - F.col("tp") - F.col("fp") - F.col("fn")
    out = rows.groupBy(*by).agg(long(F.count("*"), "images"), *(long(F.sum(c), c) for c in COUNTS), long(F.sum(tn), "tn"), long(F.count_if(F.col("fp") > 0), "images_with_fp"))
    return out.select("*", *rates.finding_rates())


def by_condition(packed: DataFrame, by: list[str], condition: str, grid: Grid) -> DataFrame:
    """Counts, rates and the share of all false positives of each condition that is found or predicted anywhere."""
    sums = [F.sum(F.bit_count(_masks(i)[c])).cast("bigint").alias(f"{c}_{i}") for i in range(len(grid.conditions)) for c in COUNTS]
    whole = packed.groupBy(*by).agg(F.count("*").alias("__n"), *sums)
    each = F.array(*(F.struct(F.lit(name).alias(condition), *(F.col(f"{c}_{i}").alias(c) for c in COUNTS)) for i, name in enumerate(grid.conditions)))
    rows = whole.select(*by, "__n", F.explode(each).alias("x")).select(*by, "__n", "x.*").where("tp + fp + fn > 0")
    tn = (F.col("__n") * len(grid.locations) - F.col("tp") - F.col("fp") - F.col("fn")).cast("bigint")
    share = rates.ratio(100 * F.col("fp"), F.sum("fp").over(Window.partitionBy(*(by or [F.lit(0)]))))
    return rows.withColumn("tn", tn).drop("__n").select("*", *rates.condition_rates(), share.alias("fp_share"))


def image_rows(packed: DataFrame, image: list[str], grid: Grid) -> DataFrame:
    """A row for each image: its sets as text (`location|condition`, sorted), counts and the hallucination rate."""
    cells = sorted((f"{location}|{name}".encode(), i, k) for i, name in enumerate(grid.conditions) for k, location in enumerate(grid.locations))
    literal = F.array(*(F.struct(F.lit(name.decode()).alias("name"), F.lit(i).alias("i"), F.lit(1 << k if k < 63 else -(1 << 63)).cast("long").alias("bit")) for name, i, k in cells))

    def shown(of: str) -> Column:
        masks = F.array(*(_masks(i)[of] for i in range(len(grid.conditions))))
        there = F.filter(literal, lambda x: F.get(masks, x["i"]).bitwiseAND(x["bit"]) != 0)
        return F.array_join(F.transform(there, lambda x: x["name"]), "; ")

    sets = (("g", "gt_set"), ("p", "pred_set"), ("tp", "tp_set"), ("fp", "fp_set"), ("fn", "fn_set"))
    out = packed.select(*image, *(shown(of).alias(name) for of, name in sets), *_counts(grid))
    out = out.withColumn("tn", F.lit(grid.slots) - F.col("tp") - F.col("fp") - F.col("fn"))
    return out.withColumn("hallucination_rate", rates.ratio(F.col("fp"), F.col("tp") + F.col("fp")))


def location_breakdown(packed: DataFrame, by: list[str], grid: Grid) -> DataFrame:
    """Predicted findings by bucket (the first that holds): in the truth; with the condition elsewhere; at a location with another condition; neither."""
    anywhere = reduce(lambda a, b: a.bitwiseOR(b), (_masks(i)["g"] for i in range(len(grid.conditions))))
    none = F.lit(0).cast("long")
    parts: dict[str, list[Column]] = {b: [] for b in BUCKETS}
    for i in range(len(grid.conditions)):
        m = _masks(i)
        elsewhere = m["g"] != 0
        left = F.when(elsewhere, none).otherwise(m["fp"])
        for bucket, mask in (("correct", m["tp"]), ("wrong_location", F.when(elsewhere, m["fp"]).otherwise(none)), ("wrong_condition", left.bitwiseAND(anywhere)), ("unsupported", left.bitwiseAND(F.bitwise_not(anywhere)))):
            parts[bucket].append(F.bit_count(mask))
    sums = packed.groupBy(*by).agg(*(F.sum(reduce(add, parts[b])).cast("bigint").alias(b) for b in BUCKETS))
    rows = sums.select(*by, F.explode(F.array(*(F.struct(F.lit(b).alias("bucket"), F.col(b).alias("n")) for b in BUCKETS))).alias("x")).select(*by, "x.*").where("n > 0")
    return rows.withColumn("rate", rates.ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)])))))
