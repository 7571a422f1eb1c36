"""Orders, first matches, held-out picks, merges and run selection."""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.session import scratch_folder


def numeric_order(key: str) -> list[Column]:
    """Numbers first and by value, then the rest by text."""
    number = F.col(key).rlike(r"^\d+$")
    return [~number, F.when(number, F.col(key).try_cast("bigint")), F.col(key)]


def tail_order(key: str) -> list[Column]:
    """By what stands before the last underscore, then by the number behind it: a_2 before a_10."""
    tail = F.element_at(F.split(key, "_"), -1)
    number = tail.rlike(r"^\d+$")
    return [F.regexp_replace(key, "_[^_]*$", ""), ~number, F.when(number, tail.try_cast("bigint")), F.col(key)]


def ranked(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)))


def first_match(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    return ranked(rows, by, order, "__r").where("__r = 1").drop("__r")


def held_out(cases: DataFrame, roles: dict[str, Column], case: str) -> DataFrame:
    """The first case of each role, in the roles' order; a case keeps its first role only. Aggregates, so no task sorts all cases."""
    first = cases.agg(*(F.min(F.when(test, F.col(case))).alias(role) for role, test in roles.items()))
    rows = first.select(F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(r).alias("role"), F.col(r).alias(case)) for i, r in enumerate(roles)))).alias("x")).select("x.*")
    return rows.where(F.col(case).isNotNull()).groupBy(case).agg(F.min_by("role", "ord").alias("role"))


def right_wins(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The union where a key's row of the right side replaces that of the left."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti").select(left.columns).unionByName(right.select(left.columns))


def latest_complete(runs: DataFrame, by: list[str], name: str, complete: Column) -> DataFrame:
    """The greatest name among each group's complete runs."""
    return runs.where(complete).groupBy(*by).agg(F.max(name).alias(name))


def full_matrix(runs: DataFrame, strategy: str, model: str, complete: Column, strategies: list[str], models: int) -> DataFrame:
    """One row: whether every strategy is there, each with so many models, all complete."""
    per = runs.groupBy(strategy).agg(F.count_distinct(model).alias("models"), F.bool_and(complete).alias("done"))
    return per.where(F.col(strategy).isin(*strategies)).agg(
        F.count("*").cast("bigint").alias("strategies"), F.coalesce((F.count("*") == len(strategies)) & F.bool_and((F.col("models") >= models) & F.col("done")), F.lit(False)).alias("ready")
    )


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run has still to do."""
    return work.join(done.select(*keys), keys, "left_anti")


def ordered_models(models: DataFrame, model: str, known: list[str]) -> DataFrame:
    """Known models in their order, others after them by name."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, known)), F.col(model)).try_cast("int"), F.lit(0))
    return models.withColumn("ord", F.when(place > 0, place).otherwise(999))


def audit_sample(rows: DataFrame, by: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows a group in the order of a digest of seed and key."""
    return ranked(rows, by, [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]).where(F.col("rank") <= n)


def plain_order(key: str) -> list[Column]:
    """By the text alone: a_10 before a_2."""
    return [F.col(key)]


def first_cases(cases: DataFrame, order: list[Column | str], n: int | None) -> DataFrame:
    """The first n cases, or all of them where n is None or 0."""
    return cases.orderBy(*order).limit(n) if n else cases


def first_of_models(rows: DataFrame, model: str, order: list[str], by: list[str], within: list[Column | str]) -> DataFrame:
    """The first row of each group among those of the first model, in the given order, that has any row in it."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(model))
    return first_match(rows.where(place > 0), by, [place, *within])


def same_strategy(done: DataFrame, strategy: str, wanted: str) -> DataFrame:
    """done, unless a row was made with another strategy: then evaluating it is an error."""
    other = F.raise_error(F.concat(F.lit(f"this run uses {wanted}, but a finished one "), F.coalesce(F.col(strategy), F.lit("none")))).cast("boolean")
    return done.where(F.when(F.coalesce(F.col(strategy) == wanted, F.lit(False)), F.lit(True)).otherwise(other))


def hard_cases(images: DataFrame, tests: dict[str, Column], order: list[Column | str]) -> DataFrame:
    """The first image of each test, by the given order, with `role`; an image of several tests keeps the last one's name."""
    at = F.struct(*order)
    first = images.agg(*(F.min(F.when(test, at)).alias(role) for role, test in tests.items()))
    picks = first.select(F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(r).alias("role"), F.col(r).alias("__at")) for i, r in enumerate(tests)))).alias("x")).select("x.*")
    picks = picks.where(F.col("__at").isNotNull()).groupBy("__at").agg(F.max_by("role", "ord").alias("role"))
    return images.withColumn("__at", at).join(picks, "__at").drop("__at")


def audit_cases(images: DataFrame, hard: DataFrame, key: str, n: int = 10, seed: int = 42) -> DataFrame:
    """key and role: the hard cases, then others in the order of a digest of seed and key, n in all."""
    others = images.select(key).distinct().join(hard.select(key), key, "left_anti").withColumn("role", F.lit(None).cast("string"))
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    both = hard.select(key, "role", F.lit(0).alias("__o")).unionByName(others.withColumn("__o", F.lit(1)))
    return both.orderBy("__o", drawn, key).limit(n).select(key, "role")


def places(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with `place`, from 0 in the order of their group, and `size`, the group's rows.

    Rows are sorted by range partitions and numbered within each; the counts of the partitions' groups give the rest, so a group of any size lies in
    many tasks. Sorted rows are a table, so numbers and counts are of the same partitions. Nulls come first; equal rows stand side by side.
    """
    folder = scratch_folder(rows.sparkSession, "places")
    sort = [*by, *order]
    rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id()).write.parquet(folder)
    found = rows.sparkSession.read.parquet(folder).withColumn("__part", F.shiftright("__at", 33))
    counts = found.groupBy("__part", *by).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    group = Window.partitionBy(*(by or [F.lit(0)]))  # a row for each partition that has rows of the group
    before = F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    starts = counts.select(F.col("__part").alias("__p"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(by)), (F.col("__first") - before).alias("__shift"), F.sum("__n").over(group).alias("size"))
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__{i}"))
    return found.join(starts, same).select(*rows.columns, (F.col("__at") - F.col("__shift")).alias("place"), "size")


def quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """by and a column for each wanted quantile, by linear interpolation; nulls and NaN don't count, a group without values has no row.

    Values are placed (places), and each quantile is made of the one or two that stand where it falls, so no task holds a group's values.
    """
    placed = places(rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, value), by, [value])
    at = {name: (F.col("size") - 1) * F.lit(float(q)) for name, q in wanted.items()}
    low = lambda name: F.floor(at[name])
    near = lambda name: (F.col("place") == low(name)) | (F.col("place") == F.ceil(at[name]))
    hit = reduce(lambda a, b: a | b, map(near, wanted))

    def made(name: str) -> Column:
        weight = F.when(F.col("place") == low(name), 1 - (at[name] - low(name))).otherwise(at[name] - low(name))
        return F.sum(F.when(near(name), F.col(value) * weight)).alias(name)

    return placed.where(hit).groupBy(*by).agg(*map(made, wanted))


def whiskers(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """A box plot's whiskers, the furthest values within one and a half times the quartiles' distance of the box, and the number of values beyond."""
    box = quantiles(rows, by, value, {"__q1": 0.25, "__q3": 0.75})
    reach = 1.5 * (F.col("__q3") - F.col("__q1"))
    low, high, v = F.col("__q1") - reach, F.col("__q3") + reach, F.col(value)
    return rows.join(F.broadcast(box) if not by else box, by or F.lit(True)).groupBy(*by).agg(
        F.count_if((v < low) | (v > high)).alias("outliers"), F.min(F.when(v >= low, v)).alias("whisker_low"), F.max(F.when(v <= high, v)).alias("whisker_high")
    )


def shuffled(n: int, most: int, seed: int) -> list[int]:
    """The first `most` of random.Random(seed).shuffle(list(range(n))): where each of them comes from follows from the swaps, read backwards. Holds eight bytes a place."""
    rnd = random.Random(seed)
    with_ = np.fromiter((rnd.randrange(i + 1) for i in range(n - 1, 0, -1)), np.int64, max(0, n - 1))
    at = list(range(min(most, n)))
    for i, j in zip(range(1, n), with_[::-1].tolist(), strict=True):
        if i < len(at) or j < len(at) or i in at or j in at:
            at = [j if k == i else i if k == j else k for k in at]
    return at


def audit_as_shuffled(images: DataFrame, hard: DataFrame, key: str, order: list[str], n: int = 10, seed: int = 42) -> DataFrame:
    """key, role and ord: the hard cases in their order, then others as Python's seeded shuffle deals them from the list in the given order, n in all.

    hard: key, role and ord; it has a few rows, which come to the driver, as do the places of the others that are drawn.
    """
    listed = places(images.select(key, *order).distinct(), [], [*order, key])
    first = listed.join(hard.select(key, "role", F.col("ord").alias("__o")), key).select(key, "role", "__o", "place").orderBy("__o").limit(n).collect()
    taken, size = sorted(r["place"] for r in first), listed.count()
    drawn = shuffled(size - len(taken), n - len(first), seed)
    picks = [(r["place"], r["role"], i) for i, r in enumerate(first)]
    for i, rank in enumerate(drawn):
        for place in taken:  # ascending: each hard case before it moves it on
            rank += place <= rank
        picks.append((rank, None, len(first) + i))
    table = images.sparkSession.createDataFrame(picks, "place long, role string, ord int")
    return listed.join(F.broadcast(table), "place").select(key, "role", "ord")
