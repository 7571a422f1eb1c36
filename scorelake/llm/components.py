"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation and a join keyed by node; nodes of very many links are dealt over several tasks.
Nothing is collected: the driver sees two numbers a round, which say whether the links are stars already. At most FEW links,
a few hundred kilobytes, are joined by one task instead, which saves the rounds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import cut, join_hot


FEW = 20_000


def _joined(links: pd.DataFrame) -> pd.DataFrame:
    """Few links as stars."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    for u, v in zip(links["u"].tolist(), links["v"].tolist(), strict=True):
        a, b = find(u), find(v)
        top[max(a, b)] = min(a, b)
    stars = [(x, find(x)) for x in list(top)]
    return pd.DataFrame([(u, v) for u, v in stars if u != v], columns=["u", "v"], dtype="int64")


def _large_star(links: DataFrame, n: int) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")).select("u", F.least("u", "low").alias("low"), "n")
    return join_hot(both, least, "u", 2 * n, "v").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame, n: int) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))
    moved = join_hot(links, least, "u", n, "v").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("low").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple[int, int]:
    """The number of links, and of nodes that keep them from being stars: with two links up, or links up and down."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    n, odd = nodes.agg(F.sum("up"), F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first()
    return n or 0, odd


def connected_components(links: DataFrame) -> DataFrame:
    """links: columns u and v (long). Returns node, component (the smallest node reachable).

    Only nodes with a link to another node appear; loops, repeats and nulls are ignored.
    An empty table gives an empty one.
    """
    links = (
        links.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    links = cut(links, large=False)
    n = links.count()
    if n <= FEW:
        links = cut(links.groupBy().applyInPandas(_joined, "u long, v long"), large=False) if n else links
    else:
        n, odd = _state(links)
        while odd:
            links = cut(_small_star(_large_star(links, n), n), large=False)
            n, odd = _state(links)
    heads = links.select("v").distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads.select("v", "v"))


def joined_by_id(rows: DataFrame, components: DataFrame) -> DataFrame | None:
    """Components that share an id count as one: rows has id and class, components class and component, all long but class.

    Returns node and component of the components concerned; None if every id has one class only.
    """
    several = rows.groupBy("id").agg(F.min(F.xxhash64("class")).alias("low"), F.max(F.xxhash64("class")).alias("high")).where("low <> high").select("id")
    if several.isEmpty():
        return None
    shared = cut(rows.join(several, "id", "left_semi").distinct().join(components, "class").select("id", F.col("component").alias("u")), large=False)
    return connected_components(shared.join(shared.groupBy("id").agg(F.min("u").alias("v")), "id").select("u", "v"))
