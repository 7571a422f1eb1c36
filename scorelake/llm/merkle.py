"""Merkle manifest of a dataset: persisted levels, built from below, and proofs pushed down from above.

A tree for each group of rows, whose leaves are the rows' digests in order, and one tree over the groups' roots. `build`
writes every level as a table: level k + 1 has a node for each run of WIDTH nodes of level k, with their digests.
`push` goes down from the root: the nodes of a level are joined to their parents, and each one
puts its siblings before the proof that it inherits, so a leaf ends with all its siblings from below upward.
No group is ever in one task: places come from counts by partition of a range-partitioned table, and a node has at most WIDTH children.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import checkpoint_dir, remove_folder

WIDTH = 3
#: A level of at most so many nodes is worked off without a shuffle.
SMALL_LEVEL = 10_000
STEPS = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal sha256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """How a value goes into a leaf: `-` for null, else its number of UTF-8 bytes, `:` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return digest(*map(field, values))


def group_key(value: Column) -> Column:
    """A string without nulls in the same order: null first, then by UTF-8 bytes."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.lit("="), text))


@dataclass
class Manifest:
    """Where the levels are. `rows` is the number of levels above the leaves of the deepest group, `tops` that of the tree over the groups."""

    spark: SparkSession
    folder: str
    rows: int
    tops: int
    sizes: dict[str, int]
    root: str | None

    def level(self, name: str) -> DataFrame:
        found = self.spark.read.parquet(f"{self.folder}/{name}")
        return found.coalesce(1) if self.sizes.get(name, SMALL_LEVEL + 1) <= SMALL_LEVEL else found

    def remove(self) -> None:
        remove_folder(self.spark, self.folder)


def _placed(spark: SparkSession, folder: str, rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (a table) with `place`, from 0 within grp, and `n`, the rows of grp. Written to folder/sorted on the way."""
    rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("at", F.monotonically_increasing_id()).write.parquet(f"{folder}/sorted")
    found = spark.read.parquet(f"{folder}/sorted").withColumn("part", F.shiftright("at", 33))
    counts = found.groupBy("part", "grp").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    # A row for each partition that has rows of the group.
    before = "sum(rows) over (partition by grp order by part rows between unbounded preceding and current row) - rows"
    starts = counts.select("part", "grp", F.expr(f"first - ({before})").alias("shift"), F.expr("sum(rows) over (partition by grp)").alias("n"))
    return found.join(starts, ["part", "grp"]).withColumn("place", F.col("at") - F.col("shift")).drop("part", "at", "shift")


def _sizes(level: DataFrame) -> list[int]:
    """The number of nodes of each level of the trees over `level`, itself first; a group of n has level k if n > WIDTH ** (k - 1)."""
    n, most = F.col("n"), 39
    groups = level.where("place = 0").select("n")
    sums = [F.sum(F.when(n > (WIDTH ** (k - 1) if k else 0), F.ceil(n / float(WIDTH**k)))).alias(f"k{k}") for k in range(most)]
    return [int(x) for x in groups.agg(*sums).first() if x is not None]


def _grow(manifest: Manifest, name: str) -> int:
    """Write the levels over `name`-0; gives how many."""
    sizes = _sizes(manifest.level(f"{name}-0"))
    for k, size in enumerate(sizes):
        manifest.sizes[f"{name}-{k}"] = size
    for k in range(1, len(sizes)):
        below = manifest.level(f"{name}-{k - 1}").where("n > 1").select("grp", "n", "place", "hash")
        runs = below.groupBy("grp", F.floor(F.col("place") / WIDTH).alias("place"), F.ceil(F.col("n") / WIDTH).alias("n"))
        kids = runs.agg(F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("kids")).withColumn("kids", F.col("kids.hash"))
        kids.withColumn("hash", F.sha2(F.array_join("kids", ""), 256)).write.parquet(f"{manifest.folder}/{name}-{k}")
    return max(0, len(sizes) - 1)


def build(rows: DataFrame, order: list[str], folder: str | None = None) -> Manifest:
    """rows: grp string (not null, see group_key), hash string (a leaf's digest), the columns `order`, and others, which the leaves carry.

    Rows that are equal in grp and order stand in the order of their digests, so repeated rows are leaves of their own; an empty table has no
    root. rows is used once. Without a folder, a new one below the checkpoint folder is taken.
    """
    spark = rows.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/manifest-{uuid.uuid4().hex}"
    rows.withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{folder}/leaves")
    manifest = Manifest(spark, folder, 0, 0, {}, None)
    _placed(spark, folder, spark.read.parquet(f"{folder}/leaves"), [*order, "hash", "row"]).drop("row").write.parquet(f"{folder}/rows-0")
    remove_folder(spark, f"{folder}/leaves")
    remove_folder(spark, f"{folder}/sorted")
    manifest.rows = _grow(manifest, "rows")
    done = [manifest.level(f"rows-{k}").where("n = 1").select(F.col("grp").alias("owner"), "hash") for k in range(manifest.rows + 1)]
    groups = done[0]
    for more in done[1:]:
        groups = groups.unionByName(more)
    groups.withColumn("grp", F.lit("")).write.parquet(f"{folder}/groups")
    _placed(spark, folder, spark.read.parquet(f"{folder}/groups"), ["owner"]).write.parquet(f"{folder}/tops-0")
    manifest.tops = _grow(manifest, "tops")
    top = manifest.level(f"tops-{manifest.tops}").where("n = 1").select("hash").first()
    manifest.root = top and top["hash"]
    return manifest


def _inherit(children: DataFrame, parents: DataFrame, extra: list[str]) -> DataFrame:
    """children with `steps` and the columns `extra` of their parents: what stands left and right of a child, before what its parent has."""
    above = parents.select("grp", F.col("place").alias("parent"), "kids", F.col("steps").alias("above"), *extra)
    joined = children.withColumn("parent", F.floor(F.col("place") / WIDTH)).join(above, ["grp", "parent"])
    at = (F.col("place") % WIDTH).cast("int")
    beside = F.struct(
        F.array_join(F.slice("kids", F.lit(1), at), "").alias("left"),
        F.array_join(F.slice("kids", at + 2, F.lit(WIDTH)), "").alias("right"),
    )
    return joined.withColumn("steps", F.concat(F.array(beside), F.col("above"))).drop("parent", "kids_above", "above")


def push(manifest: Manifest) -> DataFrame:
    """The leaves with all columns that they carry, hash, subroot and steps, from below upward; each level's proofs are a table in the manifest's folder."""
    spark, folder = manifest.spark, manifest.folder
    none = F.array().cast(STEPS)
    for k in range(manifest.tops, -1, -1):
        nodes = manifest.level(f"tops-{k}")
        ends = nodes.where("n = 1").withColumn("steps", none)
        if k < manifest.tops:
            parents = spark.read.parquet(f"{folder}/top-proofs-{k + 1}")
            below = nodes.where("n > 1")
            ends = _inherit(below.withColumnRenamed("kids", "own") if k else below, parents, [])
            ends = ends.drop("kids").withColumnRenamed("own", "kids") if k else ends.drop("kids")
        ends.write.parquet(f"{folder}/top-proofs-{k}")
    of_group = spark.read.parquet(f"{folder}/top-proofs-0").select(F.col("owner").alias("grp"), "steps", F.col("hash").alias("subroot"))
    out = None
    for k in range(manifest.rows, -1, -1):
        nodes = manifest.level(f"rows-{k}")
        found = nodes.where("n = 1").join(of_group, "grp")
        if k < manifest.rows:
            parents = spark.read.parquet(f"{folder}/row-proofs-{k + 1}")
            below = nodes.where("n > 1")
            more = _inherit(below.withColumnRenamed("kids", "own") if k else below, parents, ["subroot"]).drop("kids")
            found = found.unionByName(more.withColumnRenamed("own", "kids") if k else more)
        if k:
            found.write.parquet(f"{folder}/row-proofs-{k}")
        out = found
    return out


def proof_digest(steps: Column) -> Column:
    """H of all siblings, from below upward and from left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(start: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(steps, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def verified(rows: DataFrame, fields: list[str], group: str, order: str, now: Column | None = None) -> DataFrame:
    """Build a manifest of rows and hold what they are now against it.

    `fields` go into a leaf, in this order; `group` names the trees and `order` (a number) says how leaves follow. `now` is the leaf
    that a row has now, null where it is the same. Returns for each row `order`, leaf, subroot, root, proof_sha256, folded_root and verified. Nulls
    are values of their own (`-` in a leaf, first in the order); repeated rows are leaves beside each other; columns beside
    those named are ignored; an empty table gives an empty one.
    """
    spark = rows.sparkSession
    names = {name: F.col(name) for name in fields}
    made = rows.select(
        group_key(F.col(group)).alias("grp"), F.col(order).cast("long").alias("key"), leaf(list(names.values())).alias("hash"), (F.lit(None).cast("string") if now is None else now).alias("now")
    )
    manifest = build(made, ["key"])
    found = push(manifest).select(
        F.col("key").alias(order), F.col("hash").alias("leaf"), "subroot", F.lit(manifest.root).cast("string").alias("root"), proof_digest(F.col("steps")).alias("proof_sha256"),
        fold(F.coalesce("now", "hash"), F.col("steps")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/verified-{uuid.uuid4().hex}"
    found.write.parquet(folder)
    manifest.remove()
    return spark.read.schema(found.schema).parquet(folder)


def without_line_feeds(docs: DataFrame, fields: list[str], of: Column) -> Column:
    """The leaf of a row whose text has lost its line feeds, where `of` holds and the text has any; else null."""
    changed = [F.translate("text", "\n", "") if name == "text" else F.col(name) for name in fields]
    return F.when(of & F.col("text").contains("\n"), leaf(changed))
