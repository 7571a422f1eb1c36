"""Writers: checkpoints by run, summary and rater CSVs, JSON and audit text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpoint_results(results: DataFrame, path: str) -> None:
    """Replace just the (dataset, strategy, model) partitions that results hold."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "strategy", "model").parquet(path)


def rendered(table: DataFrame, decimals: dict[str, int] | None = None, undefined: str = "N/A") -> DataFrame:
    """All columns as text: numbers with so many decimals, `undefined` for their nulls, and an empty text for other nulls."""
    decimals = decimals or {}
    shown = lambda c: F.coalesce(F.format_string(f"%.{decimals[c]}f", F.col(c).cast("double")), F.lit(undefined)) if c in decimals else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return table.select(*((F.when(F.col(c).isNull(), undefined).otherwise(shown(c)) if c in decimals else shown(c)).alias(c) for c in table.columns))


def summary_csv(table: DataFrame, path: str, columns: list[str], decimals: dict[str, int] | None = None) -> None:
    """A small table as one CSV file of the given columns; those it lacks are empty. An empty table gives a file of the header alone."""
    full = table.select(*(F.col(c) if c in table.columns else F.lit(None).cast("string").alias(c) for c in columns))
    rendered(full, decimals, "").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def rater_sheet(cases: DataFrame, path: str, blanks: list[str]) -> None:
    cases.select("case_id", "stratum", *(F.lit("").alias(b) for b in blanks)).orderBy("case_id").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def inventory_json(table: DataFrame, path: str) -> None:
    table.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def audit_text(rows: DataFrame, path: str, line: str) -> None:
    rows.select(F.expr(line).alias("value")).write.mode("overwrite").text(path)


def provenance_json(runs: DataFrame, path: str, notes: dict[str, str]) -> None:
    """One JSON document: the notes and, as `runs`, every run's columns in the order of their names."""
    listed = runs.agg(F.array_sort(F.collect_list(F.struct(*runs.columns))).alias("runs"))
    listed.select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in notes.items()), "runs")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def score_csv(table: DataFrame, path: str, columns: list[str], three: tuple[str, ...] = ("kl_bits_mean",)) -> None:
    """Text scores with four decimals (three for some), N/A where undefined, as one CSV file of the given columns."""
    decimals = {c: 3 if c in three else 4 for c in columns if dict(table.dtypes).get(c) == "double"}
    rendered(table.select(*columns), decimals).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
