"""How results replace what is stored: reload of new files only, upsert that marks what vanished, compaction, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_loaded(incoming: DataFrame, stored: DataFrame, checksum: str) -> DataFrame:
    """Rows whose checksum is not stored yet; of equal ones among the new each stays."""
    return incoming.join(stored.select(checksum).distinct(), checksum, "left_anti")


def upsert_keep_stale(stored: DataFrame, fresh: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, state): fresh values replace stored ones; rows that the fresh set lacks stay, marked STALE."""
    old = stored.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_was"))
    new = fresh.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_is"))
    both = old.join(new, keys, "full_outer")
    state = (
        F.when(F.col("_is").isNull(), "STALE")
        .when(F.col("_was").isNull(), "NEW")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "SAME")
        .otherwise("CHANGED")
    )
    return both.select(*keys, F.when(F.col("_is"), F.col("_new")).otherwise(F.col("_old")).alias(value), state.alias("state"))


def keep_unless_empty(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """``fresh``, or what is stored if this run brought nothing."""
    return stored if fresh.isEmpty() else fresh


def lowest_per_report(scored: DataFrame, report: str, score: str, order: Column) -> DataFrame:
    """One history row for each report: its lowest score and the point that has it."""
    return scored.groupBy(report).agg(F.min(F.struct(F.col(score).alias("score"), order.alias("point"))).alias("low")).select(report, "low.score", "low.point")


def write_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replace just the partitions that ``rows`` holds; a rerun gives the same files' content."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
