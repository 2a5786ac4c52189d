"""Time series of measurements: statistics, direction bins, carried values, guarded replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sixteen directions, from north, clockwise.
DIRECTIONS = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()
#: How much coverage new data may lose, and below which speed an hour is calm.
COVERAGE_SLACK, CALM = 0.05, 3.0


def direction16(degrees: Column) -> Column:
    """The name of the nearest of sixteen directions."""
    place = (F.floor(F.pmod(degrees, F.lit(360.0)) / 22.5 + 0.5) % 16).cast("int")
    return F.get(F.array(*map(F.lit, DIRECTIONS)), place)


def speed_statistics(rows: DataFrame, key: str, speed: str) -> DataFrame:
    """Per ``key``: how many values, their mean and maximum, and the share below calm."""
    v = F.col(speed)
    return rows.where(v.isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(v), 6).alias("mean"),
        F.max(v).alias("max"),
        F.round(F.avg(F.when(v < CALM, 1.0).otherwise(0.0)), 6).alias("calm_share"),
    )


def shear_exponent(low: Column, high: Column, low_m: float, high_m: float) -> Column:
    """The exponent of the power law through two heights; null without two positive speeds."""
    return F.when((low > 0) & (high > 0), F.log(high / low) / F.log(F.lit(high_m / low_m)))


def ditto_fill(rows: DataFrame, group: str, order: list[str], value: Column) -> DataFrame:
    """Adds ``filled``: the last non-null ``value`` so far within a group."""
    so_far = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("filled", F.last(value, ignorenulls=True).over(so_far))


def islands(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal ``value`` in a row: (group, run, value, n)."""
    w = Window.partitionBy(group).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    runs = rows.withColumn("changed", changed).withColumn("run", F.sum("changed").over(w))
    return runs.groupBy(group, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"))


def guarded_replace(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Per key the coverage to keep: the new one, unless it lost more than COVERAGE_SLACK."""
    both = old.withColumnRenamed("coverage", "was").join(new, key, "full_outer")
    refused = F.col("was").isNotNull() & (F.col("coverage").isNull() | (F.col("coverage") < F.col("was") - COVERAGE_SLACK))
    return both.select(key, F.when(refused, F.col("was")).otherwise(F.col("coverage")).alias("coverage"), refused.alias("refused"))
