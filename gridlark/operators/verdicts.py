"""Verdict rows of independent checks: score, grade, worst-case merge, ranking, applicability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Penalties of a status and of a difficulty, severity order, grade order.
STATUS_PENALTY = {"POSSIBLE": 0, "CONDITIONAL": 12, "IMPOSSIBLE": 100, "UNKNOWN": 6}
DIFFICULTY_PENALTY = {"LOW": 0, "MEDIUM": 4, "HIGH": 9, "CRITICAL": 18}
SEVERITY = {"POSSIBLE": 0, "CONDITIONAL": 1, "UNKNOWN": 2, "IMPOSSIBLE": 3}
GRADE_ORDER = {"POSSIBLE": 0, "CONDITIONAL": 1, "UNKNOWN": 2, "IMPOSSIBLE": 3}


def lookup(key: Column, values: dict[str, int]) -> Column:
    """The value of ``key`` in a small fixed table; null where it is not there."""
    out = F.lit(None).cast("int")
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def score_sums() -> list[Column]:
    """The sums over rows (status, difficulty) that ``score_of`` and ``grade_of`` are made from."""
    weight = lookup(F.col("status"), STATUS_PENALTY) + lookup(F.col("difficulty"), DIFFICULTY_PENALTY)
    is_open = F.col("status").isin("CONDITIONAL", "UNKNOWN")
    return [
        F.count_if(F.col("status") == "IMPOSSIBLE").alias("_impossible"),
        F.count_if(F.col("status") == "CONDITIONAL").alias("_conditional"),
        F.count_if(F.col("status") == "UNKNOWN").alias("_unknown"),
        F.coalesce(F.max(F.when(is_open, weight)), F.lit(0)).alias("_hardest"),
    ]


def score_of() -> Column:
    """The score (0 to 100) of ``score_sums``: the worst open item counts in full, every further conditional one 3, every unknown one 2; one impossible item makes it 0."""
    lost = F.col("_hardest") + 3 * F.greatest(F.lit(0), F.col("_conditional") - 1) + 2 * F.col("_unknown")
    return F.when(F.col("_impossible") > 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost))).cast("int")


def grade_of() -> Column:
    """The grade of ``score_sums``."""
    return (
        F.when(F.col("_impossible") > 0, "IMPOSSIBLE")
        .when(F.col("_conditional") + F.col("_unknown") == 0, "POSSIBLE")
        .when((F.col("_unknown") > 0) & (2 * F.col("_unknown") >= F.col("_conditional") + F.col("_unknown")), "UNKNOWN")
        .otherwise("CONDITIONAL")
    )


def verdict_score(items: DataFrame, key: str) -> DataFrame:
    """Score and grade of each ``key`` from its rows (status, difficulty). One shuffle, with sums and maxima combined before it."""
    return items.groupBy(key).agg(*score_sums()).select(key, score_of().alias("score"), grade_of().alias("grade"))


def merge_worst(items: DataFrame, key: str, point: str) -> DataFrame:
    """Per ``key``: the worst status over points, the first point that has it, and how many points have it."""
    rank = lookup(F.col("status"), SEVERITY)
    per_point = items.groupBy(key, point).agg(F.max(rank).alias("severity"))
    worst = per_point.groupBy(key).agg(
        F.max(F.struct("severity", (-F.col(point)).alias("back"))).alias("w"),
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == s).alias(f"n{s}") for s in SEVERITY.values()],
    )
    severity = F.col("w.severity")
    hits = F.lit(0).cast("long")
    name = F.lit(None).cast("string")
    for status, s in SEVERITY.items():
        name = F.when(severity == s, status).otherwise(name)
        hits = F.when((severity == s) & F.lit(s > 0), F.col(f"n{s}")).otherwise(hits)
    return worst.select(key, name.alias("status"), F.when(severity > 0, -F.col("w.back")).alias("worst_no"), hits.alias("hits"), "total")


def rank_sites(scored: DataFrame, key: str, per: Column, most: int = 5) -> DataFrame:
    """The best ``most`` of each group ``per``: by grade, then score, then key.

    Ranks inside bounded groups; a top-k report, so the limit is the feature.
    """
    order = Window.partitionBy("grp").orderBy(lookup(F.col("grade"), GRADE_ORDER), F.desc("score"), key)
    ranked = scored.withColumn("grp", per).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= most).select("grp", key, "grade", "score", "rank")


def impact_assessment(capacity_mw: Column, threshold: float = 100.0, band: float = 0.1) -> Column:
    """Which environmental assessment a capacity needs; near the threshold both are possible, null needs an answer first."""
    low, high = threshold * (1 - band), threshold * (1 + band)
    return (
        F.when(capacity_mw.isNull(), "ASK")
        .when(capacity_mw < low, "SMALL")
        .when(capacity_mw <= high, "BOTH")
        .otherwise("FULL")
    )


def completeness(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Share of filled ``fields`` (not null and not blank) of each row's group ``key``."""
    filled = sum((F.when(F.length(F.trim(F.col(f).cast("string"))) > 0, 1).otherwise(0) for f in fields), F.lit(0))
    return rows.groupBy(key).agg(F.round(F.sum(filled) / (F.count(F.lit(1)) * len(fields)), 6).alias("completeness"))
