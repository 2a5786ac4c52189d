"""Screening of parcels over metric cells, and small rankings around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The share of a parcel inside the area under review from which it counts as whole, and what impact scores are high and middling.
WHOLE, HIGH, MIDDLING = 0.995, 20, 10
#: Penalties of a status and of a difficulty.
STATUS_PENALTY = {"POSSIBLE": 0, "CONDITIONAL": 12, "IMPOSSIBLE": 100, "UNKNOWN": 6}
DIFFICULTY_PENALTY = {"LOW": 0, "MEDIUM": 4, "HIGH": 9, "CRITICAL": 18}
#: What a hit of the first search gains at the reranker, and from which score.
GAIN, GAINED_FROM = 0.15, 0.050
#: Land categories that are farmland.
FARMLAND = ("전", "답", "과수원")


def parcel_grades(parcels: DataFrame, cells: DataFrame, area: DataFrame, layers: DataFrame, unverified: DataFrame, failed: bool = False) -> DataFrame:
    """(id, grade, reasons, inside) of the parcels that the area under review touches; others are not judged.

    ``parcels`` is (id, unfit), ``cells`` (id, x, y), ``area`` and ``unverified``
    (x, y), ``layers`` (title, blocks, x, y). A reason why a parcel is no
    candidate counts first, then the worst layer that touches it, with all
    layers of that rank as reasons; a parcel free of layers is UNKNOWN where
    rules were not read or a layer ``failed``, else POSSIBLE. Cells meet by
    equality joins; a parcel's reasons are at most as many as there are layers.
    """
    flags = area.select("x", "y", F.lit(True).alias("in_area")).distinct()
    blind = unverified.select("x", "y", F.lit(True).alias("unread")).distinct()
    marked = cells.distinct().join(flags, ["x", "y"], "left").join(blind, ["x", "y"], "left")
    whole = marked.groupBy("id").agg((F.count("in_area") / F.count(F.lit(1))).alias("inside"), F.max(F.coalesce("unread", F.lit(False))).alias("unread")).where("inside > 0")
    hits = cells.join(layers, ["x", "y"]).groupBy("id").agg(F.collect_set(F.when(F.col("blocks"), F.col("title"))).alias("hard"), F.collect_set(F.when(~F.col("blocks"), F.col("title"))).alias("soft"))
    judged = whole.join(parcels, "id").join(hits, "id", "left")
    some = lambda c: F.size(F.coalesce(c, F.array())) > 0
    cases = [
        (F.col("unfit").isNotNull(), "NA", F.array("unfit")),
        (some(F.col("hard")), "IMPOSSIBLE", F.col("hard")),
        (some(F.col("soft")), "CONDITIONAL", F.col("soft")),
        (F.col("unread"), "UNKNOWN", F.array(F.lit("rules not read"))),
        (F.lit(failed), "UNKNOWN", F.array(F.lit("layer failed"))),
    ]
    pick = lambda at: F.coalesce(*[F.when(c[0], F.lit(c[at]) if at == 1 else c[at]) for c in cases])
    edge = F.when(F.col("inside") < WHOLE, F.array(F.lit("crosses the edge"))).otherwise(F.array().cast("array<string>"))
    reasons = F.concat(F.array_sort(F.coalesce(pick(2), F.array().cast("array<string>"))), edge)
    return judged.select("id", F.coalesce(pick(1), F.lit("POSSIBLE")).alias("grade"), F.array_join(reasons, ",").alias("reasons"), F.round("inside", 3).alias("inside"))


def impact(status: Column, difficulty: Column) -> Column:
    """HIGH, MIDDLE or LOW by status and difficulty together; unknown names weigh nothing."""
    weight = lambda table, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), c), F.lit(0))
    score = weight(STATUS_PENALTY, status) + weight(DIFFICULTY_PENALTY, difficulty)
    return F.when((status == "IMPOSSIBLE") | (score >= HIGH), "HIGH").when(score >= MIDDLING, "MIDDLE").otherwise("LOW")


def reranked(hits: DataFrame, question: str, place: str, score: Column, first_score: str, k: int = 5) -> DataFrame:
    """The ``k`` hits of each question that a second scorer puts first; hits of a good first score gain a little, ties keep their place."""
    gained = score + F.when(F.coalesce(F.col(first_score), F.lit(0.0)) >= GAINED_FROM, GAIN).otherwise(0.0)
    order = Window.partitionBy(question).orderBy(F.desc("rerank_score"), place)
    return hits.withColumn("rerank_score", F.round(gained, 6)).withColumn("rerank", F.row_number().over(order)).where(F.col("rerank") <= k)


def not_sampled(rows: DataFrame, sample: DataFrame, key: str, by: str, area: str) -> DataFrame:
    """(by, n, area) of the rows that a sample left out, so that its figures say what they do not cover."""
    return rows.join(sample.select(key).distinct(), key, "left_anti").groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(area), 2).alias(area))


def farmland_share(parcels: DataFrame, site: str, category: str, area: str) -> DataFrame:
    """(site, parcels, farmland parcels, farmland area, share of the area); a site without an area has no share."""
    farm = F.col(category).isin(*FARMLAND)
    sums = parcels.groupBy(site).agg(F.count(F.lit(1)).alias("n"), F.count_if(farm).alias("n_farm"), F.coalesce(F.sum(F.when(farm, F.col(area))), F.lit(0.0)).alias("farm_m2"), F.sum(area).alias("m2"))
    return sums.select(site, "n", "n_farm", F.round("farm_m2", 2).alias("farm_m2"), F.round(F.col("farm_m2") / F.nullif("m2", F.lit(0.0)), 4).alias("share"))


def latest_first(rows: DataFrame, region: str, day: str, order: str, k: int) -> DataFrame:
    """The ``k`` latest rows of each region with their place, a top-k list; rows without a day come last."""
    w = Window.partitionBy(region).orderBy(F.desc_nulls_last(day), order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def known_projects(text: Column, stage: Column, projects: dict[str, list[str]]) -> Column:
    """The sorted names of the projects whose keywords stand in a question, narrowed to its stage where that leaves any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    named = F.array_sort(F.array_distinct(F.concat(*[F.when(low.contains(word.lower()), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for word, names in projects.items()])))
    narrow = F.filter(named, lambda n: n.contains(F.coalesce(stage, F.lit("\u0001"))))
    return F.when(F.size(narrow) > 0, narrow).otherwise(named)
