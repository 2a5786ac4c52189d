"""Zones that rules keep free around roads, houses and other sources: which rule holds depends on the source's class, and blocked land comes before uncertain land."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.operators.geometry import cells_inside, cells_near

#: Classes of zones from the strongest to the weakest.
CLASSES = ("BLOCKED", "UNCERTAIN")
#: Ranks of roads by the rule that holds for them, and the ranks whose class registers do not tell for certain.
ROAD_RULES = {"고속국도": "road_major", "일반국도": "road_major", "지방도": "road_major", "국가지원지방도": "road_major", "시도": "road_minor", "군도": "road_minor", "시·군도": "road_minor"}
UNCERTAIN_RANKS = ("시도", "군도", "시·군도")


def road_sources(roads: DataFrame, key: str, rank: str, points: str) -> DataFrame:
    """(source, kind, unsure, points) of roads; ranks without a rule are left out."""
    kind = F.try_element_at(F.create_map(*[F.lit(x) for p in ROAD_RULES.items() for x in p]), F.trim(F.col(rank)))
    return roads.select(F.col(key).cast("string").alias("source"), kind.alias("kind"), F.trim(F.col(rank)).isin(*UNCERTAIN_RANKS).alias("unsure"), F.col(points).alias("points")).where("kind IS NOT NULL")


def house_sources(houses: DataFrame, key: str, radius: float, least: int) -> DataFrame:
    """(source, kind, unsure, points) of houses (x, y): ``house_ge`` where ``least`` houses or more, itself included, stand within ``radius`` of one of them that this one is within reach of, else ``house_lt``.

    Houses are counted by place and by cells so small that all houses of a cell
    reach each other. A cell of ``least`` houses is settled at once; only houses
    of other cells, fewer than ``least`` in each, meet those around them, so the
    pairs grow with the houses, however dense they stand.
    """
    cell = lambda c: F.floor(F.col(c) / (radius * 0.7071)).cast("long")
    around = lambda c: F.explode(F.sequence(F.col(c) - 2, F.col(c) + 2))
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    places = houses.where(finite).groupBy("x", "y").agg(F.count(F.lit(1)).alias("c")).withColumn("i", cell("x")).withColumn("j", cell("y"))
    told = places.withColumn("full", F.sum("c").over(Window.partitionBy("i", "j")) >= least)
    wide = told.where("NOT full").select("x", "y", around("i").alias("i"), "j").withColumn("j", around("j"))
    others = told.select(F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("c").alias("oc"), F.col("full").alias("ofull"), "i", "j")
    near = wide.join(others.hint("merge"), ["i", "j"]).where(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) <= radius)
    known = near.groupBy("x", "y").agg(F.sum("oc").alias("n"), F.max("ofull").alias("beside")).withColumn("centre", F.col("n") >= least)
    linked = near.where("NOT ofull").join(known.where("centre").select(F.col("x").alias("ox"), F.col("y").alias("oy")).hint("merge"), ["ox", "oy"]).select("x", "y")
    dense = told.where("full").select("x", "y").unionByName(known.where("centre OR beside").select("x", "y")).unionByName(linked).distinct().withColumn("dense", F.lit(True))
    kinds = houses.select(F.col(key).alias("k"), "x", "y").join(dense.hint("merge"), ["x", "y"], "left")
    return kinds.select(F.col("k").cast("string").alias("source"), F.when(F.col("dense"), "house_ge").otherwise("house_lt").alias("kind"), F.lit(False).alias("unsure"), F.array(F.struct("x", "y")).alias("points"))


def zones(slices: DataFrame, key: str, ring: str, sources: DataFrame, rules: DataFrame, side: float) -> DataFrame:
    """(key, i, j, zone): the cells of each slice that its own rules keep free, in the strongest class that reaches them.

    ``rules`` (key, kind, metres, certain) are those of each slice; a source that
    is ``unsure`` blocks for certain only where the rule says so. A source
    reaches over the borders of slices. Each source is turned into cells once
    for each distance that some rule sets for its kind. Rules go to their slices
    before these are cut into cells, so a cell meets only what its rules name.
    """
    reaches = rules.where("metres > 0").select("kind", F.col("metres").cast("double").alias("metres")).distinct()
    lines = sources.join(reaches, "kind").select(F.struct("kind", "metres", "unsure").alias("of"), "metres", "points")
    touched = cells_near(lines, "of", "points", F.col("metres"), side, closed=False).select("of.kind", "of.metres", "of.unsure", "i", "j")
    own = rules.select(F.col(key), "kind", F.col("metres").cast("double").alias("metres"), "certain").distinct()
    ruled = slices.select(key, ring).join(own.hint("merge"), key).select(F.struct(F.col(key).alias("key"), "kind", "metres", "certain").alias("own"), ring)
    inner = cells_inside(ruled, "own", ring, side).select(F.col("own.key").alias(key), "own.kind", "own.metres", "own.certain", "i", "j")
    met = inner.join(touched.hint("merge"), ["i", "j", "kind", "metres"])
    rank = F.when(F.col("unsure") & ~F.coalesce("certain", F.lit(False)), 1).otherwise(0)
    return met.groupBy(key, "i", "j").agg(F.min(rank).alias("r")).select(key, "i", "j", F.get(F.array(*map(F.lit, CLASSES)), F.col("r")).alias("zone"))


def zone_areas(slices: DataFrame, key: str, ring: str, found: DataFrame, side: float) -> DataFrame:
    """(key, area, blocked, uncertain, open) in square metres of whole cells; the four add up."""
    whole = cells_inside(slices, key, ring, side).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    of: Column = lambda name: F.count_if(F.col("zone") == name)
    sums = found.groupBy(key).agg(of(CLASSES[0]).alias("b"), of(CLASSES[1]).alias("u"))
    square = lambda c: (c * side * side)
    b, u = F.coalesce("b", F.lit(0)), F.coalesce("u", F.lit(0))
    return whole.join(sums, key, "left").select(key, square(F.col("n")).alias("area"), square(b).alias("blocked"), square(u).alias("uncertain"), square(F.col("n") - b - u).alias("open"))
