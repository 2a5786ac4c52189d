"""Smallest enclosing circles of groups of points, and the free centre of a site."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.operators.components import checkpointed, join_by_key

#: A point this share of the radius outside counts as on the circle.
TOLERANCE = 1e-10


def _circle(points: list[Column]) -> Column:
    """The circle (x, y, r2) through one point, across two or through three; null for three on a line."""
    if len(points) == 1:
        return F.struct(points[0]["x"].alias("x"), points[0]["y"].alias("y"), F.lit(0.0).alias("r2"))
    a, b = points[0], points[1]
    if len(points) == 2:
        return F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"), ((F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2)) / 4).alias("r2"))
    bx, by, cx, cy = b["x"] - a["x"], b["y"] - a["y"], points[2]["x"] - a["x"], points[2]["y"] - a["y"]
    d = 2 * (bx * cy - by * cx)
    ux = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / F.nullif(d, F.lit(0.0))
    uy = (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / F.nullif(d, F.lit(0.0))
    return F.when(d != 0, F.struct((a["x"] + ux).alias("x"), (a["y"] + uy).alias("y"), (ux * ux + uy * uy).alias("r2")))


def _smallest(points: Column, n: int) -> Column:
    """(r2, x, y, on) of the smallest circle around up to ``n`` points, ``on`` being those that fix it."""
    at = [F.get(points, F.lit(i)) for i in range(n)]
    found = []
    for k in (1, 2, 3):
        for chosen in combinations(range(n), k):
            circle = _circle([at[i] for i in chosen])
            known = F.size(points) > chosen[-1]
            on = F.array(*[at[i] for i in chosen])
            found.append(F.when(known & circle.isNotNull(), F.struct(circle["r2"].alias("r2"), circle["x"].alias("x"), circle["y"].alias("y"), on.alias("on"))))
    holds = lambda c: F.forall(points, lambda p: F.pow(p["x"] - c["x"], 2) + F.pow(p["y"] - c["y"], 2) <= c["r2"] * (1 + 4 * TOLERANCE) + 1e-18)
    return F.array_min(F.filter(F.array_compact(F.array(*found)), holds))


def enclosing(points: DataFrame, group: str, x: str, y: str, max_rounds: int = 60) -> DataFrame:
    """(group, x, y, radius, points) of the smallest circle around each group's points.

    A circle is fixed by two or three points. Every round finds each group's
    farthest point from its circle, by one aggregation; where that lies outside,
    the circle becomes the smallest around the points that fixed it and the new
    one. The radius grows each time, so few rounds suffice, and no group is ever
    gathered. Points with a null coordinate or group take no part.
    """
    at = points.select(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("g IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    at = checkpointed(at)
    state = checkpointed(at.groupBy("g").agg(F.min(F.struct("x", "y")).alias("p"), F.count(F.lit(1)).alias("n")).select("g", "n", F.struct(F.lit(0.0).alias("r2"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.array("p").alias("on")).alias("c"), F.lit(True).alias("open")))
    total = at.count()
    grown = F.get(F.transform(F.array(F.concat("c.on", F.array(F.struct("f.x", "f.y")))), lambda on: _smallest(on, 4)), F.lit(0))
    for _ in range(max_rounds):
        asked = state.where("open").select("g", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))
        far = F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)
        farthest = join_by_key(at, asked, "g", total).groupBy("g").agg(F.max(F.struct(far.alias("d2"), "x", "y")).alias("f"))
        met = state.join(farthest, "g", "left")
        outside = F.coalesce(F.col("f.d2") > F.col("c.r2") * (1 + 2 * TOLERANCE), F.lit(False))
        new = F.when(outside, grown).otherwise(F.col("c"))
        moved = met.select("g", "n", "c", outside.alias("outside"), new.alias("new"))
        state = checkpointed(moved.select("g", "n", F.coalesce("new", "c").alias("c"), (F.col("outside") & F.coalesce(F.col("new.r2") > F.col("c.r2"), F.lit(False))).alias("open")))
        if not state.where("open").limit(1).count():
            break
    return state.select(F.col("g").alias(group), F.col("c.x").alias("x"), F.col("c.y").alias("y"), F.sqrt("c.r2").alias("radius"), F.col("n").alias("points"))


def free_centres(points: DataFrame, group: str, x: str, y: str, reach: float, rotor: float) -> DataFrame:
    """Each group's circle with the ``margin`` that is left of ``reach`` beyond its farthest rotor tip, and whether one centre is enough (``fits``)."""
    margin = reach - (F.col("radius") + rotor)
    return enclosing(points, group, x, y).withColumn("margin", margin).withColumn("fits", F.col("margin") >= 0)
