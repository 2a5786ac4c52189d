"""Scans that fit a service's limits: tiles refined where they hold too much, and what is still to be fetched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def adaptive_tiles(points: DataFrame, site: str, side: float, limit: int, depth: int) -> DataFrame:
    """(site, level, i, j, n, truncated): the tiles in which each site's points (x, y) are fetched.

    A tile of ``side`` that holds over ``limit`` points is cut into four, and
    these again, ``depth`` times at most; a tile that is still too full then is
    ``truncated``. A point on a border belongs to the tile above and to the right.
    Points are counted once, in the smallest tiles; all larger ones are sums of
    these, so all sites and levels cost one pass over the points.
    """
    if limit < 1 or depth < 0:
        raise ValueError("limit must be positive and depth not negative")
    small = side / 2**depth
    lane = lambda c: F.floor(F.col(c) / small).cast("long")
    counts = {depth: points.where("x IS NOT NULL AND y IS NOT NULL").select(site, lane("x").alias("i"), lane("y").alias("j")).groupBy(site, "i", "j").agg(F.count(F.lit(1)).alias("n"))}
    for level in range(depth - 1, -1, -1):
        counts[level] = counts[level + 1].groupBy(site, F.shiftright("i", 1).alias("i"), F.shiftright("j", 1).alias("j")).agg(F.sum("n").alias("n"))
    found = []
    for level in range(depth + 1):
        tiles = counts[level]
        if level:
            full = counts[level - 1].where(F.col("n") > limit).select(F.col(site).alias("_site"), F.col("i").alias("_i"), F.col("j").alias("_j"))
            tiles = tiles.join(full, F.col(site).eqNullSafe(F.col("_site")) & (F.shiftright("i", 1) == F.col("_i")) & (F.shiftright("j", 1) == F.col("_j")), "left_semi")
        done = tiles if level == depth else tiles.where(F.col("n") <= limit)
        found.append(done.select(site, F.lit(level).alias("level"), "i", "j", "n", (F.col("n") > limit).alias("truncated")))
    return reduce(DataFrame.unionByName, found)


def gaps(held: DataFrame, keys: list[str], start: str, end: str, wanted: DataFrame) -> DataFrame:
    """(keys, start, end): the parts of each ``wanted`` span (keys, start, end) that no span of ``held`` covers; ends are exclusive.

    Held spans are merged by a running maximum of their ends, in order of their
    beginnings. Spans without length cover nothing and want nothing.
    """
    want = wanted.where(F.col(start) < F.col(end)).select(*keys, F.col(start).alias("_from"), F.col(end).alias("_to"))
    own = held.where(F.col(start) < F.col(end)).select(*keys, F.col(start).alias("_a"), F.col(end).alias("_b"))
    inside = own.join(want, keys).where((F.col("_b") > F.col("_from")) & (F.col("_a") < F.col("_to")))
    # the span's own ends stand for what is held before and after it
    edges = want.select(*keys, "_from", "_to", F.explode(F.array(F.struct(F.col("_from").alias("a"), F.col("_from").alias("b")), F.struct(F.col("_to").alias("a"), F.col("_to").alias("b")))).alias("s"))
    spans = inside.select(*keys, "_from", "_to", F.struct(F.greatest("_a", "_from").alias("a"), F.least("_b", "_to").alias("b")).alias("s")).unionByName(edges)
    order = Window.partitionBy(*keys, "_from", "_to").orderBy("s.a", "s.b")
    reached = F.max("s.b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    open_ = spans.withColumn("_reached", reached).where(F.col("_reached") < F.col("s.a"))
    return open_.select(*keys, F.col("_reached").alias(start), F.col("s.a").alias(end)).distinct()


def merged(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, start, end): spans of the same keys that overlap or touch, as one; ends are exclusive, and spans without length are left out."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = spans.where(F.col(start) < F.col(end)).select(*keys, start, end).withColumn("_new", F.coalesce((before < F.col(start)).cast("int"), F.lit(1)))
    runs = cut.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def levels(steps: DataFrame, case: str, name: str, needs: str) -> DataFrame:
    """``steps`` with ``level`` (the longest chain of needs below a step, 0 without any) and ``cyclic`` (a step in or above a circle has no level).

    Needs that name no step of the case are met from the start. Steps of a case
    are a catalogue of a few dozen, and meet in one row of arrays.
    """
    table = steps.groupBy(case).agg(F.collect_list(F.struct(F.col(name).alias("name"), F.coalesce(F.col(needs), F.array().cast("array<string>")).alias("needs"))).alias("_all"))
    names = F.transform("_all", lambda s: s["name"])

    def round_of(held):
        def of(step, i):
            known = F.filter(step["needs"], lambda d: F.array_contains(names, d))
            below = F.transform(known, lambda d: F.get(held, (F.array_position(names, d) - 1).cast("int")))
            ready = F.forall(below, lambda v: v.isNotNull())
            return F.coalesce(F.get(held, i), F.when(ready, F.coalesce(F.array_max(below) + 1, F.lit(0))))

        return F.transform("_all", of)

    start = F.transform("_all", lambda s: F.lit(None).cast("int"))
    found = F.aggregate("_all", start, lambda held, s: round_of(held))
    placed = table.select(case, names.alias("_names"), found.alias("_levels"))
    level = F.get("_levels", (F.array_position("_names", F.col(name)) - 1).cast("int"))
    return steps.join(placed, case).withColumn("level", level).withColumn("cyclic", F.col("level").isNull()).drop("_names", "_levels")
