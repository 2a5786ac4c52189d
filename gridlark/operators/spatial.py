"""Points, distances and area algebra over square metric cells."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.operators.components import checkpointed, connected

#: The radius of the earth in metres, and metres in a degree of latitude.
EARTH_M = 6_371_008.8
DEGREE_M = EARTH_M * math.pi / 180


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between two points given in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def _columns(band: Column, high: float, metres: float) -> Column:
    """How many cells a latitude band is cut into: each at least as wide as the widest longitude step of ``metres`` from inside the band."""
    edge = F.least(F.lit(90.0), F.greatest(F.abs(band * high - 90), F.abs((band + 1) * high - 90)))
    reach = F.lit(math.sin(min(metres / EARTH_M, math.pi / 2))) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))
    return F.when((reach >= 1) | F.lit(metres >= EARTH_M * math.pi / 2), F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360 / (F.degrees(F.asin(F.least(reach, F.lit(1.0)))) * 1.001)))).cast("long")


#: Rows of one place that stay together.
TOGETHER = 1_024


def _places(points: DataFrame, by: list[str]) -> DataFrame:
    """Points (id, lat, lng) by place: (by, lat, lng, ids), a crowded place as several rows."""
    place = [*by, "lat", "lng"]
    nth = F.row_number().over(Window.partitionBy(*place).orderBy("id"))
    return points.where("lat IS NOT NULL AND lng IS NOT NULL").select("id", *place).withColumn("part", F.floor((nth - 1) / TOGETHER)).groupBy(*place, "part").agg(F.collect_list(F.struct("id")).alias("ids")).drop("part")


def pairs_within(left: DataFrame, right: DataFrame, metres: float, by: list[str] | None = None) -> DataFrame:
    """(l_id, r_id, metres) of the points (id, lat, lng) at most ``metres`` apart, anywhere on the globe; with ``by`` only of those that agree in these columns, which come first.

    Latitude bands are as high as the distance. Each is cut into cells as wide
    as the distance is there, in a ring that closes across the antimeridian; a
    band that touches a pole is one cell. The right side is laid into its own
    and the two neighbouring bands, and in each into the cells around it, so an
    equality join on cells finds every pair. Rows of one place are joined as one
    and set out again behind the join, without another shuffle.
    """
    by = by or []
    high = max(metres, 1e-3) / DEGREE_M * 1.001
    band, around = F.floor((F.col("lat") + 90) / high), F.pmod(F.col("lng") + 180, F.lit(360.0)) / 360
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = _places(left, by).select(*by, F.col("ids").alias("l_ids"), F.col("lat").alias("la"), F.col("lng").alias("lo"), band.alias("y"), around.alias("at"))
    a = a.withColumn("n", _columns(F.col("y"), high, metres)).withColumn("x", F.least(F.floor(F.col("at") * F.col("n")), F.col("n") - 1)).drop("n", "at")
    b = _places(right, by).select(*by, F.col("ids").alias("r_ids"), F.col("lat").alias("ra"), F.col("lng").alias("ro"), around.alias("at"), F.explode(F.transform(step, lambda d: band + d)).alias("y"))
    b = b.withColumn("n", _columns(F.col("y"), high, metres))
    own = F.least(F.floor(F.col("at") * F.col("n")), F.col("n") - 1)
    b = b.select(*by, "r_ids", "ra", "ro", "y", F.explode(F.array_distinct(F.transform(step, lambda d: F.pmod(own + d, F.col("n"))))).alias("x"))
    found = a.join(b, ["y", "x", *by]).withColumn("metres", haversine(F.col("la"), F.col("lo"), F.col("ra"), F.col("ro"))).where(F.col("metres") <= metres)
    return found.select(*by, F.explode("l_ids").alias("_l"), "r_ids", "metres").select(*by, "_l", F.explode("r_ids").alias("_r"), "metres").select(*by, F.col("_l.id").alias("l_id"), F.col("_r.id").alias("r_id"), "metres")


def chained(points: DataFrame, metres: float) -> DataFrame:
    """(id, root): points (id, lat, lng) in chains of steps of at most ``metres``, each with the least id of its chain; points without a place stand alone.

    Places fall into cells so small that all of a cell reach each other, so only
    cells are linked: a pair of cells is one link, however many pairs of places
    stand for it, and chains are followed over cells.
    """
    high = 0.4 * max(metres, 1e-6) / DEGREE_M
    band = F.floor((F.col("lat") + 90) / high)
    low = F.col("_y") * high - 90
    lane = F.floor(F.pmod(F.col("lng") + 180, F.lit(360.0)) / high * F.cos(F.radians(F.greatest(F.lit(0.0), low, -low - high))))
    known = points.where("lat IS NOT NULL AND lng IS NOT NULL").groupBy("lat", "lng").agg(F.min("id").alias("least")).withColumn("_y", band)
    placed = known.select("lat", "lng", "least", F.struct("_y", lane.alias("_x")).alias("cell"))
    least = placed.groupBy("cell").agg(F.min("least").alias("id"))
    named = checkpointed(placed.drop("least").join(least, "cell"))
    own = named.select("id", "lat", "lng")
    links = pairs_within(own, own, metres).where("l_id < r_id").select(F.col("l_id").alias("a"), F.col("r_id").alias("b")).distinct()
    roots = connected(least.select("id"), links).select(F.col("id").alias("cell_id"), "root")
    found = named.select("lat", "lng", F.col("id").alias("cell_id")).join(roots, "cell_id").select("lat", "lng", "root")
    return points.select("id", "lat", "lng").join(found, ["lat", "lng"], "left").select("id", F.coalesce("root", "id").alias("root"))


#: Stations a cell may hold, for each one that is looked for, before the search begins nearer, and the least distance to begin with.
CROWDED, CLOSE = 64, 10.0


def first_distance(stations: DataFrame, k: int, most: float) -> float:
    """``most``, or a fourth, a sixteenth and so on of it: the first at which no cell of stations (lat, lng) is crowded."""
    far = most
    while far > CLOSE:
        band = F.floor((F.col("lat") + 90) / (far / DEGREE_M * 1.001))
        lane = F.floor(F.pmod(F.col("lng") + 180, F.lit(360.0)) / 360 * _columns(band, far / DEGREE_M * 1.001, far))
        held = stations.where("lat IS NOT NULL AND lng IS NOT NULL").groupBy(band.alias("y"), lane.alias("x")).agg(F.count(F.lit(1)).alias("n"))
        if (held.agg(F.max("n")).first()[0] or 0) <= CROWDED * k:
            break
        far /= 4
    return far


def nearest(left: DataFrame, stations: DataFrame, k: int, first: float = 20_000.0, places: int | None = 3) -> DataFrame:
    """(l_id, r_id, metres, rank): the ``k`` nearest stations (id, lat, lng) of every point, by metres to ``places`` decimals (null: exact), ties by id.

    All stations within a distance are found over cells; a point that has ``k``
    of them is settled, since no other can be nearer. The rest looks four times
    as far, until the distance is half the globe. Where stations stand close
    together the search begins nearer than ``first``, so a point in a city does
    not meet the whole city. Points of one place search once; a place of stations
    stands for its first ``k``, as others there can't be among the nearest.
    """
    spots = left.where("lat IS NOT NULL AND lng IS NOT NULL").select("lat", "lng").distinct().select(F.struct("lat", "lng").alias("id"), "lat", "lng")
    turn = F.row_number().over(Window.partitionBy("lat", "lng").orderBy("id"))
    held = stations.where("lat IS NOT NULL AND lng IS NOT NULL").select("id", "lat", "lng").withColumn("turn", turn).where(F.col("turn") <= k).groupBy("lat", "lng").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    held = checkpointed(held.select(F.struct(F.col("ids")[0].alias("id"), "lat", "lng").alias("id"), "ids", "lat", "lng"))
    found = _nearest_places(spots, held.select("id", "lat", "lng"), k, first, places)
    each = found.join(held.select(F.col("id").alias("r_id"), "ids"), "r_id").select("l_id", F.explode("ids").alias("r_id"), "metres")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("l_id").orderBy("metres", "r_id"))).where(F.col("rank") <= k)
    named = ranked.select(F.col("l_id.lat").alias("lat"), F.col("l_id.lng").alias("lng"), "r_id", "metres", "rank")
    return left.select(F.col("id").alias("l_id"), "lat", "lng").join(named, ["lat", "lng"]).select("l_id", "r_id", "metres", "rank")


def _nearest_places(left: DataFrame, stations: DataFrame, k: int, first: float, places: int | None) -> DataFrame:
    """(l_id, r_id, metres, rank) of points and stations that each stand at a place of their own."""
    far, open_points, done = first_distance(stations, k, first), left.select("id", "lat", "lng"), None
    order = Window.partitionBy("l_id").orderBy("metres", "r_id")
    while True:
        last = far >= EARTH_M * math.pi
        near = pairs_within(open_points, stations, far)
        near = near if places is None else near.withColumn("metres", F.round("metres", places))
        ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        full = ranked.withColumn("n", F.max("rank").over(Window.partitionBy("l_id")))
        settled = checkpointed((full if last else full.where(F.col("n") == k)).drop("n"))
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done
        open_points = checkpointed(open_points.join(settled.select(F.col("l_id").alias("id")).distinct(), "id", "left_anti"))
        if open_points.isEmpty():
            return done
        far *= 4


#: How many squares' half sides a block is wide in which points are counted.
BLOCK = 8


def _weight_below(values: np.ndarray, weights: np.ndarray, first: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each question the weight of those of the ``first`` values that lie under ``limit``: values are split by their bits, from the highest, and a question follows its own side."""
    low, high, total = np.zeros_like(first), first, np.zeros(len(first), np.int64)
    for bit in reversed(range(max(int(len(values)).bit_length(), 1))):
        one = (values >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        held = np.concatenate([[0], np.cumsum(np.where(one, 0, weights))])
        up = (limit >> bit & 1).astype(bool)
        total += np.where(up, held[high] - held[low], 0)
        low, high = (np.where(up, zeros[-1] + at - zeros[at], zeros[at]) for at in (low, high))
        order = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
        values, weights = values[order], weights[order]
    return total


def _reach(line: np.ndarray, at: np.ndarray, metres: float) -> tuple[np.ndarray, np.ndarray]:
    """From where to where in a sorted line values differ from ``at`` by at most ``metres``."""
    low, high = np.searchsorted(line, at - metres, "left"), np.searchsorted(line, at + metres, "right")
    padded = np.concatenate([[-np.inf], line, [np.inf]])
    while (step := at - padded[low] <= metres).any():  # sums and differences round apart
        low = low - step
    while (step := padded[high + 1] - at <= metres).any():
        high = high + step
    return low, high


def neighbours_count(points: DataFrame, metres: float, least: int) -> DataFrame:
    """(id, n, dense) of planar points (id, x, y): how many lie in the square of half side ``metres``, oneself included.

    Points are first counted by place, so a place that holds a third of all
    points is one row. Places meet in blocks of the plane, with a margin around
    each; a block's places are sorted, and all its squares are counted by
    halving, so no pair of neighbours is ever made, however dense they are.
    """
    places = points.where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    wide, far = float(metres * BLOCK), metres * (1 + 1e-9)
    lanes = lambda c: F.array_distinct(F.transform(F.array(F.lit(-far), F.lit(0.0), F.lit(far)), lambda d: F.floor((F.col(c).cast("double") + d) / wide)))
    home = lambda c: F.floor(F.col(c).cast("double") / wide)
    laid = places.select("x", "y", "c", F.explode(lanes("x")).alias("i"), lanes("y").alias("j")).withColumn("j", F.explode("j")).withColumn("own", (F.col("i") == home("x")) & (F.col("j") == home("y")))

    def count(block: pd.DataFrame) -> pd.DataFrame:
        x, y = block["x"].to_numpy(np.float64), block["y"].to_numpy(np.float64)
        order, line = np.argsort(x, kind="stable"), np.sort(y)
        ranks, own = np.empty(len(y), np.int64), block["own"].to_numpy(bool)
        ranks[np.argsort(y, kind="stable")] = np.arange(len(y))
        (left, right), (below, above) = _reach(x[order], x[own], metres), _reach(line, y[own], metres)
        four = _weight_below(ranks[order], block["c"].to_numpy(np.int64)[order], np.concatenate([right, left, right, left]), np.concatenate([above, above, below, below])).reshape(4, -1)
        return block.loc[own, ["x", "y"]].assign(n=four[0] - four[1] - four[2] + four[3])

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    sums = laid.groupBy("i", "j").applyInPandas(count, f"x {kinds['x']}, y {kinds['y']}, n long")
    return points.join(sums.hint("merge"), ["x", "y"]).select("id", "n", (F.col("n") >= least).alias("dense"))


def cell_areas(total: DataFrame, blocked: DataFrame, conditional: DataFrame, side_m: float) -> DataFrame:
    """Areas of ``total`` that are blocked, conditional (and not blocked) and free, over cells (x, y).

    Sets are flagged and summed by cell: one shuffle, with flags combined before it.
    """
    flag = lambda df, t, b, c: df.select("x", "y", F.lit(t).alias("t"), F.lit(b).alias("b"), F.lit(c).alias("c"))
    rows = flag(total, 1, 0, 0).unionByName(flag(blocked, 0, 1, 0)).unionByName(flag(conditional, 0, 0, 1))
    cells = rows.groupBy("x", "y").agg(F.max("t").alias("t"), F.max("b").alias("b"), F.max("c").alias("c")).where("t = 1")
    area = side_m * side_m
    return cells.agg(
        (F.count(F.lit(1)) * area).alias("total_m2"),
        (F.coalesce(F.sum("b"), F.lit(0)) * area).alias("blocked_m2"),
        (F.count_if(F.expr("b = 0 AND c = 1")) * area).alias("conditional_m2"),
        (F.count_if(F.expr("b = 0 AND c = 0")) * area).alias("free_m2"),
    )


def rank_within(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
