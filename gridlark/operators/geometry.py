"""Planar geometry as columns: the national map projection, rings, segments, tiles and bearings.

A ring is an array of structs (x, y); the last point joins the first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The ellipsoid, and origin, scale and offsets of the projection (EPSG:5179).
AXIS, FLATTENING = 6_378_137.0, 1 / 298.257222101
ORIGIN_LAT, ORIGIN_LNG, SCALE, FALSE_X, FALSE_Y = 38.0, 127.5, 0.9996, 1_000_000.0, 2_000_000.0
#: The eight directions, from north, clockwise.
BEARINGS = "북 북동 동 남동 남 남서 서 북서".split()

_N = FLATTENING / (2 - FLATTENING)
#: Mean radius, and Krueger's series in the third flattening up to the fourth power.
_A = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BACK = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))


def _conformal_tangent(lat: float) -> float:
    """The tangent of the conformal latitude, for the origin."""
    s = math.sin(math.radians(lat))
    return math.sinh(math.atanh(s) - _E * math.atanh(_E * s))


def _origin_northing() -> float:
    xi = math.atan(_conformal_tangent(ORIGIN_LAT))
    return _A * (xi + sum(a * math.sin(2 * (k + 1) * xi) for k, a in enumerate(_FORWARD)))


def project(lat: Column, lng: Column) -> Column:
    """(x, y) in metres of a point in degrees."""
    s, away = F.sin(F.radians(lat)), F.radians(lng - ORIGIN_LNG)
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for k, a in enumerate(_FORWARD, 1):
        north = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    return F.struct((FALSE_X + SCALE * _A * east).alias("x"), (FALSE_Y + SCALE * (_A * north - _origin_northing())).alias("y"))


def unproject(x: Column, y: Column) -> Column:
    """(lat, lng) in degrees of a point in metres."""
    xi, eta = ((y - FALSE_Y) / SCALE + _origin_northing()) / _A, (x - FALSE_X) / (SCALE * _A)
    north, east = xi, eta
    for k, b in enumerate(_BACK, 1):
        north = north - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        east = east - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    away = F.atan2(F.sinh(east), F.cos(north))
    conformal = F.sin(north) / F.sqrt(F.pow(F.sinh(east), 2) + F.pow(F.cos(north), 2))
    # three fixed-point steps on the isometric latitude reach 1e-12
    isometric, s = F.asinh(conformal), F.sin(F.atan(conformal))
    for _ in range(4):
        s = F.tanh(isometric + _E * F.atanh(_E * s))
    return F.struct(F.degrees(F.asin(s)).alias("lat"), (ORIGIN_LNG + F.degrees(away)).alias("lng"))


def _edges(ring: Column) -> Column:
    """Each point beside the next, the last beside the first."""
    rest = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), rest.alias("b"))


def _edge(e: Column) -> tuple[Column, Column, Column, Column]:
    a, b = e.getField("a"), e.getField("b")
    return a["x"], a["y"], b["x"], b["y"]


def ring_area(ring: Column) -> Column:
    """Square metres inside a ring; null with fewer than three points."""

    def part(e: Column) -> Column:
        ax, ay, bx, by = _edge(e)
        return ax * by - bx * ay

    total = F.aggregate(F.transform(_edges(ring), part), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(ring) >= 3, F.abs(total) / 2)


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ray from the point crosses the ring an odd number of times."""

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = _edge(e)
        return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)

    return (F.size(ring) >= 3) & (F.size(F.filter(_edges(ring), crosses)) % 2 == 1)


def ring_distance(ring: Column, x: Column, y: Column) -> Column:
    """Metres from a point to a ring; 0 inside."""

    def far(e: Column) -> Column:
        ax, ay, bx, by = _edge(e)
        long = F.pow(bx - ax, 2) + F.pow(by - ay, 2)
        along = F.when(long > 0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / long).otherwise(0.0)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        return F.sqrt(F.pow(ax + t * (bx - ax) - x, 2) + F.pow(ay + t * (by - ay) - y, 2))

    return F.when(inside(ring, x, y), F.lit(0.0)).otherwise(F.array_min(F.transform(_edges(ring), far)))


def tile_cover(boxes: DataFrame, key: str, side: float) -> DataFrame:
    """(key, i, j): the tiles of a fixed grid that a box (min_x, min_y, max_x, max_y) touches."""
    lane = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / side), F.floor(F.col(high) / side)))
    return boxes.select(key, "min_y", "max_y", lane("min_x", "max_x").alias("i")).select(key, "i", lane("min_y", "max_y").alias("j"))


def bearing8(degrees: Column) -> Column:
    """The name of the nearest of eight directions."""
    return F.get(F.array(*map(F.lit, BEARINGS)), (F.floor(F.pmod(degrees, F.lit(360.0)) / 45 + 0.5) % 8).cast("int"))


def allocate_largest_first(cells: DataFrame, region: str) -> DataFrame:
    """(region, cells): every cell (x, y) goes to the largest region that has it, the smaller key on a tie.

    Sizes come from one aggregation; a cell then keeps the least of its claims,
    so nothing is subtracted region by region.
    """
    held = cells.select(region, "x", "y").distinct()
    sizes = held.groupBy(region).agg(F.count(F.lit(1)).alias("n"))
    claims = held.join(sizes, region).groupBy("x", "y").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(region).alias("k"))).alias("best"))
    return claims.groupBy(F.col("best.k").alias(region)).agg(F.count(F.lit(1)).alias("cells"))


def first_in(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of every ``key``."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_place = 1").drop("_place")


def cells_inside(shapes: DataFrame, key: str, ring: str, side: float) -> DataFrame:
    """(key, i, j) of the metric cells whose centres lie inside a ring of (x, y).

    Every row of cells is cut where the ring crosses its middle, so only cells
    inside are ever made, whatever the ring's bounding box.
    """
    ys = F.transform(ring, lambda p: p["y"])
    at = lambda v: F.floor(v / side).cast("int")
    lines = shapes.where(F.size(ring) >= 3).select(key, ring, F.explode(F.sequence(at(F.array_min(ys)), at(F.array_max(ys)))).alias("j"))
    y = (F.col("j") + 0.5) * side

    def crossing(e: Column) -> Column:
        ax, ay, bx, by = _edge(e)
        return F.when((ay > y) != (by > y), (bx - ax) * (y - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)

    xs = F.array_sort(F.array_compact(F.transform(_edges(F.col(ring)), crossing)))
    spans = lines.withColumn("_xs", xs).where(F.size("_xs") >= 2).select(key, "j", "_xs", F.explode(F.sequence(F.lit(0), F.size("_xs") - 2, F.lit(2))).alias("_k"))
    first, last = F.ceil(F.get("_xs", F.col("_k")) / side - 0.5).cast("int"), (F.ceil(F.get("_xs", F.col("_k") + 1) / side - 0.5) - 1).cast("int")
    return spans.withColumn("_first", first).withColumn("_last", last).where("_first <= _last").select(key, F.explode(F.sequence("_first", "_last")).alias("i"), "j")


def cells_near(shapes: DataFrame, key: str, points: str, reach: float | Column, side: float, closed: bool = True) -> DataFrame:
    """(key, i, j) of the metric cells whose centres lie within ``reach`` of a line through ``points``: buffers, corridors and setbacks.

    ``reach`` is a number or a column of the shapes. ``closed`` joins the last
    point to the first; one point alone gives a circle. Long edges are cut into pieces of twice the reach, so the cells
    tried are a small multiple of those found, however long or slanted an edge.
    """
    at, pair = F.col(points), F.arrays_zip(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))).alias("a"), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))).alias("b"))
    edges = F.when(F.size(at) > 1, _edges(at) if closed else pair).otherwise(_edges(at))
    far_out = reach if isinstance(reach, Column) else F.lit(float(reach))
    e = shapes.where(F.size(at) > 0).select(key, far_out.alias("_reach"), F.explode(edges).alias("_e")).select(key, "_reach", *[F.col(f"_e.{p}.{d}").alias(f"_{p}{d}") for p in "ab" for d in "xy"])
    reach = F.col("_reach")
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay")) / (2 * reach)).cast("int"))
    part = e.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    spot = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n")
    part = part.select(key, "_reach", *[spot(f"_a{d}", f"_b{d}", F.col("_k") + s).alias(f"_{d}{s}") for d in "xy" for s in (0, 1)])
    cells = lambda d: F.sequence(F.floor((F.least(f"_{d}0", f"_{d}1") - reach) / side).cast("int"), F.floor((F.greatest(f"_{d}0", f"_{d}1") + reach) / side).cast("int"))
    tried = part.withColumn("i", F.explode(cells("x"))).withColumn("j", F.explode(cells("y")))
    x, y, dx, dy = (F.col("i") + 0.5) * side, (F.col("j") + 0.5) * side, F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    long = dx * dx + dy * dy
    along = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - F.col("_x0")) * dx + (y - F.col("_y0")) * dy) / long))).otherwise(0.0)
    far = F.hypot(F.col("_x0") + along * dx - x, F.col("_y0") + along * dy - y)
    return tried.where(far <= reach).select(key, "i", "j").distinct()
