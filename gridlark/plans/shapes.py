"""Queries of planar geometry, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators import geometry
from gridlark.plans.registry import query, table


def _lat_lng(k: Column) -> tuple[Column, Column]:
    return 33 + (k * 7919 % 6000) / F.lit(1000.0), 125 + (k * 104729 % 7000) / F.lit(1000.0)


@query("""SELECT c_custkey, round(33 + (c_custkey * 7919 % 6000) / 1000.0::double, 6) AS lat, round(125 + (c_custkey * 104729 % 7000) / 1000.0::double, 6) AS lng FROM customer""")
def projection_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to metres and back, to a millionth of a degree."""
    points = table(spark, sf_dir, "customer").select("c_custkey", geometry.project(*_lat_lng(F.col("c_custkey"))).alias("p"))
    back = points.select("c_custkey", geometry.unproject(F.col("p.x"), F.col("p.y")).alias("g"))
    return back.select("c_custkey", F.round("g.lat", 6).alias("lat"), F.round("g.lng", 6).alias("lng"))


def _meridian_sql(phi: str) -> str:
    """Metres along the meridian by the classical series in the eccentricity, another road than the operator's."""
    e2 = geometry.FLATTENING * (2 - geometry.FLATTENING)
    terms = [1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256 - 175 * e2**4 / 16384, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024 + 105 * e2**4 / 4096,
             15 * e2**2 / 256 + 45 * e2**3 / 1024 + 525 * e2**4 / 16384, 35 * e2**3 / 3072 + 175 * e2**4 / 12288]
    a, b, c, d = (f"{t!r}::double" for t in terms)
    return f"{geometry.AXIS}::double * ({a} * {phi} - {b} * sin(2 * {phi}) + {c} * sin(4 * {phi}) - {d} * sin(6 * {phi}))"


def _project_sql() -> str:
    e2 = geometry.FLATTENING * (2 - geometry.FLATTENING)
    ep = e2 / (1 - e2)
    return f"""WITH g AS (SELECT c_custkey, radians(33 + (c_custkey * 7919 % 6000) / 1000.0::double) AS phi, radians((c_custkey * 104729 % 7000) / 1000.0::double - 2.5) AS l FROM customer),
t AS (SELECT *, {geometry.AXIS}::double / sqrt(1 - {e2!r}::double * pow(sin(phi), 2)) AS n, pow(tan(phi), 2) AS t, {ep!r}::double * pow(cos(phi), 2) AS c, l * cos(phi) AS a FROM g)
SELECT c_custkey, round({geometry.FALSE_X}::double + {geometry.SCALE}::double * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {ep!r}::double) * pow(a, 5) / 120), 1) AS x,
round({geometry.FALSE_Y}::double + {geometry.SCALE}::double * ({_meridian_sql('phi')} - ({_meridian_sql(f'radians({geometry.ORIGIN_LAT}::double)')}) + n * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24
 + (61 - 58 * t + t * t + 600 * c - 330 * {ep!r}::double) * pow(a, 6) / 720)), 1) AS y FROM t"""


@query(_project_sql())
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points in the national projection, to a decimetre."""
    points = table(spark, sf_dir, "customer").select("c_custkey", geometry.project(*_lat_lng(F.col("c_custkey"))).alias("p"))
    return points.select("c_custkey", F.round("p.x", 1).alias("x"), F.round("p.y", 1).alias("y"))


#: An L of six corners, as wide as the part's size.
_CORNERS = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 3), (0, 3)]


def _ring(side: Column) -> Column:
    return F.array(*[F.struct((side * x).alias("x"), (side * y).alias("y")) for x, y in _CORNERS])


@query("""WITH p AS (SELECT p_partkey, p_size::double AS s, p_partkey * 37 % 400 / 100.0::double + 0.005 AS u, p_partkey * 91 % 300 / 100.0::double + 0.005 AS v FROM part),
f AS (SELECT *, (u < 4 AND v < 1) OR (u < 1 AND v < 3) AS hit, CASE WHEN u <= 4 THEN v - 1 ELSE sqrt(pow(u - 4, 2) + pow(v - 1, 2)) END AS above, CASE WHEN v <= 3 THEN u - 1 ELSE sqrt(pow(u - 1, 2) + pow(v - 3, 2)) END AS beside FROM p)
SELECT p_partkey, s * s * 6 AS area, hit, round(CASE WHEN hit THEN 0 ELSE least(above, beside) * s END, 6) AS metres FROM f""")
def ring_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-shaped rings: area, whether a point is inside, and how far it is."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    x, y = ((k * 37 % 400) / F.lit(100.0) + 0.005) * s, ((k * 91 % 300) / F.lit(100.0) + 0.005) * s
    return table(spark, sf_dir, "part").select(
        "p_partkey", geometry.ring_area(_ring(s)).alias("area"), geometry.inside(_ring(s), x, y).alias("hit"), F.round(geometry.ring_distance(_ring(s), x, y), 6).alias("metres")
    )


@query("""WITH b AS (SELECT p_partkey, p_partkey * 7919 % 50000 AS x, p_partkey * 3571 % 50000 AS y, p_size * 100 AS w FROM part)
SELECT p_partkey, i, j FROM (SELECT p_partkey, unnest(range((x // 3000)::bigint, ((x + w) // 3000)::bigint + 1)) AS i, y, w FROM b) t, LATERAL (SELECT unnest(range((y // 3000)::bigint, ((y + w) // 3000)::bigint + 1)) AS j)""")
def tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 3 km that squares touch."""
    k, w = F.col("p_partkey"), F.col("p_size") * 100
    x, y = k * 7919 % 50000, k * 3571 % 50000
    return geometry.tile_cover(table(spark, sf_dir, "part").select("p_partkey", x.alias("min_x"), y.alias("min_y"), (x + w).alias("max_x"), (y + w).alias("max_y")), "p_partkey", 3_000)


@query("""SELECT direction, count(*) AS n FROM (SELECT (['북','북동','동','남동','남','남서','서','북서'])[(floor((event_id * 37 % 3600)::double / 10 / 45 + 0.5)::bigint % 8) + 1] AS direction FROM events) GROUP BY direction""")
def bearing_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by eight directions."""
    named = geometry.bearing8((F.col("event_id") * 37 % 3600).cast("double") / 10).alias("direction")
    return table(spark, sf_dir, "events").select(named).groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH h AS (SELECT DISTINCT l_suppkey AS region, l_partkey % 60 AS x, l_orderkey % 60 AS y FROM lineitem), z AS (SELECT region, count(*) AS n FROM h GROUP BY region),
o AS (SELECT region, row_number() OVER (PARTITION BY x, y ORDER BY n DESC, region) AS r FROM h JOIN z USING (region)) SELECT region, count(*) AS cells FROM o WHERE r = 1 GROUP BY region""")
def region_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as overlapping regions of cells: each cell to the largest."""
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("region"), (F.col("l_partkey") % 60).alias("x"), (F.col("l_orderkey") % 60).alias("y"))
    return geometry.allocate_largest_first(cells, "region")
