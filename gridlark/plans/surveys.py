"""Queries of site surveys, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators import notation, surveys
from gridlark.plans.registry import query, table
from gridlark.plans.shapes import _lat_lng

LINE = """CASE WHEN event_id % 11 = 0 THEN '# 7777' WHEN event_id % 13 = 0 THEN 'x, 1' WHEN event_id % 17 = 0 THEN '2024xx010000, 1, 1' ELSE
concat('2024010', 1 + event_id % 9, '0', event_id % 10, '00, ', event_id % 360, '.5, ', CASE WHEN event_id % 7 = 0 THEN '-9' ELSE concat(event_id % 20, '.25') END, ', =') END"""


@query("""SELECT event_id, make_timestamp(2024, 1, 1 + event_id % 9, event_id % 10, 0, 0) AS ts, event_id % 360 + 0.5::double AS direction, event_id % 20 + 0.25::double AS speed
FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 7 <> 0""")
def measurement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of measurement files."""
    return surveys.measurements(table(spark, sf_dir, "events").select("event_id", F.expr(LINE).alias("line")), "line")


@query("""WITH p AS (SELECT p_partkey % 20 AS site, CASE WHEN p_partkey % 6 < 5 AND p_size % 9 <= 6 AND p_partkey % 20 <> 3 THEN (p_partkey % 6 + 1)::int END AS grade FROM part),
g AS (SELECT site, grade, count(*) AS n FROM p GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY site)::bigint AS inside, max(grade) OVER (PARTITION BY site) AS known FROM g)
SELECT site, grade, n, inside FROM k WHERE grade IS NOT NULL OR known IS NULL""")
def pixel_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pixels of a hazard map, a little off their colour."""
    k, off = F.col("p_partkey"), F.col("p_size") % 9
    colours = F.array(*[F.array(*map(F.lit, c)) for c in [*surveys.GRADE_COLOURS, (10, 90, 10)]])
    c = F.get(colours, F.when(k % 20 == 3, 5).otherwise(k % 6).cast("int"))
    pixels = table(spark, sf_dir, "part").select((k % 20).alias("site"), c[0].alias("r"), c[1].alias("g"), F.when(c[2] == 0, off).otherwise(c[2] - off).alias("b"))
    return surveys.grade_counts(pixels, "site")


@query("""WITH c AS (SELECT p_partkey // 400 AS grid, p_partkey % 400 // 20 AS i, p_partkey % 20 AS j, CASE WHEN p_partkey % 97 <> 0 THEN p_size * 2.0::double END AS z FROM part),
n AS (SELECT c.*, u.z AS uz, u.i AS ui, d.z AS dz, d.i AS di, w.z AS wz, w.j AS wj, e.z AS ez, e.j AS ej FROM c LEFT JOIN c u ON u.grid = c.grid AND u.j = c.j AND u.i = c.i - 1 LEFT JOIN c d ON d.grid = c.grid AND d.j = c.j AND d.i = c.i + 1
  LEFT JOIN c w ON w.grid = c.grid AND w.i = c.i AND w.j = c.j - 1 LEFT JOIN c e ON e.grid = c.grid AND e.i = c.i AND e.j = c.j + 1),
g AS (SELECT *, ((CASE WHEN di IS NULL THEN z ELSE dz END) - (CASE WHEN ui IS NULL THEN z ELSE uz END)) / (nullif((di IS NOT NULL)::int + (ui IS NOT NULL)::int, 0) * 90.0::double) AS a,
  ((CASE WHEN ej IS NULL THEN z ELSE ez END) - (CASE WHEN wj IS NULL THEN z ELSE wz END)) / (nullif((ej IS NOT NULL)::int + (wj IS NOT NULL)::int, 0) * 90.0::double) AS b FROM n),
s AS (SELECT *, degrees(atan(sqrt(a * a + b * b))) AS slope, CASE WHEN sqrt(a * a + b * b) >= 1e-9 THEN (degrees(atan2(-b, a)) + 360) % 360 END AS aspect FROM g)
SELECT grid, round(avg(slope), 1) AS mean_deg, round(max(slope), 1) AS max_deg, round(quantile_cont(slope, 0.9), 1) AS p90_deg, round(coalesce(avg((aspect BETWEEN 135 AND 225)::int), 0), 3) AS south_ratio,
round(avg(z) FILTER (slope IS NOT NULL), 1) AS mean_z, count(slope) AS cells, round(count(slope) / count(*), 3) AS coverage, count(slope) >= 4 AND round(count(slope) / count(*), 3) >= 0.9 AS reliable FROM s GROUP BY grid""")
def terrain_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as heights on grids of twenty columns."""
    k = F.col("p_partkey")
    cells = table(spark, sf_dir, "part").select(
        F.floor(k / 400).alias("grid"), F.floor(k % 400 / 20).alias("i"), (k % 20).alias("j"), F.when(k % 97 != 0, F.col("p_size") * F.lit(2.0)).alias("z")
    )
    return surveys.terrain(cells, "grid", 90.0)


@query("""WITH g AS (SELECT 2000 + o_orderkey % 5 AS year, o_custkey % 40 AS r, o_orderkey * 7 % 40 AS c, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice::double / 1000 END AS v FROM orders), s AS (SELECT s_suppkey, s_suppkey * 3 % 45 AS r, s_suppkey * 11 % 45 AS c FROM supplier),
y AS (SELECT s_suppkey, year, round(avg(v), 1) AS v FROM s JOIN g ON abs(g.r - s.r) <= 1 AND abs(g.c - s.c) <= 1 WHERE v IS NOT NULL GROUP BY ALL)
SELECT s_suppkey, count(*) AS years, round(avg(v), 1) AS mean, round(max(v) - min(v), 1) AS spread, round(avg(v) * 8.76 * 0.589, 4) AS ground FROM y GROUP BY s_suppkey""")
def irradiance_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a yearly irradiance grid, suppliers as sites."""
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    grid = table(spark, sf_dir, "orders").select((2000 + k % 5).alias("year"), (F.col("o_custkey") % 40).alias("r"), (k * 7 % 40).alias("c"), F.when(k % 9 != 0, F.col("o_totalprice").cast("double") / 1000).alias("v"))
    sites = table(spark, sf_dir, "supplier").select(s, (s * 3 % 45).alias("r"), (s * 11 % 45).alias("c"))
    return surveys.irradiance(grid, sites, "s_suppkey")


@query("""WITH y AS (SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN (1000 + p_size * 13.7::double) * CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE (1400 - p_size)::double / (1450 + p_size) END * 0.84::double END AS y, p_partkey % 6 * 1.5::double AS mw FROM part)
SELECT p_partkey, round_even(y, 0) AS kwh_kwp, round_even(y / 365, 2) AS hours, round_even(y / 8760 * 100, 2) AS factor, CASE WHEN mw > 0 THEN round_even(mw * y, 1) END AS mwh FROM y""")
def yield_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as plants: what a year's irradiance gives."""
    k, size = F.col("p_partkey"), F.col("p_size")
    made = surveys.yield_of(F.when(k % 10 != 0, 1000 + size * F.lit(13.7)), F.when(k % 3 != 0, (1400 - size).cast("double")), (1450 + size).cast("double"), k % 6 * F.lit(1.5))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("y")).select("p_partkey", "y.*")


def _places(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    lat, lng = _lat_lng(F.col(key))
    return table(spark, sf_dir, name).select("*", F.col(key).alias("id"), lat.alias("lat"), lng.alias("lng"))


PLACE_SQL = "33 + ({k} * 7919 % 6000) / 1000.0::double AS lat, 125 + ({k} * 104729 % 7000) / 1000.0::double AS lng"
FAR_SQL = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"


@query(f"""WITH RECURSIVE p AS (SELECT s_nationkey AS site, s_suppkey AS id, {PLACE_SQL.format(k='s_suppkey')} FROM supplier),
e AS (SELECT a.site, a.id AS a, list(b.id) AS bs FROM p a JOIN p b ON a.site = b.site AND {FAR_SQL} <= 250000 GROUP BY ALL),
t AS (SELECT site, list(id) AS rest, 0 AS round, 0::bigint AS centre, 0::bigint AS points FROM p GROUP BY site
 UNION ALL
 SELECT site, list_filter(rest, lambda x: NOT list_contains(bs, x)), round + 1, a, len(rest) - len(list_filter(rest, lambda x: NOT list_contains(bs, x)))
 FROM (SELECT t.site, t.rest, t.round, e.a, e.bs, row_number() OVER (PARTITION BY t.site ORDER BY len(list_filter(t.rest, lambda x: list_contains(e.bs, x))) DESC, e.a) AS r FROM t JOIN e ON e.site = t.site WHERE len(t.rest) > 0) WHERE r = 1)
SELECT site, round, centre, points FROM t WHERE round > 0""")
def centre_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres that cover each nation's suppliers within 250 km."""
    points = _places(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_nationkey").alias("site"), "id", "lat", "lng")
    return surveys.cover_within(points, "site", 250_000)


@query(f"""WITH a AS (SELECT c_custkey, {PLACE_SQL.format(k='c_custkey')} FROM customer), b AS (SELECT s_suppkey, {PLACE_SQL.format(k='s_suppkey')} FROM supplier), l AS (SELECT unnest([20000, 50000, 100000])::int AS "limit"),
m AS (SELECT c_custkey, s_suppkey, {FAR_SQL} AS metres FROM a, b), r AS (SELECT c_custkey, "limit", s_suppkey, row_number() OVER (PARTITION BY c_custkey, "limit" ORDER BY metres, s_suppkey) AS r FROM m, l WHERE metres <= "limit")
SELECT a.c_custkey, l."limit", count(r.s_suppkey) AS n, coalesce(string_agg(r.s_suppkey::varchar, ',' ORDER BY r.r) FILTER (r.r <= 5), '') AS first FROM a CROSS JOIN l LEFT JOIN r ON r.c_custkey = a.c_custkey AND r."limit" = l."limit" GROUP BY ALL""")
def facility_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers around customers within three distances."""
    customers, suppliers = _places(spark, sf_dir, "customer", "c_custkey"), _places(spark, sf_dir, "supplier", "s_suppkey")
    return surveys.place_rings(customers.select("c_custkey", "lat", "lng"), suppliers, "c_custkey", [20_000, 50_000, 100_000])


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN (p_size // 4)::varchar ELSE rtrim(printf('%.2f', p_size / 4.0::double), '0') END AS prefix, round_even(p_size / 4.0::double / 0.5, 0) * 0.5 AS grid,
(p_partkey % 300)::varchar || 'x' AS folder, CASE p_partkey % 4 WHEN 0 THEN '진보' WHEN 1 THEN '신안' WHEN 2 THEN '남해' ELSE '영월' END AS substation,
CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'R' || p_size || '|' || p_partkey || '-' || CASE WHEN p_partkey % 2 = 0 THEN '7' ELSE '0' END END AS road,
CASE WHEN p_partkey % 3 = 0 THEN 'F' || p_partkey WHEN p_partkey % 3 = 1 THEN 'uid:' || p_size ELSE md5('g' || p_size) END AS feature,
CASE p_partkey % 5 WHEN 0 THEN 'ANNEX' WHEN 1 THEN 'HOUSING' WHEN 2 THEN 'LIVESTOCK' WHEN 3 THEN 'QUIET' ELSE 'NOT_TARGET' END AS building FROM part""")
def place_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates, folders, substations, roads, features and buildings as registers write them."""
    k, size, text = F.col("p_partkey"), F.col("p_size"), lambda c: c.cast("string")
    station = F.when(k % 4 == 0, " 진보 변전소").when(k % 4 == 1, "신안(154kV)S/S").when(k % 4 == 2, "남해SA").otherwise("영월 개폐소")
    purpose = F.when(k % 5 == 1, "단독주택").when(k % 5 == 2, " 동물및식물관련시설").when(k % 5 == 3, "의료시설").otherwise("공장")
    number = F.when(k % 2 == 0, F.concat(text(k), F.lit("-7"))).otherwise(text(k))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        notation.coordinate_prefix(size / 4.0).alias("prefix"),
        notation.snapped(size / 4.0, 0.5).alias("grid"),
        notation.folder_name(F.concat(F.lit(" .."), text(k % 300), F.lit("x. "))).alias("folder"),
        notation.substation(station).alias("substation"),
        notation.road_key(F.when(k % 5 != 0, F.concat(F.lit("R"), text(size))), number).alias("road"),
        notation.feature_key(F.when(k % 3 == 0, F.concat(F.lit("F"), text(k))), [("pnu", F.lit("")), ("uid", F.when(k % 3 == 1, size))], F.concat(F.lit("g"), text(size))).alias("feature"),
        notation.building_kind(F.when(k % 5 == 0, "부속건축물").otherwise("주건축물"), purpose).alias("building"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN repeat('가', 60) || '다.' WHEN o_orderkey % 3 = 1 THEN repeat('나', 70) ELSE repeat('라', 110) END AS reason FROM orders""")
def clipped_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long reasons cut at a sentence, a word or right there."""
    k = F.col("o_orderkey")
    reason = F.when(k % 3 == 0, F.expr("concat(repeat('가', 60), '다. ', repeat('나', 80))")).when(k % 3 == 1, F.expr("concat(repeat('나', 70), ' ', repeat('다', 80))")).otherwise(F.expr("repeat('라', 150)"))
    return table(spark, sf_dir, "orders").select("o_orderkey", notation.clipped(reason).alias("reason"))
