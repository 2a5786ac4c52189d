"""Queries of single checks over all sites, each with its DuckDB SQL: customers are sites, orders their parcels and what lies around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators import checks, evaluation, judgements
from gridlark.plans.registry import query, spread, table

ZONES = ("공익용산지", "임업용산지", "보전산지", "준보전산지", "산림보호구역", "수변구역", "도로구역", "상수원보호구역")
CODES = ("UFM110", "UFM120", "UFM100", "UFM200", "", "UMA", "UQS100", "UNA")
CATEGORIES = ("임야", "전", "잡종지", "도로", "목장용지", "대")
OWNERS = ("개인", "국유지", "법인", "외국정부")
RULES = [("수변", "CONDITIONAL", "MEDIUM"), ("보호구역", "CONDITIONAL", "HIGH"), ("상수원", "IMPOSSIBLE", "CRITICAL")]
_LIST = lambda names: f"[{', '.join(repr(n) for n in names)}]"
SITE = "c_custkey"


def _pick(names: tuple[str, ...], at: str) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.expr(f"int({at})"))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(SITE, (F.col(SITE) % 7 * 100_000).cast("double").alias("area"), (F.col(SITE) % 4 * 250).cast("double").alias("radius"))


def _parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as parcels, every one told twice; every eleventh customer has none."""
    own = table(spark, sf_dir, "orders").where("o_custkey % 11 > 0")
    told = own.select(F.col("o_custkey").alias(SITE), F.col("o_orderkey").alias("parcel"), _pick(CATEGORIES, "(o_custkey + o_orderkey % 2) % 6").alias("category"), (F.col("o_orderkey") % 1000).cast("double").alias("area"))
    return told.unionAll(told)


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    kept = lambda at, when: orders.where(when).select(
        F.col("o_orderkey").alias("parcel"), F.concat(F.lit(" "), _pick(ZONES, at)).alias("zone"), _pick(CODES, at).alias("code"), F.when(F.col("o_orderkey") % 3 == 0, checks.TOUCH).otherwise(checks.CONFLICT).alias("touch")
    )
    return kept("(o_custkey + o_orderkey % 2 * 3) % 8", "o_custkey % 5 > 0").unionAll(kept("(o_custkey + 1) % 8", "o_custkey % 5 > 0 AND o_orderkey % 4 = 0"))


P = f"""p AS (SELECT o_custkey AS k, o_orderkey AS parcel, ({_LIST(CATEGORIES)})[1 + ((o_custkey + o_orderkey % 2) % 6)::int] AS category, (o_orderkey % 1000)::double AS area FROM orders WHERE o_custkey % 11 > 0)"""
Z = f"""z0 AS (SELECT o_orderkey AS parcel, (o_custkey + o_orderkey % 2 * 3) % 8 AS i FROM orders WHERE o_custkey % 5 > 0 UNION ALL SELECT o_orderkey, (o_custkey + 1) % 8 FROM orders WHERE o_custkey % 5 > 0 AND o_orderkey % 4 = 0),
z AS (SELECT parcel, ({_LIST(ZONES)})[1 + i::int] AS zone, ({_LIST(CODES)})[1 + i::int] AS code, parcel % 3 = 0 AS touch FROM z0)"""


@query(f"""WITH {P}, {Z}, n AS (SELECT k, count(*) AS parcels, count(*) FILTER (category = '임야') AS woods FROM p GROUP BY k),
g AS (SELECT k, zone, list_position({_LIST(ZONES[:4])}, zone) AS o, count(*) FILTER (NOT touch) AS a, count(*) FILTER (touch) AS b FROM p JOIN z USING (parcel) WHERE list_contains({_LIST(ZONES[:5])}, zone) GROUP BY ALL),
s AS (SELECT k, string_agg(zone || '(저촉 ' || a || '·접함 ' || b || ')', ' / ' ORDER BY o) FILTER (o > 0) AS classes, arg_min(zone, o) FILTER (o > 0) AS worst, coalesce(bool_or(zone = '산림보호구역'), false) AS other FROM g GROUP BY k)
SELECT c_custkey, worst, coalesce(classes, '') AS classes, CASE WHEN other THEN '산림보호구역' ELSE '' END AS others, coalesce(parcels, 0) AS parcels, coalesce(woods, 0) AS woods,
CASE worst WHEN '보전산지' THEN 'IMPOSSIBLE' WHEN '준보전산지' THEN 'POSSIBLE' ELSE CASE WHEN worst IS NULL THEN 'UNKNOWN' ELSE 'CONDITIONAL' END END AS status,
CASE worst WHEN '공익용산지' THEN 'CRITICAL' WHEN '임업용산지' THEN 'HIGH' WHEN '보전산지' THEN 'CRITICAL' WHEN '준보전산지' THEN 'LOW' ELSE 'MEDIUM' END AS difficulty,
CASE WHEN worst IS NULL THEN 'LOW' ELSE 'MEDIUM' END AS confidence, CASE WHEN worst IS NOT NULL THEN '' WHEN parcels IS NULL THEN 'NO_PARCELS' WHEN woods > 0 THEN 'WOODS_NOT_READ' ELSE 'NO_DATA' END AS why
FROM customer LEFT JOIN n ON n.k = c_custkey LEFT JOIN s ON s.k = c_custkey""")
def forest_class_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hardest class of forest land on each site, with one stored rule before the fallback."""
    stored = spark.range(1).select(F.lit("산지구분").alias("layer"), F.lit("보전산지").alias("grade"), F.lit("IMPOSSIBLE").alias("status"), F.lit("CRITICAL").alias("difficulty"))
    found = checks.forest_class(_sites(spark, sf_dir), _parcels(spark, sf_dir), _zones(spark, sf_dir), SITE, stored)
    return found.drop("item").withColumn("others", F.array_join("others", "|"))


@query(f"""WITH {P}, {Z}, g AS (SELECT k, zone, min(code) AS code, count(*) FILTER (NOT touch) AS a FROM p JOIN z USING (parcel) WHERE code NOT LIKE 'UFM%' GROUP BY k, zone),
h AS (SELECT *, code LIKE 'UQ%' AS f, CASE WHEN code LIKE 'UQ%' THEN NULL WHEN zone = '수변구역' THEN 1 WHEN contains(zone, '보호구역') THEN 2 END AS hit FROM g),
s AS (SELECT k, count(*) FILTER (NOT f) AS zones, count(*) FILTER (f) AS facilities, count(hit) AS hits, max(hit) AS top, min(zone) FILTER (hit = 2) AS high, string_agg(zone, '|' ORDER BY a DESC, zone) FILTER (NOT f) AS names FROM h GROUP BY k)
SELECT c_custkey, coalesce(zones, 0) AS zones, coalesce(facilities, 0) AS facilities, coalesce(hits, 0) AS hits, CASE top WHEN 2 THEN high WHEN 1 THEN '수변구역' END AS worst, coalesce(names, '') AS names,
CASE WHEN zones IS NULL THEN 'UNKNOWN' WHEN top IS NULL THEN 'POSSIBLE' ELSE 'CONDITIONAL' END AS status, CASE WHEN zones IS NULL THEN 'MEDIUM' WHEN top IS NULL THEN 'LOW' WHEN top = 1 THEN 'MEDIUM' ELSE 'HIGH' END AS difficulty,
CASE WHEN zones IS NULL THEN 'LOW' ELSE 'MEDIUM' END AS confidence, CASE WHEN zones IS NULL THEN 'NO_DATA' ELSE '' END AS why FROM customer LEFT JOIN s ON k = c_custkey""")
def land_zone_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All other zones of each site's parcels, by the first rule that each name matches."""
    found = checks.land_zones(_sites(spark, sf_dir), _parcels(spark, sf_dir), _zones(spark, sf_dir), RULES, SITE)
    return found.drop("item").withColumn("names", F.array_join("names", "|"))


def _owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "orders").where("o_custkey % 7 > 0 AND o_orderkey % 3 > 0")
    return records.select(F.col("o_orderkey").alias("parcel"), _pick(OWNERS, "CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 4 ELSE 0 END").alias("owner"))


@query(f"""WITH {P}, r AS (SELECT p.*, CASE WHEN k % 7 > 0 AND parcel % 3 > 0 THEN ({_LIST(OWNERS)})[1 + CASE WHEN parcel % 5 = 0 THEN k % 4 ELSE 0 END] END AS owner FROM p),
s AS (SELECT k, count(owner) AS n, count(*) FILTER (owner = '국유지') AS pub, count(*) FILTER (owner = '외국정부') AS un, count(*) FILTER (owner IS NULL AND category IN ('도로', '잡종지')) AS likely, coalesce(sum(area) FILTER (owner IS NULL AND category IN ('도로', '잡종지')), 0) AS likely_m2 FROM r GROUP BY k)
SELECT c_custkey, coalesce(n, 0) AS read, coalesce(pub, 0) AS public, coalesce(un, 0) AS unclear, coalesce(likely, 0) AS likely, coalesce(likely_m2, 0) AS likely_m2,
CASE WHEN coalesce(n, 0) = 0 THEN 'UNKNOWN' WHEN pub > 0 THEN 'CONDITIONAL' WHEN un > 0 THEN 'UNKNOWN' ELSE 'POSSIBLE' END AS status, CASE WHEN coalesce(n, 0) = 0 THEN 'MEDIUM' WHEN pub > 0 THEN 'HIGH' ELSE 'LOW' END AS difficulty,
CASE WHEN coalesce(n, 0) = 0 THEN 'LOW' ELSE 'MEDIUM' END AS confidence, CASE WHEN n IS NULL THEN 'NO_PARCELS' WHEN n = 0 THEN 'NO_DATA' WHEN pub = 0 AND un > 0 THEN 'UNCLEAR_OWNER' ELSE '' END AS why FROM customer LEFT JOIN s ON k = c_custkey""")
def ownership_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose land the parcels of each site are, and what no record tells of."""
    return checks.ownership(_sites(spark, sf_dir), _parcels(spark, sf_dir), _owners(spark, sf_dir), SITE).drop("item")


@query(f"""WITH {P}, s AS (SELECT k, count(*) AS n, sum(area) AS m2, sum(CASE WHEN category IN ('임야', '잡종지', '목장용지') THEN area ELSE 0 END) AS o, sum(CASE WHEN category IN ('전', '대') THEN area ELSE 0 END) AS c, bool_or(category IN ('전', '대')) AS any_c FROM p GROUP BY k),
b AS (SELECT k, string_agg(category, '|' ORDER BY m2 DESC, category) AS categories FROM (SELECT k, category, sum(area) AS m2 FROM p GROUP BY ALL) GROUP BY k)
SELECT c_custkey, coalesce(n, 0) AS parcels, coalesce(m2, 0) AS m2, coalesce(c, 0) AS converted_m2, coalesce(o / nullif(m2, 0), 0) AS share, coalesce(categories, '') AS categories,
CASE WHEN n IS NULL THEN 'UNKNOWN' WHEN any_c OR coalesce(o / nullif(m2, 0), 0) < 0.5 THEN 'CONDITIONAL' ELSE 'POSSIBLE' END AS status, CASE WHEN n IS NULL OR any_c OR coalesce(o / nullif(m2, 0), 0) < 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS difficulty,
CASE WHEN n IS NULL THEN 'LOW' ELSE 'MEDIUM' END AS confidence, CASE WHEN n IS NULL THEN 'NO_PARCELS' ELSE '' END AS why FROM customer LEFT JOIN s ON s.k = c_custkey LEFT JOIN b ON b.k = c_custkey""")
def parcel_use_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the land of each site can be used for, by categories of its parcels."""
    return checks.parcel_use(_sites(spark, sf_dir), _parcels(spark, sf_dir), SITE).drop("item").withColumn("categories", F.array_join("categories", "|"))


GRADES = (9, 3, 2, 1, 3)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of a graded map; sites of one remainder are only touched, of another have none."""
    orders = table(spark, sf_dir, "orders").where("o_custkey % 6 > 0")
    grade = F.get(F.array(*map(F.lit, GRADES)), F.expr("int((o_custkey % 5 + o_orderkey % 2) % 5)"))
    return orders.select(F.col("o_custkey").alias(SITE), grade.alias("grade"), F.when(F.col("o_custkey") % 6 == 1, 0.0).otherwise((F.col("o_orderkey") % 100).cast("double")).alias("m2"))


@query("""WITH g AS (SELECT o_custkey AS k, ([9, 3, 2, 1, 3])[1 + ((o_custkey % 5 + o_orderkey % 2) % 5)::int] AS grade, sum(CASE WHEN o_custkey % 6 = 1 THEN 0 ELSE o_orderkey % 100 END)::double AS m2 FROM orders WHERE o_custkey % 6 > 0 GROUP BY ALL),
s AS (SELECT k, min(grade) FILTER (m2 > 0) AS worst, arg_min(m2, grade) FILTER (m2 > 0) AS wm, sum(m2) AS m2 FROM g GROUP BY k),
d AS (SELECT k, string_agg(grade || ':' || round(g.m2 / s.m2 * 1000)::int, ' ' ORDER BY grade) AS spread FROM g JOIN s USING (k) WHERE g.m2 > 0 GROUP BY k)
SELECT c_custkey, worst, wm AS worst_m2, wm / nullif(c_custkey % 7 * 100000, 0) AS share, m2 / nullif(c_custkey % 7 * 100000, 0) AS covered, coalesce(spread, '') AS spread,
CASE worst WHEN 3 THEN 'POSSIBLE' WHEN 2 THEN 'IMPOSSIBLE' ELSE CASE WHEN worst IS NULL THEN 'UNKNOWN' ELSE 'CONDITIONAL' END END AS status,
CASE WHEN m2 IS NULL THEN 'MEDIUM' WHEN worst IS NULL OR worst = 3 THEN 'LOW' WHEN worst = 2 THEN 'HIGH' ELSE 'CRITICAL' END AS difficulty, CASE WHEN worst IS NULL THEN 'LOW' ELSE 'MEDIUM' END AS confidence, CASE WHEN m2 IS NULL THEN 'NO_DATA' ELSE '' END AS why
FROM customer LEFT JOIN s ON s.k = c_custkey LEFT JOIN d ON d.k = c_custkey""")
def ecology_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst grade of the ecology map on each site, with one stored rule before the table."""
    stored = spark.range(1).select(F.lit("생태자연도").alias("layer"), F.lit("2").alias("grade"), F.lit("IMPOSSIBLE").alias("status"), F.lit("HIGH").alias("difficulty"))
    found = checks.graded_map(_sites(spark, sf_dir), _pieces(spark, sf_dir), SITE, "area", "생태자연도", "생태자연도", checks.ECOLOGY, stored)
    told = F.transform("spread", lambda g: F.concat_ws(":", g["grade"].cast("string"), F.round(g["share"] * 1000).cast("int").cast("string")))
    return found.drop("item").withColumn("spread", F.array_join(told, " "))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as what lies near a site, with its distance; sites of one remainder have nothing."""
    orders, k, c = table(spark, sf_dir, "orders").where("o_custkey % 6 > 0"), F.col("o_orderkey"), F.col("o_custkey")
    code = F.when(k % 4 == 0, checks.LIMITED[0]).when(k % 4 == 1, "other").otherwise(checks.LISTED[0])
    return orders.select(c.alias(SITE), code.alias("code"), F.concat(F.lit("n"), k.cast("string")).alias("name"), F.when((k % 16 == 0) & (c % 2 == 0), 0.0).otherwise((300 + k * 7 % 5000).cast("double")).alias("distance_m"))


def _point_checks(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The checks of what lies near a site, of its land and of the sea, some of them not read."""
    sites, near, orders = _sites(spark, sf_dir), _near(spark, sf_dir), table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    lands = orders.where("o_custkey % 7 > 0").select(k.alias("parcel"), F.when(k % 64 == 0, "급경사").otherwise("평지").alias("terrain"), F.when(k % 96 == 1, "맹지").alias("road"))
    pixels = orders.where("o_custkey % 6 > 1").select(c.alias(SITE), ((c % 6 == 3) | ((c % 6 == 4) & (k % 2 == 0))).alias("hit"))
    swept = orders.where("o_custkey % 6 > 2").select(c.alias(SITE), F.lit(100.0).alias("m2"), F.when((c % 6 == 5) & (k % 32 == 0), F.lit(None)).otherwise(F.when((c % 6 == 4) & (k % 8 == 0), 25.0).otherwise(0.0)).alias("sea_m2"))
    causes = sites.where(f"{SITE} % 13 = 0").select(SITE, F.lit(checks.NATURE).alias("item"))
    nature = checks.protected_nature(sites, near.where("code = 'other'"), SITE, "radius")
    return [
        checks.heritage(sites, near, SITE), checks.failed(nature, SITE, checks.NATURE, causes), checks.habitats(sites, pixels, SITE),
        checks.sea_share(sites, swept, SITE), checks.land_character(sites, spread(_parcels(spark, sf_dir), "parcel"), spread(lands, "parcel"), SITE),
    ]


N = """n AS (SELECT o_custkey AS k, o_orderkey % 4 AS m, 'n' || o_orderkey AS name, CASE WHEN o_orderkey % 16 = 0 AND o_custkey % 2 = 0 THEN 0 ELSE 300 + o_orderkey * 7 % 5000 END::double AS d FROM orders WHERE o_custkey % 6 > 0)"""
POINTS = f"""{N}, h AS (SELECT k, count(*) FILTER (m > 1) AS listed, count(*) FILTER (m = 0 AND d = 0) AS inside FROM n WHERE m <> 1 GROUP BY k),
t AS (SELECT k, count(*) FILTER (d <= k % 4 * 250) AS within FROM n WHERE m = 1 GROUP BY k),
b AS (SELECT o_custkey AS k, count(*) FILTER (o_custkey % 6 = 3 OR (o_custkey % 6 = 4 AND o_orderkey % 2 = 0)) AS hits FROM orders WHERE o_custkey % 6 > 1 GROUP BY ALL),
w AS (SELECT o_custkey AS k, bool_or(o_custkey % 6 = 4 AND o_orderkey % 8 = 0) AS sea, bool_or(o_custkey % 6 = 5 AND o_orderkey % 32 = 0) AS gone FROM orders WHERE o_custkey % 6 > 2 GROUP BY ALL),
l AS (SELECT o_custkey AS k, o_custkey % 7 > 0 AS read, bool_or(o_orderkey % 64 = 0 OR o_orderkey % 96 = 1) AS bad FROM orders WHERE o_custkey % 11 > 0 GROUP BY ALL),
v AS (SELECT c_custkey, '{judgements.HERITAGE}' AS item, CASE WHEN h.k IS NULL THEN ['POSSIBLE', 'LOW', 'MEDIUM', ''] WHEN inside > 0 THEN ['CONDITIONAL', 'CRITICAL', 'MEDIUM', ''] ELSE ['CONDITIONAL', 'HIGH', 'MEDIUM', ''] END AS r FROM customer LEFT JOIN h ON h.k = c_custkey
UNION ALL SELECT c_custkey, '{checks.NATURE}', CASE WHEN c_custkey % 13 = 0 THEN ['UNKNOWN', 'MEDIUM', 'LOW', 'FETCH'] WHEN within > 0 THEN ['CONDITIONAL', 'HIGH', 'MEDIUM', ''] ELSE ['POSSIBLE', 'LOW', 'MEDIUM', ''] END FROM customer LEFT JOIN t ON t.k = c_custkey
UNION ALL SELECT c_custkey, '{checks.BIRDS}', CASE WHEN b.k IS NULL THEN ['UNKNOWN', 'MEDIUM', 'LOW', 'NO_DATA'] WHEN hits = 0 THEN ['POSSIBLE', 'LOW', 'MEDIUM', ''] ELSE ['CONDITIONAL', 'HIGH', 'MEDIUM', ''] END FROM customer LEFT JOIN b ON b.k = c_custkey
UNION ALL SELECT c_custkey, '{checks.SEA}', CASE WHEN w.k IS NULL THEN ['UNKNOWN', 'MEDIUM', 'LOW', 'NO_DATA'] WHEN sea THEN ['CONDITIONAL', 'HIGH', 'LOW', ''] WHEN gone THEN ['UNKNOWN', 'MEDIUM', 'LOW', 'FETCH'] ELSE ['POSSIBLE', 'LOW', 'MEDIUM', ''] END FROM customer LEFT JOIN w ON w.k = c_custkey
UNION ALL SELECT c_custkey, '{checks.LAND_ITEM}', CASE WHEN l.k IS NULL THEN ['UNKNOWN', 'MEDIUM', 'LOW', 'NO_PARCELS'] WHEN NOT read THEN ['UNKNOWN', 'MEDIUM', 'LOW', 'NO_DATA'] WHEN bad THEN ['CONDITIONAL', 'MEDIUM', 'LOW', ''] ELSE ['POSSIBLE', 'LOW', 'LOW', ''] END FROM customer LEFT JOIN l ON l.k = c_custkey)"""


@query(f"WITH {POINTS} SELECT c_custkey, item, r[1] AS status, r[2] AS difficulty, r[3] AS confidence, r[4] AS why FROM v")
def point_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heritage, protected nature, habitats, sea and land of each site, a row each; one check was not read everywhere."""
    first, *others = [c.select(SITE, "item", "status", "difficulty", "confidence", "why") for c in _point_checks(spark, sf_dir)]
    for other in others:
        first = first.unionByName(other)
    return first


@query(f"""WITH {POINTS}, x AS (SELECT *, CASE r[1] WHEN 'POSSIBLE' THEN 0 WHEN 'CONDITIONAL' THEN 12 ELSE 6 END + CASE r[2] WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 4 WHEN 'HIGH' THEN 9 ELSE 18 END AS weight FROM v),
a AS (SELECT c_custkey, count(*) FILTER (r[1] = 'CONDITIONAL') AS c, count(*) FILTER (r[1] = 'UNKNOWN') AS u, coalesce(max(weight) FILTER (r[1] <> 'POSSIBLE'), 0) AS worst, count(*) FILTER (r[1] = 'UNKNOWN' OR (r[3] = 'LOW' AND r[1] <> 'POSSIBLE')) AS gaps FROM x GROUP BY c_custkey)
SELECT c_custkey, greatest(0, least(100, 100 - (worst + 3 * greatest(0, c - 1) + 2 * u)))::int AS score, CASE WHEN c + u = 0 THEN 'POSSIBLE' WHEN u > 0 AND 2 * u >= c + u THEN 'UNKNOWN' ELSE 'CONDITIONAL' END AS grade, u AS unknowns, gaps FROM a""")
def checked_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and grade of each site from the rows that the checks made, not from planted ones."""
    rows = evaluation.gathered([c.withColumn("no", F.lit(i)) for i, c in enumerate(_point_checks(spark, sf_dir))], SITE)
    return evaluation.summary(rows, SITE).select(SITE, "score", "grade", "unknowns", "gaps")
