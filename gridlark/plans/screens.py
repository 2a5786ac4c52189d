"""Queries of screening and its rankings, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators import rules, screening
from gridlark.plans.registry import query, table
from gridlark.plans.rulebook import ASKED

#: Every supplier has a parcel for each class of quantity.
CLASSES = 13
CELLS_SQL = f"SELECT DISTINCT l_suppkey * {CLASSES} + floor(l_quantity / 4)::bigint AS id, l_partkey % 200 AS x, l_orderkey % 50 AS y FROM lineitem"
GRADES_SQL = f"""WITH c AS ({CELLS_SQL}), p AS (SELECT id, CASE WHEN id % 6 = 0 THEN 'CATEGORY' END AS unfit FROM (SELECT s_suppkey * {CLASSES} + unnest(range(0, {CLASSES})) AS id FROM supplier)),
f AS (SELECT *, x < 150 AND x > 2 AS i, (x * 7 + y) % 397 = 0 AS park, x % 171 = 5 AND y < 25 AS water, (x + y * 3) % 89 = 0 AS farm, x % 101 = 0 AS blind FROM c),
g AS (SELECT id, count(*) FILTER (i) / count(*) AS inside, bool_or(park) AS park, bool_or(water) AS water, bool_or(farm) AS farm, bool_or(blind) AS blind FROM f GROUP BY id),
r AS (SELECT id, CASE WHEN unfit IS NOT NULL THEN 'NA' WHEN park OR water THEN 'IMPOSSIBLE' WHEN farm THEN 'CONDITIONAL' WHEN blind THEN 'UNKNOWN' ELSE 'POSSIBLE' END AS grade,
  list_filter([CASE WHEN unfit IS NOT NULL THEN unfit WHEN park THEN 'park' WHEN water THEN NULL WHEN farm THEN 'farm' WHEN blind THEN 'rules not read' END, CASE WHEN unfit IS NULL AND water THEN 'water' END,
  CASE WHEN inside < 0.995 THEN 'crosses the edge' END], lambda s: s IS NOT NULL) AS reasons, round(inside, 3) AS inside FROM g JOIN p USING (id) WHERE inside > 0)"""


def _grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    cells = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * CLASSES + F.floor(F.col("l_quantity") / 4)).alias("id"), (F.col("l_partkey") % 200).alias("x"), (F.col("l_orderkey") % 50).alias("y")).distinct()
    places = cells.select("x", "y").distinct()
    layer = lambda title, blocks, where: places.where(where).select(F.lit(title).alias("title"), F.lit(blocks).alias("blocks"), "x", "y")
    layers = layer("park", True, (x * 7 + y) % 397 == 0).unionByName(layer("water", True, (x % 171 == 5) & (y < 25))).unionByName(layer("farm", False, (x + y * 3) % 89 == 0))
    ids = table(spark, sf_dir, "supplier").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda n: F.col("s_suppkey") * CLASSES + n)).alias("id"))
    parcels = ids.select("id", F.when(F.col("id") % 6 == 0, "CATEGORY").alias("unfit"))
    return screening.parcel_grades(parcels, cells, places.where((x < 150) & (x > 2)), layers, places.where(x % 101 == 0))


@query(GRADES_SQL + " SELECT id, grade, array_to_string(reasons, ',') AS reasons, inside FROM r")
def parcel_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' classes of lines as parcels of cells, judged by three layers."""
    return _grades(spark, sf_dir)


@query(GRADES_SQL + " SELECT grade, count(*) AS n FROM r GROUP BY grade")
def screen_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parcels have which grade."""
    return _grades(spark, sf_dir).groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN 'HIGH' WHEN s + d >= 20 THEN 'HIGH' WHEN s + d >= 10 THEN 'MIDDLE' ELSE 'LOW' END AS impact
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 12 WHEN 2 THEN 100 ELSE 6 END AS s, CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 9 WHEN 3 THEN 18 ELSE 0 END AS d FROM part)""")
def impact_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as checks: how far they touch a project."""
    k = F.col("p_partkey")
    status, difficulty = F.array(*map(F.lit, screening.STATUS_PENALTY)), F.array(*map(F.lit, [*screening.DIFFICULTY_PENALTY, "NONE"]))
    return table(spark, sf_dir, "part").select("p_partkey", screening.impact(F.get(status, (k % 4).cast("int")), F.get(difficulty, (k % 5).cast("int"))).alias("impact"))


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, round(l_discount::double * 5 + CASE WHEN l_tax >= 0.05 THEN 0.15 ELSE 0 END, 6) AS rerank_score FROM lineitem),
r AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY rerank_score DESC, l_linenumber))::int AS rerank FROM h) SELECT * FROM r WHERE rerank <= 3""")
def reranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as hits of their order's question: the three best of a second scorer."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", F.col("l_tax").cast("double").alias("l_tax"))
    return screening.reranked(lines, "l_orderkey", "l_linenumber", F.col("l_discount").cast("double") * 5, "l_tax", 3).select("l_orderkey", "l_linenumber", "rerank_score", "rerank")


@query("SELECT p_brand, count(*) AS n, round(sum(p_size * 1.0::double), 2) AS area FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 47) GROUP BY p_brand")
def unsampled_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that the large lines leave out, by brand."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") * F.lit(1.0)).alias("area"))
    return screening.not_sampled(parts, table(spark, sf_dir, "lineitem").where("l_quantity > 47").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "p_brand", "area")


@query("""SELECT o_custkey, count(*) AS n, count(*) FILTER (f) AS n_farm, round(coalesce(sum(o_totalprice::double) FILTER (f), 0), 2) AS farm_m2, round(coalesce(sum(o_totalprice::double) FILTER (f), 0) / nullif(sum(o_totalprice::double), 0), 4) AS share
FROM (SELECT *, o_orderkey % 4 IN (0, 1) AS f FROM orders) GROUP BY o_custkey""")
def farmland_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as parcels of customers: how much is farmland."""
    names = F.array(*map(F.lit, ["전", "답", "임야", "대"]))
    parcels = table(spark, sf_dir, "orders").select("o_custkey", F.get(names, (F.col("o_orderkey") % 4).cast("int")).alias("category"), F.col("o_totalprice").cast("double").alias("area"))
    return screening.farmland_share(parcels, "o_custkey", "category", "area")


@query("""SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END DESC NULLS LAST, o_orderkey))::int AS place FROM orders) WHERE place <= 4""")
def latest_precedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four latest orders of every customer; some have no day."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("day"))
    return screening.latest_first(rows, "o_custkey", "day", "o_orderkey", 4).select("o_custkey", "o_orderkey", "place")


PROJECTS = {"가람": ["가람 1단계", "가람 2단계"], "EPC": ["전체", "가람 1단계"], "주주간": ["모회사"]}


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 6 = 0 THEN '가람 1단계' WHEN conv_id % 6 = 2 THEN '모회사' ELSE '' END AS projects FROM conversations WHERE text IS NOT NULL""")
def question_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects that every turn, read as a question, names."""
    asked = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.expr(ASKED).alias("q"))
    found = screening.known_projects(F.col("q"), rules.question_filters(F.col("q"))["stage"], PROJECTS)
    return asked.select("conv_id", "turn", F.array_join(found, ",").alias("projects"))
