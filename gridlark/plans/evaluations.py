"""Whole evaluations of planted sites, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators import evaluation, judgements
from gridlark.plans.registry import query, table

STATUSES, DIFFICULTIES = ("POSSIBLE", "CONDITIONAL", "UNKNOWN", "POSSIBLE", "IMPOSSIBLE", "POSSIBLE", "CONDITIONAL"), ("LOW", "MEDIUM", "HIGH", "CRITICAL")
#: (no, step, condition, family, needs)
STEPS = [
    (1, "허가", None, None, []), (2, "농지", "FARMLAND", None, ["허가"]), (3, "산지", "FOREST", None, ["허가"]), (4, "재해", evaluation.BY_AREA, None, ["허가"]),
    (5, "개발", "NON_URBAN_AREA", None, ["농지", "산지"]), (6, "해제", "GREENBELT", None, ["개발"]), (7, "착공", None, None, ["개발", "해제", "재해"]),
]


def _checks(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three checks of every supplier: two layers and its parcels, and a third that knows little."""
    base, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    status = lambda n: F.get(F.array(*map(F.lit, STATUSES)), ((k + n * 3) % len(STATUSES)).cast("int")).alias("status")
    difficulty = lambda n: F.get(F.array(*map(F.lit, DIFFICULTIES)), ((k + n) % 4).cast("int")).alias("difficulty")
    layer = lambda n, code: base.select("s_suppkey", F.lit(n).alias("no"), F.lit(f"layer {n}").alias("item"), F.lit(code).alias("code"), status(n), difficulty(n), F.when(k % 5 == n, "LOW").otherwise("HIGH").alias("confidence"))
    lands = base.select("s_suppkey", F.lit(2).alias("no"), F.lit(judgements.PARCELS).alias("item"), status(2), difficulty(2), F.when(k % 2 == 0, F.array(F.lit("임야"))).alias("categories"))
    other = base.select("s_suppkey", F.lit(3).alias("no"), F.lit("other").alias("item"), status(3), difficulty(3), F.lit("not read").alias("reason"), F.lit("ask").alias("action"))
    return [layer(0, "농업진흥지역"), layer(1, "개발제한구역"), lands, other]


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = evaluation.gathered(_checks(spark, sf_dir), "s_suppkey")
    sites = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 9 * 2500).cast("double").alias("area"))
    catalogue = spark.createDataFrame(STEPS, "no int, step string, condition string, family string, needs array<string>")
    return evaluation.evaluated(items, sites, "s_suppkey", "area", catalogue, False)


_PICK = lambda values, at: f"([{', '.join(repr(v) for v in values)}])[1 + ({at})::int]"
ITEMS = f"""i AS (SELECT s_suppkey AS k, n, CASE WHEN n < 2 THEN 'layer ' || n WHEN n = 2 THEN '{judgements.PARCELS}' ELSE 'other' END AS item, {_PICK(STATUSES, f's_suppkey % {len(STATUSES)}').replace(f's_suppkey % {len(STATUSES)}', f'(s_suppkey + n * 3) % {len(STATUSES)}')} AS status,
  {_PICK(DIFFICULTIES, '(s_suppkey + n) % 4')} AS difficulty, n < 2 AND s_suppkey % 5 = n AS low FROM supplier, (SELECT unnest(range(0, 4)) AS n)),
w AS (SELECT *, CASE status WHEN 'POSSIBLE' THEN 0 WHEN 'CONDITIONAL' THEN 12 WHEN 'IMPOSSIBLE' THEN 100 ELSE 6 END + CASE difficulty WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 4 WHEN 'HIGH' THEN 9 ELSE 18 END AS weight,
  CASE WHEN status = 'UNKNOWN' THEN '[' || item || '] ' || CASE WHEN n = 3 THEN 'not read → ask' ELSE ' → ' END WHEN low AND status <> 'POSSIBLE' THEN '[' || item || '] {evaluation.UNPROVED}' END AS gap FROM i),
f AS (SELECT k, bool_or(n = 0 AND status <> 'POSSIBLE') AS farm, bool_or(n = 1 AND status <> 'POSSIBLE') AS green, k % 2 = 0 AS forest, k % 9 * 2500 AS area FROM i GROUP BY k)"""


@query(f"""WITH {ITEMS}, a AS (SELECT k, count(*) FILTER (status = 'IMPOSSIBLE') AS b, count(*) FILTER (status = 'CONDITIONAL') AS c, count(*) FILTER (status = 'UNKNOWN') AS u, coalesce(max(weight) FILTER (status IN ('CONDITIONAL', 'UNKNOWN')), 0) AS worst,
  count(gap) AS gaps, coalesce(string_agg(item, '|' ORDER BY item) FILTER (status = 'IMPOSSIBLE'), '') AS blockers, coalesce(string_agg(item, '|' ORDER BY item) FILTER (status = 'CONDITIONAL' AND difficulty = 'CRITICAL'), '') AS criticals FROM w GROUP BY k)
SELECT k AS s_suppkey, (CASE WHEN b > 0 THEN 0 ELSE greatest(0, least(100, 100 - (worst + 3 * greatest(0, c - 1) + 2 * u))) END)::int AS score, CASE WHEN b > 0 THEN 'IMPOSSIBLE' WHEN c + u = 0 THEN 'POSSIBLE' WHEN u > 0 AND 2 * u >= c + u THEN 'UNKNOWN' ELSE 'CONDITIONAL' END AS grade,
  u AS unknowns, gaps, blockers, criticals, array_to_string(list_filter([CASE WHEN farm THEN 'FARMLAND' END, CASE WHEN forest THEN 'FOREST' END, CASE WHEN green THEN 'GREENBELT' END, 'NON_URBAN_AREA'], lambda x: x IS NOT NULL), '|') AS flags FROM a JOIN f USING (k)""")
def site_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sites: score, grade, gaps, blockers and conditions from all checks together."""
    found, _ = _evaluated(spark, sf_dir)
    return found.select("s_suppkey", "score", "grade", "unknowns", "gaps", *[F.array_join(c, "|").alias(c) for c in ("blockers", "criticals", "flags")])


@query(f"""WITH {ITEMS}, o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE status WHEN 'IMPOSSIBLE' THEN 0 WHEN 'CONDITIONAL' THEN 1 WHEN 'UNKNOWN' THEN 2 ELSE 3 END, CASE difficulty WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 4 WHEN 'HIGH' THEN 9 ELSE 18 END DESC, n) AS place FROM w)
SELECT k AS s_suppkey, place::int AS place, item, status, gap FROM o""")
def ordered_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all checks of each site in the order in which they are shown, with what they leave open."""
    items = evaluation.gathered(_checks(spark, sf_dir), "s_suppkey")
    return evaluation.ordered(items, "s_suppkey").select("s_suppkey", "place", "item", "status", "gap")


@query(f"""WITH {ITEMS}, d AS (SELECT *, CASE WHEN farm OR forest THEN 2 ELSE 0 END AS dev, area >= 5000 AS asked FROM f), g AS (SELECT *, greatest(dev, CASE WHEN green THEN dev + 1 ELSE 0 END, CASE WHEN asked THEN 1 ELSE 0 END) + 1 AS last FROM d)
SELECT k AS s_suppkey, s.step, s.level::int AS level FROM g, LATERAL (SELECT unnest([{{step: '허가', level: 0}}, {{step: '농지', level: CASE WHEN farm THEN 1 END}}, {{step: '산지', level: CASE WHEN forest THEN 1 END}}, {{step: '재해', level: CASE WHEN asked THEN 1 END}}, {{step: '개발', level: dev}}, {{step: '해제', level: CASE WHEN green THEN dev + 1 END}}, {{step: '착공', level: last}}]) AS s)""")
def site_roadmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The permits of each site, from its conditions and its area, with their order."""
    _, steps = _evaluated(spark, sf_dir)
    return steps.select("s_suppkey", "step", "level")
