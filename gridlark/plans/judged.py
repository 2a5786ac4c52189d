"""Queries of ordinances, single judgements and zones of cells, each with its DuckDB SQL; texts and shapes are planted from the keys of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators import chunking, geometry, judgements, ordinances, retrieval
from gridlark.plans.registry import query, table

RULE = """CASE s_suppkey % 3
WHEN 0 THEN concat('(1) 10호 이상 취락지역으로부터 ', s_suppkey, ',000미터(단, 군도는 500미터) 이상 (2) 도로 경계로부터 ', s_suppkey, '미터, 울타리 높이 2미터 (3) 도로 경계로부터 9미터')
WHEN 1 THEN '가. 반경 안(반경 500미터 안에 10호 이상) 주택 1천미터' END"""


@query("""WITH k AS (SELECT s_suppkey AS k, s_suppkey % 3 AS m FROM supplier)
SELECT k AS s_suppkey, 'RESIDENTIAL' AS target, '10호이상취락지역으로부터' AS detail, k * 1000 AS metres FROM k WHERE m = 0 AND k > 0
UNION ALL SELECT k, 'RESIDENTIAL', CASE WHEN k > 0 THEN '10호이상취락지역으로부터(군도는)' ELSE '군도는' END, 500 FROM k WHERE m = 0
UNION ALL SELECT k, 'ROAD', '도로', CASE WHEN k > 0 THEN k ELSE 9 END FROM k WHERE m = 0
UNION ALL SELECT k, 'RESIDENTIAL', '반경 안 주택', 1000 FROM k WHERE m = 1
UNION ALL SELECT k, 'RESIDENTIAL', '호수산정반경(호 기준)', 500 FROM k WHERE m = 1""")
def ordinance_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances that planted ordinances ask to keep."""
    articles = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(RULE).alias("text"))
    return ordinances.distances(articles, "s_suppkey", "text").select("s_suppkey", "target", "detail", "metres")


#: Tables with the columns in either order, after one or two appendices, with notes below, and one head that names a single source.
COLUMNS = """CASE s_suppkey % 4
WHEN 0 THEN concat('[별표 3] 앞 [별표 ', s_suppkey, '] 구 분 태양에너지 설비 풍력에너지 설비 비고 도로 500미터 이상 이격 ', 1000 + s_suppkey, '미터 이상 이격 주거밀집지역 (5호 이상) ', 300 + s_suppkey, '미터 이상 이격 2,000미터 이상 이격 * 상기 학교 1미터 이상 이격 2미터 이상 이격')
WHEN 1 THEN concat('구분 풍력 설비 태양광 설비 철도 ', s_suppkey, 'm 이상 이격 ', s_suppkey * 2, 'm 이상 이격')
WHEN 2 THEN '구분 태양광 설비 도로 5미터 이상 이격 6미터 이상 이격' END"""


@query("""WITH k AS (SELECT s_suppkey AS k, s_suppkey % 4 AS m FROM supplier)
SELECT k AS s_suppkey, 0 AS row, k::varchar AS appendix, 'ROAD' AS target, '도로' AS detail, 1000 + k AS metres FROM k WHERE m = 0 UNION ALL SELECT k, 1, k::varchar, 'RESIDENTIAL', '주거밀집지역 (5호 이상)', 2000 FROM k WHERE m = 0
UNION ALL SELECT k, 0, NULL, 'RAILWAY', '철도', k FROM k WHERE m = 1""")
def two_column_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances for wind turbines in planted tables with a column for each energy source."""
    articles = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(COLUMNS).alias("text"))
    return ordinances.table_distances(articles, "s_suppkey", "text", "WIND").drop("sentence")


SLOPES = """CASE s_suppkey % 4
WHEN 0 THEN concat('풍력발전시설 평균경사도 ', 10 + s_suppkey % 20, '도 이하')
WHEN 1 THEN concat('태양광 시설은 경사도 12도 이하. ', repeat('가', 200), ' 풍력발전은 경사도가 ', s_suppkey % 50, '도 미만')
WHEN 2 THEN '태양광 경사도 15도' END"""


@query("""SELECT * FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 10 + s_suppkey % 20 WHEN 1 THEN CASE WHEN s_suppkey % 50 BETWEEN 5 AND 45 THEN s_suppkey % 50 END END AS degrees FROM supplier) WHERE degrees IS NOT NULL""")
def slope_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope limits for wind power in planted ordinances that also speak of others."""
    return ordinances.slope_limits(table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(SLOPES).alias("text")), "s_suppkey", "text", "WIND")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 50 THEN l_quantity::double END AS m, CASE WHEN l_linenumber < 7 THEN 10 + l_linenumber END AS k, l_tax > 0.01 AS r FROM lineitem),
v AS (SELECT *, CASE WHEN m IS NULL THEN 1 WHEN k IS NULL THEN 2 WHEN NOT r THEN 1 WHEN m - k >= 3 THEN 3 WHEN k - m >= 3 THEN 4 ELSE 5 END AS c FROM s)
SELECT l_orderkey, l_linenumber, ['UNKNOWN', 'UNKNOWN', 'IMPOSSIBLE', 'POSSIBLE', 'UNKNOWN'][c] AS status, ['MEDIUM', 'MEDIUM', 'CRITICAL', 'LOW', 'HIGH'][c] AS difficulty, ['NO_DATA', 'NO_CRITERIA', NULL, NULL, 'NO_CRITERIA'][c] AS why FROM v""")
def slope_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as mean slopes of sites, judged by limits."""
    mean, limit = F.when(F.col("l_quantity") < 50, F.col("l_quantity").cast("double")), F.when(F.col("l_linenumber") < 7, F.col("l_linenumber") + 10)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", judgements.slope(mean, limit, F.col("l_tax") > 0.01).alias("v")).select("l_orderkey", "l_linenumber", "v.status", "v.difficulty", "v.why")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 1, 3) OR (p_partkey % 6 = 2 AND p_size % 7 > 0) THEN 'CONDITIONAL' END AS status,
CASE p_partkey % 6 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 3 THEN 'CRITICAL' WHEN 2 THEN CASE WHEN p_size % 7 = 0 THEN 'MEDIUM' WHEN p_size % 7 <= 3 THEN 'CRITICAL' ELSE 'HIGH' END ELSE 'MEDIUM' END AS difficulty FROM part""")
def military_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as military zones by code and name."""
    k = (F.col("p_partkey") % 6).cast("int")
    code = F.get(F.array(*map(F.lit, ["UNE110", "UNE120", "UNE400", "UNE410", "UNE430", None])), k)
    name = F.get(F.array(F.lit(""), F.lit(""), F.expr("concat('비행안전 제 ', p_size % 7, '구역')"), F.lit("항공작전기지"), F.lit("기타"), F.lit(None)), k)
    return table(spark, sf_dir, "part").select("p_partkey", judgements.military_zone(code, name).alias("v")).select("p_partkey", "v.status", "v.difficulty")


@query("""WITH s AS (SELECT o_custkey AS k, o_totalprice::double / 10 AS d, CASE o_orderkey % 3 WHEN 0 THEN 154000 WHEN 1 THEN 22900 END AS v, (o_orderkey % 5 * 1000)::double AS st, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 60 * 1000)::double END AS li FROM orders),
n AS (SELECT k, min(d) AS a, min(d) FILTER (v >= 154000) AS h, min({'d': d, 's': st, 'l': li}) FILTER (li IS NOT NULL) AS f FROM s GROUP BY k),
j AS (SELECT c_custkey, a, h, f, c_custkey % 50 * 1000 AS need FROM customer LEFT JOIN n ON k = c_custkey),
c AS (SELECT c_custkey, CASE WHEN f IS NOT NULL AND need > 0 AND f.s <= 0 THEN 1 WHEN f IS NOT NULL AND need > 0 AND f.l < need THEN 2 WHEN a IS NULL THEN 3 WHEN a <= 10000 AND h <= 10000 THEN 4 WHEN a <= 25000 THEN 5 ELSE 2 END AS c FROM j)
SELECT c_custkey, ['CONDITIONAL', 'CONDITIONAL', 'UNKNOWN', 'POSSIBLE', 'CONDITIONAL'][c] AS status, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'MEDIUM'][c] AS difficulty FROM c""")
def grid_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sites, their orders as substations around them."""
    k = F.col("o_orderkey")
    around = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        (F.col("o_totalprice").cast("double") / 10).alias("distance_m"),
        F.when(k % 3 == 0, 154_000).when(k % 3 == 1, 22_900).alias("voltage"),
        (k % 5 * 1000).cast("double").alias("station_kw"),
        F.when(k % 2 == 0, (k % 60 * 1000).cast("double")).alias("line_kw"),
    )
    return judgements.grid_connection(table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 50).alias("capacity_mw")), around, "c_custkey")


@query("""WITH i AS (SELECT o_custkey AS k, o_orderkey % 8 AS m, o_orderkey // 8 % 2 = 0 AS yes FROM orders),
f AS (SELECT k, bool_or(m = 0) AS land, bool_or(m = 0 AND k % 2 = 0 OR m = 3 AND yes) AS public, bool_or(m = 1 AND yes) AS park, bool_or(m = 2 AND yes) AS forest, bool_or(m = 4 AND yes) AS heritage, bool_or(m = 5) AS military, bool_or(m = 6 AND yes) AS urban FROM i GROUP BY k)
SELECT k AS o_custkey, array_to_string(list_filter([CASE WHEN land THEN 'FARMLAND' END, CASE WHEN forest OR NOT land THEN 'FOREST' END, CASE WHEN heritage THEN 'HERITAGE' END, CASE WHEN military THEN 'MILITARY' END,
CASE WHEN park THEN 'NATIONAL_PARK' END, CASE WHEN NOT urban THEN 'NON_URBAN_AREA' END, CASE WHEN public THEN 'PUBLIC_LAND' END, CASE WHEN land THEN 'ROAD' END, CASE WHEN urban THEN 'URBAN_AREA' END], lambda x: x IS NOT NULL), ',') AS flags FROM f""")
def site_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as checks of customers: the conditions that they bear out."""
    m, yes = (F.col("o_orderkey") % 8).cast("int"), F.floor(F.col("o_orderkey") / 8) % 2 == 0
    names = [judgements.PARCELS, "공원", "산지구분 판정", judgements.OWNERSHIP, judgements.HERITAGE, judgements.MILITARY, "용도", "기타"]
    items = table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.get(F.array(*map(F.lit, names)), m).alias("item"),
        F.when(m == 1, "국립자연공원").when(m == 6, judgements.URBAN).alias("code"),
        F.when(yes, "CONDITIONAL").otherwise("POSSIBLE").alias("status"),
        F.when(m == 0, F.array(F.lit("전"), F.lit("도로"), F.lit("대"))).alias("categories"),
        yes.alias("found"),
        (F.col("o_custkey") % 2 == 0).alias("public"),
        F.when(yes, 1).otherwise(0).alias("overlapping"),
    )
    return judgements.site_flags(items, "o_custkey", True).select("o_custkey", F.array_join("flags", ",").alias("flags"))


CORNERS = "SELECT s_suppkey, s_suppkey + 0.1::double AS x0, s_suppkey % 37 + 10.3::double AS a, s_suppkey % 23 + 7.2::double AS b FROM supplier"
PLACES = f"SELECT c.*, i::int AS i, j::int AS j, i * 5 + 2.5::double AS x, j * 5 + 2.5::double AS y FROM ({CORNERS}) c, range((x0 // 5)::bigint - 3, (x0 // 5)::bigint + 14) t(i), range(-3, 10) u(j)"


def _triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x0, a, b = k + F.lit(0.1), k % 37 + F.lit(10.3), k % 23 + F.lit(7.2)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array(point(x0, F.lit(0.0)), point(x0 + a, F.lit(0.0)), point(x0, b)).alias("ring"))


@query(f"SELECT s_suppkey, i, j FROM ({PLACES}) WHERE y > 0 AND y < b AND x >= x0 AND x < x0 + a - a * y / b")
def cells_of_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as triangles: the cells inside."""
    return geometry.cells_inside(_triangles(spark, sf_dir), "s_suppkey", "ring", 5.0)


@query(f"""SELECT s_suppkey, i, j FROM (SELECT *, greatest(0, least(1, (x - x0) / a)) AS t, greatest(0, least(1, y / b)) AS u, greatest(0, least(1, ((x - x0 - a) * -a + y * b) / (a * a + b * b))) AS w FROM ({PLACES}))
WHERE least(sqrt(pow(x0 + t * a - x, 2) + y * y), sqrt(pow(x0 - x, 2) + pow(u * b - y, 2)), sqrt(pow(x0 + a - w * a - x, 2) + pow(w * b - y, 2))) <= 8""")
def setback_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as triangles: the cells within eight metres of their edges."""
    return geometry.cells_near(_triangles(spark, sf_dir), "s_suppkey", "ring", 8.0, 5.0)


TABLED = "concat(coalesce(text, ''), chr(10), 'head', chr(10), '|a|b|', chr(10), '|--|--|', chr(10), repeat('|x|y|' || chr(10), 80), chr(10), 'after', chr(10), repeat('tail line' || chr(10), 60))"
ENDS = "[ \\t\\r\\n]"


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, string_split({TABLED}, chr(10)) AS l FROM documents),
r AS (SELECT doc_id, 0::bigint AS i, 1::bigint AS s, 0::bigint AS n, false AS t, 0::bigint AS a FROM l UNION ALL
 SELECT doc_id, i, CASE WHEN f THEN greatest(s, i - 2) ELSE s END, CASE WHEN f THEN list_sum([length(x) + 1 for x in l[greatest(s, i - 2):i]])::bigint ELSE n END, t, CASE WHEN f THEN s ELSE 0 END FROM
 (SELECT *, n >= 600 AND NOT t AS f FROM (SELECT r.doc_id, r.i + 1 AS i, s, n + length(l[r.i + 1]) + 1 AS n, CASE WHEN contains(l[r.i + 1], '|') AND contains(l[r.i + 1], '--') THEN true WHEN regexp_full_match(l[r.i + 1], '{ENDS}*') THEN false ELSE t END AS t, l FROM r JOIN l USING (doc_id) WHERE r.i < len(l)))),
c AS (SELECT doc_id, a AS s, i AS e FROM r WHERE a > 0 UNION ALL SELECT r.doc_id, s, i FROM r JOIN l ON r.doc_id = l.doc_id AND i = len(l)),
k AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY e, s) - 1)::int AS chunk_no, regexp_replace(array_to_string(l[s:e], chr(10)), '^{ENDS}+|{ENDS}+$', '', 'g') AS chunk FROM c JOIN l USING (doc_id))
SELECT doc_id, chunk_no, md5(chunk) AS chunk_md5 FROM k WHERE chunk <> ''""")
def chunk_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a table behind them, cut at lines but never inside the table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(TABLED).alias("text"))
    return chunking.table_chunks(docs, "doc_id", "text", 600).select("doc_id", "chunk_no", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


QUESTION = "CASE turn % 4 WHEN 0 THEN concat('대출 금리 ', conv_id) WHEN 1 THEN concat('PPA 보증 ', conv_id) WHEN 2 THEN concat('일정 ', conv_id) END"


@query(f"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN q || ' interest rate fees loan amount financing debt 새들바람' WHEN 1 THEN q || ' 보장공급량 보장 감소기준 발전시간 배상 재생에너지 전력거래 virtual 직접 ppa 새들바람|' || q || ' 새들바람 직접 PPA Virtual PPA 거래단가 기준가격 계약단가 정산단가 원/kWh'
WHEN 2 THEN q || ' 새들바람' ELSE '' END AS questions FROM (SELECT conv_id, turn, {QUESTION} AS q FROM conversations)""")
def question_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted questions and what is searched for them."""
    asked = table(spark, sf_dir, "conversations").select("conv_id", "turn", retrieval.expanded(F.expr(QUESTION), F.lit(" 새들바람 ")).alias("q"))
    return asked.select("conv_id", "turn", F.array_join("q", "|").alias("questions"))


@query("""WITH h AS (SELECT l_suppkey AS question, l_orderkey AS document, l_orderkey * 8 + l_linenumber AS chunk, CASE WHEN l_linenumber > 2 THEN l_orderkey * 8 END AS parent, l_extendedprice::double AS score FROM lineitem),
b AS (SELECT question, coalesce(parent, chunk) AS w, max({'s': score, 'c': -chunk, 'd': document}) AS b FROM h WHERE document IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY question, w),
p AS (SELECT *, (row_number() OVER (PARTITION BY question ORDER BY b.s DESC, w))::int AS place FROM b QUALIFY place <= 5)
SELECT question, CASE WHEN w % 8 = 0 AND w // 8 % 3 = 0 THEN -b.c ELSE w END AS chunk, b.d AS document, CASE WHEN w % 8 <> 0 THEN 'own ' || w WHEN w // 8 % 3 = 0 THEN 'own ' || -b.c ELSE 'whole ' || w // 8 END AS content, b.s AS score, place FROM p""")
def drafting_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as hits of their supplier's draft: later lines are children of their order's passage, and some passages and documents are gone."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    chunk = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    hits = lines.select(F.col("l_suppkey").alias("question"), F.col("l_orderkey").alias("document"), chunk.alias("chunk"), F.when(F.col("l_linenumber") > 2, F.col("l_orderkey") * 8).alias("parent"), F.col("l_extendedprice").cast("double").alias("score"))
    own = lines.select(chunk.alias("chunk"), F.concat(F.lit("own "), chunk).alias("content")).distinct()
    whole = orders.where("o_orderkey % 3 <> 0").select((F.col("o_orderkey") * 8).alias("chunk"), F.concat(F.lit("whole "), "o_orderkey").alias("content"))
    return retrieval.drafting_sources(hits, own.unionByName(whole), orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("document")), "question")
