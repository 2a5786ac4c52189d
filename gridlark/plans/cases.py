"""Queries of notices, the permit register and regional precedents, each with its DuckDB SQL; texts are planted from the keys of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators import notices
from gridlark.plans.registry import query, table

#: Disposals with equal reasons, small tables of hearings, labelled fields, and a single project without a reason.
NOTICE = """CASE s_suppkey % 4
WHEN 0 THEN concat('제 ', 100 + s_suppkey % 800, '차 전기위원회 처분일자 : 2023. 4. ', 1 + s_suppkey % 9, ' 사업명 설비용량(MW) 처분사유 영덕', s_suppkey, '풍력 발전사업 ㈜영덕 경북 영덕군 병곡면 1104-2번지 ', s_suppkey, '.5MW 2018-', 1 + s_suppkey % 99, ' 전기사업법 제12조제1항 제2호 해남', s_suppkey, ' 태양광 발전사업 동도에너지 전라남도 해남군 10.8 제2019-78호 상동 묘도 발전사업 묘도연료전지발전 제주특별자치도 ㎿ 3 2020 - 7 상동')
WHEN 1 THEN concat('당사자 허가번호 발전사업명 발전사업자 지역 2018-60 순천', s_suppkey, '풍력 발전사업 순천㈜ 전남 순천시 예정된 처분 취소 처분사유 미착공 ', s_suppkey, ' 청문 실시 당사자 허가번호 발전 사업명 발전사업자 지역 2019-3 가나태양광 발전사업 가나 강원특별자치도 철원군 예정된 처분 처분 사유 기타')
WHEN 2 THEN concat('⑴ 평산', s_suppkey, ' 발전사업 허가증 번호 2022 - ', 1 + s_suppkey % 99, ' 상호 폭풍㈜ 성명 김 사업장소 강원도 삼척시 도계읍 원동력의 종류 풍력 설비용량 1,020MW 처분사유 미착공 청문 ⑵ 번호없는 발전사업 상호 없음')
ELSE concat('하나', s_suppkey, ' 풍력 발전사업 회사 경남 거창군 49.8MW 2019년10월30일 (제2019-', 1 + s_suppkey % 99, '호)') END"""
NOTICE_TITLE = "CASE s_suppkey % 4 WHEN 1 THEN '청문 공고' WHEN 2 THEN '허가취소 청문' WHEN 3 THEN NULL ELSE '허가취소 처분' END"


@query("""WITH k AS (SELECT s_suppkey AS k, s_suppkey % 4 AS m, 1 + s_suppkey % 99 AS n, '2023-04-0' || (1 + s_suppkey % 9) AS d, (100 + s_suppkey % 800)::int AS r FROM supplier), law AS (SELECT '전기사업법 제12조제1항 제2호' AS l)
SELECT k AS s_suppkey, 1 AS no, 'DISPOSAL' AS kind, '영덕' || k || '풍력 발전사업' AS name, '㈜영덕' AS company, '경북 영덕군 병곡면 1104-2번지' AS location, '경북' AS province, '영덕군' AS district, 'WIND' AS source, k + 0.5::double AS megawatts, '2018-' || n AS permit, l AS reason, d AS disposed, r AS round FROM k, law WHERE m = 0
UNION ALL SELECT k, 2, 'DISPOSAL', '해남' || k || ' 태양광 발전사업', '동도에너지', '전라남도 해남군', '전남', '해남군', 'SOLAR', 10.8, '2019-78', l, d, r FROM k, law WHERE m = 0
UNION ALL SELECT k, 3, 'DISPOSAL', '묘도 발전사업', '묘도연료전지발전', '제주특별자치도 ㎿', '제주', '', 'OTHER', 3, '2020-7', l, d, r FROM k, law WHERE m = 0
UNION ALL SELECT k, 1, 'HEARING', '순천' || k || '풍력 발전사업', '순천㈜', '전남 순천시', '전남', '순천시', 'WIND', NULL, '2018-60', '미착공 ' || k, '', NULL FROM k WHERE m = 1
UNION ALL SELECT k, 2, 'HEARING', '가나태양광 발전사업', '가나', '강원특별자치도 철원군', '강원', '철원군', 'SOLAR', NULL, '2019-3', '기타', '', NULL FROM k WHERE m = 1
UNION ALL SELECT k, 1, 'HEARING', '평산' || k || ' 발전사업', '폭풍㈜', '강원도 삼척시 도계읍', '강원', '삼척시', 'WIND', 1020, '2022-' || n, '미착공', '', NULL FROM k WHERE m = 2
UNION ALL SELECT k, 1, 'DISPOSAL', '하나' || k || ' 풍력 발전사업', '회사', '경남 거창군', '경남', '거창군', 'WIND', 49.8, '2019-' || n, '', '', NULL FROM k WHERE m = 3""")
def cancellation_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as notices: the projects of disposals and of hearings in either layout."""
    papers = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(NOTICE_TITLE).alias("title"), F.expr(NOTICE).alias("text"))
    return notices.notices(papers, "s_suppkey", "title", "text")


@query("""SELECT p_partkey, (2000 + p_size)::int::varchar AS year, p_partkey::varchar AS no, '한국농어촌공사' AS company, CASE WHEN p_partkey % 2 = 0 THEN '경북영덕군병곡면' ELSE '강원특별자치도 삼척시 원덕읍 노경리 산 ' || (100000 + p_partkey) || '번지' END AS location,
CASE WHEN p_partkey % 2 = 0 THEN '경북' ELSE '강원' END AS province, CASE WHEN p_partkey % 2 = 0 THEN '영덕군' ELSE '삼척시' END AS district, 'WIND' AS source, '풍력' AS raw_source, p_size + 0.5::double AS megawatts,
'20' || lpad((p_size::int % 24)::varchar, 2, '0') || '-0' || (1 + p_partkey % 9) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '-05' END AS permitted, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '2027-11' END AS ready, CASE p_partkey % 4 WHEN 2 THEN '준비기간 연장' WHEN 3 THEN '양수 / 용량 변경' ELSE '' END AS changed
FROM part WHERE p_partkey % 7 <> 0""")
def register_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of a permit register, with heads between them and cells broken by the table's width."""
    k, number = F.col("p_partkey"), F.col("p_partkey").cast("string")
    size = F.col("p_size").cast("int")
    place = F.when(k % 2 == 0, "경북 영덕군 병곡 면").otherwise(F.concat(F.lit("강원특별자치도 삼척시\n원덕읍 노경리 산 "), (k + 100000).cast("string"), F.lit("번지")))
    day = F.concat(F.format_string("20%02d.%d", size % 24, (1 + k % 9).cast("int")), F.when(k % 3 == 0, "").otherwise(".5"))
    ready = lambda *more: F.array(F.lit(None).cast("string"), F.lit("2027.11"), *map(F.lit, more))
    rest = F.when(k % 4 == 0, F.array(F.lit(""), F.lit(" "))).when(k % 4 == 1, ready()).when(k % 4 == 2, ready("준비기간 연장")).otherwise(ready("양수", "", "용량 변경"))
    line = F.array(F.when(k % 7 == 0, "NO").otherwise((2000 + size).cast("string")), number, F.lit("한국농어촌공\n사"), place, F.lit("풍력"), F.concat(size.cast("string"), F.lit(".5")), day)
    return notices.register(table(spark, sf_dir, "part").select("p_partkey", F.concat(line, rest).alias("cells")), "p_partkey", "cells")


DISTRICTS, PROVINCES, SOURCES = ("영덕군", "삼척시", "해남군", "태안군", "가평군"), ("경북", "강원", "전남", "충남", "경기"), ("WIND", "SOLAR")
GROUPS = ("가결", "보류", "부결", "조건부")
_LIST = lambda names: f"[{', '.join(repr(n) for n in names)}]"


def _pick(names: tuple[str, ...], at: str) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.expr(f"int({at} % {len(names)})"))


@query(f"""WITH d AS (SELECT {_LIST(DISTRICTS)} AS ds, {_LIST(PROVINCES)} AS ps, {_LIST(SOURCES)} AS ss, {_LIST(GROUPS)} AS gs),
a AS (SELECT DISTINCT ps[1 + s_suppkey % 5] AS province, ds[1 + s_suppkey % 5] AS district, ss[1 + s_suppkey % 2] AS source FROM supplier, d),
p AS (SELECT ds[1 + o_orderkey % 4] AS district, ps[1 + o_orderkey % 4] AS province, ss[1 + o_custkey % 2] AS source, CASE WHEN o_orderkey % 7 > 0 THEN o_custkey % 100 + 0.5::double END AS mw, strftime(o_orderdate::date, '%Y-%m-%d') AS permitted, o_orderkey % 3 = 0 AS first FROM orders, d),
t AS (SELECT ['영덕', '삼척', '영덕 해남 영덕', '서울'][1 + p_partkey % 4] || ' 발전사업 허가(안)' AS title, ss[1 + p_size::int % 2] AS source, gs[1 + (p_partkey // 4) % 4] AS g, CASE WHEN p_partkey % 5 = 0 THEN '이유 ' || p_partkey ELSE '' END AS reason, p_size::int AS round FROM part, d),
c AS (SELECT ds[1 + c_custkey % 5] AS district, ss[1 + c_custkey % 2] AS source, '20' || (10 + c_custkey % 13) || '-01-01' AS day FROM customer, d),
h AS (SELECT a.district, a.source, g, reason, round, title FROM a JOIN t ON a.source = t.source AND contains(title, left(a.district, len(a.district) - 1))),
s AS (SELECT district, source, round, reason FROM h WHERE g IN ('보류', '부결') QUALIFY row_number() OVER (PARTITION BY district, source ORDER BY reason <> '' DESC, round DESC, title DESC, reason DESC) = 1),
pa AS (SELECT district, source, count(*) AS permits, count(*) FILTER (first) AS first_permits, coalesce(max(mw), 0) AS most_mw, round(coalesce(sum(mw), 0), 1) AS total_mw, max(permitted) AS latest FROM p GROUP BY ALL),
pr AS (SELECT province, source, count(*) AS n FROM p GROUP BY ALL), ca AS (SELECT district, source, count(*) AS n, max(day) AS day FROM c GROUP BY ALL),
ha AS (SELECT district, source, count(*) FILTER (g = '가결') AS passed, count(*) FILTER (g = '조건부') AS conditional, count(*) FILTER (g IN ('보류', '부결')) AS blocked FROM h GROUP BY ALL)
SELECT a.province, a.district, a.source, coalesce(permits, 0) AS permits, coalesce(first_permits, 0) AS first_permits, coalesce(most_mw, 0) AS most_mw, coalesce(total_mw, 0) AS total_mw, latest, coalesce(passed, 0) AS passed, coalesce(conditional, 0) AS conditional, coalesce(blocked, 0) AS blocked,
s.round AS blocked_round, s.reason AS blocked_reason, coalesce(ca.n, 0) AS cancelled, ca.day AS last_cancelled, coalesce(pr.n, 0) AS in_province
FROM a LEFT JOIN pa USING (district, source) LEFT JOIN pr ON pr.province = a.province AND pr.source = a.source LEFT JOIN ca ON ca.district = a.district AND ca.source = a.source LEFT JOIN ha ON ha.district = a.district AND ha.source = a.source LEFT JOIN s ON s.district = a.district AND s.source = a.source""")
def regional_precedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts of suppliers: what permits (orders), decisions (parts) and cancellations (customers) say of them."""
    asked = table(spark, sf_dir, "supplier").select(_pick(PROVINCES, "s_suppkey").alias("province"), _pick(DISTRICTS, "s_suppkey").alias("district"), _pick(SOURCES, "s_suppkey").alias("source"))
    k = F.col("o_orderkey")
    permits = table(spark, sf_dir, "orders").select(
        _pick(DISTRICTS[:4], "o_orderkey").alias("district"), _pick(PROVINCES[:4], "o_orderkey").alias("province"), _pick(SOURCES, "o_custkey").alias("source"),
        F.when(k % 7 > 0, F.col("o_custkey") % 100 + F.lit(0.5)).alias("megawatts"), F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd").alias("permitted"), F.when(k % 3 != 0, "연장").alias("changed"),
    )
    title = F.concat(_pick(("영덕", "삼척", "영덕 해남 영덕", "서울"), "p_partkey"), F.lit(" 발전사업 허가(안)"))
    reason = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("이유 "), F.col("p_partkey").cast("string")))
    decided = table(spark, sf_dir, "part").select(title.alias("title"), _pick(SOURCES, "p_size").alias("source"), _pick(GROUPS, "p_partkey div 4").alias("decision_group"), reason.alias("reason"), F.col("p_size").cast("int").alias("round"))
    gone = table(spark, sf_dir, "customer").select(_pick(DISTRICTS, "c_custkey").alias("district"), _pick(SOURCES, "c_custkey").alias("source"), F.format_string("20%d-01-01", (10 + F.col("c_custkey") % 13).cast("int")).alias("disposed"))
    found = notices.precedents(asked, permits, decided, gone)
    of = lambda g: F.coalesce(F.try_element_at("decisions", F.lit(g)), F.lit(0).cast("long"))
    return found.withColumn("passed", of("가결")).withColumn("conditional", of("조건부")).drop("decisions")
