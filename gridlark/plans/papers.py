"""Queries of committee papers, contracts and ordinances, each with its DuckDB SQL; texts are planted from the keys of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators import clauses, committee
from gridlark.plans.registry import query, spread, table

SECTION = """CASE s_suppkey % 3
WHEN 0 THEN concat('심의 결과 1. ㈜회사', s_suppkey, '의 사천 태양광발전사업 허가(안) ※ (사유) 이유 설명 ', s_suppkey, ' 2. (주)빛', s_suppkey, ' 풍력발전사업 변경허가 ( ) ')
WHEN 1 THEN concat('결과 - 궁항', s_suppkey, '발전(주)의 태안 연료전지 사업 양수, - 짧음 - 집단에너지 사업 연장 건 ')
ELSE concat('ㅇ 기본공급약관 ', s_suppkey, ' 취소 ( )') END"""


@query("""WITH k AS (SELECT s_suppkey AS k, s_suppkey % 3 AS m FROM supplier)
SELECT k AS s_suppkey, 1 AS no, '㈜회사' || k AS company, '사천 태양광발전사업 허가(안)' AS title, 'SOLAR' AS source, 'NEW' AS kind, '사천' AS region, '이유 설명 ' || k AS reason FROM k WHERE m = 0
UNION ALL SELECT k, 2, '(주)빛' || k, '풍력발전사업 변경허가', 'WIND', 'CHANGE', '', '' FROM k WHERE m = 0
UNION ALL SELECT k, 1, '궁항' || k || '발전(주)', '태안 연료전지 사업 양수', 'FUELCELL', 'TRANSFER', '태안', '' FROM k WHERE m = 1
UNION ALL SELECT k, 3, '', '집단에너지 사업 연장 건', 'THERMAL', 'EXTEND', '', '' FROM k WHERE m = 1
UNION ALL SELECT k, 1, '', '기본공급약관 ' || k || ' 취소', 'OTHER', 'CANCEL', '', '' FROM k WHERE m = 2""")
def agenda_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of committee results as agenda rows."""
    sections = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(SECTION).alias("section"))
    return committee.agenda(committee.items(sections, "section"), "raw").select("s_suppkey", "no", "company", "title", "source", "kind", "region", "reason")


@query("""SELECT s_suppkey, s_suppkey % 10 AS round, CASE s_suppkey % 4 WHEN 3 THEN '' WHEN 2 THEN '짧은 글 ' || s_suppkey ELSE repeat('긴', 20) || '짧은 글 ' || s_suppkey || chr(10) || chr(10) || '다른 글' END AS minutes FROM supplier""")
def minutes_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes beside results: alike titles, contained texts once."""
    k = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier").select(k, (k % 10).alias("round"), F.lit("허가").alias("verdict"), k.alias("no"))
    results = base.withColumn("title", F.expr("concat('사천 태양광 발전사업 ', s_suppkey, ' 허가')"))
    short = F.expr("concat('짧은 글 ', s_suppkey)")
    texts = F.when(k % 4 == 2, F.array(short)).otherwise(F.array(short, F.expr("concat(repeat('긴', 20), '짧은 글 ', s_suppkey)"), F.lit("다른 글"), F.lit("")))
    other = F.when(k % 4 == 3, "전혀 무관한 안건").otherwise(F.expr("concat('사천태양광 발전 사업', s_suppkey)"))
    minutes = base.select("round", "verdict", "no", other.alias("title"), F.explode(F.concat(texts, texts)).alias("text"))
    return committee.minutes_beside(results, minutes, ["round", "verdict", "no"], "title", "text").select("s_suppkey", "round", "minutes")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '허가' WHEN 1 THEN '조건부 허가' WHEN 2 THEN '심의 보류' WHEN 3 THEN '수정의결' WHEN 4 THEN '부결' ELSE '기타' END AS decision,
CASE p_partkey % 6 WHEN 0 THEN '가결' WHEN 1 THEN '조건부' WHEN 2 THEN '보류' WHEN 3 THEN '가결' WHEN 4 THEN '부결' ELSE '' END AS grp,
CASE WHEN p_partkey % 2 = 0 THEN '한국농어촌공사' || p_size ELSE '한국 농어촌 공 사 와 함께 하는 긴 이름의 사업 ' || p_size END AS cell,
CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 1000.0::double + p_size + 0.5 ELSE p_size::double END AS megawatts FROM part""")
def paper_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions, cells of tables and capacities as papers write them."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    names = F.array(*map(F.lit, ["허가 기준 충족", "조건부 허가", "허가 심의보류", "원안 수정의결", "부결", "기타"]))
    named = committee.decision(F.get(names, (k % 6).cast("int")))
    cell = F.when(k % 2 == 0, F.concat(F.lit(" 한국농어촌공  사"), size)).otherwise(F.concat(F.lit("한국 농어촌 공 사 와 함께 하는 긴 이름의  사업 "), size))
    power = F.when(k % 3 == 1, F.format_string("약 1,0%02d.5 MW (2기)", F.col("p_size").cast("int"))).when(k % 3 == 2, F.concat(F.lit("총"), size, F.lit("MW"))).otherwise("미정")
    return table(spark, sf_dir, "part").select("p_partkey", named.alias("decision"), committee.decision_group(named).alias("grp"), committee.squeezed(cell).alias("cell"), committee.capacity(power).alias("megawatts"))


CONTRACT = "concat('계약서 ', s_suppkey, chr(10), chr(10), '제 ', s_suppkey, ' 조 (정의)', chr(10), '① 가', chr(10), '② 나', chr(10), 'Article 7 [Term]', chr(10), '1. one', chr(10), '별표 첫째', chr(10), '제9조')"


@query("""WITH k AS (SELECT s_suppkey AS k FROM supplier)
SELECT k AS s_suppkey, 0 AS no, 'standalone' AS role, 'header' AS kind, NULL::int AS number, '계약 정보' AS title, '계약서 ' || k AS content FROM k
UNION ALL SELECT k, 1, 'parent', 'article', k::int, '정의', '제 ' || k || ' 조 (정의)' || chr(10) || '① 가' || chr(10) || '② 나' FROM k
UNION ALL SELECT k, 2, 'parent', 'annex', 7, 'Term', 'Article 7 [Term]' || chr(10) || '1. one' || chr(10) || '별표 첫째' FROM k
UNION ALL SELECT k, 3, 'parent', 'article', 9, '', '제9조' FROM k""")
def contract_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts by article."""
    return clauses.articles(table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(CONTRACT).alias("text")), "s_suppkey", "text")


@query("""WITH p AS (SELECT p_partkey, 100 + p_size * 4 AS l, 8 AS h FROM part), s AS (SELECT p_partkey, l, h, h + 1 + l AS a FROM p),
c AS (SELECT p_partkey, CASE WHEN a + l <= 400 AND a + 1 + l + l <= 400 THEN [a + 2 + 2 * l] WHEN a + l <= 400 THEN [a + 1 + l, l] WHEN 2 * l <= 400 THEN [a, 2 * l + 1] ELSE [a, l, l] END AS n FROM s)
SELECT p_partkey, (i - 1)::int AS child, n[i]::int AS n FROM c, LATERAL (SELECT unnest(range(1, len(n) + 1)) AS i)""")
def article_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of three paragraphs, packed into children."""
    paragraph = lambda sign: F.concat(F.lit(f"\n{sign} "), F.expr("repeat('가', 98 + p_size * 4)"))
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    parents = parts.select("p_partkey", F.concat(F.lit("제3조 (목적)"), *map(paragraph, "①②③")).alias("content"))
    return clauses.children(parents, ["p_partkey"], "content").select("p_partkey", "child", F.length("content").alias("n"))


#: A head of any length, an article without marks, one with two, and tables under every second contract.
WHOLE_CONTRACT = """concat(repeat('머리 ', p_size * 20), chr(10), '제1조 (목적)', chr(10), repeat('가', 50 + p_size * 20), chr(10), '제2조 [기간]', chr(10), '① ', repeat('나', 100), chr(10), '② ', repeat('다', 200 + p_size * 4),
 CASE WHEN p_partkey % 2 = 1 THEN concat(chr(10), chr(10), '[표 데이터]', chr(10), 'a|b', chr(10), chr(10), 'c|d') ELSE '' END)"""


@query("""WITH p AS (SELECT p_partkey AS k, p_size::int AS z, rtrim(repeat('머리 ', p_size::int * 20)) AS head, 10 + 50 + p_size::int * 20 - 1 AS a, 202 + p_size::int * 4 AS b FROM part),
r AS (SELECT k, 'standalone' AS role, 'header' AS kind, NULL::int AS number, g AS part, NULL::int AS child, length(trim(substring(head, g * 1300 + 1, 1500))) AS n FROM p, LATERAL (SELECT unnest(range(0, CASE WHEN length(head) > 1500 THEN (length(head) - 1) // 1300 + 1 ELSE 1 END)) AS g)
UNION ALL SELECT k, 'parent', 'article', 1, 0, NULL, a FROM p UNION ALL SELECT k, 'parent', 'article', 2, 0, NULL, 8 + 1 + 102 + 1 + b FROM p
UNION ALL SELECT k, 'child', 'article', 1, 0, c, CASE WHEN a <= 400 THEN a ELSE least(400, a - c * 320) END FROM p, LATERAL (SELECT unnest(range(0, CASE WHEN a <= 400 THEN 1 ELSE (a - 1) // 320 + 1 END)) AS c)
UNION ALL SELECT k, 'child', 'article', 2, 0, 0, CASE WHEN 111 + b <= 400 THEN 112 + b ELSE 111 END FROM p UNION ALL SELECT k, 'child', 'article', 2, 0, 1, b FROM p WHERE 111 + b > 400
UNION ALL SELECT k, 'standalone', 'table', NULL, g, NULL, 11 FROM p, (SELECT unnest([0, 1]) AS g) WHERE k % 2 = 1)
SELECT k AS p_partkey, (row_number() OVER (PARTITION BY k ORDER BY CASE WHEN kind = 'header' THEN 0 WHEN kind = 'table' THEN 9 ELSE number END, part, child NULLS FIRST) - 1)::int AS no, role, kind, number, child::int AS child, n::int AS n FROM r""")
def contract_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as contracts: heads in parts, articles with children, tables apart."""
    docs = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", F.expr(WHOLE_CONTRACT).alias("text"))
    return clauses.contract_chunks(docs, "p_partkey", "text").select("p_partkey", "no", "role", "kind", "number", "child", F.length("content").alias("n"))


CLAUSE_NOTES = ["", " 비밀 유지와 배상, 배상 및 배상", " laws of England: liability and damages", " 갑의 승인 없이 양도하지 못한다. 을은 책임을 지지 아니한다. 발주자의 서면", " New York arbitration, force majeure", " 대한민국 계약의 기간 갱신과 해지"]


def _tags_sql() -> str:
    text = f"text || ([{', '.join(repr(n) for n in CLAUSE_NOTES)}])[1 + doc_id % {len(CLAUSE_NOTES)}]"
    count = lambda words, at: " + ".join(f"contains({at}, '{w}')::int" for w in words)
    topics = ", ".join(f"{{n: {count(words, 'low')}, back: {-i}, name: '{name}'}}" for i, (name, words) in enumerate(clauses.TOPICS.items()))
    law = " ".join(f"WHEN {count(words, 't')} > 0 THEN '{name}'" for name, words in clauses.LAWS.items())
    buyer, seller = (count(words, "t") for words in clauses.BIASES.values())
    return f"""WITH d AS (SELECT doc_id, source, {text} AS t FROM documents), l AS (SELECT *, lower(t) AS low, length(regexp_replace(t, '[^ㄱ-ㅣ가-힣]', '', 'g')) / greatest(length(t), 1) > 0.05 AS ko FROM d),
m AS (SELECT *, list_max([{topics}]) AS best FROM l)
SELECT doc_id, CASE WHEN ko THEN 'ko' ELSE 'en' END AS language, CASE {law} WHEN ko THEN '대한민국' ELSE '뉴욕주 (추정)' END AS law, CASE WHEN best.n > 0 THEN best.name ELSE '기타' END AS topic,
CASE WHEN {buyer} > {seller} THEN 'pro-buyer' WHEN {seller} > {buyer} THEN 'pro-seller' ELSE 'neutral' END AS bias, CASE doc_id % 3 WHEN 0 THEN '풍력' WHEN 1 THEN '태양광' ELSE '일반' END AS industry FROM m"""


@query(_tags_sql())
def clause_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as clauses: language, law, topic, side and industry."""
    k = (F.col("doc_id") % len(CLAUSE_NOTES)).cast("int")
    text = F.concat(F.coalesce("text", F.lit("")), F.get(F.array(*map(F.lit, CLAUSE_NOTES)), k))
    project = F.get(F.array(F.lit("West Wind farm"), F.lit("SOLAR park"), F.lit("other")), (F.col("doc_id") % 3).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", clauses.clause_tags(text, project).alias("t")).select("doc_id", "t.*")


ADDENDA = """CASE o_orderkey % 4
WHEN 0 THEN concat('부칙 (2020.1.5) 이 조례는 공포한 날부터 시행한다. 부  칙 <조례 제12호, 2021. 3. ', 1 + o_custkey % 9, '.> 이 조례는 공포 후 30일이 지난 날부터 시행한다. 풍력 발전의 경과조치를 둔다.')
WHEN 1 THEN '부칙 (2020.1.5) 경과조치: 전기사업법에 따른다. 이 조례는 2022년 7월 1일부터 시행한다. 부칙(2023.2.2) 공포한 날부터 시행한다.'
WHEN 2 THEN '부칙 (2019.11.30) 태양에너지 시설의 경과조치. 공포한 날부터 시행한다.' ELSE '경과조치와 풍력만 적은 글' END"""


@query("""WITH k AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 4 AS m FROM orders)
SELECT k AS o_orderkey, CASE m WHEN 0 THEN strftime(make_date(2021, 3, (1 + c % 9)::int) + 30, '%Y%m%d') WHEN 1 THEN '20220701' WHEN 2 THEN '20191130' ELSE '' END AS date,
CASE m WHEN 0 THEN 'AFTER_DAYS' WHEN 1 THEN 'EXPLICIT' WHEN 2 THEN 'IMMEDIATE' ELSE 'PROMULGATED' END AS basis, CASE m WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 1 END::bigint AS rounds FROM k""")
def addenda_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ordinances: rounds of addenda, and when the transition takes effect."""
    rounds = clauses.addenda(table(spark, sf_dir, "orders").select("o_orderkey", F.expr(ADDENDA).alias("text")), "o_orderkey", "text")
    counts = rounds.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("rounds"))
    return clauses.transition(rounds, "o_orderkey").join(counts, "o_orderkey")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::date END AS effective, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderdate::date - 400) END AS transition FROM orders),
d AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM r WHERE coalesce(transition, effective) IS NOT NULL)
SELECT c_custkey AS o_custkey, strftime(coalesce(transition, effective), '%Y-%m-%d') AS cutoff, transition IS NOT NULL AS by_transition, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN DATE '1995-06-01' END < coalesce(transition, effective), false) AS earlier
FROM customer JOIN d ON o_custkey = c_custkey WHERE i = 1""")
def grandfathering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as regions: whether a permit is older than the first dated rule."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    rules = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(k % 3 != 0, day).alias("effective"), F.when(k % 5 == 0, F.date_sub(day, 400)).alias("transition"))
    slices = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 4 != 0, F.lit("1995-06-01").cast("date")).alias("permit"))
    found = clauses.earlier_permits(slices, rules, "o_custkey", ["o_orderkey"])
    return found.withColumn("cutoff", F.date_format("cutoff", "yyyy-MM-dd"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'contract' WHEN 1 THEN 'report' WHEN 2 THEN 'financial' WHEN 3 THEN 'general' ELSE 'contract' END AS strategy,
CASE WHEN p_partkey % 3 = 0 THEN '' ELSE (p_partkey % 30)::varchar END AS number, CASE WHEN p_partkey % 3 = 1 THEN '2' ELSE '' END AS branch FROM part""")
def document_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How kinds of documents are cut, and labels of appendices."""
    k = F.col("p_partkey")
    kinds = F.array(*map(F.lit, ["ppa", "permit", "financial", "law", "equity_sale"]))
    label = F.when(k % 3 == 0, "붙임").when(k % 3 == 1, F.concat(F.lit("[별표 "), (k % 30).cast("string"), F.lit(" 의 2]"))).otherwise(F.concat(F.lit("시행령 별 표"), (k % 30).cast("string")))
    named = clauses.appendix(label)
    return table(spark, sf_dir, "part").select("p_partkey", clauses.strategy(F.get(kinds, (k % 5).cast("int"))).alias("strategy"), named["number"].alias("number"), named["branch"].alias("branch"))
