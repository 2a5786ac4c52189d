"""Queries of rules and notations, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators import notation, rules
from gridlark.plans.registry import query, table

NOTES = "CASE p_partkey % 7 WHEN 0 THEN 'GND' WHEN 1 THEN 'UNL' WHEN 2 THEN concat('FL ', p_size) WHEN 3 THEN concat(p_size, ' 000 AMSL') WHEN 4 THEN 'above' WHEN 5 THEN CAST(p_size AS VARCHAR(9)) ELSE NULL END"


@query(f"""WITH s AS (SELECT p_partkey, upper(trim(coalesce({NOTES}, ''))) AS s FROM part)
SELECT p_partkey, CASE WHEN s IN ('GND', 'SFC', 'SURFACE') THEN 0.0::double WHEN s LIKE 'UNL%' THEN NULL WHEN s LIKE 'FL%' THEN try_cast(trim(s[3:]) AS double) * 100
WHEN regexp_matches(s, '^[0-9]') THEN try_cast(replace(replace(regexp_replace(s, '[A-Z]', '', 'g'), ' ', ''), ',', '') AS double) END AS feet FROM s""")
def altitude_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airspace limits in feet."""
    return table(spark, sf_dir, "part").select("p_partkey", notation.altitude_feet(F.expr(NOTES)).alias("feet"))


@query(f"""WITH s AS (SELECT p_brand, p_size, {NOTES} AS s FROM part), v AS (SELECT p_brand, p_size, CASE WHEN s = 'GND' THEN 0.0::double WHEN s = 'UNL' THEN NULL WHEN s LIKE 'FL%' THEN try_cast(s[4:] AS double) * 100
WHEN regexp_matches(s, '^[0-9]') THEN try_cast(replace(replace(s, ' AMSL', ''), ' ', '') AS double) END AS f FROM s)
SELECT p_brand, p_size, count(*) FILTER (f IS NULL) = 0 AND min(f) > 600 AS cleared, min(f) AS lowest FROM v GROUP BY p_brand, p_size""")
def altitude_clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by size as airspaces: whether all their floors are known and lie above a tip at 600 feet."""
    floors = table(spark, sf_dir, "part").select("p_brand", "p_size", notation.altitude_feet(F.expr(NOTES)).alias("floor"))
    return rules.altitude_cleared(floors, ["p_brand", "p_size"], "floor", 600.0)


VOLTS = "CASE p_partkey % 4 WHEN 0 THEN concat(p_size, '000;22900') WHEN 1 THEN concat('154000, ', p_size, '0000') WHEN 2 THEN 'none' ELSE NULL END"


@query(f"""SELECT p_partkey, greatest(0, coalesce(list_max(list_transform(string_split_regex(coalesce({VOLTS}, ''), '[;,]'), lambda x: try_cast(trim(x) AS bigint))), 0))::bigint AS volts FROM part""")
def voltage_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest voltage of every list."""
    return table(spark, sf_dir, "part").select("p_partkey", notation.max_voltage(F.expr(VOLTS)).alias("volts"))


@query("""SELECT p_partkey, (p_size * CASE p_partkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 10000 ELSE 1 END * CASE WHEN p_partkey % 2 = 0 THEN 1000 ELSE 1 END)::bigint AS metres,
CASE WHEN p_size * 37.31 < 1000 THEN printf('%.0fm', p_size * 37.31::double) ELSE printf('%.2fkm', p_size * 37.31::double / 1000) END AS far FROM part""")
def distance_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of ordinances in metres, and distances as text."""
    k = F.col("p_partkey")
    scale = F.when(k % 3 == 0, "천").when(k % 3 == 1, "만")
    unit = F.when(k % 2 == 0, "km").otherwise("미터")
    return table(spark, sf_dir, "part").select(
        "p_partkey", notation.metres(F.col("p_size").cast("string"), unit, scale).alias("metres"), notation.distance_text(F.col("p_size") * F.lit(37.31)).alias("far")
    )


PLACE = "CASE s_suppkey % 3 WHEN 0 THEN concat('경기도 수원시 ', s_suppkey, '구') WHEN 1 THEN concat('강원도  시', s_suppkey) ELSE '세종특별자치시' END"
LOT = "concat('산 ', s_suppkey, '-3', CASE s_suppkey % 5 WHEN 0 THEN ' 임' WHEN 1 THEN '도' WHEN 2 THEN ' 과' WHEN 3 THEN ' 전' ELSE '' END)"


@query(f"""WITH p AS (SELECT s_suppkey, string_split_regex({PLACE}, '\\s+') AS w, {LOT} AS lot FROM supplier)
SELECT s_suppkey, w[1] AS sido, CASE WHEN len(w) >= 3 AND w[len(w)] LIKE '%구' THEN w[2] ELSE w[len(w)] END AS sigungu,
CASE right(lot, 1) WHEN '임' THEN '임야' WHEN '도' THEN '도로' WHEN '과' THEN '과수원' WHEN '전' THEN '전' ELSE '' END AS category,
s_suppkey::varchar AS number, CASE WHEN s_suppkey % 2 = 0 THEN '2' ELSE '' END AS branch FROM p""")
def register_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, land categories and articles as registers write them."""
    label = F.expr("concat('제', s_suppkey, '조', CASE WHEN s_suppkey % 2 = 0 THEN '의2(허가)' ELSE '' END)")
    at, art = notation.place(F.expr(PLACE)), notation.article(label)
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", at["sido"].alias("sido"), at["sigungu"].alias("sigungu"), notation.land_category(F.expr(LOT)).alias("category"), art["number"].alias("number"), art["branch"].alias("branch")
    )


@query("""SELECT o_orderkey, (o_orderkey % 10000 // 1)::varchar AS number, CASE WHEN o_custkey % 100 = 0 THEN '' ELSE (o_custkey % 100)::varchar END AS branch,
strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def article_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-digit article keys taken apart, and dates with dots made plain."""
    key = notation.article_key(F.format_string("%04d%02d", (F.col("o_orderkey") % 10_000).cast("int"), (F.col("o_custkey") % 100).cast("int")))
    day = notation.calendar_date(F.concat(F.lit("posted "), F.date_format("o_orderdate", "yyyy.M.d")))
    return table(spark, sf_dir, "orders").select("o_orderkey", key["number"].alias("number"), key["branch"].alias("branch"), day.alias("day"))


@query("""WITH n AS (SELECT DISTINCT l_orderkey, CASE WHEN l_quantity > 12 THEN l_linenumber END AS n FROM lineitem), r AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS run FROM n WHERE n IS NOT NULL),
g AS (SELECT l_orderkey, run, min(n) AS a, max(n) AS b, count(*) AS c, string_agg(n::varchar, '·' ORDER BY n) AS s FROM r GROUP BY l_orderkey, run)
SELECT o.l_orderkey, coalesce(string_agg(CASE WHEN c >= 3 THEN a || '~' || b ELSE s END, '·' ORDER BY a), '-') AS label FROM (SELECT DISTINCT l_orderkey FROM n) o LEFT JOIN g ON g.l_orderkey = o.l_orderkey GROUP BY o.l_orderkey""")
def number_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger lines of every order as a label of runs; orders without any are labelled as such."""
    large = F.when(F.col("l_quantity") > 12, F.col("l_linenumber").cast("int"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(large).alias("nos"))
    return lines.select("l_orderkey", notation.run_label(F.col("nos")).alias("label"))


ASKED = "concat(text, CASE conv_id % 6 WHEN 0 THEN ' 가람 1 단계 EPC 계약서' WHEN 1 THEN ' 대출 보고서' WHEN 2 THEN ' 주주간 2nd' WHEN 3 THEN ' 허가' ELSE '' END)"


def _first_sql(words: dict[str, list[str]]) -> str:
    tests = " ".join("WHEN " + " OR ".join(f"contains(q, '{w}')" for w in of) + f" THEN '{name}'" for name, of in words.items())
    return f"CASE {tests} END"


@query(f"""WITH q AS (SELECT conv_id, turn, {ASKED} AS t, lower({ASKED}) AS q FROM conversations WHERE text IS NOT NULL), c AS (SELECT *, {_first_sql(rules.CONTRACT_WORDS)} AS contract, {_first_sql(rules.DOCUMENT_WORDS)} AS d FROM q)
SELECT conv_id, turn, contract, coalesce(d, CASE WHEN contract <> 'REC' THEN 'contract' END) AS document,
CASE WHEN regexp_matches(t, '1\\s*단계|1st') THEN '1단계' WHEN regexp_matches(t, '2\\s*단계|2nd') THEN '2단계' END AS stage FROM c""")
def query_analyzer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every turn, read as a question, asks for."""
    asked = rules.question_filters(F.expr(ASKED))
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", asked.alias("a"))
    return turns.select("conv_id", "turn", "a.contract", "a.document", "a.stage")


RULES = [("BRASS", "MEDIUM"), ("STEEL", "HIGH"), ("ECONOMY", "LOW"), ("PROMO", "CRITICAL"), ("STANDARD", "HIGH"), ("SMALL", "MEDIUM")]


@query("WITH r(i, w, s, d) AS (VALUES " + ", ".join(f"({i}, '{w}', {rules.DIFFICULTIES.index(d) + 1}, '{d}')" for i, (w, d) in enumerate(RULES)) + """),
m AS (SELECT p_partkey, arg_max(w, s * 100 - i) AS rule, arg_max(d, s * 100 - i) AS difficulty FROM part JOIN r ON contains(p_type, w) GROUP BY p_partkey)
SELECT p_partkey, rule, coalesce(difficulty, 'LOW') AS difficulty FROM part LEFT JOIN m USING (p_partkey)""")
def rule_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The severest rule that the type of each part meets."""
    return rules.resolve_rules(table(spark, sf_dir, "part"), "p_partkey", "p_type", RULES, "LOW")


STEPS = "SELECT o_orderkey, 'P' || n AS name, CASE n WHEN 3 THEN o_totalprice >= 150000 WHEN 4 THEN o_totalprice < 150000 WHEN 2 THEN o_custkey % 2 = 0 ELSE true END AS applies FROM orders, range(1, 7) t(n)"


@query(f"""WITH s AS ({STEPS}), e AS (SELECT o_orderkey, max(name) FILTER (applies AND name IN ('P3', 'P4')) AS alive, bool_or(applies AND name = 'P2') AS two FROM s GROUP BY o_orderkey)
SELECT o_orderkey, name, applies, CASE name WHEN 'P5' THEN CASE WHEN two THEN 'P2,' ELSE '' END || alive WHEN 'P6' THEN alive || ',P1' ELSE '' END AS needs FROM s JOIN e USING (o_orderkey)""")
def permit_roadmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six permit steps for every order, their applicability, and predecessors that point at steps which apply."""
    n = F.col("n")
    applies = F.when(n == 3, F.col("o_totalprice") >= 150_000).when(n == 4, F.col("o_totalprice") < 150_000).when(n == 2, F.col("o_custkey") % 2 == 0).otherwise(True)
    needs = F.when(n == 5, F.array(F.lit("P2"), F.lit("P4"))).when(n == 6, F.array(F.lit("P3"), F.lit("P4"), F.lit("P1"))).otherwise(F.array().cast("array<string>"))
    steps = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("n"))
    family = F.when(n.isin(3, 4), "assessment")
    named = steps.select("o_orderkey", F.concat(F.lit("P"), n.cast("string")).alias("name"), applies.alias("applies"), family.alias("family"), needs.alias("needs"))
    return rules.relink(named, "o_orderkey", "name", "applies", "family", "needs").select("o_orderkey", "name", "applies", F.array_join("needs", ",").alias("needs"))


@query("SELECT need, count(*) AS n FROM (SELECT CASE WHEN a IS NULL THEN 'ASK' WHEN a >= 30000 THEN 'YES' WHEN a >= 5000 THEN 'ASK' ELSE 'NO' END AS need FROM (SELECT CASE WHEN l_quantity < 45 THEN l_extendedprice END AS a FROM lineitem)) GROUP BY need")
def area_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as areas: how many need a procedure."""
    area = F.when(F.col("l_quantity") < 45, F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select(rules.area_need(area).alias("need")).groupBy("need").agg(F.count(F.lit(1)).alias("n"))


PARCELS = "SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN '도로' WHEN 1 THEN '임야' ELSE '전' END AS category, s_suppkey * 131 % 1500 AS area, (s_suppkey * 17 % 12) / 100.0::double AS built FROM supplier"


@query(f"""WITH RECURSIVE p AS ({PARCELS}), o AS (SELECT *, CASE WHEN area < 900 THEN 'AREA' WHEN category = '도로' THEN 'CATEGORY' WHEN built >= 0.1 THEN 'BUILT' END AS reason, category <> '도로' AND built < 0.1 AS fit FROM p),
e AS (SELECT a.id AS a, b.id AS b FROM o a JOIN o b ON (b.id = a.id + 1 OR b.id = a.id - 1) AND a.fit AND b.fit),
s AS (SELECT id FROM o WHERE fit AND reason IS NULL UNION SELECT e.b FROM s JOIN e ON e.a = s.id)
SELECT o.id, CASE WHEN s.id IS NULL THEN reason END AS reason, s.id IS NOT NULL AND reason IS NOT NULL AS rescued FROM o LEFT JOIN s USING (id)""")
def undersized_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as parcels in a row: small ones chained to a candidate are saved."""
    k = F.col("s_suppkey")
    category = F.when(k % 6 == 0, "도로").when(k % 6 == 1, "임야").otherwise("전")
    parcels = table(spark, sf_dir, "supplier").select(k.alias("id"), category.alias("category"), (k * 131 % 1500).alias("area"), ((k * 17 % 12) / F.lit(100.0)).alias("built"))
    beside = parcels.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return rules.rescued(parcels, beside, 900)


@query("""SELECT event_id, round(value * pow(2.0::double, 0.14::double), 6) AS low, round(value * pow(2.0::double, 0.25::double), 6) AS high,
CASE WHEN value IS NULL THEN NULL WHEN value * pow(2.0::double, 0.14::double) >= 5.5 THEN 'GOOD' WHEN value * pow(2.0::double, 0.25::double) < 5.5 THEN 'POOR' ELSE 'UNSURE' END AS verdict FROM events""")
def hub_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as speeds at 50 m, carried to 100 m."""
    speeds = table(spark, sf_dir, "events").select("event_id", rules.hub_speeds(F.col("value"), 50.0, 100.0).alias("s"))
    return speeds.select("event_id", F.round("s.low", 6).alias("low"), F.round("s.high", 6).alias("high"), rules.hub_verdict(F.col("s.low"), F.col("s.high")).alias("verdict"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, list_filter([l_quantity::double, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::double * 1.1::double END, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity::double * 0.95::double END], lambda x: x IS NOT NULL) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, round(list_avg(v), 6) AS mean, round((list_max(v) - list_min(v)) / list_avg(v) * 100, 6) AS spread FROM v""")
def source_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as one to three sources of a value: their mean and spread."""
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber")
    s = rules.source_spread([q, F.when(n % 2 == 0, q * 1.1), F.when(n % 3 == 0, q * 0.95)])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", s.alias("s")).select("l_orderkey", "l_linenumber", F.round("s.mean", 6).alias("mean"), F.round("s.spread", 6).alias("spread"))


@query("""WITH m AS (SELECT DISTINCT c_name[1:17] || '*' AS masked FROM customer), n AS (SELECT DISTINCT c_name AS name FROM customer)
SELECT masked, name FROM m JOIN n ON starts_with(name, replace(masked, '*', ''))""")
def masked_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers that masked ones can stand for."""
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).distinct()
    return rules.masked_names(names.select(F.concat(F.substring("name", 1, 17), F.lit("*")).alias("masked")).distinct(), names)


#: Classes of forest land, worst first, with what they mean where no rule is stored.
FOREST = {"공익용산지": ("CONDITIONAL", "CRITICAL"), "임업용산지": ("CONDITIONAL", "HIGH"), "보전산지": ("CONDITIONAL", "HIGH"), "준보전산지": ("POSSIBLE", "LOW")}


@query("""WITH g AS (SELECT o_custkey, CASE o_orderkey % 6 WHEN 0 THEN '준보전산지' WHEN 1 THEN '보전산지' WHEN 2 THEN '임업용산지' WHEN 3 THEN '공익용산지' WHEN 4 THEN '미상' END AS class, CASE o_orderkey % 6 WHEN 3 THEN 1 WHEN 2 THEN 2 WHEN 1 THEN 3 WHEN 0 THEN 4 END AS o FROM orders),
w AS (SELECT o_custkey, min(o) AS o, arg_min(class, o) AS class FROM g WHERE o IS NOT NULL GROUP BY o_custkey)
SELECT o_custkey, class, CASE o WHEN 1 THEN 'IMPOSSIBLE' WHEN 4 THEN 'POSSIBLE' ELSE 'CONDITIONAL' END AS status, CASE o WHEN 1 THEN 'CRITICAL' WHEN 4 THEN 'LOW' ELSE 'HIGH' END AS difficulty FROM w""")
def forest_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as forest parcels of customers: the worst class, by a stored rule or else the fallback."""
    names = F.array(*map(F.lit, ["준보전산지", "보전산지", "임업용산지", "공익용산지", "미상"]))
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.get(names, (F.col("o_orderkey") % 6).cast("int")).alias("class"))
    stored = spark.createDataFrame([("공익용산지", "IMPOSSIBLE", "CRITICAL")], "class string, status string, difficulty string")
    return rules.rule_or_fallback(rows, "o_custkey", "class", stored, FOREST)
