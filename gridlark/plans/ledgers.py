"""Queries of registers, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators import registers, rules, series
from gridlark.plans.registry import query, table


@query("SELECT o_orderkey, CASE WHEN c[1:5] = '00001' THEN '99001' WHEN c[1:5] = '00002' THEN '99002' ELSE c[1:5] END || c[6:] AS code FROM (SELECT o_orderkey, lpad(o_orderkey::varchar, 8, '0') AS c FROM orders)")
def code_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys as parcel codes with two renamed districts."""
    code = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", registers.rewrite_code(code, {"00001": "99001", "00002": "99002"}).alias("code"))


@query("""WITH l AS (SELECT s_suppkey AS road, s_suppkey + 5000 AS lot, s_name FROM supplier), r AS (SELECT p_partkey, p_partkey % 150 AS road, 5000 + p_partkey % 130 AS lot FROM part)
SELECT p_partkey, coalesce(a.s_name, b.s_name) AS s_name, CASE WHEN a.s_name IS NOT NULL THEN 'road' WHEN b.s_name IS NOT NULL THEN 'lot' ELSE 'UNKNOWN' END AS found_by
FROM r LEFT JOIN (SELECT road, min(s_name) AS s_name FROM l GROUP BY road) a USING (road) LEFT JOIN (SELECT lot, min(s_name) AS s_name FROM l GROUP BY lot) b USING (lot)""")
def building_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as buildings: their ledger row by road, else by lot."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    rows = table(spark, sf_dir, "part").select(k, (k % 150).alias("road"), (5_000 + k % 130).alias("lot"))
    ledger = table(spark, sf_dir, "supplier").select(s.alias("road"), (s + 5_000).alias("lot"), "s_name")
    return registers.two_key_join(rows, ledger, "road", "lot", "s_name").select("p_partkey", "s_name", "found_by")


@query("""WITH s AS (SELECT s_suppkey % 40 AS dong, s_nationkey AS gu, s_acctbal FROM supplier), c AS (SELECT c_custkey, c_custkey % 60 AS dong, c_nationkey AS gu FROM customer),
j AS (SELECT c_custkey, n.v AS a, w.v AS b FROM c LEFT JOIN (SELECT dong, max(s_acctbal) AS v FROM s GROUP BY dong) n USING (dong) LEFT JOIN (SELECT gu, max(s_acctbal) AS v FROM s GROUP BY gu) w USING (gu))
SELECT c_custkey, coalesce(a, b) AS s_acctbal, CASE WHEN a IS NOT NULL THEN 'NEAR' WHEN b IS NOT NULL THEN 'WIDE' ELSE 'NONE' END AS scope FROM j""")
def supply_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers: supply of their quarter, else of their district."""
    supply = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 40).alias("dong"), F.col("s_nationkey").alias("gu"), "s_acctbal")
    sites = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 60).alias("dong"), F.col("c_nationkey").alias("gu"))
    return registers.widening_sums(sites, supply, "dong", "gu", "s_acctbal").select("c_custkey", "s_acctbal", "scope")


@query("""WITH a AS (SELECT c_custkey % 700 AS x, c_custkey % 11 AS y FROM customer), b AS (SELECT p_partkey % 900 AS x, p_partkey % 11 AS y FROM part)
SELECT x, y, 1::int AS origin FROM a UNION ALL SELECT x, y, 2 FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.x = b.x AND a.y = b.y)""")
def facility_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of places: the second adds what the first has not."""
    place = lambda name, k, n: table(spark, sf_dir, name).select((F.col(k) % n).alias("x"), (F.col(k) % 11).alias("y"))
    return registers.second_source(place("customer", "c_custkey", 700), place("part", "p_partkey", 900), ["x", "y"])


@query("""SELECT l_partkey, l_linenumber, l_quantity, l_tax, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_quantity DESC, l_tax DESC, l_suppkey) AS r FROM lineitem WHERE l_tax >= 0.02) WHERE r = 1""")
def best_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as wind samples: the best of every part and line number."""
    return registers.best_period(table(spark, sf_dir, "lineitem"), "l_partkey", "l_linenumber", "l_quantity", "l_tax", "l_suppkey", 0.02)


@query("""WITH d AS (SELECT user_id, event_id, (['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'])[(floor((event_id * 37 % 3600)::double / 10 / 22.5 + 0.5)::bigint % 16) + 1] AS direction FROM events),
b AS (SELECT user_id, direction, count(*) AS n, min(event_id) AS seen FROM d GROUP BY ALL) SELECT user_id, arg_min(direction, (-n, seen)) AS direction, round(max(n) / sum(n), 6) AS share FROM b GROUP BY user_id""")
def prevailing_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest direction of every user's events."""
    named = series.direction16((F.col("event_id") * 37 % 3600).cast("double") / 10)
    return registers.prevailing(table(spark, sf_dir, "events"), "user_id", named, F.col("event_id")).withColumn("share", F.round("share", 6))


@query("""SELECT p_partkey, 'Site ' || p_size AS project, p_brand AS company, CASE WHEN p_partkey % 2 = 0 THEN '1단계' ELSE '' END AS stage,
CASE p_partkey % 3 WHEN 0 THEN 'contract' WHEN 1 THEN 'report' ELSE 'general' END AS document, 'EPC' AS sub_type, p_name || '.pdf' AS file FROM part""")
def path_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What paths say of the files behind them."""
    path = F.expr("concat('Site ', p_size, 'PJT(', p_brand, ')', if(p_partkey % 2 = 0, '_1단계', ''), '/', element_at(array('계약서', 'Report', 'x'), int(p_partkey % 3) + 1), '/02. epc/', p_name, '.pdf')")
    return table(spark, sf_dir, "part").select("p_partkey", registers.path_fields(path).alias("f")).select("p_partkey", "f.*")


@query("""WITH p AS (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations), q AS (SELECT * FROM p WHERE t <> ''),
b AS (SELECT *, lag(t) OVER w AS was FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(CASE WHEN was IS NULL OR regexp_matches(was, '[.!?"''”]$') OR regexp_matches(t, '^(?i:제\\s*[0-9]+\\s*조|Article\\s*[0-9]+)') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM b)
SELECT conv_id, part::bigint AS part, count(*) AS pages, string_agg(t, ' ' ORDER BY turn) AS text FROM g GROUP BY conv_id, part""")
def page_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages that run on into one another."""
    return registers.stitched(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_discount >= 0.09 AS b, (l_linenumber % 4) + 1 AS d, l_quantity AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, rank::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY b DESC, d DESC, q DESC, l_linenumber) AS rank FROM i) WHERE rank <= 5""")
def issue_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five gravest lines of every order."""
    severity = rules.severity(F.element_at(F.array(*map(F.lit, rules.DIFFICULTIES)), (F.col("l_linenumber") % 4 + 1).cast("int")))
    return registers.issue_rank(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_discount") >= 0.09, severity, F.col("l_quantity"), "l_linenumber")
