"""The operators bound to tables, as queries, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators import retrieval, series, spatial, texts, verdicts
from gridlark.operators.components import checkpointed
from gridlark.plans import cases, checked, evaluations, judged, ledgers, overlays, papers, passages, rulebook, screens, shapes, surveys  # noqa: F401  (they register their queries)
from gridlark.plans.registry import QUERIES, SQL, Query, query, table
from gridlark.sources import readers
from gridlark.streaming import intake

# --- verdicts ---------------------------------------------------------------

STATUS_SQL = "CASE WHEN l_discount >= 0.095 AND l_tax >= 0.075 THEN 'IMPOSSIBLE' WHEN l_returnflag = 'A' THEN 'CONDITIONAL' WHEN l_returnflag = 'R' THEN 'UNKNOWN' ELSE 'POSSIBLE' END"
DIFFICULTY_SQL = "CASE l_linenumber % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END"
ITEMS_SQL = f"SELECT l_orderkey, l_linenumber, {STATUS_SQL} AS status, {DIFFICULTY_SQL} AS difficulty FROM lineitem"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as verdict rows."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.expr(STATUS_SQL).alias("status"), F.expr(DIFFICULTY_SQL).alias("difficulty"), "l_suppkey", "l_partkey"
    )


SCORE_SQL = f"""
WITH i AS ({ITEMS_SQL}),
w AS (SELECT *, CASE status WHEN 'POSSIBLE' THEN 0 WHEN 'CONDITIONAL' THEN 12 WHEN 'IMPOSSIBLE' THEN 100 ELSE 6 END
  + CASE difficulty WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 4 WHEN 'HIGH' THEN 9 ELSE 18 END AS weight FROM i),
a AS (SELECT l_orderkey, count(*) FILTER (status = 'IMPOSSIBLE') AS b, count(*) FILTER (status = 'CONDITIONAL') AS c, count(*) FILTER (status = 'UNKNOWN') AS u,
  coalesce(max(weight) FILTER (status IN ('CONDITIONAL', 'UNKNOWN')), 0) AS worst FROM w GROUP BY l_orderkey)
SELECT l_orderkey, (CASE WHEN b > 0 THEN 0 ELSE greatest(0, least(100, 100 - (worst + 3 * greatest(0, c - 1) + 2 * u))) END)::int AS score,
  CASE WHEN b > 0 THEN 'IMPOSSIBLE' WHEN c + u = 0 THEN 'POSSIBLE' WHEN u > 0 AND 2 * u >= c + u THEN 'UNKNOWN' ELSE 'CONDITIONAL' END AS grade
FROM a"""


@query(SCORE_SQL)
def verdict_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and grade of every order."""
    return verdicts.verdict_score(items(spark, sf_dir), "l_orderkey")


@query(f"""
WITH p AS (SELECT l_partkey, l_suppkey, max(CASE status WHEN 'POSSIBLE' THEN 0 WHEN 'CONDITIONAL' THEN 1 WHEN 'UNKNOWN' THEN 2 ELSE 3 END) AS s
  FROM (SELECT l_partkey, l_suppkey, {STATUS_SQL} AS status FROM lineitem) GROUP BY ALL),
m AS (SELECT *, max(s) OVER (PARTITION BY l_partkey) AS w FROM p)
SELECT l_partkey, CASE w WHEN 0 THEN 'POSSIBLE' WHEN 1 THEN 'CONDITIONAL' WHEN 2 THEN 'UNKNOWN' ELSE 'IMPOSSIBLE' END AS status,
  CASE WHEN w > 0 THEN min(l_suppkey) FILTER (s = w) END AS worst_no, CASE WHEN w > 0 THEN count(*) FILTER (s = w) ELSE 0 END AS hits, count(*) AS total
FROM m GROUP BY l_partkey, w""")
def verdict_merge_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst status of every part over its suppliers."""
    return verdicts.merge_worst(items(spark, sf_dir), "l_partkey", "l_suppkey")


@query(f"""
WITH s AS ({SCORE_SQL}),
r AS (SELECT o_custkey AS grp, l_orderkey, grade, score, row_number() OVER (PARTITION BY o_custkey ORDER BY
  CASE grade WHEN 'POSSIBLE' THEN 0 WHEN 'CONDITIONAL' THEN 1 WHEN 'UNKNOWN' THEN 2 ELSE 3 END, score DESC, l_orderkey) AS rank
  FROM s JOIN orders ON o_orderkey = l_orderkey)
SELECT grp, l_orderkey, grade, score, rank::int AS rank FROM r WHERE rank <= 5""")
def site_compare_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's five best orders, by grade and score."""
    scored = verdict_score(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return verdicts.rank_sites(scored, "l_orderkey", F.col("o_custkey"))


@query("""SELECT need, count(*) AS n FROM (SELECT CASE WHEN mw < 90 THEN 'SMALL' WHEN mw <= 110 THEN 'BOTH' WHEN mw > 110 THEN 'FULL' ELSE 'ASK' END AS need
FROM (SELECT o_totalprice / 1000 AS mw FROM orders)) GROUP BY need""")
def impact_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders need which assessment, with price in thousands as capacity."""
    need = verdicts.impact_assessment(F.col("o_totalprice") / 1000, 100.0, 0.1).alias("need")
    return table(spark, sf_dir, "orders").select(need).groupBy("need").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_nationkey, round(sum((length(trim(c_name)) > 0)::int + (length(trim(c_mktsegment)) > 0)::int) / (count(*) * 2), 6) AS completeness
FROM customer GROUP BY c_nationkey""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled fields of customers by nation."""
    return verdicts.completeness(table(spark, sf_dir, "customer"), "c_nationkey", ["c_name", "c_mktsegment"])


# --- retrieval --------------------------------------------------------------

EVERY, TOP, TERMS, ANSWERS, LEAST = 50, 45, 3, 15, 3
HYBRID_SQL = """
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::double / nullif(sqrt(list_dot_product(embedding::double[], embedding::double[])), 0)) AS v FROM embeddings WHERE embedding IS NOT NULL),
c AS (SELECT q.id AS question, v.id, round(list_dot_product(q.v, v.v), 6) AS s FROM v q, v WHERE q.id % 50 = 0),
d AS (SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY s DESC, id) AS dense_rank FROM c QUALIFY dense_rank <= 45),
tf AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}')) AS term FROM documents) GROUP BY ALL),
w AS (SELECT id, term, tf / (tf + 1.2::double) AS w, count(*) OVER (PARTITION BY term) AS df FROM tf),
a AS (SELECT id AS question, term FROM w WHERE id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY df, term) <= 3),
t AS (SELECT question, id, round(sum(w), 6) AS s FROM a JOIN w USING (term) GROUP BY ALL),
l AS (SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY s DESC, id) AS lexical_rank FROM t QUALIFY lexical_rank <= 45),
u AS (SELECT question, id, dense_rank::int AS dense_rank, lexical_rank::int AS lexical_rank, round(coalesce(0.5 / (60 + dense_rank), 0) + coalesce(0.5 / (60 + lexical_rank), 0), 6) AS plain,
  round(coalesce(0.5 / (60 + dense_rank), 0) + coalesce(0.5 / (60 + lexical_rank), 0) + CASE WHEN least(dense_rank, lexical_rank) <= 15 THEN 0.05 ELSE 0 END, 6) AS score FROM d FULL JOIN l USING (question, id))
"""


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ranked dense and lexical lists of every question: vectors and documents whose id is divisible by 50, against all rows."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = vectors.where(F.col("id") % EVERY == 0).select(F.col("id").alias("question"), "v")
    dense = retrieval.ranked(retrieval.dense_top(vectors, asked, TOP), "question", "id", "s", TOP, "dense_rank")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    terms = checkpointed(retrieval.asked_terms(docs, "id", "text", F.col("id") % EVERY == 0, TERMS).withColumnRenamed("id", "question"))
    weights = retrieval.weights_of(docs, "id", "text", terms)
    return dense, retrieval.ranked(retrieval.sparse_top(weights, terms), "question", "id", "s", TOP, "lexical_rank")


@query(HYBRID_SQL + "SELECT question, id, dense_rank, lexical_rank, score, (row_number() OVER (PARTITION BY question ORDER BY score DESC, id))::int AS place FROM u QUALIFY place <= 15")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen best answers of every question from its fused dense and lexical lists."""
    return retrieval.best_of_each(retrieval.fuse(*_lists(spark, sf_dir), ["question", "id"]), "question", "id", ANSWERS)


@query(HYBRID_SQL + """, g AS (SELECT question, id, score, 0 AS turn FROM u WHERE id % 11 = question % 11 QUALIFY row_number() OVER (PARTITION BY question ORDER BY score DESC, id) <= 15),
x AS (SELECT question, id, plain AS score, 1 AS turn FROM u QUALIFY row_number() OVER (PARTITION BY question ORDER BY plain DESC, id) <= 15),
y AS (SELECT * FROM g UNION ALL SELECT x.* FROM x ANTI JOIN g USING (question, id)),
z AS (SELECT *, count(*) FILTER (turn = 0) OVER (PARTITION BY question) AS have, row_number() OVER (PARTITION BY question ORDER BY turn, score DESC, id) AS r FROM y)
SELECT question, id, score, turn FROM z WHERE turn = 0 OR (have < 3 AND r <= 15)""")
def rrf_fallback_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter that leaves too few answers to a question, filled up from its unfiltered and unboosted list."""
    dense, lexical = _lists(spark, sf_dir)
    found = retrieval.fuse(dense, lexical, ["question", "id"]).where(F.col("id") % 11 == F.col("question") % 11)
    return retrieval.fallback_fill(found, retrieval.fuse(dense, lexical, ["question", "id"], boost=False), "question", "id", LEAST, ANSWERS)


@query("SELECT l_orderkey, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS l_linenumber, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY l_orderkey")
def parent_child_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its best line."""
    return retrieval.parent_swap(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_extendedprice")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, place::int AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 8 + l_linenumber) AS place
FROM lineitem) WHERE place <= 10""")
def per_document_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best lines of every supplier."""
    hits = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"))
    return retrieval.per_document_cap(hits, "l_suppkey", "key", "l_extendedprice").select("l_suppkey", "l_orderkey", "l_linenumber", "place")


# --- series -----------------------------------------------------------------


@query("""SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max, round(avg(CASE WHEN value < 3.0 THEN 1.0::double ELSE 0.0::double END), 6) AS calm_share
FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def wind_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every user's values."""
    return series.speed_statistics(table(spark, sf_dir, "events"), "user_id", "value")


DEGREES = "event_id * 37 % 3600 / 10.0"


@query("""SELECT direction, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT value,
(['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'])[(floor((event_id * 37 % 3600)::double / 10 / 22.5 + 0.5)::bigint % 16) + 1] AS direction FROM events) GROUP BY direction""")
def wind_direction_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by sixteen directions."""
    named = series.direction16((F.col("event_id") * 37 % 3600).cast("double") / 10).alias("direction")
    return table(spark, sf_dir, "events").select(named, "value").groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events""")
def ditto_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types carried on where two of three are blank."""
    value = F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
    return series.ditto_fill(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], value).select("event_id", "filled")


@query("""WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND lag(1) OVER w IS NOT NULL THEN 0 ELSE 1 END AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::bigint AS run FROM c)
SELECT user_id, run, any_value(event_type) AS event_type, count(*) AS n FROM r GROUP BY user_id, run""")
def stitch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the same event type of each user."""
    return series.islands(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""WITH o AS (SELECT user_id, count(*) FILTER (value > 10) / count(*) AS was FROM events GROUP BY user_id), n AS (SELECT user_id, count(*) FILTER (value > 12) / count(*) AS coverage FROM events GROUP BY user_id)
SELECT user_id, round(CASE WHEN coverage < was - 0.05 THEN was ELSE coverage END, 6) AS coverage, coverage < was - 0.05 AS refused FROM o JOIN n USING (user_id)""")
def coverage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New coverage of every user, unless it loses too much."""
    rows = table(spark, sf_dir, "events").groupBy("user_id")
    share = lambda least: rows.agg((F.count_if(F.col("value") > least) / F.count(F.lit(1))).alias("coverage"))
    return series.guarded_replace(share(10), share(12), "user_id").withColumn("coverage", F.round("coverage", 6))


# --- space ------------------------------------------------------------------

POINT_SQL = "33 + ({k} * 7919 % 6000) / 1000.0::double AS lat, 125 + ({k} * 104729 % 7000) / 1000.0::double AS lng"


def _points(df: DataFrame, key: str) -> DataFrame:
    k: Column = F.col(key)
    return df.select(k.alias("id"), (33 + (k * 7919 % 6000) / F.lit(1000.0)).alias("lat"), (125 + (k * 104729 % 7000) / F.lit(1000.0)).alias("lng"))


DISTANCE_SQL = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"
SITES_SQL = f"a AS (SELECT c_custkey AS id, {POINT_SQL.format(k='c_custkey')} FROM customer), b AS (SELECT s_suppkey AS id, {POINT_SQL.format(k='s_suppkey')} FROM supplier)"


@query(f"WITH {SITES_SQL} SELECT a.id AS l_id, b.id AS r_id, round({DISTANCE_SQL}, 3) AS metres FROM a, b WHERE {DISTANCE_SQL} <= 20000")
def haversine_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers at most 20 km apart."""
    a, b = _points(table(spark, sf_dir, "customer"), "c_custkey"), _points(table(spark, sf_dir, "supplier"), "s_suppkey")
    return spatial.pairs_within(a, b, 20_000).withColumn("metres", F.round("metres", 3))


@query(f"""WITH {SITES_SQL}, d AS (SELECT a.id AS l_id, b.id AS r_id, round({DISTANCE_SQL}, 3) AS metres FROM a, b)
SELECT l_id, r_id, metres, rank::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY metres, r_id) AS rank FROM d) WHERE rank <= 5""")
def nearest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest suppliers of every customer."""
    stations = _points(table(spark, sf_dir, "supplier"), "s_suppkey")
    return spatial.nearest(_points(table(spark, sf_dir, "customer"), "c_custkey"), stations, 5)


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey * 7919 % 5003 AS x, p_partkey * 3571 % 5009 AS y FROM part)
SELECT a.id, count(*) AS n, count(*) >= 3 AS dense FROM p a JOIN p b ON abs(a.x - b.x) <= 100 AND abs(a.y - b.y) <= 100 GROUP BY a.id""")
def dense_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as points: neighbours within a square, and whether they are many."""
    k = F.col("p_partkey")
    return spatial.neighbours_count(table(spark, sf_dir, "part").select(k.alias("id"), (k * 7919 % 5003).alias("x"), (k * 3571 % 5009).alias("y")), 100, 3)


@query("""WITH t AS (SELECT DISTINCT l_partkey % 200 AS x, l_suppkey % 200 AS y FROM lineitem), b AS (SELECT DISTINCT l_partkey % 200 AS x, l_suppkey % 200 AS y FROM lineitem WHERE l_returnflag = 'R'),
c AS (SELECT DISTINCT l_partkey % 200 AS x, l_suppkey % 200 AS y FROM lineitem WHERE l_returnflag = 'A'), f AS (SELECT t.*, b.x IS NOT NULL AS b, c.x IS NOT NULL AS c FROM t LEFT JOIN b USING (x, y) LEFT JOIN c USING (x, y))
SELECT count(*) * 100.0::double AS total_m2, count(*) FILTER (b) * 100.0::double AS blocked_m2, count(*) FILTER (c AND NOT b) * 100.0::double AS conditional_m2, count(*) FILTER (NOT b AND NOT c) * 100.0::double AS free_m2 FROM f""")
def cells_blocked_conditional_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area algebra over order lines as cells."""
    cells = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 200).alias("x"), (F.col("l_suppkey") % 200).alias("y"), "l_returnflag")
    return spatial.cell_areas(cells, cells.where("l_returnflag = 'R'"), cells.where("l_returnflag = 'A'"), 10.0)


@query(f"""WITH RECURSIVE p AS (SELECT s_suppkey AS id, {POINT_SQL.format(k='s_suppkey')} FROM supplier),
e AS (SELECT a.id AS x, b.id AS y FROM p a, p b WHERE {DISTANCE_SQL} <= 45000), r AS (SELECT x, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x)
SELECT x AS id, min(root) AS cluster FROM r GROUP BY x""")
def chain_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers chained by steps of at most 45 km."""
    points = _points(table(spark, sf_dir, "supplier"), "s_suppkey")
    return spatial.chained(points, 45_000).select("id", F.col("root").alias("cluster"))


# --- texts and totals -------------------------------------------------------

KINDS = {"license": ["license", "licensed", "copyright"], "secret": ["password", "token", "secret"], "german": ["und", "die", "der"], "english": ["the", "and", "of"]}


@query("SELECT kind, count(*) AS n FROM (SELECT " + "CASE WHEN greatest({v}) = 0 THEN 'other' {w} END AS kind FROM documents) GROUP BY kind".format(
    v=", ".join(" + ".join(f"contains(lower(text), '{k}')::int" for k in words) for words in KINDS.values()),
    w=" ".join("WHEN {} = greatest({}) THEN '{}'".format(" + ".join(f"contains(lower(text), '{k}')::int" for k in words), ", ".join(" + ".join(f"contains(lower(text), '{k}')::int" for k in w) for w in KINDS.values()), kind) for kind, words in KINDS.items()),
))
def keyword_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the kind that their keywords vote for."""
    kind = texts.keyword_vote(F.col("text"), KINDS, "other").alias("kind")
    return table(spark, sf_dir, "documents").select(kind).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT md5(text) AS checksum, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text)")
def checksum_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts with their first document."""
    return texts.checksum_dedupe(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '[0-9]{6}-[0-9]{7}', '[ID]', 'g'), '[0-9]{2,3}-[0-9]{3,4}-[0-9]{4}', '[PHONE]', 'g')) AS masked_md5 FROM documents""")
def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every masked document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(texts.masked(F.col("text")).cast("binary")).alias("masked_md5"))


@query("""WITH p AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: length(s) > 0) AS l FROM conversations),
e AS (SELECT DISTINCT conv_id, turn, unnest(l[1:2] || l[greatest(1, len(l) - 1):len(l)]) AS line FROM p), t AS (SELECT conv_id, count(*) AS total FROM conversations GROUP BY conv_id HAVING count(*) >= 3)
SELECT conv_id, line, count(*) AS n_pages FROM e JOIN t USING (conv_id) WHERE length(line) > 3 GROUP BY conv_id, line, total HAVING count(*) >= 0.5 * total""")
def header_footer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines repeated at the edges of a conversation's turns."""
    return texts.edge_lines(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("""WITH g AS (SELECT p_partkey, lower(replace(p_name, ' ', '')) AS s, lower(replace(p_type, ' ', '')) AS t FROM part),
b AS (SELECT p_partkey, list_distinct(list_transform(range(1, length(s)), lambda i: s[i:i + 1])) AS x, list_distinct(list_transform(range(1, length(t)), lambda i: t[i:i + 1])) AS y FROM g)
SELECT p_partkey, round(CASE WHEN least(len(x), len(y)) = 0 THEN 0 ELSE len(list_intersect(x, y)) / least(len(x), len(y)) END, 6) AS overlap FROM b""")
def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far names and types of parts share bigrams."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(texts.overlap(texts.bigrams(F.col("p_name")), texts.bigrams(F.col("p_type"))), 6).alias("overlap"))


@query("""SELECT s_nationkey, max(s_acctbal) AS margin, arg_max(s_suppkey, (s_acctbal, -s_suppkey)) AS best, count(*) AS n FROM supplier GROUP BY s_nationkey""")
def capacity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest margin of every nation and the supplier that has it."""
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(
        F.max("s_acctbal").alias("margin"), F.max_by("s_suppkey", F.struct("s_acctbal", -F.col("s_suppkey"))).alias("best"), F.count(F.lit(1)).alias("n")
    )


@query("""SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_totalprice IS NULL) AS n_null FROM orders GROUP BY o_orderstatus""")
def kpi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums of orders by status."""
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.countDistinct("o_custkey").alias("customers"), F.count_if(F.col("o_totalprice").isNull()).alias("n_null")
    )


@query("SELECT date_trunc('hour', ts)::timestamp AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows, as the stream has them."""
    return intake.hourly(table(spark, sf_dir, "events"))


@query("""WITH e AS (SELECT user_id, ts::timestamp AS ts, value, CASE WHEN lag(ts::timestamp) OVER w + INTERVAL 6 HOUR > ts::timestamp THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e)
SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, no""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of every user's events, six hours apart."""
    return intake.sessions(table(spark, sf_dir, "events"), "user_id")


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the visible text of every page."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(readers.visible_text(F.col("html")).cast("binary")).alias("text_md5"))


def queries() -> dict[str, Query]:
    """Query name to function."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return dict(SQL)
