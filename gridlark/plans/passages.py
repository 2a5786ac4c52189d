"""Queries of passages, chunks, paths and sinks, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators import chunking, geometry, retrieval
from gridlark.plans.registry import query, table
from gridlark.sources import sinks

_REAR = " ".join(f"WHEN instr(reverse(w), reverse({b})) > 0 THEN length(w) - instr(reverse(w), reverse({b})) + 1" for b in ("chr(10) || chr(10)", "chr(10)", "'. '", "'。'", "' '"))


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, 0::bigint AS b, 0::bigint AS e, true AS first FROM d UNION ALL
 SELECT doc_id, nb, CASE WHEN n <= 400 THEN n WHEN nb + 400 >= n THEN nb + 400 ELSE coalesce(nb + 200 + CASE {_REAR} END, nb + 400) END, false
 FROM (SELECT c.doc_id, n, nb, text[nb + 201:nb + 400] AS w FROM (SELECT doc_id, CASE WHEN first THEN 0 ELSE e - 100 END AS nb, first, e FROM c) c JOIN d USING (doc_id) WHERE nb < n AND (first OR n > 400))),
t AS (SELECT doc_id, b, trim(text[b + 1:e], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS s FROM c JOIN d USING (doc_id) WHERE NOT first)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1)::int AS chunk_no, md5(s) AS chunk_md5 FROM t WHERE s <> ''""")
def chunk_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of every document."""
    chunks = chunking.chunk_windows(table(spark, sf_dir, "documents"), "doc_id", "text")
    return chunks.select("doc_id", "chunk_no", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


MARKED = "concat(text, chr(10), '# Head ', doc_id, chr(10), 'body', chr(10), '### Deep', chr(10), '#### not one', chr(10), 'end ')"


@query(f"""WITH p AS (SELECT doc_id, string_split(regexp_replace({MARKED.replace('concat(text', "concat(coalesce(text, '')")}, '(^|\\n)(#{{1,3}}[ \\t])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM documents),
q AS (SELECT doc_id, list_filter(list_transform(p, lambda s: regexp_replace(s, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')), lambda s: s <> '') AS p FROM p)
SELECT doc_id, (i - 1)::int AS section_no, md5(p[i]) AS section_md5, regexp_replace(regexp_replace(regexp_extract(p[i], '^[^\\n]*'), '^#+', ''), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')[1:50] AS title FROM q, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)""")
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with headings behind them, by section."""
    marked = F.expr(MARKED.replace("concat(text", "concat(coalesce(text, '')"))
    cut = chunking.sections(table(spark, sf_dir, "documents").select("doc_id", marked.alias("text")), "doc_id", "text")
    return cut.select("doc_id", "section_no", F.md5(F.col("section").cast("binary")).alias("section_md5"), "title")


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, least(length(text) * 20, 3000) AS n FROM conversations WHERE text IS NOT NULL),
f AS (SELECT conv_id, turn, i, CASE WHEN n <= 5000 THEN n WHEN 5000 > 200 THEN 5000 ELSE 0 END AS taken, CASE WHEN n <= 5000 THEN n ELSE 5000 END AS used FROM r WHERE i = 1 UNION ALL
SELECT r.conv_id, r.turn, r.i, CASE WHEN n <= 5000 - used THEN n WHEN 5000 - used > 200 THEN 5000 - used ELSE 0 END, used + CASE WHEN n <= 5000 - used THEN n WHEN 5000 - used > 200 THEN 5000 - used ELSE 0 END FROM f JOIN r ON r.conv_id = f.conv_id AND r.i = f.i + 1)
SELECT conv_id, turn, taken::bigint AS taken FROM f""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as ranked passages of their conversation: what each gets of 5,000 characters."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", (F.length("text") * 20).alias("n"))
    return retrieval.context_budget(turns, "conv_id", "turn", "n", 5_000)


@query("""WITH o AS (SELECT conv_id, turn, coalesce(sum(length(coalesce(text, '')) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS p FROM conversations),
q AS (SELECT conv_id, turn * 97 AS pos FROM conversations) SELECT q.conv_id, pos, arg_max(turn, p) AS page FROM q JOIN o ON o.conv_id = q.conv_id AND p <= pos GROUP BY q.conv_id, pos""")
def page_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages: on which one a position of the joined text stands."""
    turns = table(spark, sf_dir, "conversations")
    return retrieval.page_of(turns.select("conv_id", (F.col("turn") * 97).alias("pos")), retrieval.page_offsets(turns, "conv_id", "turn", "text"), "conv_id")


@query("""WITH h AS (SELECT *, l_returnflag = 'R' AS priced FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, priced ORDER BY l_extendedprice DESC, l_orderkey * 8 + l_linenumber) AS t FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY priced DESC, l_extendedprice DESC, l_orderkey * 8 + l_linenumber) AS place FROM k WHERE NOT priced OR t <= 5)
SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS key, priced, place::int AS place FROM p WHERE place <= 14""")
def rerank_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen lines of every supplier, returned ones first but five at most."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"), "l_extendedprice", "l_returnflag")
    return retrieval.rerank_pool(lines, "l_suppkey", "key", "l_extendedprice", F.col("l_returnflag") == "R").select("l_suppkey", "key", "priced", "place")


@query("SELECT l_partkey, max(l_extendedprice) AS score FROM lineitem GROUP BY l_partkey")
def subquery_union_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as hits of sub-questions: each part's best."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("score"))
    return retrieval.best_of_questions(lines, "l_partkey", "score")


@query("""SELECT o_custkey, sum(CASE o_orderpriority WHEN '1-URGENT' THEN 2.0::double WHEN '2-HIGH' THEN 1.5::double WHEN '5-LOW' THEN 0.25::double END * (o_orderkey % 8)) AS score FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY o_custkey""")
def sparse_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as postings of priorities: the dot product with a question of three terms."""
    postings = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", (F.col("o_orderkey") % 8).cast("double").alias("w"))
    return retrieval.sparse_scores(postings, {"1-URGENT": 2.0, "2-HIGH": 1.5, "5-LOW": 0.25}, "o_custkey", "o_orderpriority", "w")


@query("SELECT conv_id, count(*) AS turns, arg_max(text, turn)[1:100] AS preview FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def conversation_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with its length and the beginning of its last turn."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.substring("text", 1, 100).alias("start"))
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max_by("start", "turn").alias("preview"))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.' || json_keys(props)[1]) AS varchar) AS first_prop, len(json_keys(props)) AS n FROM events WHERE props IS NOT NULL""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first property of every event and how many it has."""
    fields = F.from_json("props", "map<string,string>")
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", F.try_element_at(fields, F.get(keys, F.lit(0))).alias("first_prop"), F.size(keys).cast("long").alias("n"))


@query("""WITH o AS (SELECT DISTINCT o_custkey, o_orderpriority, o_custkey * 3 % 7 AS d FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_custkey, o_orderpriority, max(o_custkey * 3 % 7 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) AS d FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL)
SELECT o_custkey, o_orderpriority, coalesce(n.d, o.d) AS d, CASE WHEN n.d IS NULL THEN 'STALE' WHEN o.d IS NULL THEN 'NEW' WHEN n.d = o.d THEN 'SAME' ELSE 'CHANGED' END AS state FROM o FULL JOIN n USING (o_custkey, o_orderpriority)""")
def ordinance_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ordinance rows: what a new reading changes, adds and leaves stale."""
    orders, d = table(spark, sf_dir, "orders"), F.col("o_custkey") * 3 % 7
    keys = ["o_custkey", "o_orderpriority"]
    stored = orders.where("o_orderkey % 3 <> 0").select(*keys, d.alias("d")).distinct()
    fresh = orders.where("o_orderkey % 2 = 0").groupBy(*keys).agg(F.max(d + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).alias("d"))
    return sinks.upsert_keep_stale(stored, fresh, keys, "d")


@query("SELECT doc_id, md5(text) AS checksum FROM documents WHERE text IS NOT NULL AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE text IS NOT NULL AND source = 'web')")
def reload_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text is not among those of one source, which count as stored."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("checksum"))
    return sinks.not_loaded(docs.select("doc_id", "checksum"), docs.where("source = 'web'"), "checksum").select("doc_id", "checksum")


@query("SELECT l_orderkey, min(l_quantity) AS score, arg_min(l_linenumber, (l_quantity, l_linenumber)) AS point FROM lineitem GROUP BY l_orderkey")
def history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history row of every order: its line of least quantity."""
    return sinks.lowest_per_report(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", F.col("l_linenumber"))


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, min(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey")
def first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of every customer, as a ledger index keeps first rows."""
    return geometry.first_in(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")])
