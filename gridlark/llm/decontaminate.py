"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search, exact check.

Texts become lower-cased words and hashed shingles of five words; items of one
to four words are searched by their whole word sequence, with shingles of that
size. Items of the same words are one item text. A shingle that stands in ``n``
item texts weighs ``1000 div (binary digits of n)``, so it never weighs nothing
and a template that many items share does not lose to a few words of its own;
shingles outside the benchmark weigh nothing.

A window of a document is as long as an item and stands so that a shared
shingle falls on the item's own place; runs of consecutive shared shingles give
one window. Windows and items get weighted 64-bit SimHashes. Four blocks of
sixteen bits are indexed: the items under every value within two bits, the
windows under every value within one bit. Of the fifteen bits that may differ
at most three fall into some block, so every pair within the radius meets.
Candidate pairs of a document and an item are then held to the exact weighted
similarity: the largest share of the item's weight that stands in an item-sized
window, over all windows of the document, by one running sum.

Cases: null and empty texts have no shingles, on either side, and never match;
a null id is reported like any other; repeated rows are reported once; two
texts under one id are searched apart and reported together; of equally good
windows the first counts; very long texts are searched whole, window by window;
an empty table or benchmark gives no rows; other columns, of any name, are not
looked at and stay in ``decontaminate``.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlark.llm.common import broadcast_if_small, checkpointed, free_name, plain_words

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 15
BLOCKS, BLOCK_BITS = 4, 16
#: Bits of a block that the window's side and the item's side flip; with the radius spread over the blocks both together suffice.
WINDOW_FLIPS, ITEM_FLIPS = 1, 2
#: The bitmap that most hashes fall through: bits for each benchmark shingle, 64-bit lanes at most, and shingles at most.
SIEVE_BITS, SIEVE_LANES, SIEVE_SHINGLES = 64, 1 << 17, 1 << 22
#: A word of a text, as DuckDB writes it.
WORD_SQL = r"regexp_extract_all(lower(replace(coalesce(text, ''), chr(8490), chr(312))), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """A hash for every ``size`` words in a row."""
    last = F.size(words) - size
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))


def simhash_of(found: Column) -> Column:
    """The weighted SimHash of an array of (h, w)."""

    def bit(fp: Column, b: Column) -> Column:
        total = F.aggregate(found, F.lit(0).cast("long"), lambda s, x: s + F.when(F.getbit(x["h"], b) == 1, x["w"]).otherwise(-x["w"]))
        return fp.bitwiseOR(F.when(total > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)


def simhash(found: str) -> Column:
    """The weighted SimHash of a column of (h, w)."""
    return F.coalesce(simhash_of(F.col(found)), F.lit(0).cast("long"))


def item_sizes(benchmark: DataFrame) -> list[int]:
    """Shingle sizes that the items need: five, and of one to four those that are some item's whole length."""
    needed = F.least(F.size(plain_words(F.col("text"))), F.lit(SHINGLE))
    return sorted(r["n"] for r in benchmark.select(needed.alias("n")).where("n > 0").distinct().collect())


def _item_shingles(benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items (no, item_id), their distinct texts (no, len, found), and shingles (h, w, places of (len, off)), of one shingle size."""
    fits = F.size("words") == size if size < SHINGLE else F.size("words") >= SHINGLE
    items = checkpointed(
        benchmark.select("item_id", plain_words(F.col("text")).alias("words"))
        .where(fits)
        .select("item_id", F.xxhash64(F.array_join("words", " ")).alias("no"), shingle_hashes(F.col("words"), size).alias("hs"))
        .distinct()
    )
    texts = checkpointed(items.groupBy("no").agg(F.first("hs").alias("hs"))).withColumn("len", F.size("hs"))
    held = texts.select("no", F.explode(F.array_distinct("hs")).alias("h"))
    weights = held.groupBy("h").agg(F.expr("CAST(1000 div length(bin(count(1))) AS bigint)").alias("w"))
    places = texts.select("len", F.posexplode("hs").alias("off", "h")).groupBy("h").agg(F.collect_set(F.struct("len", "off")).alias("places"))
    shingles = checkpointed(weights.join(places, "h"))
    sums = held.join(shingles.select("h", "w"), "h").groupBy("no").agg(F.collect_list(F.struct("h", "w")).alias("found"))
    return items.select("no", "item_id"), checkpointed(texts.select("no", "len").join(sums, "no")), shingles


def sieve(shingles: DataFrame) -> str | None:
    """SQL of a bitmap test of ``h`` that every benchmark shingle passes; None for very large benchmarks."""
    n = shingles.limit(SIEVE_SHINGLES + 1).count()
    if n > SIEVE_SHINGLES:
        return None
    lanes = min(SIEVE_LANES, 1 << max(0, n * SIEVE_BITS // 64 - 1).bit_length())
    lane = F.expr(f"cast(shiftrightunsigned(h, 6) & {lanes - 1} AS int)")
    bits = shingles.groupBy(lane.alias("lane")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 AS int)))").alias("bits"))
    held = {r["lane"]: r["bits"] for r in bits.collect()}
    bitmap = ",".join(str(held.get(i, 0)) for i in range(lanes))
    return f"getbit(get(cast(split('{bitmap}', ',') AS array<bigint>), cast(shiftrightunsigned(h, 6) & {lanes - 1} AS int)), cast(h & 63 AS int)) = 1"


def hits(docs: DataFrame, shingles: DataFrame, size: int = SHINGLE) -> DataFrame:
    """For each document that shares shingles with the benchmark: the sorted array ``hits`` of (pos, h, w, places)."""
    test = sieve(shingles) or "true"
    hashed = docs.select("doc_id", F.xxhash64("text").alias("tid"), shingle_hashes(F.col("words"), size).alias("hs"))
    passed = F.expr(f"array_compact(transform(hs, (h, i) -> CASE WHEN {test} THEN named_struct('pos', i, 'h', h) END))")
    at = hashed.select("doc_id", "tid", F.explode(passed).alias("x")).select("doc_id", "tid", "x.pos", "x.h")
    return (
        at.join(broadcast_if_small(shingles), "h")
        .groupBy("doc_id", "tid")
        .agg(F.array_sort(F.collect_set(F.struct("pos", "h", "w", "places"))).alias("hits"))
    )


def windows(found: DataFrame) -> DataFrame:
    """Item-sized windows (doc_id, tid, start, len) with the fingerprint ``fp`` of the hits inside."""
    starts = F.expr("""
        flatten(transform(hits, (x, i) -> transform(
            filter(x.places, p -> i = 0 OR NOT (get(hits, i - 1).pos = x.pos - 1
                AND array_contains(get(hits, i - 1).places, named_struct('len', p.len, 'off', p.off - 1)))),
            p -> named_struct('start', x.pos - p.off, 'len', p.len, 'i', i))))
    """)
    inside = F.expr("""
        array_sort(transform(
            filter(slice(hits, greatest(1, at.i + 2 - at.len), 2 * at.len), x -> x.pos >= at.start AND x.pos < at.start + at.len),
            x -> named_struct('h', x.h, 'w', x.w)))
    """)
    once = lambda held: F.filter(held, lambda x, k: (k == 0) | (F.get(held, k - 1)["start"] != x["start"]) | (F.get(held, k - 1)["len"] != x["len"]))
    distinct = F.get(F.transform(F.array(F.array_sort(starts)), once), F.lit(0))  # several runs can stand for the same window
    placed = found.select("doc_id", "tid", "hits", F.explode(distinct).alias("at"))
    # both steps bind what they read, so that it is made once and not for each bit
    by_shingle = F.transform(F.array(inside), lambda held: F.filter(held, lambda x, k: (k == 0) | (F.get(held, k - 1)["h"] != x["h"])))
    fp = F.transform(by_shingle, lambda held: simhash_of(held))
    return placed.select("doc_id", "tid", "at.start", "at.len", F.get(fp, F.lit(0)).alias("fp"))


def _within(bits: int) -> list[int]:
    return [sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(BLOCK_BITS), n)]


def _blocks(rows: DataFrame, fp: str, flips: int, keep: list[str]) -> DataFrame:
    """Each row under the values (j, v) of its blocks with up to ``flips`` bits turned."""
    each = rows.select(*keep, fp, F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("j"))
    value = F.expr(f"cast(shiftrightunsigned({fp}, j * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1} AS int)")
    return each.withColumn("flip", F.explode(F.array(*map(F.lit, _within(flips))))).withColumn("v", value.bitwiseXOR(F.col("flip"))).drop("flip")


def best_windows(pairs: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, tid, no, common, start): for each pair of a document and an item the item-sized window that holds most of the item's weight, of equals the first.

    A window is scored where it begins with a shared shingle. A shingle counts
    once in a window: at ``pos``, it adds its weight to the windows that begin
    after both its place before and ``pos - len``, up to ``pos``. So the scores
    of all windows are one running sum over twice as many steps as there are
    hits, however long the item is.
    """
    item = texts.select("no", F.explode("found").alias("x")).select("no", "x.h")
    held = found.join(broadcast_if_small(pairs.select(F.col("doc_id").alias("d"), F.col("tid").alias("t")).distinct()), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("t")), "left_semi")
    rows = held.select("doc_id", "tid", F.explode("hits").alias("x")).select("doc_id", "tid", "x.pos", "x.h", "x.w")
    other = pairs.select(F.col("doc_id").alias("d"), F.col("tid").alias("t"), "no", "len")
    met = rows.join(broadcast_if_small(other), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("t"))).join(broadcast_if_small(item), ["no", "h"])
    key = ["doc_id", "tid", "no"]
    was = F.lag("pos").over(W.partitionBy(*key, "h").orderBy("pos"))
    seen = met.repartition(*key).select(*key, "pos", "w", F.greatest(F.coalesce(was, F.lit(-1)), F.col("pos") - F.col("len")).alias("after"))
    steps = F.array(
        F.struct((F.col("after") + 1).alias("at"), F.col("w").alias("w"), F.lit(False).alias("begins")),
        F.struct((F.col("pos") + 1).alias("at"), (-F.col("w")).alias("w"), F.lit(False).alias("begins")),
        F.struct(F.col("pos").alias("at"), F.lit(0).cast("long").alias("w"), F.lit(True).alias("begins")),
    )
    each = seen.select(*key, F.explode(steps).alias("s")).select(*key, "s.*")
    common = F.sum("w").over(W.partitionBy(*key).orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow))
    scored = each.select(*key, "at", "begins", common.alias("common")).where("begins")
    best = F.max(F.struct("common", (-F.col("at")).alias("back")))
    return scored.groupBy(*key).agg(best.alias("best")).select(*key, "best.common", (-F.col("best.back")).alias("start"))


def _matches(docs: DataFrame, benchmark: DataFrame, threshold: float, radius: int) -> tuple[DataFrame, DataFrame] | None:
    """(doc_id, tid, no, s, start), the windows that reach ``threshold``, and the items (no, item_id); None without items."""
    if (WINDOW_FLIPS + ITEM_FLIPS + 1) * BLOCKS <= radius:
        raise ValueError("the blocks do not cover this radius")
    words = docs.select("doc_id", "text", plain_words(F.col("text")).alias("words"))
    found, named = [], []
    for size in item_sizes(benchmark):
        items, texts, shingles = _item_shingles(benchmark, size)
        held = checkpointed(hits(words, shingles, size))
        index = _blocks(texts.withColumn("item_fp", simhash("found")), "item_fp", ITEM_FLIPS, ["no", "len"])
        near = (
            _blocks(windows(held), "fp", WINDOW_FLIPS, ["doc_id", "tid", "len"])
            .join(broadcast_if_small(index), ["len", "j", "v"])
            .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        )
        pairs = checkpointed(near.select("doc_id", "tid", "no", "len").distinct())
        whole = texts.select("no", F.expr("aggregate(found, 0L, (s, x) -> s + x.w)").alias("whole"))
        scored = best_windows(pairs, held, texts).join(broadcast_if_small(whole), "no")
        found.append(scored.select("doc_id", "tid", "no", (F.col("common") / F.col("whole")).alias("s"), "start").where(F.col("s") >= threshold))
        named.append(items)
    if not found:
        return None
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, named)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): each document and item whose best window reaches ``threshold``."""
    pair = _matches(docs, benchmark, threshold, radius)
    if pair is None:
        kind = benchmark.schema["item_id"].dataType
        return docs.select("doc_id", F.lit(None).cast(kind).alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("first_word")).where("false")
    found, items = pair
    by_text = found.groupBy("doc_id", "no").agg(F.max(F.struct("s", (-F.col("start")).alias("back"))).alias("best"))
    return (
        by_text.join(broadcast_if_small(items), "no")
        .groupBy("doc_id", "item_id")
        .agg(F.max("best").alias("best"))
        .select("doc_id", "item_id", F.round("best.s", 6).alias("similarity"), (-F.col("best.back")).cast("long").alias("first_word"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark passage; all columns stay, and so do other texts under the same id."""
    pair = _matches(docs, benchmark, threshold, radius)
    if pair is None:
        return docs
    leaked, tid = free_name(docs, "leaked_id"), free_name(docs, "leaked_text")
    found = checkpointed(pair[0].select(F.col("doc_id").alias(leaked), F.col("tid").alias(tid)).distinct())
    same = docs["doc_id"].eqNullSafe(F.col(leaked)) & (F.xxhash64(docs["text"]) == F.col(tid))
    return docs.join(broadcast_if_small(found), same, "left_anti")


def sql() -> str:
    """The same result as DuckDB SQL over ``documents`` and ``benchmark``: every item-sized window that begins with a shared shingle, no fingerprints."""

    def cut(table: str, key: str, sizes: str) -> str:
        return f"""SELECT {key}, m, pos, array_to_string(words[pos + 1:pos + m], ' ') AS h, len(words) AS n
  FROM (SELECT {key}, {WORD_SQL} AS words FROM {table}) t, ({sizes}) k, LATERAL (SELECT unnest(range(0, len(words) - m + 1)) AS pos) p"""

    return f"""
WITH b0 AS ({cut("benchmark", "item_id", f"SELECT unnest(range(1, {SHINGLE + 1})) AS m")}),
b AS (SELECT item_id, m, pos, h, n - m + 1 AS len FROM b0 WHERE m = least(n, {SHINGLE})),
x AS (SELECT item_id, string_agg(h, '|' ORDER BY pos) AS txt FROM b GROUP BY item_id),
w AS (SELECT m, h, 1000 // length(bin(count(DISTINCT txt))) AS w FROM b JOIN x USING (item_id) GROUP BY m, h),
t AS (SELECT item_id, sum(w) AS total FROM (SELECT DISTINCT item_id, m, h FROM b) JOIN w USING (m, h) GROUP BY item_id),
d AS ({cut("documents", "doc_id", "SELECT DISTINCT m FROM b")}),
hit AS (SELECT doc_id, item_id, d.pos, m, h, len FROM d JOIN (SELECT DISTINCT item_id, m, h, len FROM b) USING (m, h)),
win AS (SELECT DISTINCT doc_id, item_id, pos AS start, len FROM hit),
s AS (
  SELECT doc_id, item_id, start, sum(w) AS common FROM (
    SELECT DISTINCT win.doc_id, win.item_id, win.start, hit.m, hit.h FROM win JOIN hit
    ON hit.doc_id = win.doc_id AND hit.item_id = win.item_id AND hit.pos >= win.start AND hit.pos < win.start + win.len)
  JOIN w USING (m, h) GROUP BY ALL)
SELECT doc_id, item_id, round(max(common / total), 6)::double AS similarity, arg_max(start, (common, -start))::bigint AS first_word
FROM s JOIN t USING (item_id) GROUP BY doc_id, item_id HAVING max(common / total) >= {THRESHOLD}
"""
