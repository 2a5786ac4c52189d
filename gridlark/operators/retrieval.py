"""Hybrid retrieval: dense and lexical ranks, weighted reciprocal rank fusion, passages and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank constant, weights (dense, lexical) by question type, and the boost of a rank up to BOOST_RANK.
RANK_CONSTANT, BOOST, BOOST_RANK = 60, 0.05, 15
WEIGHTS = {"contract": (0.4, 0.6), "report": (0.7, 0.3), "general": (0.5, 0.5)}
#: Words of a question and what is asked beside it, words that ask for prices, and the words of a second question about them.
ASKED_BESIDE = {
    ("금리", "이자"): "interest rate fees",
    ("대주단", "대주"): "lenders lender",
    ("대출금액", "대출", "차입"): "loan amount financing debt",
    ("상대방", "당사자", "계약자"): "갑지 계약당사자 체결 발주자 이하",
    ("보증", "보장", "발전시간"): "보장공급량 보장 감소기준 발전시간 배상",
    ("ppa",): "재생에너지 전력거래 virtual 직접 ppa",
}
PRICE_WORDS = ("가격", "단가", "계약금액", "공사비", "ppa", "정산", "금액")
PRICE_QUESTION = "직접 PPA Virtual PPA 거래단가 기준가격 계약단가 정산단가 원/kWh"


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 where either is all zeros."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when(norm(a) * norm(b) == 0, 0.0).otherwise(dot / (norm(a) * norm(b)))


def dense_top(vectors: DataFrame, questions: DataFrame, k: int, block: int = 512) -> DataFrame:
    """(question, id, s): the ``k`` rows (id, v) of highest cosine, to six places, for every row of ``questions`` (question, v).

    Both sides become blocks of ``block`` vectors, every pair of blocks is one
    matrix product, and only the best ``k`` of a pair of blocks are sent on.
    """

    def blocks(of: DataFrame, key: str) -> DataFrame:
        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), block):
                    part = batch.iloc[at : at + block]
                    m = np.array([np.asarray(v, np.float64) for v in part["v"]])
                    length = np.sqrt((m * m).sum(axis=1))
                    m = m / np.where(length == 0, 1, length)[:, None]
                    yield pd.DataFrame({f"{key}s": [part[key].tolist()], f"{key}_m": [m.tobytes()]})

        return of.select(F.col(key).cast("long").alias(key), "v").where("v IS NOT NULL").mapInPandas(cut, f"{key}s array<long>, {key}_m binary")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                q = np.frombuffer(row.question_m).reshape(len(row.questions), -1)
                m = np.frombuffer(row.id_m).reshape(len(row.ids), -1)
                s, ids = np.round(q @ m.T, 6), np.asarray(row.ids)
                place = np.array([np.lexsort((ids, -line))[:k] for line in s])
                yield pd.DataFrame({"question": np.repeat(row.questions, place.shape[1]), "id": ids[place].ravel(), "s": np.take_along_axis(s, place, 1).ravel()})

    return blocks(vectors, "id").crossJoin(blocks(questions, "question")).mapInPandas(best, "question long, id long, s double")


def term_weights(docs: DataFrame, key: str, text: str, k: float = 1.2) -> DataFrame:
    """(key, term, w, df): the saturated frequency of each term of four letters and more, and how many rows hold it."""
    counts = docs.select(key, F.explode(_words(text)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    frequencies = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.join(frequencies, "term").select(key, "term", (F.col("tf") / (F.col("tf") + k)).alias("w"), "df")


def rarest_terms(weights: DataFrame, key: str, most: int) -> DataFrame:
    """(key, term): the ``most`` rarest terms of each row, ties by the alphabet."""
    order = Window.partitionBy(key).orderBy("df", "term")
    return weights.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select(key, "term")


#: Terms that are sent to all tasks at most.
FEW_TERMS = 500_000


def _words(text: str) -> Column:
    """The terms of a text: four letters and more."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("([a-z]{4,})"), 1)


def asked_terms(docs: DataFrame, key: str, text: str, asking: Column, most: int) -> DataFrame:
    """(key, term): the ``most`` rarest terms of each row that is ``asking``, by how many of all rows hold them, ties by the alphabet; keys are unique.

    Rows that hold a term are counted within the tasks that read them, so only
    the vocabulary is shuffled, not every row's terms.
    """
    terms = docs.select(key, asking.alias("_asking"), F.explode(F.array_distinct(_words(text))).alias("term"))
    frequencies = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return rarest_terms(terms.where("_asking").select(key, "term").join(frequencies, "term"), key, most)


def weights_of(docs: DataFrame, key: str, text: str, terms: DataFrame, k: float = 1.2) -> DataFrame:
    """(key, term, w) of ``term_weights`` for the ``terms`` (term) alone.

    Up to ``FEW_TERMS`` are sent to all tasks, and other terms are left out
    before rows are counted; more meet the counted rows by shuffle.
    """
    words, asked = docs.select(key, F.explode(_words(text)).alias("term")), terms.select("term").distinct()
    few = asked.count() <= FEW_TERMS
    held = words.join(F.broadcast(asked), "term", "left_semi") if few else words
    counts = held.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    counts = counts if few else counts.join(asked, "term", "left_semi")
    return counts.select(key, "term", (F.col("tf") / (F.col("tf") + k)).alias("w"))


def sparse_top(weights: DataFrame, asked: DataFrame) -> DataFrame:
    """(question, id, s): the summed weights of a question's terms (question, term) in every row (id, term, w) that holds one, to six places."""
    return asked.join(weights, "term").groupBy("question", "id").agg(F.round(F.sum("w"), 6).alias("s"))


def ranked(scored: DataFrame, question: str, key: str, score: str, k: int, rank: str) -> DataFrame:
    """The ``k`` best rows of each question with their rank; ties go to the smaller key. A task sends at most ``k`` rows of a question on."""
    order = Window.partitionBy(question).orderBy(F.desc(score), key)
    return scored.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k).select(question, key, rank)


def fuse(dense: DataFrame, lexical: DataFrame, keys: list[str], kind: str = "general", boost: bool = True) -> DataFrame:
    """Weighted reciprocal rank fusion of two ranked lists (``dense_rank``, ``lexical_rank``) by ``keys`` (question and id)."""
    wd, wl = WEIGHTS[kind]
    part = lambda w, r: F.coalesce(F.lit(w) / (RANK_CONSTANT + F.col(r)), F.lit(0.0))
    near = F.least(F.col("dense_rank"), F.col("lexical_rank")) <= BOOST_RANK
    score = part(wd, "dense_rank") + part(wl, "lexical_rank") + (F.when(near, BOOST).otherwise(0.0) if boost else F.lit(0.0))
    return dense.join(lexical, keys, "full_outer").select(*keys, "dense_rank", "lexical_rank", F.round(score, 6).alias("score"))


def best_of_each(fused: DataFrame, question: str, key: str, k: int) -> DataFrame:
    """The ``k`` fused rows of highest score of each question, ties by the smaller key."""
    order = Window.partitionBy(question).orderBy(F.desc("score"), key)
    return fused.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def fallback_fill(found: DataFrame, spare: DataFrame, question: str, key: str, least: int, k: int) -> DataFrame:
    """``found`` and, for a question with fewer than ``least`` rows, the best of ``spare`` that it lacks, up to ``k`` in all; both are cut to ``k`` a question first.

    ``spare`` is the list without a filter and without a boost; its questions without any row in ``found`` are filled too.
    """
    first, rest = best_of_each(found, question, key, k), best_of_each(spare, question, key, k)
    extra = rest.join(first, [question, key], "left_anti").select(question, key, "score", F.lit(1).alias("turn"))
    both = first.select(question, key, "score", F.lit(0).alias("turn")).unionByName(extra)
    have = F.count_if(F.col("turn") == 0).over(Window.partitionBy(question))
    place = F.row_number().over(Window.partitionBy(question).orderBy("turn", F.desc("score"), key))
    filled = both.withColumn("have", have).withColumn("r", place)
    return filled.where((F.col("turn") == 0) | ((F.col("have") < least) & (F.col("r") <= k))).select(question, key, "score", "turn")


def per_document_cap(hits: DataFrame, document: str, key: str, score: str, most: int = 10) -> DataFrame:
    """At most ``most`` hits of each document, best first."""
    order = Window.partitionBy(document).orderBy(F.desc(score), key)
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def parent_swap(children: DataFrame, parent: str, key: str, score: str) -> DataFrame:
    """Each parent with its best child and that child's score; ties go to the smaller key, whatever its type."""
    best = children.groupBy(parent).agg(F.min_by(F.struct(key, score), F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))).alias("b"))
    return best.select(parent, F.col(f"b.{key}").alias(key), F.col(f"b.{score}").alias(score))


def best_of_questions(hits: DataFrame, key: str, score: str) -> DataFrame:
    """Hits of several sub-questions as one list: each key with its highest score."""
    return hits.groupBy(key).agg(F.max(score).alias(score))


def sparse_scores(postings: DataFrame, question: dict[str, float], key: str, term: str, weight: str) -> DataFrame:
    """(key, score): the dot product of each row's terms with the question's; only postings of its terms are read."""
    asked = F.create_map(*[F.lit(x) for pair in question.items() for x in pair])
    near = postings.where(F.col(term).isin(*question))
    return near.groupBy(key).agg(F.sum(F.col(weight) * F.element_at(asked, F.col(term))).alias("score"))


def rerank_pool(hits: DataFrame, group: str, key: str, score: str, priced: Column, pool: int = 14, quota: int = 5) -> DataFrame:
    """The ``pool`` best hits of each question, up to ``quota`` priced ones first; further priced ones are left out."""
    by = Window.partitionBy(group, "priced").orderBy(F.desc(score), key)
    kept = hits.withColumn("priced", priced).withColumn("turn", F.row_number().over(by)).where(~F.col("priced") | (F.col("turn") <= quota))
    order = Window.partitionBy(group).orderBy(F.desc("priced"), F.desc(score), key)
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= pool).drop("turn")


def context_budget(ranked: DataFrame, group: str, place: str, length: str, budget: int = 25_000, cut: int = 3_000, least: int = 200) -> DataFrame:
    """(group, place, taken): characters that each ranked passage of a question gets.

    A passage is cut to ``cut``; one that does not fit gets the rest if that
    is more than ``least``, and shorter ones after it may still fit. The ranked
    list of one question is bounded (a rerank pool) and is folded as an array.
    """
    row = F.struct(F.col(place).alias("place"), F.least(F.col(length).cast("long"), F.lit(cut).cast("long")).alias("n"))
    lists = ranked.groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<place:bigint,taken:bigint>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        room = F.lit(budget) - acc["used"]
        taken = F.when(r["n"] <= room, r["n"]).when(room > least, room).otherwise(F.lit(0)).cast("long")
        one = F.array(F.struct(r["place"].cast("long").alias("place"), taken.alias("taken")))
        return F.struct((acc["used"] + taken).alias("used"), F.concat(acc["out"], one).alias("out"))

    folded = lists.select(group, F.explode(F.aggregate("rows", start, step, lambda acc: acc["out"])).alias("o"))
    return folded.select(group, F.col("o.place").alias(place), F.col("o.taken").alias("taken"))


def page_of(positions: DataFrame, pages: DataFrame, document: str) -> DataFrame:
    """(document, pos, page): the page (offset, page) with the greatest offset up to each position.

    Both sides are sorted once together by position; the last page so far is the answer.
    """
    marks = pages.select(document, F.col("offset").alias("pos"), F.lit(0).alias("side"), "page")
    asked = positions.select(document, "pos", F.lit(1).alias("side"), F.lit(None).cast(pages.schema["page"].dataType).alias("page"))
    so_far = Window.partitionBy(document).orderBy("pos", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(asked).withColumn("page", F.last("page", ignorenulls=True).over(so_far))
    return found.where("side = 1").select(document, "pos", "page")


def page_offsets(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """(document, page, offset): where each page begins when pages are joined by two characters."""
    before = Window.partitionBy(document).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length(F.coalesce(F.col(text), F.lit(""))) + 2).over(before), F.lit(0))
    return pages.select(document, F.col(page).alias("page"), offset.cast("long").alias("offset"))


def expanded(question: Column, names: Column) -> Column:
    """The questions to search with: the question with related words and the companies' ``names``, and a second one where prices are asked for; null asks nothing."""
    low = F.lower(question)
    any_of = lambda words: F.greatest(*[low.contains(w) for w in words], F.lit(False))
    related = [F.when(any_of(words), F.lit(f" {more}")).otherwise("") for words, more in ASKED_BESIDE.items()]
    own = F.coalesce(F.trim(names), F.lit(""))
    first = F.trim(F.concat(question, *related, F.lit(" "), own))
    second = F.trim(F.concat(question, F.lit(" "), own, F.lit(f" {PRICE_QUESTION}")))
    return F.when(question.isNull(), F.array().cast("array<string>")).when(any_of(PRICE_WORDS), F.array(first, second)).otherwise(F.array(first))


def drafting_sources(hits: DataFrame, chunks: DataFrame, documents: DataFrame, question: str, k: int = 5) -> DataFrame:
    """(question, chunk, document, content, score, place): the ``k`` passages that a draft may quote.

    ``hits`` is (question, document, chunk, parent, score), ``chunks`` (chunk,
    content), ``documents`` (document). Hits of vanished documents are left out; a
    child stands for its parent, whose content is quoted if it still exists; each
    passage counts once, with its best hit. Ties go to the smaller passage.
    """
    known = hits.join(documents.select("document").distinct(), "document", "left_semi")
    whole = F.coalesce("parent", "chunk")
    best = known.groupBy(question, whole.alias("whole")).agg(F.min_by(F.struct("document", "chunk", "score"), F.struct((-F.col("score")).alias("s"), F.col("chunk").alias("c"))).alias("b"))
    order = Window.partitionBy(question).orderBy(F.desc("b.score"), "whole")
    first = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(question, "whole", "b.document", F.col("b.chunk").alias("own"), "b.score", "place")
    parents = first.join(chunks.select(F.col("chunk").alias("whole"), F.col("content").alias("outer")), "whole", "left")
    quoted = parents.join(chunks.select(F.col("chunk").alias("own"), F.col("content").alias("inner")), "own", "left")
    return quoted.select(question, F.when(F.col("outer").isNotNull(), F.col("whole")).otherwise(F.col("own")).alias("chunk"), "document", F.coalesce("outer", "inner").alias("content"), "score", "place")
