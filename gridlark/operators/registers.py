"""Joins and look-ups over registers: rewritten codes, two keys, widening, two sources, best period, file paths, split pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Folder names and the kind of document that they hold.
FOLDER_KINDS = {
    "계약서": "contract", "contract": "contract", "보고자료": "report", "보고서": "report", "report": "report", "사업개요": "report",
    "재무모델": "financial", "재무": "financial", "financial": "financial", "인허가": "permit", "감리": "supervision", "o&m": "om", "om": "om",
    "epc": "epc", "ppa": "ppa", "pf": "pf", "전력거래": "power_trading", "법령": "regulation", "spc": "spc", "지분매각": "equity_sale",
}
#: How a page's last sentence ends, and how a page begins a clause.
SENTENCE_END, CLAUSE_START = "[.!?\"'”]$", r"^(?i)(제\s*[0-9]+\s*조|Article\s*[0-9]+)"


def rewrite_code(code: Column, aliases: dict[str, str]) -> Column:
    """A code whose first five digits are replaced by their alias, if they have one."""
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.concat(F.coalesce(F.try_element_at(known, F.substring(code, 1, 5)), F.substring(code, 1, 5)), F.substring(code, 6, 1_000))


def two_key_join(rows: DataFrame, ledger: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of the ledger by its key ``first``, else by ``second``, and which key found it.

    The ledger is brought to one row for each key beforehand (the least
    ``value``), so neither join multiplies rows.
    """
    by = lambda k, name: ledger.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(value).alias(name))
    both = rows.join(by(first, "_a"), first, "left").join(by(second, "_b"), second, "left")
    found = F.when(F.col("_a").isNotNull(), first).when(F.col("_b").isNotNull(), second).otherwise("UNKNOWN")
    return both.withColumn(value, F.coalesce("_a", "_b")).withColumn("found_by", found).drop("_a", "_b")


def widening_sums(rows: DataFrame, supply: DataFrame, near: str, wide: str, value: str) -> DataFrame:
    """``rows`` with the greatest ``value`` in their ``near`` region, or in their ``wide`` one where that has none."""
    inner = supply.groupBy(near).agg(F.max(value).alias("_near"))
    outer = supply.groupBy(wide).agg(F.max(value).alias("_wide"))
    both = rows.join(inner, near, "left").join(outer, wide, "left")
    scope = F.when(F.col("_near").isNotNull(), "NEAR").when(F.col("_wide").isNotNull(), "WIDE").otherwise("NONE")
    return both.withColumn(value, F.coalesce("_near", "_wide")).withColumn("scope", scope).drop("_near", "_wide")


def second_source(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``first``, and those of ``second`` whose ``keys`` no row of ``first`` has; ``second`` keeps its own repeats."""
    return first.withColumn("origin", F.lit(1)).unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti").withColumn("origin", F.lit(2)))


def best_period(samples: DataFrame, key: str, height: str, months: str, coverage: str, distance: str, least: float = 0.7) -> DataFrame:
    """One sample for each key and height: the most months, then coverage, then nearness; thin coverage does not count."""
    order = F.struct((-F.col(months)).alias("m"), (-F.col(coverage)).alias("c"), F.col(distance).alias("d"))
    best = samples.where(F.col(coverage) >= least).groupBy(key, height).agg(F.min(order).alias("b"))
    return best.select(key, height, (-F.col("b.m")).alias(months), (-F.col("b.c")).alias(coverage), F.col("b.d").alias(distance))


def prevailing(rows: DataFrame, key: str, direction: Column, order: Column) -> DataFrame:
    """(key, direction, share): the commonest direction of a series, the one seen first on a tie."""
    bins = rows.groupBy(key, direction.alias("direction")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    top = F.min_by("direction", F.struct((-F.col("n")).alias("n"), "seen"))
    return bins.groupBy(key).agg(top.alias("direction"), (F.max("n") / F.sum("n")).alias("share"))


def path_fields(path: Column) -> Column:
    """(project, company, stage, document, sub_type, file) of ``project(company)_stage/document/sub type/…/file``."""
    parts = F.split(path, "/")
    n, folder = F.size(parts), F.get(parts, F.lit(0))
    pattern = r"^(?i)(.+?)(?:PJT)?\s*[(（]([^)）]+)[)）](?:_(.+))?$"
    part = lambda g: F.trim(F.regexp_extract(folder, pattern, g))
    kinds = F.create_map(*[F.lit(x) for pair in FOLDER_KINDS.items() for x in pair])
    kind = F.when(n >= 3, F.try_element_at(kinds, F.lower(F.trim(F.get(parts, F.lit(1))))))
    sub = F.when(n >= 4, F.upper(F.trim(F.regexp_replace(F.get(parts, F.lit(2)), r"^[0-9]+\.\s*", "")))).otherwise("")
    project = F.when(folder.rlike(pattern), part(1)).otherwise(folder)
    return F.struct(project.alias("project"), part(2).alias("company"), part(3).alias("stage"), F.coalesce(kind, F.lit("general")).alias("document"), sub.alias("sub_type"), F.get(parts, n - 1).alias("file"))


def stitched(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """(document, part, pages, text): pages run on into the next unless a sentence ends or a clause begins; blank pages are left out."""
    order = Window.partitionBy(document).orderBy(page)
    plain = pages.select(document, page, F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "").alias("_t")).where("_t <> ''")
    before = F.lag("_t").over(order)
    begins = F.when(before.isNull() | before.rlike(SENTENCE_END) | F.col("_t").rlike(CLAUSE_START), 1).otherwise(0)
    marked = plain.withColumn("_begins", begins).withColumn("part", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.array_sort(F.collect_list(F.struct(page, "_t")))
    return marked.groupBy(document, "part").agg(F.count(F.lit(1)).alias("pages"), F.array_join(F.transform(rows, lambda r: r["_t"]), " ").alias(text))


def issue_rank(items: DataFrame, key: str, blocker: Column, difficulty: Column, area: Column, name: str, most: int = 5) -> DataFrame:
    """The first ``most`` issues of every report: blockers, then by difficulty and area; a top-k report."""
    order = Window.partitionBy(key).orderBy(F.desc(blocker), F.desc(difficulty), F.desc(area), name)
    return items.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(key, name, "rank")
