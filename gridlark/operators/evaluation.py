"""Whole evaluation of sites: all checks' rows in order, what is missing, the score, the conditions that hold, and the permits that follow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.operators.judgements import site_flags
from gridlark.operators.rules import area_need, relink
from gridlark.operators.scans import levels
from gridlark.operators.verdicts import DIFFICULTY_PENALTY, grade_of, lookup, score_of, score_sums

#: Statuses in the order in which rows are shown, and what a gap says.
SHOWN = ("IMPOSSIBLE", "CONDITIONAL", "UNKNOWN", "POSSIBLE")
UNPROVED = "판정 기준이 미검증(LOW) 상태입니다. 법령 원문 대조가 필요합니다."
#: The condition of a step that depends on the area of a site.
BY_AREA = "AREA"
COLUMNS = ("no", "item", "code", "status", "difficulty", "confidence", "reason", "action", "categories", "found", "public", "overlapping")


def gathered(checks: list[DataFrame], site: str) -> DataFrame:
    """The rows of all checks as one table; what a check does not say is null."""
    kinds = {f.name: f.dataType for c in checks for f in c.schema}

    def whole(check: DataFrame) -> DataFrame:
        return check.select(site, *[F.col(c) if c in check.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])

    return reduce(DataFrame.unionByName, map(whole, checks))


def gap() -> Column:
    """What a row leaves open: an unknown, or a verdict other than possible that rests on an unproved rule; null for all others."""
    name = F.concat(F.lit("["), F.col("item"), F.lit("] "))
    said = F.concat(name, F.coalesce("reason", F.lit("")), F.lit(" → "), F.coalesce("action", F.lit("")))
    return F.when(F.col("status") == "UNKNOWN", said).when((F.col("confidence") == "LOW") & (F.col("status") != "POSSIBLE"), F.concat(name, F.lit(UNPROVED)))


def ordered(items: DataFrame, site: str) -> DataFrame:
    """``items`` with ``place`` (worst status first, then the hardest, then as checked) and ``gap``."""
    status = F.array_position(F.array(*map(F.lit, SHOWN)), F.col("status"))
    order = Window.partitionBy(site).orderBy(status, F.desc_nulls_last(lookup(F.col("difficulty"), DIFFICULTY_PENALTY)), "no")
    return items.withColumn("place", F.row_number().over(order)).withColumn("gap", gap())


def summary(items: DataFrame, site: str) -> DataFrame:
    """(site, score, grade, blockers, criticals, unknowns, gaps): the score, and the names and numbers that a comparison of sites shows; one grouping, so the checks run once."""
    names = lambda when: F.array_sort(F.collect_set(F.when(when, F.col("item"))))
    sums = items.where(F.col(site).isNotNull()).withColumn("_gap", gap()).groupBy(site).agg(
        *score_sums(),
        names(F.col("status") == "IMPOSSIBLE").alias("blockers"),
        names((F.col("status") == "CONDITIONAL") & (F.col("difficulty") == "CRITICAL")).alias("criticals"),
        F.count("_gap").alias("gaps"),
    )
    return sums.select(site, score_of().alias("score"), grade_of().alias("grade"), "blockers", "criticals", F.col("_unknown").alias("unknowns"), "gaps")


def roadmap(sites: DataFrame, site: str, flags: str, area: str, catalogue: DataFrame) -> DataFrame:
    """(site, no, step, applies, sure, needs, level, cyclic) of every step of the ``catalogue`` (no, step, condition, family, needs) for every site.

    A step without a condition applies everywhere, one by area where the area
    needs it or must be asked about (then it is not ``sure``), any other where
    its condition is among the site's flags. Needs name steps that apply, and
    the level is a step's place in the order of applying steps, null for others.
    The catalogue is a fixed list of a few dozen steps and goes to every site.
    """
    steps = [r.asDict(recursive=True) for r in catalogue.orderBy("no").collect()]
    listed = F.array(*[F.struct(F.lit(s["no"]).alias("no"), F.lit(s["step"]).alias("step"), F.lit(s["condition"]).cast("string").alias("condition"), F.lit(s["family"]).cast("string").alias("family"), F.array(*map(F.lit, s["needs"] or [])).cast("array<string>").alias("needs")) for s in steps])
    need = area_need(F.col(area))
    rows = sites.select(site, flags, need.alias("_need"), F.explode(listed).alias("_s")).select(site, flags, "_need", "_s.*")
    by_area = F.col("condition") == BY_AREA
    applies = F.col("condition").isNull() | F.when(by_area, F.col("_need") != "NO").otherwise(F.array_contains(flags, F.col("condition")))
    told = rows.withColumn("applies", F.coalesce(applies, F.lit(False))).withColumn("sure", ~F.coalesce(by_area & (F.col("_need") == "ASK"), F.lit(False)))
    linked = relink(told, site, "step", "applies", "family", "needs")
    placed = levels(linked.where("applies"), site, "step", "needs").select(site, "step", "level", "cyclic")
    return linked.join(placed, [site, "step"], "left").select(site, "no", "step", "applies", "sure", "needs", "level", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def evaluated(items: DataFrame, sites: DataFrame, site: str, area: str, catalogue: DataFrame, assume_forest: bool) -> tuple[DataFrame, DataFrame]:
    """The summary of every site with its ``flags``, and its road map; sites that nothing was checked for have flags and a road map, but no score."""
    flagged = sites.select(site, area).join(site_flags(items, site, assume_forest), site, "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    return flagged.join(summary(items, site), site, "left"), roadmap(flagged, site, "flags", area, catalogue)
