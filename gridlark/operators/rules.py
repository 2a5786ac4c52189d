"""Rules as tables: question analysis, rule resolution, applicability, road maps, parcel reasons and rescue, register look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.operators.components import connected

#: Difficulty from mild to severe.
DIFFICULTIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
#: Words of a question that name a kind of contract, and a kind of document, in the order in which they are tried.
CONTRACT_WORDS = {
    "EPC": ["epc", "도급", "시공"],
    "O&M": ["o&m", "om", "o_m", "유지보수", "운영관리"],
    "PPA": ["ppa", "전력거래", "전력수급", "전력판매"],
    "PF": ["pf", "프로젝트파이낸싱", "대출", "대출약정", "loan", "금융"],
    "REC": ["rec", "신재생에너지공급인증서"],
    "SPA": ["spa", "주식매매", "지분매각"],
    "SHA": ["sha", "주주간", "주주간계약"],
}
DOCUMENT_WORDS = {
    "contract": ["계약서", "계약", "약정서", "약정", "합의서", "합의", "contract", "agreement"],
    "report": ["보고서", "보고자료", "보고", "투자심의", "투소위", "report"],
    "financial": ["재무모델", "재무", "fs", "financial", "현금흐름", "cashflow"],
    "permit": ["인허가", "허가", "허가증", "인가", "permit", "발전사업허가"],
    "supervision": ["감리", "준공", "감리보고서", "supervision"],
    "om": ["운영", "유지보수", "o&m", "om", "월간보고서"],
}
#: A kind of contract that does not say that the document is one.
NO_CONTRACT = ("REC",)
#: Square metres from which an area needs a procedure, and from which that must be asked.
AREA_NEEDS, AREA_ASKS = 30_000, 5_000
#: Land that is never a site, and the share of a parcel under buildings that rules it out.
NEVER_SITE = ("도로", "하천", "구거", "제방", "철도용지", "수도용지")
BUILT_SHARE = 0.10


def first_named(text: Column, words: dict[str, list[str]]) -> Column:
    """The first entry one of whose words stands in the text, whatever its case; null without any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [F.when(low.rlike("|".join(words_of)), F.lit(name)) for name, words_of in words.items()]
    return F.coalesce(*found)


def question_filters(text: Column) -> Column:
    """(contract, document, stage) that a question asks for."""
    contract = first_named(text, CONTRACT_WORDS)
    stage = F.when(text.rlike(r"1\s*단계|1st"), "1단계").when(text.rlike(r"2\s*단계|2nd"), "2단계")
    implied = F.when(contract.isNotNull() & ~contract.isin(*NO_CONTRACT), "contract")
    return F.struct(contract.alias("contract"), F.coalesce(first_named(text, DOCUMENT_WORDS), implied).alias("document"), stage.alias("stage"))


def severity(difficulty: Column) -> Column:
    """The place of a difficulty, mild first."""
    return F.array_position(F.array(*map(F.lit, DIFFICULTIES)), difficulty)


def resolve_rules(names: DataFrame, key: str, name: str, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """(key, rule, difficulty): the severest rule (word, difficulty) whose word stands in ``name``; the first listed on a tie.

    The rules are a fixed list of literals, so the match is an expression over
    each row and nothing is joined.
    """
    listed = F.array(*[F.struct(severity(F.lit(d)).alias("s"), F.lit(-i).alias("back"), F.lit(w).alias("rule"), F.lit(d).alias("difficulty")) for i, (w, d) in enumerate(rules)])
    hit = F.array_max(F.filter(listed, lambda r: F.contains(F.coalesce(F.col(name), F.lit("")), r["rule"])))
    return names.select(key, hit["rule"].alias("rule"), F.coalesce(hit["difficulty"], F.lit(default)).alias("difficulty"))


def rule_or_fallback(rows: DataFrame, site: str, grade: str, stored: DataFrame, fallback: dict[str, tuple[str, str]]) -> DataFrame:
    """(site, grade, status, difficulty) of each site's worst grade: grades are worst first in ``fallback``, and a stored rule (grade, status, difficulty) goes before the fallback's.

    Grades that neither knows are left out, and a site with none of the others
    has no row: what is not known is not guessed.
    """
    order = F.array_position(F.array(*map(F.lit, fallback)), F.col(grade))
    worst = rows.withColumn("_o", order).where("_o > 0").groupBy(site).agg(F.min_by(grade, "_o").alias(grade))
    pick = lambda at: F.element_at(F.create_map(*[F.lit(x) for g, pair in fallback.items() for x in (g, pair[at])]), F.col(grade))
    known = stored.groupBy(grade).agg(F.min(F.struct("status", "difficulty")).alias("_r"))
    return worst.join(known, grade, "left").select(site, grade, F.coalesce("_r.status", pick(0)).alias("status"), F.coalesce("_r.difficulty", pick(1)).alias("difficulty"))


def area_need(square_metres: Column) -> Column:
    """Whether an area needs a procedure: YES, ASK or NO; unknown areas must be asked."""
    return F.when(square_metres.isNull(), "ASK").when(square_metres >= AREA_NEEDS, "YES").when(square_metres >= AREA_ASKS, "ASK").otherwise("NO")


def relink(steps: DataFrame, case: str, name: str, applies: str, family: str, needs: str) -> DataFrame:
    """``steps`` with ``needs`` repaired: steps that do not apply are dropped, or replaced by the step of their ``family`` that does.

    The names of a case (a dozen at most, a fixed catalogue) meet in one row of
    arrays by an aggregation; no step is joined with another.
    """
    kin = F.col(family).isNotNull()
    sums = steps.groupBy(case).agg(
        F.collect_set(F.when(F.col(applies), F.col(name))).alias("_on"),
        F.collect_set(F.when(kin, F.col(name))).alias("_kin"),
        F.min(F.when(kin & F.col(applies), F.col(name))).alias("_alive"),
    )
    swap = lambda d: F.when(F.array_contains("_on", d), d).when(F.array_contains("_kin", d), F.col("_alive"))
    kept = F.array_distinct(F.filter(F.transform(F.col(needs), swap), lambda d: d.isNotNull()))
    return steps.join(sums, case).withColumn(needs, kept).drop("_on", "_kin", "_alive")


def parcel_reason(category: Column, area: Column, least: float, built: Column) -> Column:
    """Why a parcel is no candidate: AREA before CATEGORY before BUILT; null for a candidate."""
    return F.when(area < least, "AREA").when(category.isin(*NEVER_SITE), "CATEGORY").when(built >= BUILT_SHARE, "BUILT")


def rescued(parcels: DataFrame, touching: DataFrame, least: float) -> DataFrame:
    """(id, reason, rescued) of ``parcels`` (id, category, area, built): small ones chained to a candidate by ``touching`` (a, b) count as candidates.

    Only chains of parcels that nothing but their size rules out pass on, so
    the fixed point is a question of components: a component is saved if a
    candidate is in it.
    """
    own = parcels.select("id", parcel_reason(F.col("category"), F.col("area"), least, F.col("built")).alias("reason"), parcel_reason(F.col("category"), F.lit(least), least, F.col("built")).isNull().alias("fit"))
    fit = own.where("fit").select("id", "reason")
    links = touching.join(fit.select(F.col("id").alias("a")), "a", "left_semi").join(fit.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    roots = connected(fit.select("id"), links).join(fit, "id")
    saved = roots.groupBy("root").agg(F.bool_or(F.col("reason").isNull()).alias("saved"))
    found = roots.join(saved, "root").where("saved AND reason IS NOT NULL").select("id", F.lit(True).alias("saved"))
    joined = own.join(found, "id", "left")
    return joined.select("id", F.when(F.col("saved"), None).otherwise(F.col("reason")).alias("reason"), F.coalesce("saved", F.lit(False)).alias("rescued"))


def altitude_cleared(features: DataFrame, keys: list[str], floor_ft: str, tip_ft: float) -> DataFrame:
    """(keys, cleared, lowest): cleared only if every floor is known and all lie above the tip."""
    floor = F.col(floor_ft)
    sums = features.groupBy(*keys).agg(F.count_if(floor.isNull()).alias("unknown"), F.min(floor).alias("lowest"))
    return sums.select(*keys, ((F.col("unknown") == 0) & F.coalesce(F.col("lowest") > tip_ft, F.lit(False))).alias("cleared"), "lowest")


def hub_speeds(speed: Column, measured_m: float, hub_m: float, open_land: float = 0.14, forest: float = 0.25) -> Column:
    """(low, high): a speed carried to hub height over open land and over forest."""
    up = hub_m / measured_m
    return F.struct((speed * up**open_land).alias("low"), (speed * up**forest).alias("high"))


def hub_verdict(low: Column, high: Column, least: float = 5.5) -> Column:
    """GOOD when even the low estimate reaches ``least``, POOR when not even the high one does, else UNSURE."""
    return F.when(low.isNull() | high.isNull(), None).when(low >= least, "GOOD").when(high < least, "POOR").otherwise("UNSURE")


def source_spread(values: list[Column]) -> Column:
    """(mean, spread): the mean of the known sources and their range in percent of it."""
    known = F.filter(F.array(*values), lambda v: v.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(known), F.lit(0))
    return F.struct(mean.alias("mean"), F.when(mean != 0, (F.array_max(known) - F.array_min(known)) / mean * 100).otherwise(0.0).alias("spread"))


def masked_names(masked: DataFrame, names: DataFrame) -> DataFrame:
    """(masked, name): names that begin as a masked one does before its ``*``; no match is dropped.

    Every name is laid out by its beginnings of those lengths that masked ones
    have, so the match is one equality join on the whole head.
    """
    heads = masked.select("masked", F.trim(F.replace(F.col("masked"), F.lit("*"), F.lit(""))).alias("k")).where("k <> ''")
    lengths = sorted(r["n"] for r in heads.select(F.length("k").alias("n")).distinct().collect())
    cuts = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("name"))
    starts = names.select("name", F.explode(F.transform(cuts, lambda n: F.substring(F.col("name"), F.lit(1), n))).alias("k"))
    return heads.join(starts, "k").select("masked", "name")
