"""Committee papers: sections into items, items into agenda rows, minutes beside results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.operators.notation import CUTS, evened
from gridlark.operators.texts import overlap

#: Patterns of energy sources and of kinds of permit, in the order in which they are tried.
SOURCES = {
    "SOLAR": "태양광|태양에너지", "WIND": "풍력", "FUELCELL": "연료전지", "BESS": "BESS|전기저장|에너지저장", "BIO": "바이오|매스|SRF|고형연료", "HYDRO": "수력|조력",
    "THERMAL": "화력|복합|열병합|가스터빈|LNG|집단에너지|부생가스",
}
KINDS = {"CHANGE": r"변경\s*허가|변경\s*인가|변경", "TRANSFER": "양수|양도", "EXTEND": "연장", "CANCEL": "취소|철회", "NEW": r"허가\s*\(?안|인가\s*\(?안|허가안|인가안"}
#: Other names of a decision, and the group of each.
DECISIONS = {
    "허가기준충족": "허가", "인가기준충족": "인가", "승인기준충족": "승인", "조건부허가기준충족": "조건부 허가", "조건부인가기준충족": "조건부 인가", "조건부승인기준충족": "조건부 승인",
    "조건부허가": "조건부 허가", "조건부인가": "조건부 인가", "조건부승인": "조건부 승인", "허가심의보류": "심의 보류", "심의보류": "심의 보류", "심의연기": "심의 연기", "원안의결": "원안의결",
    "원안수정의결": "수정의결", "수정의결": "수정의결",
}
GROUPS = {
    "허가": "가결", "인가": "가결", "승인": "가결", "원안의결": "가결", "수정의결": "가결", "조건부 허가": "조건부", "조건부 인가": "조건부", "조건부 승인": "조건부", "심의 보류": "보류", "심의 연기": "보류",
    "보류": "보류", "재심의": "보류", "불허가": "부결", "부결": "부결", "기각": "부결", "철회": "부결",
}
#: Marks of an item, in the order in which they are tried; a reason; a company before a title; a region at its head.
NUMBERED, MARKED = r"(?:^|\s)(\d{1,2})\.\s+(?=\S)", (r"(?:^|\s)[-–]\s+(?=[^\s\-])", r"(?:^|\s)[ㅇ○●]\s+(?=\S)")
REASON = r"[※*]\s*\(?\s*(?:사\s*유|부대의견)?\s*\)?\s*(.{4,})"
COMPANY = r"^(?:(㈜|\(주\)|\(유\))\s*(.{2,28}?)|(.{2,28}?)(㈜|\(주\)|\(유\)|주식회사|공사))의\s+(.+)$"
COMPANY_FIRST = r"^((?:㈜|\(주\)|\(유\))\S{1,24}|\S{1,24}(?:㈜|\(주\)|\(유\)))\s+(.{5,})$"
REGION = r"^([가-힣]{2,4})\s"
_CUT = CUTS[0]


def _first_of(text: Column, patterns: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), F.lit(code)) for code, p in patterns.items()], F.lit("OTHER"))


def energy_source(text: Column) -> Column:
    """The first source whose words stand in a text, else OTHER."""
    return _first_of(text, SOURCES)


def permit_kind(title: Column) -> Column:
    """The first kind of permit whose words stand in a title, else OTHER."""
    return _first_of(title, KINDS)


def decision(text: Column) -> Column:
    """A decision's one name, without white space and by its common name."""
    plain = F.regexp_replace(evened(text), r"\s+", "")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in DECISIONS.items() for x in p]), plain), plain)


def decision_group(name: Column) -> Column:
    """The group of a decision; empty where it has none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in GROUPS.items() for x in p]), name), F.lit(""))


def squeezed(text: Column) -> Column:
    """A cell of a table without blanks inside Korean words, if it is up to 24 characters long."""
    one = F.trim(F.regexp_replace(evened(text), r"\s+", " "))
    return F.when(F.length(one) <= 24, F.regexp_replace(one, "(?<=[가-힣]) (?=[가-힣])", "")).otherwise(one)


def capacity(text: Column) -> Column:
    """The first number of a text, thousands separators or not; null without any."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), r"([\d,]+(?:\.\d+)?)", 1), ",", "").try_cast("double")


def items(sections: DataFrame, section: str) -> DataFrame:
    """The items (no, raw) of each section, beside its other columns: by numbers, else by dashes, else by circles; none without marks."""
    text = evened(F.col(section))
    numbered = F.split(F.regexp_replace(text, NUMBERED, f"{_CUT}$1{_CUT}"), _CUT)
    pairs = F.transform(F.sequence(F.lit(1), F.size("_n") - 2, F.lit(2)), lambda i: F.struct(F.get("_n", i).cast("int").alias("no"), F.get("_n", i + 1).alias("raw")))
    after_first = lambda parts: F.slice(parts, 2, F.size(parts))
    marked = [after_first(F.split(F.regexp_replace(text, p, _CUT), _CUT)) for p in MARKED]
    by_place = lambda parts: F.transform(parts, lambda s, i: F.struct((i + 1).alias("no"), s.alias("raw")))
    dashes, circles = (by_place(m) for m in marked)
    found = F.when(F.size("_n") >= 3, pairs).when(text.rlike(MARKED[0]), dashes).when(text.rlike(MARKED[1]), circles)
    others = [c for c in sections.columns if c != section]
    return sections.withColumn("_n", numbered).select(*others, F.explode(found).alias("_x")).select(*others, "_x.no", "_x.raw")


def clean_title(text: Column) -> Column:
    """A title without empty brackets, repeated blanks and signs at its ends, 200 characters at most; empty if it is too short or a note."""
    one = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\(\s*\)", ""), r"\s{2,}", " ")
    bare = F.regexp_replace(F.regexp_replace(one, r"^[ ·,]+|[ ·,]+$", ""), r"[\s·,]*$", "")
    return F.when((F.length(bare) < 5) | bare.startswith("※"), "").otherwise(F.substring(bare, 1, 200))


def agenda(rows: DataFrame, raw: str) -> DataFrame:
    """``rows`` with the fields of an agenda item read from ``raw``: title, company, source, kind, region, reason; rows without a title are left out."""
    text = evened(F.col(raw))
    reason = F.substring(F.trim(F.regexp_replace(F.regexp_extract(text, REASON, 1), r"\s+", " ")), 1, 400)
    body = F.when(text.rlike(REASON), F.get(F.split(F.regexp_replace(text, REASON, f"{_CUT}$0"), _CUT), F.lit(0))).otherwise(text)
    named = rows.withColumn("reason", reason).withColumn("_t", clean_title(F.regexp_replace(body, r"\s+", " "))).where("_t <> ''")
    t, part = F.col("_t"), lambda p, g: F.regexp_extract(F.col("_t"), p, g)
    with_of = F.when(part(COMPANY, 1) != "", F.concat(F.lit("㈜"), F.trim(part(COMPANY, 2)))).otherwise(F.concat(F.trim(part(COMPANY, 3)), part(COMPANY, 4)))
    company = F.when(t.rlike(COMPANY), with_of).when(t.rlike(COMPANY_FIRST), F.trim(part(COMPANY_FIRST, 1))).otherwise("")
    title = F.when(t.rlike(COMPANY), F.trim(part(COMPANY, 5))).when(t.rlike(COMPANY_FIRST), F.trim(part(COMPANY_FIRST, 2))).otherwise(t)
    made = named.withColumn("company", company).withColumn("title", title).drop("_t", raw)
    return made.withColumn("source", energy_source(F.col("title"))).withColumn("kind", permit_kind(F.col("title"))).withColumn("region", F.regexp_extract("title", REGION, 1))


def title_pairs(text: Column) -> Column:
    """The distinct pairs of adjacent letters and digits of a title."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "[^가-힣A-Za-z0-9]", "")
    pairs = F.transform(F.sequence(F.lit(1), F.length(plain) - 1), lambda i: F.substring(plain, i, F.lit(2)))
    return F.when(F.length(plain) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def minutes_beside(results: DataFrame, minutes: DataFrame, keys: list[str], title: str, text: str, least: float = 0.5) -> DataFrame:
    """``results`` with the minutes of the same keys whose title shares half of its pairs: distinct texts, the longest first, without those that stand inside one kept before.

    Titles may be misread, so keys decide and the title only has to be alike.
    Each distinct title of a key asks once, however many results repeat it, and
    equal results stay rows of their own. The texts of one item meet in one row;
    there are as many as its minutes. Result columns may have any name.
    """
    own = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    named = [f"k{i}" for i in range(len(keys))]
    asked = results.select(*own, F.col(title).alias("title")).distinct()
    said = minutes.select(*own, F.col(title).alias("heard"), F.col(text).alias("text")).where("text <> ''").distinct()
    alike = overlap(title_pairs(F.col("title")), title_pairs(F.col("heard"))) >= least
    met = asked.join(said, named).where(alike)
    texts = F.array_sort(F.collect_set(F.struct((-F.length("text")).alias("n"), F.col("text").alias("t"))))
    grouped = met.groupBy(*named, "title").agg(F.transform(texts, lambda x: x["t"]).alias("all"))
    kept = F.aggregate("all", F.array().cast("array<string>"), lambda held, t: F.when(F.exists(held, lambda k: k.contains(t)), held).otherwise(F.concat(held, F.array(t))))
    found = grouped.select(F.struct(*named, "title").alias("_asked"), F.array_join(kept, "\n\n").alias("_minutes"))
    asks = F.struct(*own, F.col(title).alias("title"))
    joined = results.select(F.struct("*").alias("_row"), asks.alias("_by")).join(found, F.col("_by") == F.col("_asked"), "left")
    return joined.select(*[F.col("_row")[c].alias(c) for c in results.columns], F.coalesce("_minutes", F.lit("")).alias("minutes"))
