"""Notices of cancelled permits and of hearings, lines of the permit register, and what a region's earlier cases say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.operators.committee import capacity, energy_source, squeezed
from gridlark.operators.notation import evened

_CUT, _PART = "\u0001", "\u0002"
#: Provinces by their names in addresses, longer names first, and the one name of each.
PROVINCES = {
    "강원특별자치도": "강원", "전북특별자치도": "전북", "제주특별자치도": "제주", "세종특별자치시": "세종", "서울특별시": "서울", "부산광역시": "부산", "대구광역시": "대구", "인천광역시": "인천",
    "광주광역시": "광주", "대전광역시": "대전", "울산광역시": "울산", "충청북도": "충북", "충청남도": "충남", "전라북도": "전북", "전라남도": "전남", "경상북도": "경북", "경상남도": "경남",
    "경기도": "경기", "강원도": "강원", "제주도": "제주", "서울시": "서울", "부산시": "부산", "대구시": "대구", "인천시": "인천", "광주시": "광주", "대전시": "대전", "울산시": "울산", "세종시": "세종",
    "서울": "서울", "부산": "부산", "대구": "대구", "인천": "인천", "광주": "광주", "대전": "대전", "울산": "울산", "세종": "세종", "경기": "경기", "강원": "강원", "충북": "충북", "충남": "충남",
    "전북": "전북", "전남": "전남", "경북": "경북", "경남": "경남", "제주": "제주",
}
DISTRICT = "^([가-힣]{2,4}(?:시|군|구))"
#: A permit's number; a capacity and a permit's number before a reason; the same in brackets where no reason is given.
PERMIT = r"(?:19|20)\d\d\s*-\s*\d{1,4}"
WITH_REASON = rf"(\d{{1,5}}(?:\.\d+)?)\s*(?:MW|㎿)?\s+제?\s*({PERMIT})\s*호?\s+(?=전기사업법|상동)"
WITHOUT_REASON = rf"(\d{{1,5}}(?:\.\d+)?)\s*(?:MW|㎿)\s+(?:(?:19|20)\d\d년\s*\d{{1,2}}월\s*\d{{1,2}}일\s*)?\(\s*제?\s*({PERMIT})\s*호?\s*\)"
#: The law a reason cites, the end of a project's name, the beginning of a place, the mark of an equal reason, the head of a table's last column.
CITED = r"전기사업법\s*제\s*\d+\s*조(?:\s*제\s*\d+\s*항)?(?:\s*제\s*\d+(?:\s*의\s*\d+)?\s*호)?(?:\s*(?:및|,)\s*제\s*\d+(?:\s*의\s*\d+)?\s*호)*"
NAMED, SAME, LAST_HEAD = r"발전\s*사업", "상동", "처분사유"
PLACE = r"(?:서울|부산|대구|인천|광주|대전|울산|세종|경기|강원|충북|충남|전북|전남|경북|경남|제주|충청[남북]|전라[남북]|경상[남북])(?:특별자치도|특별자치시|특별시|광역시|도|시)?\s"
#: The head over a party of a hearing, what follows its row, its reason; the mark and name of a labelled party and the patterns of its fields.
PARTY, PLANNED, GROUNDS = r"허가번호\s*발전\s*사업명\s*발전사업자\s*지역\s*", r"예정된\s*처분", r"처분\s*사유\s*(.+?)\s*(?:청문\s*실시|$)"
LABELLED = r"[⑴-⒇①-⑳]\s*(?=.{4,80}?발전\s*사업\s)"
FIELDS = {
    "permit": rf"허가증\s*번호\s*({PERMIT})", "company": r"상\s*호\s*(.+?)\s*(?:성\s*명|대표자|사업장소)", "location": r"사업\s*장소\s*(.+?)\s*(?:원동력|설비\s*용량|예정된)",
    "raw_source": r"원동력의?\s*종류\s*(.+?)\s*(?:설비\s*용량|공사계획)", "megawatts": r"설비\s*용량\s*([\d,]+(?:\.\d+)?)\s*(?:MW|㎿)", "reason": r"(?:취소|처분)\s*사유\s*(.+?)\s*(?:청문|$)",
}
#: The day of a disposal, the committee's round, and a day in a cell of the register.
DAY, ROUND = r"처분\s*일자\s*[:：]?\s*((?:19|20)\d\d)\s*[.년]\s*(\d{1,2})\s*[.월]\s*(\d{1,2})", r"제\s*(\d{2,4})\s*차\s*전기위원회"
CELL_DAY = r"((?:19|20)\d\d)[-.](\d{1,2})(?:[-.](\d{1,2}))?"
#: Letters at a name's ends that belong to no name, the shortest name, the longest reason, letters after the last row that may hold its reason.
EDGES, SHORTEST, REASON_LENGTH, TAIL = r"^[ ·,|]+|[ ·,|]+$", 4, 200, 60
#: Groups of decisions that stand in an applicant's way.
BLOCKING = ("보류", "부결")


def region(location: Column) -> Column:
    """(province, district) of an address; an empty text for what it does not tell. Old and new names of a province are one."""
    plain = F.regexp_replace(evened(location), r"\s+", "")
    head = F.regexp_extract(plain, f"^({'|'.join(PROVINCES)})", 1)
    province = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in PROVINCES.items() for x in p]), head), F.lit(""))
    return F.struct(province.alias("province"), F.regexp_extract(F.substr(plain, F.length(head) + 1), DISTRICT, 1).alias("district"))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def _closed(body: Column, pattern: str) -> Column:
    """What stands before each match, and "first group, second group, what follows" of it, cut at ``_PART``; each text belongs to two rows, as the end of one and the head of the next."""
    pieces = F.split(F.regexp_replace(body, pattern, f"{_CUT}$1{_PART}$2{_PART}"), _CUT)
    return _pairs(F.slice(pieces, 1, F.size(pieces) - 1), F.slice(pieces, 2, F.size(pieces)), "D")


def _blocks(body: Column, pattern: str, layout: str) -> Column:
    """What follows each match of a heading."""
    pieces = F.split(F.regexp_replace(body, pattern, _CUT), _CUT)
    own = F.slice(pieces, 2, F.size(pieces))
    return _pairs(own, own, layout)


def _pairs(before: Column, own: Column, layout: str) -> Column:
    zipped = F.arrays_zip(before.alias("before"), own.alias("own"))
    return F.transform(zipped, lambda x: F.struct(x["before"].alias("before"), x["own"].alias("own"), F.lit(layout).alias("layout")))


def _fields(rows: DataFrame) -> DataFrame:
    """``rows`` (_before, _own, _layout, _last) with the fields of each layout; a row that is none gets an empty name."""
    own, layout = F.col("_own"), F.col("_layout")
    party, label = rf"^({PERMIT})\s+(.+?)\s*{PLANNED}(.*)$", rf"^(.{{4,80}}?{NAMED})\s"
    parts = F.split(own, _PART)
    cut = rows.select(
        "*",
        F.when(layout == "D", F.regexp_replace(F.get(F.split("_before", _PART), F.size(F.split("_before", _PART)) - 1), f"^.*{LAST_HEAD}", "")).when(layout == "T", F.regexp_extract(own, party, 2)).alias("_head"),
        F.when(layout == "D", _bare(F.when(F.col("_last"), F.substring(F.get(parts, F.lit(2)), 1, TAIL)).otherwise(F.get(parts, F.lit(2))))).when(layout == "T", F.regexp_extract(own, party, 3)).otherwise(F.regexp_replace(own, label, "")).alias("_rest"),
    )
    text = cut.withColumn("_head", _bare(F.regexp_replace(F.regexp_replace("_head", rf"^\s*{SAME}\s*", ""), rf"^\s*{CITED}", "")))
    named = text.withColumn("_after", F.when(F.col("_head").rlike(NAMED), _bare(F.regexp_extract("_head", rf"^.*?{NAMED}(.*)$", 1))).otherwise(""))
    of = {k: F.trim(F.regexp_extract("_rest", p, 1)) for k, p in FIELDS.items()}
    placed, has_place, labelled = rf"^(.*?)({PLACE}.*)$", F.col("_after").rlike(PLACE), layout == "L"
    permit = F.when(layout == "D", F.get(parts, F.lit(1))).when(layout == "T", F.regexp_extract(own, party, 1)).otherwise(of["permit"])
    name = F.when(labelled, F.when(of["permit"] != "", _bare(F.regexp_extract(own, label, 1))).otherwise("")).when(F.col("_head").rlike(NAMED), _bare(F.regexp_extract("_head", rf"^(.*?{NAMED})", 1))).otherwise(F.col("_head"))
    reason = F.when(layout == "D", F.trim(F.regexp_extract("_rest", f"^{CITED}", 0))).otherwise(F.substring(F.when(labelled, of["reason"]).otherwise(F.regexp_extract("_rest", GROUNDS, 1)), 1, REASON_LENGTH))
    return named.select(
        *[c for c in rows.columns if c not in ("_before", "_own", "_last")],
        name.alias("name"),
        F.when(labelled, of["company"]).when(has_place, _bare(F.regexp_extract("_after", placed, 1))).otherwise(F.col("_after")).alias("company"),
        F.when(labelled, of["location"]).when(has_place, _bare(F.regexp_extract("_after", placed, 2))).otherwise("").alias("location"),
        F.regexp_replace(permit, r"\s+", "").alias("permit"),
        F.when(layout == "D", capacity(F.get(parts, F.lit(0)))).when(labelled, capacity(of["megawatts"])).alias("megawatts"),
        reason.alias("reason"),
        ((layout == "D") & F.col("_rest").startswith(SAME)).alias("_same"),
        F.when(labelled, of["raw_source"]).otherwise("").alias("_raw"),
    )


def notices(papers: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """The projects (key, no, kind, name, company, location, province, district, source, megawatts, permit, reason, disposed, round) of each notice.

    A paper that speaks of a hearing in its title or its first 400 letters only
    announces (HEARING), all others have decided (DISPOSAL); the two are never
    counted together. A disposal's rows end at a capacity beside a permit's
    number, before a reason or, if no row has one, in brackets. A hearing has a
    small table for each party or, if none is found, labelled fields. Names
    under four letters are headings. "The same" stands for the reason of the row
    before. Null texts and titles are empty, papers without rows give none,
    repeated papers repeat their rows, and other columns are left behind.
    """
    whole = papers.select(F.col(key).alias("_k"), evened(F.col(title)).alias("_title"), evened(F.col(text)).alias("_text"))
    read = whole.withColumn("_body", F.regexp_replace("_text", r"\s+", " ")).select(
        "_k",
        F.when(F.concat_ws(" ", "_title", F.substring("_text", 1, 400)).contains("청문"), "HEARING").otherwise("DISPOSAL").alias("_kind"),
        F.when(F.col("_text").rlike(DAY), F.format_string("%s-%02d-%02d", *[F.regexp_extract("_text", DAY, g) if g == 1 else F.regexp_extract("_text", DAY, g).cast("int") for g in (1, 2, 3)])).otherwise("").alias("_day"),
        F.nullif(F.regexp_extract("_text", ROUND, 1), F.lit("")).cast("int").alias("_round"),
        "_body",
        F.xxhash64("_title", "_text").alias("_paper"),
    )
    body, none = F.col("_body"), "array<struct<before:string,own:string,layout:string>>"
    closed = F.when(body.rlike(WITH_REASON), _closed(body, WITH_REASON)).otherwise(_closed(body, WITHOUT_REASON))
    heard = F.concat(_blocks(body, rf"{PARTY}(?={PERMIT}\s)", "T"), _blocks(body, LABELLED, "L"))
    told = read.select("_k", "_kind", "_day", "_round", "_paper", F.when(F.col("_kind") == "HEARING", heard).otherwise(closed).cast(none).alias("_rows"))
    each = told.select("_k", "_kind", "_day", "_round", "_paper", F.size("_rows").alias("_n"), F.posexplode("_rows").alias("_at", "_r"))
    cut = each.select("_k", "_kind", "_day", "_round", "_paper", "_at", F.col("_r.before").alias("_before"), F.col("_r.own").alias("_own"), F.col("_r.layout").alias("_layout"), (F.col("_at") == F.col("_n") - 1).alias("_last"))
    paper = Window.partitionBy("_k", "_paper")
    kept = _fields(cut).where(F.length("name") >= SHORTEST).withColumn("_table", F.max(F.col("_layout") == "T").over(paper)).where((F.col("_layout") != "L") | ~F.col("_table"))
    before = paper.orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.coalesce(F.last(F.when(~F.col("_same"), F.col("reason")), True).over(before), F.lit(SAME))
    full = kept.withColumn("_no", F.dense_rank().over(paper.orderBy("_at"))).withColumn("reason", F.when(F.col("_same"), carried).otherwise(F.col("reason"))).withColumn("_region", region(F.col("location")))
    return full.select(
        F.col("_k").alias(key), F.col("_no").alias("no"), F.col("_kind").alias("kind"), "name", "company", "location", "_region.province", "_region.district", energy_source(F.when(F.col("_raw") != "", F.col("_raw")).otherwise(F.col("name"))).alias("source"),
        "megawatts", "permit", "reason", F.col("_day").alias("disposed"), F.col("_round").alias("round"),
    )


def register_day(text: Column) -> Column:
    """The first day or month of a cell as yyyy-mm-dd or yyyy-mm; empty without one."""
    plain = evened(text)
    part = lambda g: F.regexp_extract(plain, CELL_DAY, g)
    month = F.format_string("%s-%02d", part(1), part(2).cast("int"))
    return F.when(part(1) == "", "").when(part(3) == "", month).otherwise(F.concat(month, F.format_string("-%02d", part(3).cast("int"))))


def register(lines: DataFrame, key: str, cells: str) -> DataFrame:
    """Lines of the permit register (key, year, no, company, location, province, district, source, raw_source, megawatts, permitted, ready, changed) from arrays of ``cells``.

    A line has nine cells or more, of which the first is a year; all others are
    heads or notes. The first seven have their places; of the rest, the first
    that is a day tells when the plant must be ready, and all that are no days
    tell what was changed (empty: the first permit). Null cells are empty.
    """
    tidy = F.transform(F.col(cells), lambda c: F.trim(F.regexp_replace(evened(c), "\n", " ")))
    read = lines.select(F.col(key).alias("_k"), tidy.alias("_c")).where((F.size("_c") >= 9) & F.get("_c", F.lit(0)).rlike(r"^(19|20)\d\d$"))
    cell = lambda i: F.get("_c", F.lit(i))
    rest = F.filter(F.slice("_c", 8, F.greatest(F.size("_c") - 7, F.lit(0))), lambda c: c != "")
    day = lambda c: c.rlike(f"^{CELL_DAY}$")
    full = read.withColumn("_rest", rest).withColumn("_place", squeezed(cell(3))).withColumn("_at", region(F.col("_place")))
    return full.select(
        F.col("_k").alias(key), cell(0).alias("year"), cell(1).alias("no"), squeezed(cell(2)).alias("company"), F.col("_place").alias("location"), "_at.province", "_at.district",
        energy_source(cell(4)).alias("source"), squeezed(cell(4)).alias("raw_source"), capacity(cell(5)).alias("megawatts"), register_day(cell(6)).alias("permitted"),
        register_day(F.get(F.filter("_rest", day), F.lit(0))).alias("ready"), F.array_join(F.filter("_rest", lambda c: ~day(c)), " / ").alias("changed"),
    )


def stem(district: Column) -> Column:
    """A district's name as titles have it, without its last syllable for what it is."""
    return F.regexp_replace(F.coalesce(district, F.lit("")), "(시|군|구)$", "")


def precedents(asked: DataFrame, permits: DataFrame, decided: DataFrame, cancelled: DataFrame, longest: int = 6) -> DataFrame:
    """What earlier cases say of each distinct (province, district, source) of ``asked``.

    ``permits`` (district, province, source, megawatts, permitted, changed) and
    ``cancelled`` (district, source, disposed) are matched by district and
    source. ``decided`` (source, title, decision_group, reason, round) has no
    addresses, so a case belongs to every district whose stem stands in its
    title; stems have at most ``longest`` letters. Titles are cut once into
    their pieces of that many letters or fewer, so the match is an equality join
    and no title meets every district. Every side is summed before it is joined,
    and pieces that no district asks for fall out by a semi join first.

    Columns: permits, first_permits, most_mw, total_mw, latest, the counts of
    decisions by group (a map), blocked, blocked_round and blocked_reason of the
    case to show first (with a reason before without, then the latest round),
    cancelled, last_cancelled, in_province. Missing counts are 0.
    """
    at, zero = ["district", "source"], F.lit(0).cast("long")
    asks = asked.select("province", *at).distinct().withColumn("_stem", stem(F.col("district")))
    of = permits.groupBy(*at).agg(
        F.count(F.lit(1)).alias("permits"), F.count_if(F.coalesce("changed", F.lit("")) == "").alias("first_permits"), F.coalesce(F.max("megawatts"), F.lit(0.0)).alias("most_mw"),
        F.round(F.coalesce(F.sum("megawatts"), F.lit(0.0)), 1).alias("total_mw"), F.max(F.nullif("permitted", F.lit(""))).alias("latest"),
    )
    around = permits.groupBy("province", "source").agg(F.count(F.lit(1)).alias("in_province"))
    gone = cancelled.groupBy(*at).agg(F.count(F.lit(1)).alias("cancelled"), F.max(F.nullif("disposed", F.lit(""))).alias("last_cancelled"))

    stems = asks.where("_stem <> ''").select("source", "_stem").distinct()
    title = F.coalesce("title", F.lit(""))
    pieces = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.length(title) >= n, F.transform(F.sequence(F.lit(1), F.length(title) - n + 1), lambda i: F.substr(title, i, n))).otherwise(F.array().cast("array<string>")))))
    held = decided.select("source", "decision_group", "reason", "round", "title", F.explode(pieces).alias("_stem")).join(stems, ["source", "_stem"], "left_semi")
    reason = F.coalesce("reason", F.lit(""))
    shown = F.when(F.col("decision_group").isin(*BLOCKING), F.struct((reason != "").alias("told"), F.coalesce("round", F.lit(0)).alias("round"), title.alias("title"), reason.alias("reason")))
    groups = held.groupBy("source", "_stem", "decision_group").agg(F.count(F.lit(1)).alias("n"), F.max(shown).alias("shown"))
    cases = groups.groupBy("source", "_stem").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("decision_group", F.lit("")).alias("k"), F.col("n").alias("v"))))).alias("decisions"),
        F.sum(F.when(F.col("decision_group").isin(*BLOCKING), F.col("n"))).alias("blocked"), F.max("shown").alias("_shown"),
    )
    met = asks.join(of, at, "left").join(around, ["province", "source"], "left").join(gone, at, "left").join(cases, ["source", "_stem"], "left")
    count = lambda c: F.coalesce(c, zero).alias(c)
    return met.select(
        "province", *at, count("permits"), count("first_permits"), F.coalesce("most_mw", F.lit(0.0)).alias("most_mw"), F.coalesce("total_mw", F.lit(0.0)).alias("total_mw"), "latest",
        F.coalesce("decisions", F.create_map().cast("map<string,bigint>")).alias("decisions"), count("blocked"), F.col("_shown.round").alias("blocked_round"), F.col("_shown.reason").alias("blocked_reason"),
        count("cancelled"), "last_cancelled", count("in_province"),
    )
