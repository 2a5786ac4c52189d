"""Ordinances: distances that facilities keep, and slope limits, read from their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.operators.notation import CUTS, evened, metres

#: How a distance, a bracket and the mark of an item are written.
DISTANCE = r"([0-9][0-9,\.]*)\s*(천|만)?\s*(미터|m|M|킬로미터|km|KM)"
BRACKET = r"[(（]([^()（）]*)[)）]"
ITEM = r"(?=\(\d+\)|\n?\s*\d+[\.\)]\s|[가-힣]\.\s)"
ITEM_MARK = r"^\s*(?:\(\d+\)|\d+\.|[가-힣]\.)\s*"
#: What a distance is kept from, first fit first.
TARGETS = {
    "RESIDENTIAL": r"취락|주거\s*밀집|주거\s*지역|주택|가구|세대|호\s*이상|호\s*미만",
    "QUIET_FACILITY": r"정온\s*시설|학교|병원|요양|어린이집|경로당|공공\s*시설",
    "ROAD": r"도로|국도|지방도|군도|고속도로|교통\s*시설",
    "RAILWAY": r"철도|역사",
}
#: Words shortly before a number that is no distance to keep, and how far back they count.
NO_DISTANCE = ("높이", "울타리", "산정 방법", "산정방법", "주택 간", "주택간", "건물 외벽", "차로", "폭", "가로방향", "연속하여", "이격공간", "설치할 경우")
LOOK_BACK = 40
#: A radius in which houses are counted, and its label.
COUNTED = r"반\s*경[^)）]{0,20}?[0-9][0-9,\.]*\s*(?:천|만)?\s*(?:미터|m|M)[^)）]{0,20}?\d+\s*호\s*이상"
COUNTED_LABEL = "호수산정반경(호 기준)"
#: Forms of the words that say what a number applies to; of the first two the last fit counts.
HOUSES, ROADS, FROM = r"([0-9]+호\s*(?:이상|미만)\s*(?:의\s*)?[가-힣]+)", r"([가-힣]{2,}(?:와|과)\s*[가-힣]{2,})\s*에서는", r"([가-힣·\s]{2,24}?)(?:으로부터|로부터|에서부터|와의|과의|경계)"
#: How a slope is written, how far around it an energy source is looked for, and plausible degrees.
SLOPE, SLOPE_AROUND, DEGREES = r"(?:평균\s*)?경사도[^\n]{0,40}?[0-9]{1,2}\s*도", 150, (5, 45)
#: Words of each energy source, and those that mark another one.
SOURCE_WORDS = {"WIND": ("풍력",), "SOLAR": ("태양광", "태양에너지")}
SOURCE_MARKS = {"WIND": "풍력", "SOLAR": "태양"}
#: The head of a table with a column for each energy source, how far it goes, what is left of it before a first row, a row of two distances, and where notes below a table begin.
TABLE_HEAD, HEAD_LENGTH, HEAD_REST = r"구\s*분", 80, r"^.*(?:설비|비고)\s*"
_UNIT = r"\s*(?:미터|m|M|킬로미터|km|KM)\s*이상\s*이격"
TABLE_ROW, TABLE_END = rf"([^\n]{{1,80}}?)([0-9][0-9,\.]*){_UNIT}\s*([0-9][0-9,\.]*){_UNIT}", r"\*\s*상기|[0-9]\.\s*[“\"]|\(비고\)"
#: Fixed value: how an appendix is named.
APPENDIX = r"\[별표\s*([0-9]+)\s*(?:의\s*[0-9]+)?\]"
_CUT, _ZONE = CUTS


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def hits(text: Column, pattern: str, reach: int = LOOK_BACK) -> Column:
    """All places of ``pattern`` as structs (before, hit, after) with up to ``reach`` characters on either side; none for null.

    A text of n places is cut once; each place looks at a fixed number of its neighbours.
    """
    return _places(F.split(F.regexp_replace(evened(text), f"({pattern})", f"{_CUT}$1{_CUT}"), _CUT), reach, F.lit(""))


def _places(parts: Column, reach: int, earlier: Column) -> Column:
    """Places of a cut text, every second part of ``parts``; ``earlier`` is what stands before all of them."""

    def found(cut: Column) -> Column:
        tails, heads = F.transform(cut, lambda p: F.right(p, F.lit(reach))), F.transform(cut, lambda p: F.left(p, F.lit(reach)))
        return F.transform(F.array(F.struct(cut.alias("cut"), tails.alias("tails"), heads.alias("heads"))), place_all)

    def place_all(x: Column) -> Column:
        many = 2 * reach  # of two neighbouring parts one is a hit, and so not empty

        def at(i: Column) -> Column:
            first = F.greatest(2 * i - many, F.lit(1))
            before = F.concat(F.when(first == 1, earlier).otherwise(""), F.array_join(F.slice(x["tails"], first, 2 * i - first), ""))
            after = F.array_join(F.slice(x["heads"], 2 * i + 1, many), "")
            return F.struct(F.right(before, F.lit(reach)).alias("before"), F.get(x["cut"], 2 * i - 1).alias("hit"), F.left(after, F.lit(reach)).alias("after"))

        n = F.floor((F.size(x["cut"]) - 1) / 2).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), at)).otherwise(F.array().cast("array<struct<before:string,hit:string,after:string>>"))

    return F.get(found(parts), F.lit(0))


def target(line: Column) -> Column:
    """What a rule keeps its distance from."""
    return F.coalesce(*[F.when(line.rlike(pattern), name) for name, pattern in TARGETS.items()], F.lit("OTHER"))


def _metres(hit: Column) -> Column:
    return metres(F.regexp_extract(hit, DISTANCE, 1), F.regexp_extract(hit, DISTANCE, 3), F.regexp_extract(hit, DISTANCE, 2))


def no_distance(before: Column) -> Column:
    """Whether the words shortly before a number say that it is a height, a width or the like."""
    return F.right(before, F.lit(LOOK_BACK)).rlike("|".join(NO_DISTANCE))


def detail(before: Column) -> Column:
    """The words before a number that say what it applies to."""
    text = F.regexp_replace(F.trim(before), ITEM_MARK, "")
    last = lambda pattern: F.regexp_replace(F.element_at(F.regexp_extract_all(text, F.lit(pattern), 1), -1), " ", "")
    given = _squeezed(F.regexp_extract(text, FROM, 1))
    some = lambda pattern: text.rlike(pattern)
    return F.when(some(HOUSES), last(HOUSES)).when(some(ROADS), last(ROADS)).when(some(FROM), F.left(given, F.lit(40))).otherwise(F.left(_squeezed(text), F.lit(40)))


def condition(inner: Column) -> Column:
    """A bracket's text without its distances and its first "but"."""
    bare = F.regexp_replace(F.regexp_replace(inner, DISTANCE, " "), r"^[\s,]*(?:단|다만|이하)[\s,]*", "")
    left = F.left(F.regexp_replace(_squeezed(bare), r"^[ ,.·]+|[ ,.·]+$", ""), F.lit(60))
    return F.when(left == "", "단서").otherwise(left)


def _zones(line: Column) -> Column:
    """A line cut where what its numbers apply to changes, as structs (text, label): after each house count; before the first of them after each place "where"; before that after the first "from".

    The label of the zone before all of these is null: there the words before a number decide.
    """
    ended = lambda text, pattern: F.split(F.regexp_replace(text, f"({pattern})", f"$1{_ZONE}"), _ZONE)
    last = lambda text, pattern: F.regexp_replace(F.element_at(F.regexp_extract_all(text, F.lit(pattern), 1), -1), " ", "")

    def named(parts: Column, pattern: str) -> Column:
        return F.transform(F.slice(parts, 2, F.size(parts)), lambda text, i: F.struct(text.alias("text"), last(F.get(parts, i), pattern).alias("label")))

    def by_from(text: Column) -> Column:
        whole = F.regexp_extract(text, FROM, 0)
        end = F.when(whole == "", F.length(text)).otherwise(F.instr(text, whole) + F.length(whole) - 1)
        first = F.struct(F.left(text, end).alias("text"), F.lit(None).cast("string").alias("label"))
        rest = F.struct(F.substring(text, end + 1, F.length(text)).alias("text"), F.left(_squeezed(F.regexp_extract(text, FROM, 1)), F.lit(40)).alias("label"))
        return F.when(whole == "", F.array(first)).otherwise(F.array(first, rest))

    def by_roads(parts: Column) -> Column:
        return F.concat(by_from(F.get(parts, F.lit(0))), named(parts, ROADS))

    def by_houses(parts: Column) -> Column:
        return F.concat(_of(ended(F.get(parts, F.lit(0)), ROADS), by_roads), named(parts, HOUSES))

    return _of(ended(line, HOUSES), by_houses)


def _of(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Parts that hold the first forty visible characters of a line: every second one is a number with its unit.
_FIRST_PARTS = 80


def _line_hits(base: Column) -> Column:
    """The distances (label, metres) of a line outside brackets, in order, each with what it applies to."""
    mark = F.when(base.rlike(rf"^\s*{DISTANCE}"), "").otherwise(F.regexp_extract(base, rf"^ *(?:{ITEM_MARK[1:]})?", 0))
    return _of(F.struct(base.alias("base"), mark.alias("mark"), F.substring(base, F.length(mark) + 1, F.length(base)).alias("rest")), _hits_of)


def _hits_of(line: Column) -> Column:
    def in_zones(zones: Column) -> Column:
        tails = F.concat(F.array(line["mark"]), F.transform(zones, lambda z: F.right(z["text"], F.lit(LOOK_BACK))))
        return _of(tails, lambda held: F.flatten(F.transform(zones, lambda zone, k: in_zone(zone, k, held))))

    def in_zone(zone: Column, k: Column, tails: Column) -> Column:
        earlier = F.array_join(F.slice(tails, F.greatest(k + 2 - LOOK_BACK, F.lit(1)), F.least(k + 1, F.lit(LOOK_BACK))), "")

        def of_parts(parts: Column) -> Column:
            heads = F.transform(F.slice(parts, 1, _FIRST_PARTS), lambda p: F.left(F.regexp_replace(p, r"\s+", " "), F.lit(60)))
            alone = F.when(line["mark"] == "", detail(line["base"])).otherwise("")  # nothing but the mark stands before the number

            def label(i: Column, held: Column) -> Column:
                before = F.array_join(F.slice(held, 1, 2 * i + 1), "")
                bare = F.when(line["mark"] == "", F.regexp_replace(F.trim(before), ITEM_MARK, "")).otherwise(before)
                return F.when(zone["label"].isNotNull(), zone["label"]).when(before == "", alone).otherwise(F.left(_squeezed(bare), F.lit(40)))

            def told(held: Column) -> Column:
                found = F.transform(_places(parts, LOOK_BACK, earlier), lambda h, i: F.struct(_metres(h["hit"]).alias("metres"), no_distance(h["before"]).alias("none"), label(i, held).alias("label")))
                return F.transform(F.filter(found, lambda h: h["metres"].isNotNull() & ~h["none"]), lambda h: F.struct(h["label"].alias("label"), h["metres"].alias("metres")))

            return _of(heads, told)

        return _of(F.split(F.regexp_replace(zone["text"], f"({DISTANCE})", f"{_CUT}$1{_CUT}"), _CUT), of_parts)

    return _of(_zones(line["rest"]), in_zones)


def distances(articles: DataFrame, key: str, text: str) -> DataFrame:
    """(key, item, target, detail, metres, sentence) of every distance that an article's items ask to keep.

    Distances in brackets are conditions of their own, named after the item's
    first distance; a radius in which houses are counted is marked as such. Of
    equal target and detail in one article the first stays; zero is no distance.
    White space of any kind separates words. Work grows with a text's length,
    however many distances it holds.
    """
    items = articles.select(F.col(key), F.posexplode(F.split(evened(F.col(text)), ITEM)).alias("item", "line"))
    cut = items.withColumn("plain", _line_hits(F.regexp_replace("line", BRACKET, "")))
    cut = cut.withColumn("parent", F.coalesce(F.get("plain", F.lit(0))["label"], F.lit("")))

    def bracketed(inner: Column) -> Column:
        named = F.when(F.col("parent") != "", F.concat(F.left("parent", F.lit(40)), F.lit("("), condition(inner), F.lit(")"))).otherwise(condition(inner))
        told = F.when(inner.rlike(COUNTED), COUNTED_LABEL).when(inner.rlike(r"[0-9]+호\s*(?:이상|미만)"), detail(inner)).otherwise(named)
        kept = F.filter(hits(inner, DISTANCE), lambda h: _metres(h["hit"]).isNotNull() & ~no_distance(h["before"]))
        return _of(told, lambda label: F.transform(kept, lambda h: F.struct(label.alias("label"), _metres(h["hit"]).alias("metres"))))

    inside = F.flatten(F.transform(F.regexp_extract_all("line", F.lit(BRACKET), 1), bracketed))
    each = cut.select(key, "item", "line", F.concat("plain", inside).alias("all"))
    labels = F.transform("all", lambda x: x["label"])
    first = _of(labels, lambda held: F.transform(F.array_distinct(held), lambda d: F.get("all", (F.array_position(held, d) - 1).cast("int"))))
    rows = each.select(key, "item", target(F.col("line")).alias("target"), _squeezed(F.col("line")).alias("sentence"), F.posexplode(first).alias("at", "f"))
    one = rows.groupBy(key, "target", F.col("f.label").alias("detail")).agg(F.min(F.struct("item", "at", F.col("f.metres").alias("metres"), "sentence")).alias("r"))
    return one.select(key, "r.item", "target", "detail", "r.metres", "r.sentence")


def slope_limits(articles: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, degrees) of the articles that limit the slope for an energy source: the first limit that is not another source's.

    A limit counts where its own source is named around it, or where the whole text names no other.
    """
    mine, others = "|".join(SOURCE_WORDS[source]), "|".join(m for s, m in SOURCE_MARKS.items() if s != source)
    around = lambda h: F.concat(F.right(h["before"], F.lit(SLOPE_AROUND)), h["hit"], F.left(h["after"], F.lit(SLOPE_AROUND)))
    degrees = lambda h: F.regexp_extract(h["hit"], r"([0-9]{1,2})\s*도$", 1).cast("int")
    fits = lambda h: degrees(h).between(*DEGREES) & (around(h).rlike(mine) | ~F.col(text).rlike(others))
    found = F.transform(F.filter(hits(F.col(text), SLOPE, SLOPE_AROUND), fits), degrees)
    return articles.where(F.col(text).rlike(mine)).select(key, F.get(found, F.lit(0)).alias("degrees")).where("degrees IS NOT NULL")


def table_distances(articles: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, row, appendix, target, detail, metres, sentence) of tables that set two distances side by side, one for each energy source.

    The order of the two sources in the head says which distance is the
    ``source``'s own; a head that does not name both belongs to no such table.
    The first table of a text that has rows counts, up to the notes below it.
    Its appendix is the last one named before it, null without any. Distances
    are in metres whatever unit is written, and zero is none.
    """
    whole = evened(F.col(text))
    parts = F.split(F.regexp_replace(whole, TABLE_HEAD, f"{_CUT}$0"), _CUT)
    rest = lambda part: F.regexp_replace(part, f"^{TABLE_HEAD}", "")
    mine, other = (F.lit(SOURCE_MARKS[s]) for s in (source, next(k for k in SOURCE_MARKS if k != source)))
    # every part carries how far into the text it begins, so that bodies are cut from the text itself
    heads = articles.select(F.col(key), whole.alias("whole"), F.posexplode(parts).alias("no", "part")).where("no > 0")
    heads = heads.withColumn("head", F.left(rest(F.array_join(F.slice(parts_of("whole"), F.col("no") + 1, F.lit(HEAD_LENGTH)), "")), F.lit(HEAD_LENGTH)))
    a, b = F.instr("head", mine), F.instr("head", other)
    named = heads.where((a > 0) & (b > 0)).withColumn("second", a > b)
    tail = rest(F.array_join(F.slice(parts_of("whole"), F.col("no") + 1, F.size(parts_of("whole"))), ""))
    body = F.get(F.split(tail, TABLE_END, 2), F.lit(0))
    rows = F.regexp_extract_all(body, F.lit(TABLE_ROW), 0)
    before = F.regexp_extract_all(F.array_join(F.slice(parts_of("whole"), 1, F.col("no")), ""), F.lit(APPENDIX), 1)
    each = named.select(key, "no", "second", F.element_at(F.when(F.size(before) > 0, before), -1).alias("appendix"), F.posexplode(rows).alias("row", "line"))
    group = lambda g: F.regexp_extract("line", TABLE_ROW, g)
    bare = lambda c: F.regexp_replace(c, r"^[ ·,]+|[ ·,]+$", "")
    label = bare(F.regexp_replace(bare(_squeezed(group(1))), HEAD_REST, ""))
    number = metres(F.when(F.col("second"), group(3)).otherwise(group(2)), F.lit("미터"), F.lit(""))
    told = each.select(key, "no", "row", "appendix", target(label).alias("target"), label.alias("label"), number.alias("metres"), _squeezed(F.col("line")).alias("sentence"))
    kept = told.where("label <> '' AND metres IS NOT NULL")
    first = kept.groupBy(F.col(key).alias("_key")).agg(F.min("no").alias("_first"))
    found = kept.join(first, F.col(key).eqNullSafe(F.col("_key")) & (F.col("no") == F.col("_first")))
    return found.select(key, "row", "appendix", "target", F.left("label", F.lit(60)).alias("detail"), "metres", "sentence")


def parts_of(whole: str) -> Column:
    """A text cut before every head of a table."""
    return F.split(F.regexp_replace(F.col(whole), TABLE_HEAD, f"{_CUT}$0"), _CUT)
