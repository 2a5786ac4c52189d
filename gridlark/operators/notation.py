"""Columns that read the notations of registers and laws: heights, voltages, distances, articles, land categories, names of places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sign of a land category and its name.
LAND_CATEGORIES = {
    "전": "전", "답": "답", "과": "과수원", "목": "목장용지", "임": "임야", "광": "광천지", "염": "염전", "대": "대", "장": "공장용지", "학": "학교용지",
    "차": "주차장", "주": "주유소용지", "창": "창고용지", "도": "도로", "철": "철도용지", "제": "제방", "천": "하천", "구": "구거", "유": "유지", "양": "양어장",
    "수": "수도용지", "공": "공원", "체": "체육용지", "원": "유원지", "종": "종교용지", "사": "사적지", "묘": "묘지", "잡": "잡종지",
}
#: What multiplies a number of metres.
SCALES = {"천": 1_000, "만": 10_000}
#: Forms of the dot between words of a law's name, and the one they become.
DOTS, DOT = "·‧・•", "ㆍ"


#: White space beyond ASCII, which Java's patterns do not know as such, and signs that parsers here cut at.
WIDE_BLANKS = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CUTS = "\u0001\u0002"


def blank(text: Column) -> Column:
    """Null as empty text."""
    return F.coalesce(text, F.lit(""))


def evened(text: Column) -> Column:
    """A text to be cut: null as empty, every white space beyond ASCII as a blank, without the signs that mark a cut."""
    return F.translate(blank(text), WIDE_BLANKS + CUTS, " " * len(WIDE_BLANKS))


def altitude_feet(raw: Column) -> Column:
    """Feet of an airspace limit: ground is 0, a flight level counts hundreds, no limit and unreadable text give null."""
    s = F.upper(F.trim(blank(raw)))
    level = F.regexp_extract(s, r"FL *([0-9]+)", 1)
    plain = F.regexp_replace(F.regexp_extract(s, r"^([0-9][0-9 ,]*)(?: *(?:FT|AMSL|AGL|MSL))*$", 1), "[ ,]", "")
    return (
        F.when(s.isin("GND", "SFC", "SURFACE"), F.lit(0.0))
        .when(s.startswith("UNL"), F.lit(None))
        .when(level != "", level.try_cast("double") * 100)
        .when(plain != "", plain.try_cast("double"))
    )


def max_voltage(raw: Column) -> Column:
    """The highest number of a list in volts; 0 where none can be read."""
    volts = F.transform(F.split(blank(raw), "[;,]"), lambda p: F.trim(p).try_cast("double").try_cast("long"))
    return F.greatest(F.lit(0).cast("long"), F.coalesce(F.array_max(volts), F.lit(0).cast("long")))


def metres(number: Column, unit: Column, scale: Column) -> Column:
    """Whole metres of a phrase in metres or kilometres, with a word for thousands; null unless positive."""
    times = F.lit(1)
    for word, by in SCALES.items():
        times = F.when(F.trim(blank(scale)) == word, F.lit(by)).otherwise(times)
    far = F.lower(blank(unit)).isin("킬로미터", "km")
    value = F.regexp_replace(number, ",", "").try_cast("double") * times * F.when(far, 1_000).otherwise(1)
    return F.when(value > 0, F.bround(value).cast("long"))


def distance_text(m: Column) -> Column:
    """A distance as people read it; a kilometre figure that lies halfway by its shortest decimal form is rounded up."""
    return F.when(m <= 0, "중첩(0m)").when(m < 1_000, F.format_string("%,.0fm", F.bround(m, 0))).otherwise(F.format_string("%,.2fkm", m / 1_000))


def land_category(lot: Column) -> Column:
    """The category whose sign stands last in a lot number; empty without any."""
    sign = F.regexp_extract(blank(lot), rf"([{''.join(LAND_CATEGORIES)}])[^{''.join(LAND_CATEGORIES)}]*$", 1)
    names = F.create_map(*[F.lit(x) for pair in LAND_CATEGORIES.items() for x in pair])
    return blank(F.try_element_at(names, sign))


def place(name: Column) -> Column:
    """(sido, sigungu) of a full name: a ward inside a city belongs to the city, a lone name is both."""
    parts = F.filter(F.split(F.trim(blank(name)), r"\s+"), lambda p: p != "")
    n = F.size(parts)
    first, second, last = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, n - 1)
    inner = F.when((n >= 3) & last.endswith("구"), second).otherwise(last)
    return F.struct(blank(first).alias("sido"), blank(inner).alias("sigungu"))


def article(label: Column) -> Column:
    """(number, branch) of an article's label; empty where none is named."""
    pattern = r"제\s*([0-9]+)\s*조(?:\s*의\s*([0-9]+))?"
    return F.struct(F.regexp_extract(blank(label), pattern, 1).alias("number"), F.regexp_extract(blank(label), pattern, 2).alias("branch"))


def article_key(key: Column) -> Column:
    """(number, branch) of a six-digit key: four digits and two, without leading zeros; other digits are a number alone."""
    k = blank(key)
    digits = lambda c: c.try_cast("long").cast("string")
    number = F.when(k.rlike("^[0-9]{6}$"), digits(F.substring(k, 1, 4))).when(k.rlike("^[0-9]+$"), digits(k)).otherwise(k)
    branch = F.when(k.rlike("^[0-9]{6}$") & ~k.endswith("00"), digits(F.substring(k, 5, 2))).otherwise("")
    return F.struct(number.alias("number"), branch.alias("branch"))


def law_name(name: Column) -> Column:
    """A law's name without white space and with one form of dot."""
    return F.regexp_replace(F.translate(blank(name), DOTS, DOT * len(DOTS)), r"\s+", "")


def calendar_date(text: Column) -> Column:
    """The first date of a text as YYYY-MM-DD, or YYYY-MM; empty without any."""
    pattern = r"((?:19|20)[0-9]{2})[-.]([0-9]{1,2})(?:[-.]([0-9]{1,2}))?"
    part = lambda g: F.regexp_extract(blank(text), pattern, g)
    day = F.when(part(3) != "", F.concat(F.lit("-"), F.lpad(part(3), 2, "0"))).otherwise("")
    return F.when(part(1) == "", "").otherwise(F.concat(part(1), F.lit("-"), F.lpad(part(2), 2, "0"), day))


def run_label(numbers: Column) -> Column:
    """Sorted distinct whole numbers as one text: three or more in a row as ``a~b``, the rest one by one, joined by ``·``.

    Number ``x`` at place ``i`` belongs to the run ``x - i``, so runs are the
    distinct values of that difference.
    """
    ordered = F.array_sort(F.array_distinct(numbers))
    runs = F.array_distinct(F.transform(ordered, lambda x, i: x - i))

    def written(run: Column) -> Column:
        own = F.filter(ordered, lambda x, i: x - i == run)
        span = F.concat(F.element_at(own, 1).cast("string"), F.lit("~"), F.element_at(own, -1).cast("string"))
        return F.when(F.size(own) >= 3, span).otherwise(F.array_join(own.cast("array<string>"), "·"))

    return F.when(F.size(ordered) == 0, "-").otherwise(F.array_join(F.transform(runs, written), "·"))


#: Square metres of a pyeong, endings of a substation's name in the order in which they are tried, and how much of a reason is quoted.
PYEONG, SUBSTATIONS, QUOTED = 3.305785, ("변전소", "변전소S/S", "S/S", "SS", "SA", "CB", "개폐소"), 110
#: Uses of buildings that keep a distance, by kind.
BUILDINGS = {"HOUSING": ["단독주택", "공동주택"], "LIVESTOCK": ["동물및식물관련시설"], "QUIET": ["교육연구시설", "종교시설", "관광휴게시설", "노유자시설", "의료시설", "수련시설", "문화및집회시설"]}
ANNEX_BUILDING = "부속건축물"


def coordinate_prefix(degrees: Column) -> Column:
    """A coordinate to two places without zeros at its end, as a prefix of longer ones."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", F.bround(degrees, 2)), "0+$", ""), r"\.$", "")


def snapped(value: Column, grid: float) -> Column:
    """The nearest point of a grid; halves go to the even one."""
    return F.bround(value / grid, 0) * grid


def area_text(square_metres: Column) -> Column:
    """An area in pyeong, hectares and square metres."""
    return F.format_string("%,.0f평 (%,.1f ha · %,.0f㎡)", square_metres / PYEONG, square_metres / 10_000, square_metres)


def folder_name(raw: Column) -> Column:
    """A name that is one folder: no separators, reserved characters or dots at its ends."""
    bare = F.regexp_replace(F.trim(blank(raw)), r"^\.+|\.+$", "")
    return F.trim(F.regexp_replace(bare, r'[\\/:*?"<>|]', "_"))


def substation(name: Column) -> Column:
    """A substation's name without blanks, brackets and the first ending that fits."""
    bare = F.regexp_replace(F.regexp_replace(blank(name), r"\s+", ""), r"\(.*?\)", "")
    out = bare
    for ending in reversed(SUBSTATIONS):
        out = F.when(bare.endswith(ending), F.substring(bare, F.lit(1), F.length(bare) - len(ending))).otherwise(out)
    return out


def road_key(road: Column, number: Column) -> Column:
    """A building's road and its main and sub number; null without either."""
    found = r"^(\d+)(?:-(\d+))?"
    sub = F.regexp_extract(F.trim(blank(number)), found, 2)
    key = F.concat(road, F.lit("|"), F.regexp_extract(F.trim(blank(number)), found, 1), F.lit("-"), F.when(sub == "", "0").otherwise(sub))
    return F.when((blank(road) != "") & F.trim(blank(number)).rlike(found), key)


def feature_key(own: Column, properties: list[tuple[str, Column]], geometry: Column) -> Column:
    """What tells features apart: their id, else the first property that has a value, with its name, else a digest of the geometry."""
    named = [F.when(blank(c.cast("string")) != "", F.concat(F.lit(f"{name}:"), c.cast("string"))) for name, c in properties]
    return F.coalesce(F.when(blank(own) != "", own), *named, F.md5(geometry.cast("string").cast("binary")))


def clipped(reason: Column, most: int = QUOTED) -> Column:
    """A reason of up to ``most`` characters: cut behind its last sentence there, else before its last blank, if that leaves two fifths, else right there."""
    cut = F.substring(reason, 1, most)
    at = lambda sign: F.length(cut) - F.instr(F.reverse(cut), sign[::-1]) - len(sign) + 1
    last = lambda sign: F.when(F.contains(cut, F.lit(sign)), at(sign)).otherwise(-1)
    sentence, word = F.greatest(last("다. "), last(". ")), last(" ")
    at_word = F.when(word > most * 0.4, F.substring(reason, F.lit(1), word)).otherwise(cut)
    return F.when(F.length(reason) <= most, reason).otherwise(F.regexp_replace(F.when(sentence > most * 0.4, F.substring(reason, F.lit(1), sentence + 1)).otherwise(at_word), r"\s+$", ""))


def building_kind(annexed: Column, purpose: Column) -> Column:
    """What a building is to an ordinance: an annex whatever its use, else by its use, else no target."""
    kinds = [F.when(F.trim(blank(purpose)).isin(*uses), F.lit(kind)) for kind, uses in BUILDINGS.items()]
    return F.coalesce(F.when(F.trim(blank(annexed)) == ANNEX_BUILDING, F.lit("ANNEX")), *kinds, F.lit("NOT_TARGET"))
