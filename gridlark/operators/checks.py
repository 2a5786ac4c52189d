"""Verdict rows of single checks over all sites at once: parcels and their zones, owners and land, graded maps, heritage, nature, sea.

Every check takes the sites and what was found for them, and returns one row for
each distinct site: (site, item, status, difficulty, confidence, why) and the
figures it rests on. Evidence is summed by site before it meets the sites, so a
site with a third of all parcels is only partial sums; what is collected are the
few names shown. Shares are not rounded. A site without evidence is unknown with its cause, never clear,
unless the check says that finding nothing is the answer. Rows of null sites are
left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.operators.judgements import FOREST_CLASS, HERITAGE, OWNERSHIP, PARCELS
from gridlark.operators.notation import blank
from gridlark.operators.rules import severity

#: Classes of forest land, hardest first, the verdict of each, words of other forest zones, and codes of the classes among zones.
FOREST = {"공익용산지": ("CONDITIONAL", "CRITICAL"), "임업용산지": ("CONDITIONAL", "HIGH"), "보전산지": ("CONDITIONAL", "HIGH"), "준보전산지": ("POSSIBLE", "LOW")}
FOREST_WORDS, FOREST_CODES, FACILITIES = "산지|산림|사방지", ("UFM100", "UFM110", "UFM120", "UFM200"), ("UQS", "UQT")
CONFLICT, TOUCH, WOODS = "저촉", "접함", "임야"
#: Owners whose land must be leased from the state, owners whose land need not, and categories that are usually public.
PUBLIC, PRIVATE = ("국유지", "공유지", "시유지", "도유지", "군유지", "구유지"), ("개인", "법인", "종중", "종교단체", "외국인", "기타")
LIKELY_PUBLIC = ("구거", "제방", "도로", "하천", "유지", "잡종지")
#: Categories that need another permit, and those that forest permits open.
CONVERTED, OPEN = ("전", "답", "과수원", "대", "묘지"), ("임야", "잡종지", "목장용지")
#: Verdicts of the grades of the ecology map (9 is land under other protection) and of the landslide map.
ECOLOGY = {1: ("CONDITIONAL", "CRITICAL"), 2: ("CONDITIONAL", "HIGH"), 3: ("POSSIBLE", "LOW"), 9: ("CONDITIONAL", "CRITICAL")}
LANDSLIDE = {1: ("CONDITIONAL", "CRITICAL"), 2: ("CONDITIONAL", "HIGH"), 3: ("CONDITIONAL", "MEDIUM"), 4: ("POSSIBLE", "LOW"), 5: ("POSSIBLE", "LOW")}
#: Names of checks, the share from which habitats cover most of a site, how many zones are named.
ZONES_ITEM, LAND_ITEM, NATURE, BIRDS, SEA = "필지 지역지구(토지이용계획)", "토지특성(지형·진입도로)", "생태·경관보전지역", "철새도래지", "유효지역(해역 제외)"
MOSTLY, NAMED = 0.6, 14
#: Datasets of listed heritage, and of zones with limits of their own.
LISTED, LIMITED = ("heritage_국가지정유산", "heritage_시도지정유산", "heritage_국가등록문화유산", "heritage_시도등록문화유산"), ("heritage_현상변경허용기준",)


def _row(status: str | Column, difficulty: str | Column, confidence: str = "MEDIUM", why: str = "") -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_column(status).alias("status"), as_column(difficulty).alias("difficulty"), F.lit(confidence).alias("confidence"), F.lit(why).alias("why"))


def _unknown(why: str, difficulty: str = "MEDIUM") -> Column:
    return _row("UNKNOWN", difficulty, "LOW", why)


def _rows(sums: DataFrame, site: str, item: str, verdict: Column, facts: dict[str, Column]) -> DataFrame:
    return sums.withColumn("_v", verdict).select(site, F.lit(item).alias("item"), "_v.status", "_v.difficulty", "_v.confidence", "_v.why", *[c.alias(n) for n, c in facts.items()])


def _judged(sites: DataFrame, site: str, sums: DataFrame, item: str, verdict: Column, facts: dict[str, Column]) -> DataFrame:
    """One row for each distinct site, judged by its sums; ``facts`` are columns over the sums, null ones for sites without any."""
    named = sums.withColumnRenamed(site, "_site")
    met = sites.select(F.col(site).alias("_site")).where("_site IS NOT NULL").distinct().join(named, "_site", "left")
    return _rows(met.withColumnRenamed("_site", site), site, item, verdict, facts)


def _tallied(sites: DataFrame, site: str, found: DataFrame, **sums: Column) -> DataFrame:
    """``sums`` over the rows ``found`` of each distinct site, null for sites without any: sites and rows are grouped together, once, so neither is sorted for a join.

    The sums also see a row of nulls for each site, on which ``_found`` is null, and must pass over it.
    """
    both = found.withColumn("_found", F.lit(True)).unionByName(sites.select(site, F.lit(True).alias("_asked")), allowMissingColumns=True).where(F.col(site).isNotNull())
    each = both.groupBy(site).agg(F.count("_asked").alias("_asked"), F.count("_found").alias("_found"), *[c.alias(n) for n, c in sums.items()])
    return each.where("_asked > 0").select(F.col(site).cast(sites.schema[site].dataType).alias(site), *[F.when(F.col("_found") > 0, F.col(n)).alias(n) for n in sums])


def _count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast("long"))


def _stored(stored: DataFrame | None, layer: str, sums: DataFrame, grade: str) -> DataFrame:
    """``sums`` with the stored rule (``_rule``: status, difficulty) of their grade, if ``stored`` (layer, grade, status, difficulty) has one; the least of several."""
    if stored is None:
        return sums.withColumn("_rule", F.lit(None).cast("struct<status:string,difficulty:string>"))
    rules = stored.where(F.col("layer") == layer).groupBy(F.col("grade").cast("string").alias("_grade")).agg(F.min(F.struct("status", "difficulty")).alias("_rule"))
    return sums.join(rules, F.col(grade).cast("string") == F.col("_grade"), "left").drop("_grade")


def _verdict_of(grade: Column, table: dict) -> Column:
    """The stored rule of a grade, else that of the table; a grade that neither knows is unknown."""
    found = F.when(F.col("_rule").isNotNull(), _row(F.col("_rule.status"), F.col("_rule.difficulty")))
    for name, (status, difficulty) in table.items():
        found = found.when(grade == F.lit(name), _row(status, difficulty))
    return found.otherwise(_row("UNKNOWN", "MEDIUM"))


def _parcels(parcels: DataFrame, site: str, *more: str) -> DataFrame:
    return parcels.where(F.col(site).isNotNull()).select(site, "parcel", *more).dropDuplicates([site, "parcel"])


def forest_class(sites: DataFrame, parcels: DataFrame, zones: DataFrame, site: str, stored: DataFrame | None = None) -> DataFrame:
    """The hardest class of forest land on a site's ``parcels`` (site, parcel, category), by ``zones`` (parcel, zone, code, touch).

    ``classes`` counts, hardest first, the parcels that a class overlaps and those
    it only touches; ``others`` names other forest zones. Without any class, a
    site with woods was not read, which is not the same as a site without woods.
    """
    own = _parcels(parcels, site, "category")
    zone = F.trim(blank(F.col("zone")))
    about = zones.select("parcel", zone.alias("zone"), F.trim(blank(F.col("touch"))).alias("touch")).where(zone.isin(*FOREST) | zone.rlike(FOREST_WORDS))
    met = own.join(about, "parcel")
    tally = lambda name, how: F.count_if((F.col("zone") == name) & (F.col("touch") == how))
    each = [F.struct(F.lit(c).alias("name"), F.count_if(F.col("zone") == c).alias("n"), tally(c, CONFLICT).alias("overlaps"), tally(c, TOUCH).alias("touches")) for c in FOREST]
    seen = met.groupBy(site).agg(F.array(*each).alias("_all"), F.array_sort(F.collect_set(F.when(~F.col("zone").isin(*FOREST), F.col("zone")))).alias("others"))
    counts = own.groupBy(site).agg(F.count(F.lit(1)).alias("parcels"), F.count_if(F.col("category") == WOODS).alias("woods"))
    sums = counts.join(seen, site, "left").withColumn("_classes", F.filter("_all", lambda c: c["n"] > 0)).withColumn("_worst", F.get("_classes", F.lit(0))["name"])
    named = F.transform("_classes", lambda c: F.format_string(f"%s({CONFLICT} %d·{TOUCH} %d)", c["name"], c["overlaps"], c["touches"]))
    worst = F.col("_worst")
    verdict = (
        F.when(F.col("parcels").isNull(), _unknown("NO_PARCELS")).when(worst.isNull() & (F.col("woods") > 0), _unknown("WOODS_NOT_READ")).when(worst.isNull(), _unknown("NO_DATA")).otherwise(_verdict_of(worst, FOREST))
    )
    return _judged(sites, site, _stored(stored, "산지구분", sums, "_worst"), FOREST_CLASS, verdict, {"worst": worst, "classes": F.coalesce(F.array_join(named, " / "), F.lit("")), "others": F.coalesce("others", F.array().cast("array<string>")), "parcels": _count("parcels"), "woods": _count("woods")})


def land_zones(sites: DataFrame, parcels: DataFrame, zones: DataFrame, rules: list[tuple[str, str, str]], site: str) -> DataFrame:
    """All zones but forest classes on a site's parcels, judged by the hardest of the ``rules`` (word, status, difficulty) that their names match.

    Zones of one name count once per site; each takes the first rule whose word
    stands in its name. Of the hits the severest decides, the hardest status and
    then the first name on a tie. City facilities are counted apart and match no
    rule. ``names`` shows the zones with most overlaps, a list of 14; figures
    count them all.
    """
    zone, code = F.trim(blank(F.col("zone"))), F.trim(blank(F.col("code")))
    read = zones.select("parcel", zone.alias("zone"), code.alias("code"), (blank(F.col("touch")) == TOUCH).alias("_touch")).where((zone != "") & ~code.isin(*FOREST_CODES))
    each = _parcels(parcels, site).join(read, "parcel").groupBy(site, "zone").agg(F.count_if(~F.col("_touch")).alias("overlaps"), F.min("code").alias("code"))
    facility = F.lit(False)
    for head in FACILITIES:
        facility = facility | F.col("code").startswith(head)
    listed = F.array(*[F.struct(F.lit(w).alias("word"), severity(F.lit(d)).alias("s"), F.lit(st).alias("status"), F.lit(d).alias("difficulty")) for w, st, d in rules])
    hit = F.get(F.filter(listed, lambda r: F.col("zone").contains(r["word"])), F.lit(0)) if rules else F.lit(None).cast("struct<word:string,s:bigint,status:string,difficulty:string>")
    told = each.withColumn("_facility", facility).withColumn("_hit", F.when(~F.col("_facility"), hit))
    order = Window.partitionBy(site, "_facility").orderBy(F.desc("overlaps"), "zone")
    hard = F.array_position(F.array(*map(F.lit, ("POSSIBLE", "UNKNOWN", "CONDITIONAL", "IMPOSSIBLE"))), F.col("_hit.status"))
    sums = told.withColumn("_place", F.row_number().over(order)).groupBy(site).agg(
        F.count_if(~F.col("_facility")).alias("zones"), F.count_if("_facility").alias("facilities"), F.count("_hit").alias("hits"),
        F.min(F.when(F.col("_hit").isNotNull(), F.struct((-F.col("_hit.s")).alias("s"), (-hard).alias("h"), F.col("zone"), F.col("_hit.status").alias("status"), F.col("_hit.difficulty").alias("difficulty")))).alias("_worst"),
        F.array_sort(F.collect_list(F.when(~F.col("_facility") & (F.col("_place") <= NAMED), F.struct("_place", "zone")))).alias("_names"),
    )
    verdict = F.when(F.col("zones").isNull(), _unknown("NO_DATA")).when(F.col("_worst").isNull(), _row("POSSIBLE", "LOW")).otherwise(_row(F.col("_worst.status"), F.col("_worst.difficulty")))
    return _judged(sites, site, sums, ZONES_ITEM, verdict, {"zones": _count("zones"), "facilities": _count("facilities"), "hits": _count("hits"), "worst": F.col("_worst.zone"), "names": F.coalesce(F.col("_names.zone"), F.array().cast("array<string>"))})


def ownership(sites: DataFrame, parcels: DataFrame, owners: DataFrame, site: str) -> DataFrame:
    """Whose land a site's ``parcels`` (site, parcel, category, area) are, by ``owners`` (parcel, owner).

    State land is conditional. An owner that is neither known as public nor as
    private leaves the site unknown: it is not taken for private. Parcels without
    a record whose category is usually public are told with their area, as the
    figures of the others say nothing of them. Of several records of a parcel the
    first by name counts.
    """
    own = _parcels(parcels, site, "category", "area")
    read = owners.groupBy("parcel").agg(F.min(F.trim(blank(F.col("owner")))).alias("owner"))
    owner, known = F.col("owner"), F.col("owner").isNotNull()
    likely = ~known & F.col("category").isin(*LIKELY_PUBLIC)
    sums = own.join(read, "parcel", "left").groupBy(site).agg(
        F.count(owner).alias("read"), F.count_if(owner.isin(*PUBLIC)).alias("public"), F.count_if(known & ~owner.isin(*PUBLIC, *PRIVATE)).alias("unclear"),
        F.count_if(likely).alias("likely"), F.coalesce(F.sum(F.when(likely, F.col("area"))), F.lit(0.0)).alias("likely_m2"),
    )
    verdict = (
        F.when(F.col("read").isNull(), _unknown("NO_PARCELS")).when(F.col("read") == 0, _unknown("NO_DATA")).when(F.col("public") > 0, _row("CONDITIONAL", "HIGH")).when(F.col("unclear") > 0, _row("UNKNOWN", "LOW", "MEDIUM", "UNCLEAR_OWNER")).otherwise(_row("POSSIBLE", "LOW"))
    )
    return _judged(sites, site, sums, OWNERSHIP, verdict, {**{c: _count(c) for c in ("read", "public", "unclear", "likely")}, "likely_m2": F.coalesce("likely_m2", F.lit(0.0))})


def land_character(sites: DataFrame, parcels: DataFrame, lands: DataFrame, site: str) -> DataFrame:
    """Parcels without a road and steep ones, by ``lands`` (parcel, terrain, road); either makes a site conditional, as neither measures its slope."""
    read = lands.groupBy("parcel").agg(F.min(F.struct(blank(F.col("terrain")).alias("terrain"), blank(F.col("road")).alias("road"))).alias("_l"))
    told = _parcels(parcels, site).join(read, "parcel", "left").select(site, F.col("_l").isNotNull().alias("_read"), F.col("_l.road").contains("맹지").alias("_landlocked"), F.col("_l.terrain").rlike("급경사|고지").alias("_steep"))
    sums = _tallied(sites, site, told, read=F.count_if("_read"), landlocked=F.count_if("_landlocked"), steep=F.count_if("_steep"))
    verdict = F.when(F.col("read").isNull(), _unknown("NO_PARCELS")).when(F.col("read") == 0, _unknown("NO_DATA")).when(F.col("landlocked") + F.col("steep") > 0, _row("CONDITIONAL", "MEDIUM", "LOW")).otherwise(_row("POSSIBLE", "LOW", "LOW"))
    return _rows(sums, site, LAND_ITEM, verdict, {c: _count(c) for c in ("read", "landlocked", "steep")})


def parcel_use(sites: DataFrame, parcels: DataFrame, site: str) -> DataFrame:
    """What a site's ``parcels`` (site, parcel, category, area inside the site) can be used for.

    Farmland, plots and graves need another permit; otherwise under half of the
    area being open to forest permits is a condition too. ``categories`` names
    all categories by falling area.
    """
    each = _parcels(parcels, site, "category", "area").groupBy(site, F.coalesce("category", F.lit("미상")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("m2"))
    of = lambda names: F.coalesce(F.sum(F.when(F.col("category").isin(*names), F.col("m2"))), F.lit(0.0))
    sums = each.groupBy(site).agg(
        F.sum("n").alias("parcels"), F.sum("m2").alias("m2"), of(OPEN).alias("open_m2"), of(CONVERTED).alias("converted_m2"), F.count_if(F.col("category").isin(*CONVERTED)).alias("_converted"),
        F.array_sort(F.collect_list(F.struct((-F.col("m2")).alias("m2"), "category"))).alias("_by"),
    )
    share = F.coalesce(F.col("open_m2") / F.nullif("m2", F.lit(0.0)), F.lit(0.0))
    verdict = F.when(F.col("parcels").isNull(), _unknown("NO_PARCELS")).when((F.col("_converted") > 0) | (share < 0.5), _row("CONDITIONAL", "MEDIUM")).otherwise(_row("POSSIBLE", "LOW"))
    return _judged(sites, site, sums, PARCELS, verdict, {"parcels": _count("parcels"), "m2": F.coalesce("m2", F.lit(0.0)), "converted_m2": F.coalesce("converted_m2", F.lit(0.0)), "share": share, "categories": F.coalesce(F.col("_by.category"), F.array().cast("array<string>"))})


def graded_map(sites: DataFrame, pieces: DataFrame, site: str, area: str, item: str, layer: str, table: dict, stored: DataFrame | None = None) -> DataFrame:
    """A site's best-protected grade on a map: the least number of the ``pieces`` (site, grade, m2) with an area, judged by stored rules or ``table``.

    ``share`` is the worst grade's part of the site's ``area``, ``covered`` that
    of all grades (null without an area), ``spread`` the grades' parts of what is
    graded. A site without pieces is unknown, and so is one that its pieces only
    touch, with less to fear. Landslide maps come as pixels: their area is the
    count times that of a pixel.
    """
    own = pieces.where(F.col(site).isNotNull() & F.col("grade").isNotNull()).groupBy(site, "grade").agg(F.coalesce(F.sum("m2"), F.lit(0.0)).alias("m2"))
    sums = own.groupBy(site).agg(
        F.min(F.when(F.col("m2") > 0, F.struct(F.col("grade").alias("grade"), F.col("m2").alias("m2")))).alias("_w"), F.sum("m2").alias("_m2"),
        F.array_sort(F.collect_list(F.when(F.col("m2") > 0, F.struct("grade", "m2")))).alias("_all"),
    )
    sized = sites.where(F.col(site).isNotNull()).groupBy(site).agg(F.max(area).alias("_area"))
    full = _stored(stored, layer, sums.withColumn("_worst", F.col("_w.grade")).join(sized, site, "left"), "_worst")
    worst = F.col("_worst")
    verdict = F.when(F.col("_all").isNull(), _unknown("NO_DATA")).when(worst.isNull(), _row("UNKNOWN", "LOW", "LOW")).otherwise(_verdict_of(worst, table))
    part = lambda m2: m2 / F.nullif("_area", F.lit(0.0))
    spread = F.transform("_all", lambda g: F.struct(g["grade"].alias("grade"), (g["m2"] / F.col("_m2")).alias("share")))
    return _judged(sites, site, full, item, verdict, {"worst": worst, "worst_m2": F.col("_w.m2"), "share": part(F.col("_w.m2")), "covered": part(F.col("_m2")), "spread": F.coalesce(spread, F.array().cast("array<struct<grade:int,share:double>>"))})


def heritage(sites: DataFrame, near: DataFrame, site: str) -> DataFrame:
    """Heritage ``near`` (site, code, name, distance_m) a site: none is clear, a zone of limits around the site itself is hardest, all else hard."""
    listed, limited = F.col("code").isin(*LISTED), F.col("code").isin(*LIMITED)
    sums = _tallied(
        sites, site, near.where(listed | limited).select(site, "code", "name", "distance_m"),
        listed=F.count_if(listed), limited=F.count_if(limited), inside=F.count_if(limited & (F.col("distance_m") == 0)), _first=F.min(F.when(listed, F.struct("distance_m", "name"))),
    )
    verdict = F.when(F.col("listed").isNull(), _row("POSSIBLE", "LOW")).when(F.col("inside") > 0, _row("CONDITIONAL", "CRITICAL")).otherwise(_row("CONDITIONAL", "HIGH"))
    return _rows(sums, site, HERITAGE, verdict, {**{c: _count(c) for c in ("listed", "limited", "inside")}, "nearest": F.col("_first.name"), "nearest_m": F.col("_first.distance_m")})


def protected_nature(sites: DataFrame, near: DataFrame, site: str, radius: str) -> DataFrame:
    """Protected areas ``near`` (site, name, distance_m) a site: under it, within the ``radius`` of the site's row, or only farther away."""
    reach = sites.where(F.col(site).isNotNull()).groupBy(site).agg(F.max(radius).alias("_reach"))
    met = near.select(site, "name", "distance_m").join(reach, site)
    sums = _tallied(sites, site, met, inside=F.count_if(F.col("distance_m") == 0), within=F.count_if(F.col("distance_m") <= F.col("_reach")), _first=F.min(F.when(F.col("_found"), F.struct("distance_m", "name"))))
    verdict = F.when(F.col("inside") > 0, _row("CONDITIONAL", "CRITICAL")).when(F.col("within") > 0, _row("CONDITIONAL", "HIGH")).otherwise(_row("POSSIBLE", "LOW"))
    return _rows(sums, site, NATURE, verdict, {"inside": _count("inside"), "within": _count("within"), "nearest": F.col("_first.name"), "nearest_m": F.col("_first.distance_m")})


def habitats(sites: DataFrame, pixels: DataFrame, site: str) -> DataFrame:
    """The part of a site's ``pixels`` (site, hit) in habitats of birds; no pixels are no answer. ``mostly`` is true from six tenths on."""
    sums = _tallied(sites, site, pixels.select(site, "hit"), _n=F.count("_found"), _hit=F.count_if("hit")).withColumn("_share", F.col("_hit") / F.col("_n"))
    verdict = F.when(F.col("_n").isNull(), _unknown("NO_DATA")).when(F.col("_hit") == 0, _row("POSSIBLE", "LOW")).otherwise(_row("CONDITIONAL", "HIGH"))
    return _rows(sums, site, BIRDS, verdict, {"share": F.col("_share"), "mostly": F.coalesce(F.col("_share") >= MOSTLY, F.lit(False))})


def sea_share(sites: DataFrame, swept: DataFrame, site: str) -> DataFrame:
    """Whether the circles a site's rotors sweep (site, m2, sea_m2) reach the sea: then the site is conditional. Circles that could not be measured are no answer, as they may all be at sea."""
    unread = F.col("m2").isNull() | F.col("sea_m2").isNull()
    sums = _tallied(sites, site, swept.select(site, "m2", "sea_m2"), _unread=F.count_if(F.col("_found") & unread), _m2=F.sum("m2"), _sea=F.sum("sea_m2"))
    verdict = F.when(F.col("_unread").isNull(), _unknown("NO_DATA")).when(F.col("_sea") > 0, _row("CONDITIONAL", "HIGH", "LOW")).when(F.col("_unread") > 0, _unknown("FETCH")).otherwise(_row("POSSIBLE", "LOW"))
    return _rows(sums, site, SEA, verdict, {"share": F.col("_sea") / F.nullif("_m2", F.lit(0.0)), "unread": _count("_unread")})


def failed(rows: DataFrame, site: str, item: str, causes: DataFrame) -> DataFrame:
    """``rows`` of a check with those of sites whose reading failed (``causes``: site, item) made unknown: a failed reading is not an absence."""
    hit = causes.where(F.col("item") == item).select(F.col(site).alias("_failed")).where("_failed IS NOT NULL").distinct()
    met = rows.join(hit, F.col(site) == F.col("_failed"), "left").withColumn("_v", F.when(F.col("_failed").isNotNull(), _unknown("FETCH")).otherwise(F.struct("status", "difficulty", "confidence", "why")))
    return met.select(*[F.col("_v")[c].alias(c) if c in ("status", "difficulty", "confidence", "why") else c for c in rows.columns])
