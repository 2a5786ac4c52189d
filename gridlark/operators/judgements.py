"""Judgements of single checks: slope, military zones, grid connection, and the conditions of a site that its permits depend on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: degrees around a slope limit within which a coarse grid decides nothing.
MARGIN = 3.0
#: First letters of a zone's code and how hard it is, numbers of flight zones that are hardest, and the mark of an air base.
ZONES, HARDEST_FLIGHT_ZONES, FLIGHT_CODE, BASE = {"UNE11": "CRITICAL", "UNE12": "HIGH"}, (1, 2, 3), "UNE4", "작전기지"
FLIGHT_ZONE = r"비행안전\s*제\s*([1-6])\s*구역"
#: Kilometres to a substation that are good and fair, and volts of a strong one.
GOOD_KM, FAIR_KM, STRONG = 10.0, 25.0, 154_000
#: Layers and land categories, and the condition of a site that each stands for.
LAYER_FLAGS = {
    "백두대간보호지역": "BAEKDUDAEGAN", "산림보호구역": "FOREST", "농업진흥지역": "FARMLAND", "국가유산보호구역": "HERITAGE",
    "개발제한구역": "GREENBELT", "국립자연공원": "NATIONAL_PARK", "도립자연공원": "NATIONAL_PARK", "군립자연공원": "NATIONAL_PARK",
}
CATEGORY_FLAGS = {"전": "FARMLAND", "답": "FARMLAND", "과수원": "FARMLAND", "임야": "FOREST", "도로": "ROAD", "하천": "RIVER", "구거": "FARM_INFRA", "유지": "FARM_INFRA"}
PARCELS, FOREST_CLASS, OWNERSHIP, HERITAGE, MILITARY, URBAN = "필지·지적 분석", "산지구분", "토지 소유구분(국·공유지)", "국가유산·역사문화환경 보존지역", "군사기지·비행안전구역", "용도지역_도시"


def _verdict(status: str, difficulty: str, why: str | None = None) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(difficulty).alias("difficulty"), F.lit(why).cast("string").alias("why"))


def slope(mean: Column, limit: Column, reliable: Column) -> Column:
    """(status, difficulty, why) of a mean slope: too few cells or a mean near the limit decide nothing; without a mean or a limit it is unknown."""
    return (
        F.when(mean.isNull(), _verdict("UNKNOWN", "MEDIUM", "NO_DATA"))
        .when(limit.isNull(), _verdict("UNKNOWN", "MEDIUM", "NO_CRITERIA"))
        .when(~F.coalesce(reliable, F.lit(False)), _verdict("UNKNOWN", "MEDIUM", "NO_DATA"))
        .when(mean >= limit + MARGIN, _verdict("IMPOSSIBLE", "CRITICAL"))
        .when(mean <= limit - MARGIN, _verdict("POSSIBLE", "LOW"))
        .otherwise(_verdict("UNKNOWN", "HIGH", "NO_CRITERIA"))
    )


def military_zone(code: Column, name: Column) -> Column:
    """(status, difficulty, why) of a zone by the beginning of its code, or its flight zone's number; codes that are not known have a null status."""
    known = F.lit(None)
    for prefix, difficulty in ZONES.items():
        known = F.when(code.startswith(prefix), _verdict("CONDITIONAL", difficulty)).otherwise(known)
    number = F.regexp_extract(name, FLIGHT_ZONE, 1)
    flight = F.when(number.isin(*map(str, HARDEST_FLIGHT_ZONES)), _verdict("CONDITIONAL", "CRITICAL")).when(number != "", _verdict("CONDITIONAL", "HIGH")).when(name.contains(BASE), _verdict("CONDITIONAL", "CRITICAL"))
    none = F.struct(F.lit(None).cast("string").alias("status"), F.lit("MEDIUM").alias("difficulty"), F.lit(None).cast("string").alias("why"))
    return F.coalesce(known, F.when(code.startswith(FLIGHT_CODE), flight), none)


def grid_connection(sites: DataFrame, substations: DataFrame, site: str) -> DataFrame:
    """(site, status, difficulty) of ``sites`` (site, capacity_mw) by ``substations`` (site, distance_m, voltage, station_kw, line_kw).

    Distance judges first; then the nearest substation whose spare capacity is
    known, not the roomiest. A site that found none is unknown. One pass of
    aggregates that combine before the shuffle.
    """
    known = F.col("line_kw").isNotNull()
    near = substations.groupBy(site).agg(
        F.min("distance_m").alias("any_m"),
        F.min(F.when(F.col("voltage") >= STRONG, F.col("distance_m"))).alias("strong_m"),
        F.min(F.when(known, F.struct("distance_m", F.coalesce("station_kw", F.lit(0.0)).alias("station"), F.col("line_kw").alias("line")))).alias("spare"),
    )
    need = F.coalesce(F.col("capacity_mw"), F.lit(0.0)) * 1000
    far = (
        F.when(F.col("any_m").isNull(), _verdict("UNKNOWN", "MEDIUM"))
        .when((F.col("any_m") <= GOOD_KM * 1000) & (F.col("strong_m") <= GOOD_KM * 1000), _verdict("POSSIBLE", "LOW"))
        .when(F.col("any_m") <= FAIR_KM * 1000, _verdict("CONDITIONAL", "MEDIUM"))
        .otherwise(_verdict("CONDITIONAL", "HIGH"))
    )
    asked = F.col("spare").isNotNull() & (need > 0)
    verdict = F.when(asked & (F.col("spare.station") <= 0), _verdict("CONDITIONAL", "CRITICAL")).when(asked & (F.col("spare.line") < need), _verdict("CONDITIONAL", "HIGH")).otherwise(far)
    return sites.join(near, site, "left").select(site, verdict.alias("v")).select(site, "v.status", "v.difficulty")


def site_flags(items: DataFrame, site: str, assume_forest: bool) -> DataFrame:
    """(site, flags): the sorted conditions that a site's ``items`` (site, item, code, status, categories, found, public, overlapping) bear out.

    ``assume_forest`` takes a site without farmland or forest for forest. A site
    has at most as many flags as there are names, so collecting them is bounded.
    """
    item, code, open_ = F.col("item"), F.col("code"), F.coalesce(F.col("status") != "POSSIBLE", F.lit(True))
    of = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    flag = lambda when, name: F.when(F.coalesce(when, F.lit(False)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    parcels = F.coalesce(item == PARCELS, F.lit(False))
    lands = F.transform(F.when(parcels, F.coalesce("categories", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")), lambda c: F.try_element_at(of(CATEGORY_FLAGS), c))
    rows = F.concat(
        F.when(open_ & code.isNotNull(), F.array(F.try_element_at(of(LAYER_FLAGS), code))).otherwise(F.array().cast("array<string>")),
        lands,
        flag(parcels & F.col("public"), "PUBLIC_LAND"),
        flag(item.startswith(FOREST_CLASS) & F.col("found"), "FOREST"),
        flag((item == OWNERSHIP) & open_, "PUBLIC_LAND"),
        flag((item == HERITAGE) & F.col("found"), "HERITAGE"),
        flag(item == MILITARY, "MILITARY"),
        flag((code == URBAN) & (F.col("overlapping") > 0), "URBAN_AREA"),
    )
    sets = items.select(site, F.explode_outer(F.array_distinct(rows)).alias("flag")).groupBy(site).agg(F.collect_set("flag").alias("seen"))
    seen = F.col("seen")
    way = F.when(F.array_contains(seen, "URBAN_AREA"), seen).otherwise(F.concat(seen, F.array(F.lit("NON_URBAN_AREA"))))
    bare = ~F.arrays_overlap(seen, F.array(F.lit("FARMLAND"), F.lit("FOREST")))
    return sets.select(site, F.array_sort(F.when(F.lit(assume_forest) & bare, F.concat(way, F.array(F.lit("FOREST")))).otherwise(way)).alias("flags"))
