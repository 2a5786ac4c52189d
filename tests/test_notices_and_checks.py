"""Notices, registers, precedents and single checks against plain versions, and on odd tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gridlark.operators import checks, notices

LAWS = ["전기사업법 제12조제1항 제2호", "전기사업법 제12조 제1항 제2의2호 및 제3호", "상동"]
NAMES = ["영덕풍력 발전사업", "가나 태양광 발전 사업", "묘도연료전지 발전사업"]
COMPANIES = ["㈜영덕", "국제해양에너지", "묘도연료전지발전"]
PLACES = [("경북 영덕군 영해면 1104-2번지", "경북", "영덕군"), ("강원특별자치도 철원군", "강원", "철원군"), ("전라남도 해남군 문내면", "전남", "해남군")]


def planted_disposal(rng):
    """A disposal and its rows, as a table whose lines run on."""
    text, rows, before = "공고 제 301차 전기위원회 처분일자: 2023. 4. 7 사업명 설비용량(MW) 허가번호 처분사유 ", [], None
    for _ in range(rng.randint(0, 6)):
        name, company, place, law = rng.choice(NAMES), rng.choice(COMPANIES), rng.choice(PLACES), rng.choice(LAWS)
        mw, permit = rng.choice(["93.15MW", "10.8", "7 ㎿"]), f"20{rng.randint(10, 23)}-{rng.randint(1, 99)}"
        text += f"{name} {company} {place[0]} {mw} {rng.choice(['', '제'])}{permit}{rng.choice(['', '호'])} {law}{rng.choice([' ', chr(0x3000), chr(10)])}"
        before = (before or "상동") if law == "상동" else law
        rows.append((name, company, place[0], place[1], place[2], float(re.match(r"[\d.]+", mw)[0]), permit, before))
    return text, rows


@pytest.mark.parametrize("seed", range(3))
def test_disposals_give_back_what_was_planted(spark, seed):
    rng = random.Random(seed)
    papers = [(i, *planted_disposal(rng)) for i in range(40)]
    df = spark.createDataFrame([(i, "허가취소 처분", t) for i, t, _ in papers], "k int, title string, text string")
    got = {}
    for r in notices.notices(df, "k", "title", "text").collect():
        assert (r["kind"], r["disposed"], r["round"]) == ("DISPOSAL", "2023-04-07", 301)
        got.setdefault(r["k"], {})[r["no"]] = (r["name"], r["company"], r["location"], r["province"], r["district"], r["megawatts"], r["permit"], r["reason"])
    assert {i: [v[n] for n in sorted(v)] for i, v in got.items()} == {i: rows for i, _, rows in papers if rows}


def test_hearings_are_told_apart_and_read_in_both_layouts(spark):
    table = "허가번호 발전사업명 발전사업자 지역 2018-60 서순천풍력 발전사업 서순천㈜ 전남 순천시 예정된 처분 취소 처분사유 미착공 청문 실시 허가번호 발전 사업명 발전사업자 지역 2019-3 나 발전사업 가 세종시 한솔동 예정된 처분"
    labels = "⑴ 삼척 평산풍력 발전사업 허가증 번호 2022 - 82 상 호 블랙㈜ 성명 김 사업장소 강원도 삼척시 도계읍 원동력의 종류 해상 풍력 설비 용량 1,200.5MW 취소사유 늦음 청문 ② 번호없는 발전사업 상호 나"
    rows = [(1, "청문 실시", table), (2, None, "청문 " + labels), (3, "청문", None), (4, "청문", "아무 표도 없다"), (None, "청문", table), (1, "청문 실시", table)]
    got = notices.notices(spark.createDataFrame(rows, "k int, title string, text string"), "k", "title", "text").collect()
    assert {r["kind"] for r in got} == {"HEARING"}
    found = sorted((-1 if r["k"] is None else r["k"], r["no"], r["name"], r["district"], r["megawatts"] or 0, r["permit"], r["reason"], r["source"]) for r in got)
    one = [(1, "서순천풍력 발전사업", "순천시", 0, "2018-60", "미착공", "WIND"), (2, "나 발전사업", "", 0, "2019-3", "", "OTHER")]
    assert found == sorted([(k, *r) for k in (-1, 1, 1) for r in one] + [(2, 1, "삼척 평산풍력 발전사업", "삼척시", 1200.5, "2022-82", "늦음", "WIND")])


def test_repeated_keys_do_not_lend_each_other_reasons(spark):
    a = "처분사유 가나 발전사업 회사 경북 영덕군 1 2018-1 전기사업법 제1조 다라 발전사업 회사 경북 영덕군 2 2018-2 상동"
    b = "처분사유 마바 발전사업 회사 경북 영덕군 3 2018-3 상동"
    got = notices.notices(spark.createDataFrame([(1, "", a), (1, "", b)], "k int, title string, text string"), "k", "title", "text").collect()
    assert {(r["permit"], r["reason"]) for r in got} == {("2018-1", "전기사업법 제1조"), ("2018-2", "전기사업법 제1조"), ("2018-3", "상동")}


def test_a_long_notice_is_read_in_linear_time(spark):
    n = 4000
    text = "처분사유 " + " ".join(f"사업{i} 발전사업 회사 경북 영덕군 {i}.5MW 2018-{1 + i % 999} {'상동' if i else '전기사업법 제1조'}" for i in range(n))
    got = notices.notices(spark.createDataFrame([(1, "", text)], "k int, title string, text string"), "k", "title", "text")
    assert got.agg(F.count("*"), F.count_distinct("name"), F.count_distinct("reason")).first()[:] == (n, n, 1)


def test_register_lines_of_odd_widths(spark):
    cells = [
        (1, ["2019", "7", "한국농어촌공 사", "경북영덕군", "풍력", "1,020.5", "2019.3.4", None, "", "2025-11", "2026.1.2", "연장"]), (2, ["2019", "7", "회사", "어딘가", "태양광", "미정", "없음", "", ""]),
        (3, ["NO"] * 12), (4, ["2019"] * 8), (5, None), (6, []), (7, [None] * 9),
    ]
    got = {r["k"]: r for r in notices.register(spark.createDataFrame(cells, "k int, c array<string>"), "k", "c").collect()}
    assert sorted(got) == [1, 2]
    assert tuple(got[1][c] for c in ("company", "province", "district", "source", "megawatts", "permitted", "ready", "changed")) == ("한국농어촌공사", "경북", "영덕군", "WIND", 1020.5, "2019-03-04", "2025-11", "연장")
    assert tuple(got[2][c] for c in ("province", "source", "megawatts", "permitted", "ready", "changed")) == ("", "SOLAR", None, "", "", "")


@pytest.mark.parametrize("seed", range(2))
def test_precedents_equal_a_plain_count(spark, seed):
    rng = random.Random(seed)
    districts, sources = ["영덕군", "삼척시", "해남군", "가평군", ""], ["WIND", "SOLAR"]
    pick = lambda: (rng.choice(districts), rng.choice(sources))
    asked = [("경북", *pick()) for _ in range(12)]
    permits = [(*pick()[:1], "경북", rng.choice(sources), rng.choice([None, 1.5, 20.0]), rng.choice(["", None, "2019-01-02", "2020-02"]), rng.choice([None, "", "연장"])) for _ in range(60)]
    decided = [(rng.choice(sources), rng.choice(["영덕 풍력", "삼척영덕 사업", "해남해남", "", None]), rng.choice(["가결", "보류", "부결", None]), rng.choice([None, "", "가", "나"]), rng.choice([None, 1, 2])) for _ in range(80)]
    gone = [(*pick(), rng.choice([None, "2020-01-01", "2021-01-01"])) for _ in range(20)]
    got = notices.precedents(
        spark.createDataFrame(asked + asked[:3], "province string, district string, source string"), spark.createDataFrame(permits, "district string, province string, source string, megawatts double, permitted string, changed string"),
        spark.createDataFrame(decided, "source string, title string, decision_group string, reason string, round int"), spark.createDataFrame(gone, "district string, source string, disposed string"),
    ).collect()
    assert sorted((r["province"], r["district"], r["source"]) for r in got) == sorted(set(asked))
    for r in got:
        mine = [p for p in permits if p[0] == r["district"] and p[2] == r["source"]]
        stem = re.sub("(시|군|구)$", "", r["district"])
        cases = [d for d in decided if d[0] == r["source"] and stem and stem in (d[1] or "")]
        assert (r["permits"], r["first_permits"], r["most_mw"]) == (len(mine), sum(not p[5] for p in mine), max([p[3] or 0 for p in mine], default=0))
        assert r["total_mw"] == round(sum(p[3] or 0 for p in mine), 1) and r["latest"] == max([p[4] for p in mine if p[4]], default=None)
        assert r["decisions"] == {g: n for g in ("가결", "보류", "부결", "") if (n := sum((d[2] or "") == g for d in cases))}
        blocked = [d for d in cases if d[2] in notices.BLOCKING]
        first = max(((bool(d[3]), d[4] or 0, d[1], d[3] or "") for d in blocked), default=None)
        assert (r["blocked"], r["blocked_round"], r["blocked_reason"]) == (len(blocked), first and first[1], first and first[3])
        lost = [g for g in gone if g[0] == r["district"] and g[1] == r["source"]]
        assert (r["cancelled"], r["last_cancelled"]) == (len(lost), max([g[2] for g in lost if g[2]], default=None))
        assert r["in_province"] == sum(p[1] == r["province"] and p[2] == r["source"] for p in permits)


def every_check(spark, sites, rows):
    """All checks on the same odd rows, by name."""
    s = spark.createDataFrame(sites, "s int, area double, radius double, item string")
    of = lambda name, schema: spark.createDataFrame(rows.get(name, []), schema)
    parcels = of("parcels", "s int, parcel int, category string, area double, item string")
    zones = of("zones", "parcel int, zone string, code string, touch string, s string")
    near = of("near", "s int, code string, name string, distance_m double")
    return {
        "forest": checks.forest_class(s, parcels, zones, "s"), "zones": checks.land_zones(s, parcels, zones, [("수변", "CONDITIONAL", "HIGH")], "s"),
        "owners": checks.ownership(s, parcels, of("owners", "parcel int, owner string"), "s"), "land": checks.land_character(s, parcels, of("lands", "parcel int, terrain string, road string"), "s"),
        "use": checks.parcel_use(s, parcels, "s"), "graded": checks.graded_map(s, of("pieces", "s int, grade int, m2 double"), "s", "area", "산사태위험등급", "산사태위험등급", checks.LANDSLIDE),
        "heritage": checks.heritage(s, near, "s"), "nature": checks.protected_nature(s, near, "s", "radius"), "birds": checks.habitats(s, of("pixels", "s int, hit boolean"), "s"),
        "sea": checks.sea_share(s, of("swept", "s int, m2 double, sea_m2 double"), "s"),
    }


def test_checks_without_evidence_are_unknown_unless_nothing_is_the_answer(spark):
    got = {n: [(r["status"], r["why"]) for r in d.collect()] for n, d in every_check(spark, [(1, None, None, "x"), (1, 2.0, None, "y"), (None, 1.0, 1.0, "z")], {}).items()}
    clear = {"heritage", "nature"}
    whys = {"forest": "NO_PARCELS", "owners": "NO_PARCELS", "land": "NO_PARCELS", "use": "NO_PARCELS"}
    assert got == {n: [("POSSIBLE", "")] if n in clear else [("UNKNOWN", whys.get(n, "NO_DATA"))] for n in got}
    assert all(d.count() == 0 for d in every_check(spark, [], {}).values())


def test_checks_of_nulls_repeats_and_ties(spark):
    rows = {
        "parcels": [(1, 10, "임야", 5.0, "i"), (1, 10, "임야", 5.0, "i"), (1, None, None, None, None), (None, 10, "전", 1.0, ""), (2, 20, "도로", None, None)],
        "zones": [(10, " 보전산지 ", "UFM100", "접함", ""), (10, "준보전산지", None, None, ""), (10, None, None, None, None), (10, "수변구역", "U", "접함", ""), (None, "공익용산지", "", "저촉", ""), (20, "수변 도로", "UQS1", "저촉", "")],
        "owners": [(10, "개인"), (10, "국유지"), (20, None)], "lands": [(10, None, "맹지"), (20, "평지", None)], "pieces": [(1, 4, 3.0), (1, 1, 0.0), (1, 2, None), (2, None, 5.0), (2, 7, 1.0)],
        "near": [(1, checks.LIMITED[0], None, 0.0), (1, None, "x", None), (2, checks.LISTED[0], "나", 9.0), (2, checks.LISTED[1], "가", 9.0)], "pixels": [(1, None), (1, False), (2, True), (2, None)], "swept": [(1, None, None), (2, 4.0, 1.0), (2, None, 1.0)],
    }
    got = {n: {r["s"]: r for r in d.collect()} for n, d in every_check(spark, [(1, 6.0, 1.0, ""), (2, 0.0, None, "")], rows).items()}
    said = lambda n: [(got[n][k]["status"], got[n][k]["difficulty"], got[n][k]["why"]) for k in (1, 2)]
    assert said("forest") == [("CONDITIONAL", "HIGH", ""), ("UNKNOWN", "MEDIUM", "NO_DATA")] and got["forest"][1]["classes"] == "보전산지(저촉 0·접함 1) / 준보전산지(저촉 0·접함 0)"
    assert said("zones") == [("CONDITIONAL", "HIGH", ""), ("POSSIBLE", "LOW", "")] and (got["zones"][1]["names"], got["zones"][2]["facilities"]) == (["준보전산지", "수변구역"], 1)
    assert said("owners") == [("POSSIBLE", "LOW", ""), ("UNKNOWN", "LOW", "UNCLEAR_OWNER")]
    assert said("land") == [("CONDITIONAL", "MEDIUM", ""), ("POSSIBLE", "LOW", "")]
    assert said("use") == [("POSSIBLE", "LOW", ""), ("CONDITIONAL", "MEDIUM", "")]
    assert said("graded") == [("POSSIBLE", "LOW", ""), ("UNKNOWN", "MEDIUM", "")] and (got["graded"][1]["worst"], got["graded"][1]["share"], got["graded"][2]["share"]) == (4, 0.5, None)
    assert said("heritage") == [("CONDITIONAL", "CRITICAL", ""), ("CONDITIONAL", "HIGH", "")] and got["heritage"][2]["nearest"] == "가"
    assert said("nature") == [("CONDITIONAL", "CRITICAL", ""), ("POSSIBLE", "LOW", "")]
    assert said("birds") == [("POSSIBLE", "LOW", ""), ("CONDITIONAL", "HIGH", "")] and got["birds"][2]["mostly"] is False
    assert said("sea") == [("UNKNOWN", "MEDIUM", "FETCH"), ("CONDITIONAL", "HIGH", "")]


def test_a_failed_reading_is_unknown_and_other_columns_stay(spark):
    rows = spark.createDataFrame([(1, "POSSIBLE", "LOW", "MEDIUM", "", 7), (2, "POSSIBLE", "LOW", "MEDIUM", "", 8)], "s int, status string, difficulty string, confidence string, why string, extra int")
    causes = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "a")], "s int, item string")
    got = checks.failed(rows, "s", "a", causes)
    assert got.columns == rows.columns and sorted(map(tuple, got.collect())) == [(1, "UNKNOWN", "MEDIUM", "LOW", "FETCH", 7), (2, "POSSIBLE", "LOW", "MEDIUM", "", 8)]
