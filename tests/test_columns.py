"""Columns and operators on small rows whose results follow from their rules by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridlark.operators import chunking, components, geometry, judgements, notation, ordinances, registers, retrieval, rules, spatial, texts
from gridlark.sources import sinks


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "feet"), [("GND", 0.0), ("UNL", None), ("FL 400", 40000.0), ("10 000 AMSL", 10000.0), ("", None), (None, None), ("high", None), ("1,500", 1500.0)]
)
def test_altitude(spark, raw, feet):
    assert one(spark, notation.altitude_feet(F.lit(raw).cast("string"))) == feet


@pytest.mark.parametrize(("raw", "volts"), [("345000;154000", 345000), (None, 0), ("x", 0), ("22900,154000", 154000)])
def test_voltage(spark, raw, volts):
    assert one(spark, notation.max_voltage(F.lit(raw).cast("string"))) == volts


def test_distance_phrase(spark):
    assert one(spark, notation.metres(F.lit("1"), F.lit("미터"), F.lit("천"))) == 1000
    assert one(spark, notation.metres(F.lit("1.5"), F.lit("km"), F.lit(None).cast("string"))) == 1500
    assert one(spark, notation.metres(F.lit("0"), F.lit("m"), F.lit(""))) is None


def test_places_lots_and_articles(spark):
    assert tuple(one(spark, notation.place(F.lit("경기도 수원시 장안구")))) == ("경기도", "수원시")
    assert tuple(one(spark, notation.place(F.lit("세종특별자치시")))) == ("세종특별자치시", "세종특별자치시")
    assert tuple(one(spark, notation.place(F.lit(None).cast("string")))) == ("", "")
    assert [one(spark, notation.land_category(F.lit(x))) for x in ("66 도", "산 12-3 임", "12")] == ["도로", "임야", ""]
    assert [tuple(one(spark, notation.article_key(F.lit(x)))) for x in ("002002", "000700", "12")] == [("20", "2"), ("7", ""), ("12", "")]
    assert tuple(one(spark, notation.article(F.lit("제20조의2(허가)")))) == ("20", "2")
    assert one(spark, notation.law_name(F.lit("국토의 계획·이용"))) == "국토의계획ㆍ이용"
    assert one(spark, notation.calendar_date(F.lit("on 2024.9.2"))) == "2024-09-02"


def test_number_label(spark):
    label = lambda xs: one(spark, notation.run_label(F.array(*map(F.lit, xs)).cast("array<int>")))
    assert label([9, 1, 3, 4, 5]) == "1·3~5·9"
    assert label([1, 2]) == "1·2"
    assert label([]) == "-"


def test_projection(spark):
    at = one(spark, geometry.project(F.lit(38.0), F.lit(127.5)))
    assert (at["x"], at["y"]) == pytest.approx((1_000_000, 2_000_000), abs=1e-6)
    grid = spark.range(33, 40).crossJoin(spark.range(125, 133).withColumnRenamed("id", "l"))
    p = grid.select("id", "l", geometry.project(F.col("id").cast("double"), F.col("l").cast("double")).alias("p"))
    g = p.select("id", "l", geometry.unproject(F.col("p.x"), F.col("p.y")).alias("g"))
    assert g.where("abs(g.lat - id) > 1e-9 OR abs(g.lng - l) > 1e-9").count() == 0


def test_ring_edges(spark):
    point = F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    assert one(spark, geometry.ring_area(F.array(point, point))) is None
    assert one(spark, geometry.inside(F.array(point), F.lit(1.0), F.lit(2.0))) is False
    assert one(spark, geometry.ring_distance(F.array(point), F.lit(4.0), F.lit(6.0))) == 5.0


def test_largest_region_takes_a_shared_cell(spark):
    cells = spark.createDataFrame([("a", 0, 0), ("b", 0, 0), ("b", 0, 1), ("c", 5, 5), ("d", 5, 5), ("b", 0, 1)], "r string, x int, y int")
    assert {tuple(r) for r in geometry.allocate_largest_first(cells, "r").collect()} == {("b", 2), ("c", 1)}


def test_rescue_passes_along_a_chain(spark):
    parcels = spark.createDataFrame([(1, "전", 2000, 0.0), (2, "전", 10, 0.0), (3, "전", 10, 0.0), (4, "도로", 10, 0.0), (5, "전", 10, 0.0)], "id long, category string, area int, built double")
    touching = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "a long, b long")
    assert {r["id"]: (r["reason"], r["rescued"]) for r in rules.rescued(parcels, touching, 900).collect()} == {
        1: (None, False), 2: (None, True), 3: (None, True), 4: ("AREA", False), 5: ("AREA", False),
    }


def test_masked_names_keep_all_matches(spark):
    masked = spark.createDataFrame([("삼*",), ("*",), ("도계역앞*",)], "masked string")
    names = spark.createDataFrame([("삼척",), ("삼계",), ("도계",), ("도계역앞길",)], "name string")
    got = {tuple(r) for r in rules.masked_names(masked, names).collect()}
    assert got == {("삼*", "삼척"), ("삼*", "삼계"), ("도계역앞*", "도계역앞길")}


def test_question(spark):
    asked = one(spark, rules.question_filters(F.lit("가람 1 단계 EPC 계약서")))
    assert tuple(asked) == ("EPC", "contract", "1단계")
    assert tuple(one(spark, rules.question_filters(F.lit("REC")))) == ("REC", None, None)


def test_windows_end_at_breaks_and_overlap():
    assert list(chunking.windows(None)) == [] == list(chunking.windows("  "))
    assert list(chunking.windows(" short ")) == ["short"]
    text = "".join(f"w{i} " for i in range(400))
    pieces = list(chunking.windows(text, 100, 20))
    assert all(len(p) <= 100 for p in pieces)
    assert all(p in text for p in pieces)
    assert pieces[0].startswith("w0 ") and pieces[-1].endswith("w399")
    assert set(" ".join(pieces).split()) >= set(text.split())


def test_chunks_of_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 900), (None, "y")], "doc_id long, text string")
    assert [tuple(r) for r in chunking.chunk_windows(docs, "doc_id", "text").selectExpr("doc_id", "chunk_no", "length(chunk)").orderBy("chunk_no").collect()] == [(3, 0, 400), (3, 1, 400), (3, 2, 300)]
    assert chunking.sections(docs.where("doc_id < 3"), "doc_id", "text").count() == 0


def test_budget_lets_a_shorter_passage_in_later(spark):
    ranked = spark.createDataFrame([(1, 1, 900), (1, 2, 900), (1, 3, 50), (1, 4, 60)], "q long, place long, n long")
    got = retrieval.context_budget(ranked, "q", "place", "n", budget=1000, cut=3000, least=200)
    assert {r["place"]: r["taken"] for r in got.collect()} == {1: 900, 2: 0, 3: 50, 4: 0}


def test_page_lookup(spark):
    pages = spark.createDataFrame([("d", 0, 1), ("d", 102, 2)], "doc string, offset long, page int")
    at = spark.createDataFrame([("d", 101), ("d", 102), ("e", 5)], "doc string, pos long")
    assert {(r["doc"], r["pos"], r["page"]) for r in retrieval.page_of(at, pages, "doc").collect()} == {("d", 101, 1), ("d", 102, 2), ("e", 5, None)}


def test_upsert_marks_what_vanished(spark):
    stored = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "k string, v int")
    fresh = spark.createDataFrame([("a", 2), ("b", None), ("d", 4)], "k string, v int")
    got = {r["k"]: (r["v"], r["state"]) for r in sinks.upsert_keep_stale(stored, fresh, ["k"], "v").collect()}
    assert got == {"a": (2, "CHANGED"), "b": (None, "SAME"), "c": (3, "STALE"), "d": (4, "NEW")}


def test_partitions_are_replaced_alone(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "p int, v int")
    sinks.write_partitions(rows((1, 1), (2, 2)), str(tmp_path / "t"), ["p"])
    sinks.write_partitions(rows((2, 5)), str(tmp_path / "t"), ["p"])
    assert {(r["p"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, 1), (2, 5)}


def test_paths(spark):
    fields = lambda p: tuple(one(spark, registers.path_fields(F.lit(p))))
    assert fields("가람PJT(가람햇살)_1단계/계약서/01. epc/a.pdf") == ("가람", "가람햇살", "1단계", "contract", "EPC", "a.pdf")
    assert fields("a.pdf") == ("a.pdf", "", "", "general", "", "a.pdf")


def test_pages_run_on(spark):
    pages = spark.createDataFrame([("d", 1, "one"), ("d", 2, "two."), ("d", 3, None), ("d", 4, "three"), ("d", 5, "제 5 조 four")], "doc string, page int, text string")
    got = registers.stitched(pages, "doc", "page", "text").orderBy("part")
    assert [tuple(r) for r in got.collect()] == [("d", 1, 2, "one two."), ("d", 2, 1, "three"), ("d", 3, 1, "제 5 조 four")]


def test_repeated_ledger_rows_do_not_multiply(spark):
    rows = spark.createDataFrame([(1, "r1", "x"), (2, None, "l1"), (3, "r9", "l9")], "id long, road string, lot string")
    ledger = spark.createDataFrame([("r1", "l0", "b"), ("r1", "l1", "a"), (None, "l1", "c")], "road string, lot string, v string")
    got = {r["id"]: (r["v"], r["found_by"]) for r in registers.two_key_join(rows, ledger, "road", "lot", "v").collect()}
    assert got == {1: ("a", "road"), 2: ("a", "lot"), 3: (None, "UNKNOWN")}


def test_pairs_across_the_antimeridian_and_near_the_pole(spark):
    points = [(1, 0.0, 179.99), (2, 0.0, -179.99), (3, 75.0, 0.35), (4, 75.0, 0.73), (5, 89.95, 10.0), (6, 89.95, -170.0), (7, -33.0, 18.0), (8, 0.0, -179.7), (9, 90.0, 0.0)]
    frame = spark.createDataFrame(points, "id long, lat double, lng double")
    for metres in (500.0, 20_000.0, 45_000.0, 9_000_000.0, 25_000_000.0):
        got = {(r["l_id"], r["r_id"]) for r in spatial.pairs_within(frame, frame, metres).collect()}
        far = lambda a, b: 2 * 6_371_008.8 * math.asin(math.sqrt(min(1.0, math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2)))
        assert got == {(a[0], b[0]) for a in points for b in points if far(a, b) <= metres}, metres
    near = spatial.nearest(frame, frame, 3).collect()
    assert len(near) == 27 and {r["r_id"] for r in near if r["l_id"] == 1} == {1, 2, 8}
    assert spatial.nearest(frame, frame.where("id > 7"), 3).count() == 18


def test_rows_without_a_text_are_no_copies(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "")], "id long, t string")
    assert {(r["checksum"] is None, r["id"], r["copies"]) for r in texts.checksum_dedupe(rows, "id", "t").collect()} == {(True, 1, 1), (False, 2, 2)}


def test_heavy_keys_are_joined_apart(spark):
    left = spark.createDataFrame([(k, i) for i in range(60) for k in ([1] * 3 + [2, None, i + 10])], "k long, i long")
    right = spark.createDataFrame([(2, "b"), (11, "c"), (None, "d")], "k long, v string")
    for how in ("inner", "left"):
        found = [sorted(map(str, join.collect())) for join in (components.join_by_key(left, right, "k", 360, how, limit) for limit in (5, 1000))]
        assert found[0] == found[1] and len(found[0]) == {"inner": 61, "left": 360}[how]


def test_a_hub_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(300, 340)]
    nodes = spark.createDataFrame([(i,) for i in range(400)], "id long")
    roots = components.connected(nodes, spark.createDataFrame(edges, "a long, b long"), heavy_rows=20)
    want = {i: 0 if i < 200 else 300 if 300 <= i <= 340 else i for i in range(400)}
    assert {r["id"]: r["root"] for r in roots.collect()} == want


def test_distances_of_an_ordinance(spark):
    text = "1. 5호 미만 취락지역으로부터 300미터, 5호 이상 취락지역으로부터 1.5km\n2. 고속도로와 국도에서는 1천미터(다만, 높이 10m인 경우 70미터) 3. 폭 6m"
    rows = ordinances.distances(spark.createDataFrame([(1, text), (2, ""), (3, None)], "k long, t string"), "k", "t").collect()
    assert sorted((r["k"], r["target"], r["detail"], r["metres"]) for r in rows) == [
        (1, "RESIDENTIAL", "5호미만취락지역으로부터", 300), (1, "RESIDENTIAL", "5호이상취락지역으로부터", 1500), (1, "ROAD", "고속도로와국도", 1000),
    ]


def test_circles_corridors_and_rings_of_cells(spark):
    shapes = spark.createDataFrame([("dot", [(0.0, 0.0)]), ("line", [(0.0, 0.0), (100.0, 0.0)]), ("none", []), (None, None)], "k string, p array<struct<x:double,y:double>>")
    near = geometry.cells_near(shapes, "k", "p", 20.0, 1.0, closed=False).groupBy("k").count().collect()
    found = {r["k"]: r["count"] for r in near}
    assert set(found) == {"dot", "line"}
    assert found["dot"] == pytest.approx(math.pi * 400, rel=0.01) and found["line"] == pytest.approx(math.pi * 400 + 4000, rel=0.01)
    u = [(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (20.0, 30.0), (20.0, 10.0), (10.0, 10.0), (10.0, 30.0), (0.0, 30.0)]
    cells = geometry.cells_inside(spark.createDataFrame([(1, u)], "k long, p array<struct<x:double,y:double>>"), "k", "p", 10.0).collect()
    assert sorted((r["i"], r["j"]) for r in cells) == [(0, 0), (0, 1), (0, 2), (1, 0), (2, 0), (2, 1), (2, 2)]


def test_unknown_inputs_of_judgements(spark):
    judged = lambda m, k, r: tuple(one(spark, judgements.slope(*[F.lit(x) for x in (m, k, r)])))
    assert judged(25.0, 15.0, True) == ("IMPOSSIBLE", "CRITICAL", None) and judged(25.0, 15.0, None) == ("UNKNOWN", "MEDIUM", "NO_DATA")
    assert judged(14.0, 15.0, True) == ("UNKNOWN", "HIGH", "NO_CRITERIA")
    assert one(spark, judgements.military_zone(F.lit(None).cast("string"), F.lit(None).cast("string")))["status"] is None
    items = spark.createDataFrame([(1, None, None, None, None, None, None, None)], "site long, item string, code string, status string, categories array<string>, found boolean, public boolean, overlapping int")
    assert [r["flags"] for r in judgements.site_flags(items, "site", False).collect()] == [["NON_URBAN_AREA"]]


def test_nearest_stations_of_a_city(spark):
    rng = random.Random(4)
    place = lambda n, wide: [(i, 37.5 + rng.gauss(0, wide), 127.0 + rng.gauss(0, wide)) for i in range(n)]
    stations, points = place(6_000, 0.01) + [(9_000, 35.0, 129.0), (9_001, None, 1.0)], place(300, 0.02) + [(700, 34.0, 128.0)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, lat double, lng double")
    assert spatial.first_distance(frame(stations), 3, 20_000.0) < 1_000 and spatial.first_distance(frame(points), 3, 20_000.0) > 1_000
    got = {}
    for r in spatial.nearest(frame(points), frame(stations), 3).collect():
        got.setdefault(r.l_id, []).append((r.rank, r.metres, r.r_id))

    def far(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return round(2 * spatial.EARTH_M * math.asin(math.sqrt(h)), 3)

    for p in points[::25] + points[-1:]:
        want = sorted((far(p, s), s[0]) for s in stations if s[1] is not None)[:3]
        assert [(m, s) for _, m, s in sorted(got[p[0]])] == want
