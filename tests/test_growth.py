"""Steps whose work must grow with their rows, not with pairs of them: plain versions on random input, and crowds that all pairs would not finish in time."""

import math
import random
import time

from pyspark.sql import functions as F

from gridlark.operators import checks, clauses, evaluation, features, outlines, overlay, retrieval, setbacks, spatial, surveys
from gridlark.plans import checked, overlays


def crowd(spark, n, side):
    """``n`` distinct points in a square."""
    return spark.range(n).select("id", (F.col("id") % 200 * (side / 200)).alias("x"), (F.floor(F.col("id") / 200) * (side / (n / 200))).alias("y"))


def test_f1_squares_are_counted_without_pairs(spark):
    rng = random.Random(1)
    points = [(i, rng.uniform(-40, 40), rng.uniform(-40, 40)) for i in range(150)] + [(150 + i, float(rng.randint(-6, 6)), float(rng.randint(-60, 60))) for i in range(150)]
    points += [(i + 300, *p[1:]) for i, p in enumerate(points[:60])]
    frame = spark.createDataFrame([*points, (999, None, 1.0)], "id long, x double, y double")
    for metres in (0.3, 3, 25):
        want = {i: sum(abs(x - u) <= metres and abs(y - v) <= metres for _, u, v in points) for i, x, y in points}
        assert {r.id: (r.n, r.dense) for r in spatial.neighbours_count(frame, metres, 3).collect()} == {i: (n, n >= 3) for i, n in want.items()}
    began = time.time()
    assert spatial.neighbours_count(crowd(spark, 20_000, 90.0), 100, 3).agg(F.min("n"), F.count("n")).first() == (20_000, 20_000)
    assert time.time() - began < 60


def test_f2_groups_of_houses_without_pairs(spark):
    rng = random.Random(2)
    for least, spread in ((3, 300), (5, 90)):
        at = [(i, round(rng.uniform(-spread, spread), 1), round(rng.uniform(-spread, spread), 1)) for i in range(120)]
        at += [(120 + i, *at[i][1:]) for i in range(15)] + [(500 + i, 0.0 + 20 * i, 900.0) for i in range(7)]
        near = {i: [j for j, u, v in at if math.hypot(x - u, y - v) <= 20] for i, x, y in at}
        dense = {j for i, js in near.items() if len(js) >= least for j in js}
        got = setbacks.house_sources(spark.createDataFrame([*at, (900, None, 1.0)], "k long, x double, y double"), "k", 20.0, least).collect()
        assert {(int(r.source), r.kind) for r in got} == {(i, "house_ge" if i in dense else "house_lt") for i in [*near, 900]} and len(got) == len(at) + 1
    began = time.time()
    assert setbacks.house_sources(crowd(spark, 20_000, 90.0), "id", 200.0, 5).where("kind = 'house_ge'").count() == 20_000
    assert time.time() - began < 60


def places(spark, n, lat=37.0, lng=127.0):
    """``n`` rows at one place, with ids from 0."""
    return spark.range(n).select("id", F.lit(lat).alias("lat"), F.lit(lng).alias("lng"))


def metres_of(p, q):
    (a, b), (c, d) = (tuple(map(math.radians, v)) for v in (p, q))
    return 2 * spatial.EARTH_M * math.asin(math.sqrt(min(1.0, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def test_f11_crowded_places_search_once(spark):
    began = time.time()
    got = spatial.nearest(places(spark, 20_000), places(spark, 20_000, 37.01), 5)
    assert got.agg(F.count("l_id"), F.min("r_id"), F.max("r_id"), F.max("rank")).first() == (100_000, 0, 4, 5)
    assert time.time() - began < 60


def test_f13_chains_over_cells(spark):
    rng = random.Random(3)
    at = {i: (rng.choice((0, 60, 89.7)) + rng.uniform(-0.25, 0.25), rng.choice((-179.9, 10)) + rng.uniform(-0.4, 0.4)) for i in range(150)}
    root = {i: i for i in at}
    while (new := {i: min(root[j] for j in at if metres_of(at[i], at[j]) <= 9_000) for i in at}) != root:
        root = new
    frame = spark.createDataFrame([(i, *p) for i, p in at.items()] + [(900, None, 1.0)], "id long, lat double, lng double")
    assert {r.id: r.root for r in spatial.chained(frame, 9_000.0).collect()} == root | {900: 900}
    began = time.time()
    near = spark.range(20_000).select("id", (37 + F.col("id") * 1e-6).alias("lat"), F.lit(127.0).alias("lng"))
    assert spatial.chained(near, 45_000.0).agg(F.count("id"), F.max("root")).first() == (20_000, 0)
    assert time.time() - began < 300


def test_f7_rings_of_crowded_places(spark):
    limits, told = [1_000, 5_000], {}
    began = time.time()
    for r in surveys.place_rings(places(spark, 20_000).withColumnRenamed("id", "s"), places(spark, 20_000, 37.01), "s", limits).groupBy("limit", "n", "first").count().collect():
        told[r["limit"]] = (r["n"], r["first"], r["count"])
    assert told == {1_000: (0, "", 20_000), 5_000: (20_000, "0,1,2,3,4", 20_000)} and time.time() - began < 60


def test_f12_rows_of_a_place_are_joined_as_one(spark):
    plan = spatial.pairs_within(places(spark, 3_000), places(spark, 2_000, 37.01), 20_000.0)
    assert plan.agg(F.count("l_id"), F.countDistinct("l_id"), F.countDistinct("r_id")).first() == (6_000_000, 3_000, 2_000)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Generate explode(l_ids") < text.index("Join Inner")


def test_f6_pairs_of_one_group(spark):
    a = spark.createDataFrame([(1, 7, 0.0, 0.0), (2, 8, 0.0, 0.0), (3, 7, 0.0, 0.001), (4, None, 0.0, 0.0)], "id long, g long, lat double, lng double")
    got = spatial.pairs_within(a, a, 1_000.0, ["g"]).collect()
    assert sorted((r.g, r.l_id, r.r_id) for r in got) == [(7, 1, 1), (7, 1, 3), (7, 3, 1), (7, 3, 3), (8, 2, 2)]


def test_f19_readings_are_summed_by_cell(spark):
    grid = spark.range(20_000).select(F.lit(2000).alias("year"), F.lit(1).alias("r"), F.lit(1).alias("c"), F.col("id").cast("double").alias("v"))
    began = time.time()
    got = surveys.irradiance(grid, spark.range(20_000).select("id", F.lit(1).alias("r"), F.lit(2).alias("c")), "id")
    assert got.agg(F.count("id"), F.min("mean"), F.max("mean")).first() == (20_000, 9_999.5, 9_999.5) and time.time() - began < 60


def test_f10_equal_distances_split_at_the_first(spark):
    # by hypot the third corner comes out farther than the second
    at = [(0.0, 30.0), (40.0, 105.0), (80.0, 10.0), (120.0, 85.0), (160.0, 160.0)]
    rng, found = random.Random(4), []
    lines = [(k, [(40.0 * i, float(rng.randint(0, 210))) for i in range(5)]) for k in range(400)] + [(999, at)]
    for k, p in lines:
        keep = {0, 4}
        stack = [(0, 4)]
        while stack:
            low, high = stack.pop()
            (ax, ay), (bx, by) = p[low], p[high]
            best = (60.0, 0)
            for i in range(low + 1, high):
                t = max(0.0, min(1.0, ((p[i][0] - ax) * (bx - ax) + (p[i][1] - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
                d = math.sqrt((ax + t * (bx - ax) - p[i][0]) ** 2 + (ay + t * (by - ay) - p[i][1]) ** 2)
                best = (d, i) if d > best[0] else best
            if best[1]:
                keep.add(best[1])
                stack += [(low, best[1]), (best[1], high)]
        found.append((k, [p[i] for i in sorted(keep)]))
    got = {r.k: [tuple(c) for c in r.points] for r in outlines.simplified(spark.createDataFrame(lines, "k long, p array<struct<x:double,y:double>>"), "k", "p", 60.0).collect()}
    assert got == dict(found)


def test_f9_points_of_one_place_ask_once(spark):
    shape = spark.range(2_000).select(F.col("id").alias("s"), F.expr("array(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 9D + id, 'y', 0D), named_struct('x', 9D + id, 'y', 9D), named_struct('x', 0D, 'y', 9D)))").alias("rings"))
    points = spark.range(20_000).select("id", F.lit(3.0).alias("x"), F.lit(4.0).alias("y")).union(spark.sql("SELECT 20000L, NULL, 1D"))
    began = time.time()
    got = overlay.at_points(points, "id", shape, "s", "rings", 5_000.0, 10.0)
    assert got.groupBy("s", "inside").count().orderBy("s").collect() == [(None, False, 1), (0, True, 20_000)] and time.time() - began < 60


def test_f8_rules_are_not_sent_to_every_task(spark):
    slices = spark.range(4).select("id", F.expr("array(named_struct('x', id * 10D, 'y', 0D), named_struct('x', id * 10D + 10, 'y', 0D), named_struct('x', id * 10D + 10, 'y', 10D), named_struct('x', id * 10D, 'y', 10D))").alias("ring"))
    sources = spark.sql("SELECT 'a' AS source, 'k' AS kind, true AS unsure, array(named_struct('x', 0D, 'y', 5D), named_struct('x', 40D, 'y', 5D)) AS points")
    rules = spark.range(4).select("id", F.lit("k").alias("kind"), F.lit(2.0).alias("metres"), (F.col("id") % 2 == 0).alias("certain"))
    found = setbacks.zones(slices, "id", "ring", sources, rules, 1.0)
    assert found.groupBy("id", "zone").count().orderBy("id").collect() == [(i, "UNCERTAIN" if i % 2 else "BLOCKED", 40) for i in range(4)]
    assert "strategy=broadcast" not in found._jdf.queryExecution().analyzed().toString()


def test_f18_only_the_vocabulary_is_shuffled(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcd", k=4)) for _ in range(60)]
    docs = spark.createDataFrame([(i, None if i == 7 else " ".join(rng.choices(words, k=30))) for i in range(80)], "id long, text string")
    old = retrieval.term_weights(docs, "id", "text")
    want = {tuple(r) for r in retrieval.rarest_terms(old.where("id % 10 = 0"), "id", 3).collect()}
    terms = retrieval.asked_terms(docs, "id", "text", F.col("id") % 10 == 0, 3)
    assert {tuple(r) for r in terms.collect()} == want
    weights = {(r.id, r.term, r.w) for r in old.collect() if r.term in {t for _, t in want}}
    for few in (500_000, 0):
        monkeypatch.setattr(retrieval, "FEW_TERMS", few)
        assert {tuple(r) for r in retrieval.weights_of(docs, "id", "text", terms).collect()} == weights


def test_f4_a_line_and_a_shape_meet_once_without_being_made_distinct(spark):
    lines = spark.sql("SELECT 1L AS l, array(named_struct('x', -5D, 'y', 3D), named_struct('x', 95D, 'y', 43D)) AS p")
    shape = spark.sql("SELECT 2L AS s, array(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 90D, 'y', 0D), named_struct('x', 90D, 'y', 90D), named_struct('x', 0D, 'y', 90D))) AS rings")
    found = overlay.lines_inside(lines, "l", "p", shape, "s", "rings", 10.0)
    assert [round(r.metres, 6) for r in found.collect()] == [round(math.hypot(90, 36), 6)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_f3_contracts_are_read_once_and_not_shuffled(spark):
    text = "머리 말\n제1조 (목적)\n가나다\n제2조 [기간]\n① 하나\n② 둘\n\n[표 데이터]\na|b\n\nc|d"
    found = clauses.contract_chunks(spark.createDataFrame([(1, text), (2, None), (None, "글")], "k long, t string"), "k", "t")
    want = [(0, None, "header", "머리 말"), (1, None, "article", "제1조 (목적)\n가나다"), (2, 0, "article", "제1조 (목적)\n가나다"), (3, None, "article", "제2조 [기간]\n① 하나\n② 둘"), (4, 0, "article", "제2조 [기간]\n① 하나\n② 둘")]
    want += [(5, None, "table", "[표 데이터]\na|b"), (6, None, "table", "[표 데이터]\nc|d")]
    assert [(r.no, r.child, r.kind, r.content) for r in found.orderBy("no").collect()] == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Window" not in plan and "Union" not in plan


def test_f16_paragraphs_of_an_article_are_cut_once(spark):
    rng = random.Random(6)
    pieces = ["① " + "가" * rng.choice((3, 90, 150, 500)) for _ in range(300)]
    want = []
    for p in pieces:
        if want and len(want[-1]) + len(p) <= 400:
            want[-1] += "\n" + p
        else:
            want.append(p)
    found = clauses.children(spark.createDataFrame([(1, "\n".join(pieces)), (2, "나" * 900)], "k long, t string"), ["k"], "t")
    got = found.orderBy("k", "child").collect()
    assert [r.content for r in got if r.k == 1] == want and [(r.child, len(r.content)) for r in got if r.k == 2] == [(0, 400), (1, 400), (2, 260)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_f5_convex_outlines_are_met_whole(spark):
    rng = random.Random(7)
    star = [(20.0, 0.0), (80.0, 90.0), (0.0, 35.0), (100.0, 35.0), (30.0, 90.0)]

    def shape(k):
        x, y, w, h = (rng.randint(0, 90), rng.randint(0, 90), rng.randint(5, 60), rng.randint(5, 60))
        box, slant = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)], [(x, y), (x + w, y + 9), (x + 3, y + h)]
        return [[box], [box[::-1]], [slant], [[*slant, slant[0]]], [[*box[:2], (x + w / 2, y + h / 4), *box[2:]]], [box, slant], [star], [[*box, box[-1]]]][k % 8]

    of = lambda name, n: spark.createDataFrame([(k % (n - 2), [[(float(x), float(y)) for x, y in r] for r in shape(k)]) for k in range(n)], f"{name} long, rings array<array<struct<x:double,y:double>>>")
    a, b = of("a", 26), of("b", 34)
    assert {r.whole for r in overlay._sorted_out(a, "a", "rings").collect()} == {True, False}
    swept = a.crossJoin(b.withColumnRenamed("rings", "others")).select("a", "b", F.explode(overlay.strips(F.array("rings", "others"))).alias("s")).where("s.owner = 1").groupBy("a", "b").agg(F.sum("s.area").alias("area"))
    want = {(r.a, r.b): r.area for r in swept.where("area > 1e-9").collect()}
    rows = overlay.intersections(a, "a", b, "b", "rings", 40.0).where("area > 1e-9").collect()
    got = {(r.a, r.b): r.area for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_f14_feature_documents_are_spread_and_areas_made_once(spark, tmp_path):
    boxes = [[(float(i), float(i)), (99.0 - i, float(i)), (99.0 - i, 99.0 - i), (float(i), 99.0 - i)][:: 1 if i % 3 else -1] for i in range(12)]
    frame = spark.createDataFrame([(1, boxes[::-1])], "k long, rings array<array<struct<x:double,y:double>>>")
    got = frame.select(features.nested(F.col("rings")).alias("r")).first().r
    assert [x.depth for x in got] == list(range(12))[::-1]
    spark.range(40).select(F.col("id").alias("p_partkey"), F.lit(5).alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert "RepartitionByExpression" in overlays.feature_rings(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_f15_checks_run_once_and_sites_are_not_joined(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def status(i):
        runs.add(1)
        return "CONDITIONAL" if i % 3 else "IMPOSSIBLE"

    rows = spark.range(60).select((F.col("id") % 5).alias("s"), F.lit("a").alias("item"), F.udf(status, "string")("id").alias("status"), *[F.lit(v).alias(c) for c, v in (("difficulty", "LOW"), ("confidence", "LOW"), ("reason", ""), ("action", ""))])
    got = evaluation.summary(rows, "s").collect()
    assert runs.value == 60 and {(r.s, r.score, r.grade, r.unknowns, r.gaps) for r in got} == {(i, 0, "IMPOSSIBLE", 0, 12) for i in range(5)}
    spark.range(40).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(400).select(F.col("id").alias("o_orderkey"), (F.col("id") % 50).alias("o_custkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    plan = checked.checked_sites(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 3 and plan.count("RepartitionByExpression") == 2  # radii of sites, failed readings, land of parcels; parcels and land are spread


def test_f15_sites_and_evidence_meet_in_one_grouping(spark):
    rng = random.Random(15)
    sites = [rng.randint(0, 30) for _ in range(40)] + [None]
    found = [(rng.choice([None, *range(40)]), rng.choice([None, 0.0, 5.0]), rng.choice([None, 0.0, 3.0]), rng.choice([None, True, False])) for _ in range(60)]
    rows, s = spark.createDataFrame(found, "s long, m2 double, sea_m2 double, hit boolean"), spark.createDataFrame([(i,) for i in sites], "s int")
    sea, birds = checks.sea_share(s, rows.select("s", "m2", "sea_m2"), "s"), checks.habitats(s, rows.select("s", "hit"), "s")
    of = {i: [r for r in found if r[0] == i] for i in set(sites) - {None}}
    want_sea = {i: "UNKNOWN" if not own or (sum(r[2] or 0 for r in own) == 0 and any(None in r[1:3] for r in own)) else "CONDITIONAL" if sum(r[2] or 0 for r in own) else "POSSIBLE" for i, own in of.items()}
    got = sea.collect()
    assert len(got) == len(of) and {r.s: r.status for r in got} == want_sea and {r.s: r.unread for r in got} == {i: sum(None in r[1:3] for r in own) for i, own in of.items()}
    got = birds.collect()
    assert len(got) == len(of) and {r.s: r.share for r in got} == {i: sum(bool(r[3]) for r in own) / len(own) if own else None for i, own in of.items()}
    assert sea.schema["s"].dataType == s.schema["s"].dataType
    assert all("Join" not in d._jdf.queryExecution().optimizedPlan().toString() for d in (sea, birds))
