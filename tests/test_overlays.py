"""Overlay, lines, features, circles, scans and ordinances against plain versions on random input."""

import math
import random
import re
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from gridlark.operators import circles, features, geometry, ordinances, outlines, overlay, scans, setbacks

RINGS = overlay.RINGS


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2 if ring else 0.0


def clipped(ring, convex):
    """A ring inside a convex one, edge by edge."""
    for (x1, y1), (x2, y2) in zip(convex, convex[1:] + convex[:1]):
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            s, t = ((x2 - x1) * (v[1] - y1) - (y2 - y1) * (v[0] - x1) for v in (p, q))
            out += [p] if s >= 0 else []
            if (s >= 0) != (t >= 0):
                u = s / (s - t)
                out.append((p[0] + u * (q[0] - p[0]), p[1] + u * (q[1] - p[1])))
        ring = out
        if not ring:
            break
    return ring


def star(rng, n, x, y, r):
    return [(x + r * s * math.cos(2 * math.pi * k / n), y + r * s * math.sin(2 * math.pi * k / n)) for k in range(n) for s in [rng.uniform(0.4, 1)]]


def regular(n, x, y, r):
    return [(x + r * math.cos(2 * math.pi * k / n + 0.3), y + r * math.sin(2 * math.pi * k / n + 0.3)) for k in range(n)]


@pytest.fixture(scope="module")
def shapes(spark):
    rng = random.Random(2)
    at = lambda: (rng.uniform(-150, 150), rng.uniform(-150, 150), rng.uniform(20, 90))
    a = [(i, [star(rng, rng.randint(5, 12), *at())]) for i in range(18)]
    b = [(i, [regular(rng.randint(3, 8), *at())]) for i in range(18)]
    return a, b, spark.createDataFrame(a, f"a long, rings {RINGS}"), spark.createDataFrame(b, f"b long, rings {RINGS}")


def test_random_shapes_share_what_clipping_says(shapes):
    a, b, left, right = shapes
    want = {(i, j): area(clipped(p[0], q[0])) for i, p in a for j, q in b}
    for side in (64.0, 1000.0):
        got = {(r.a, r.b): r.area for r in overlay.intersections(left, "a", right, "b", "rings", side).collect()}
        assert all(abs(got.get(k, 0) - v) < 1e-8 for k, v in want.items()) and got.keys() <= want.keys()


def test_parts_and_rest_add_up(shapes):
    a, b, left, right = shapes
    rows = overlay.allocated(left, "a", right, "b", "rings", 64.0).collect()
    for i, p in a:
        assert sum(r.area for r in rows if r.a == i) == pytest.approx(area(p[0]), rel=1e-10)
    shares = {i: sorted(((-area(clipped(p[0], q[0])), j) for j, q in b), key=lambda x: x) for i, p in a}
    for r in rows:  # the first gets all that it shares
        if r.b is not None and shares[r.a][0][1] == r.b:
            assert r.area == pytest.approx(-shares[r.a][0][0], rel=1e-9)


def test_holes_bow_ties_and_odd_shapes(spark):
    square = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    data = [(1, [square(0.0, 0.0, 10.0), square(2.0, 2.0, 4.0)]), (2, [[(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0)]]), (3, []), (4, None), (5, [[(0.0, 0.0), (1.0, 1.0)]]), (6, [square(10.0, 0.0, 10.0)])]
    left = spark.createDataFrame(data, f"a long, rings {RINGS}")
    right = spark.createDataFrame([(1, [square(0.0, 0.0, 5.0)]), (2, [square(-10.0, -10.0, 100.0)])], f"b long, rings {RINGS}")
    got = {(r.a, r.b): round(r.area, 9) for r in overlay.intersections(left, "a", right, "b", "rings", 4.0).collect()}
    assert got == {(1, 1): 16.0, (1, 2): 84.0, (2, 1): 12.5, (2, 2): 50.0, (6, 2): 100.0}  # touching edges share no area
    cover = {r.a: (round(r.area, 9), round(r.share, 9)) for r in overlay.covered_share(left.where("a IN (1, 6)"), "a", right.where("b = 1"), "b", "rings", 4.0).collect()}
    assert cover == {1: (84.0, round(16 / 84, 9)), 6: (100.0, 0.0)}
    assert overlay.intersections(left.limit(0), "a", right, "b", "rings", 4.0).count() == 0


def test_lines_through_and_along_shapes(spark):
    square = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]]
    lines = [
        (1, [(-5.0, 5.0), (15.0, 5.0)]), (2, [(0.0, -5.0), (0.0, 15.0)]), (3, [(-1.0, -1.0), (11.0, 11.0)]), (4, [(20.0, 0.0), (30.0, 0.0)]), (5, [(4.0, 3.0), (4.0, 7.0)]),
        (6, [(1.0, 1.0), (1.0, 1.0)]), (7, []), (8, None), (9, [(2.0, 10.0), (5.0, 10.0), (5.0, 20.0)]), (10, [(10.0, 10.0), (20.0, 20.0)]),
    ]
    shape = spark.createDataFrame([(1, square)], f"s long, rings {RINGS}")
    df = spark.createDataFrame(lines, "l long, p array<struct<x:double,y:double>>")
    for side in (3.0, 10.0, 64.0):
        got = {r.l: round(r.metres, 9) for r in overlay.lines_inside(df, "l", "p", shape, "s", "rings", side).collect()}
        assert got == {1: 8.0, 2: 10.0, 3: round(8 * math.sqrt(2), 9), 5: 4.0, 9: 3.0}
    near = {r.l: r.metres for r in overlay.nearest_vertex(df, "p", F.lit(0.0), F.lit(5.0)).collect()}
    assert near[1] == 5.0 and near[7] is None and near[8] is None


def test_lines_against_convex_shapes(spark):
    rng = random.Random(6)
    lines = [(i, [(rng.uniform(-99, 99), rng.uniform(-99, 99)) for _ in range(3)]) for i in range(40)]
    hulls = [(j, [regular(rng.randint(3, 7), rng.uniform(-50, 50), rng.uniform(-50, 50), 40)]) for j in range(6)]

    def inside(p, q, ring):
        low, high = 0.0, 1.0
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            s, t = ((x2 - x1) * (v[1] - y1) - (y2 - y1) * (v[0] - x1) for v in (p, q))
            if s < 0 and t < 0:
                return 0.0
            low, high = (max(low, s / (s - t)), high) if s < 0 <= t else (low, min(high, s / (s - t))) if t < 0 <= s else (low, high)
        return max(0.0, high - low) * math.dist(p, q)

    want = {(i, j): sum(inside(p, q, h[0]) for p, q in zip(line, line[1:])) for i, line in lines for j, h in hulls}
    got = {(r.l, r.s): r.metres for r in overlay.lines_inside(spark.createDataFrame(lines, "l long, p array<struct<x:double,y:double>>"), "l", "p", spark.createDataFrame(hulls, f"s long, rings {RINGS}"), "s", "rings", 30.0).collect()}
    assert all(abs(got.get(k, 0.0) - v) < 1e-9 for k, v in want.items())


def test_rings_of_documents(spark):
    pos = lambda *p: " ".join(f"{x} {y}" for x, y in p)
    outer, hole, island = [(0, 0), (20, 0), (20, 20), (0, 20)], [(5, 5), (5, 15), (15, 15), (15, 5)], [(7, 7), (9, 7), (9, 9), (7, 9)]
    text = f"<a:f><m:z><m:n> x </m:n><g:posList>{pos(*island, island[0])}</g:posList><g:posList>\n{pos(*outer[::-1])}\n</g:posList><g:posList>{pos(*hole, hole[0], hole[0])}</g:posList></m:z><m:z/><m:z><m:n/></m:z><m:z>cut"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "<z><posList>1 2 3 4</posList><posList>0 0 1 1 2 2 3 3</posList></z>")], "k long, t string")
    found = features.members(docs, "k", "t", "z").select("k", "no", features.element_text(F.col("body"), "n").alias("n"), features.nested(features.position_rings(F.col("body"))).alias("r"))
    rows = {(r.k, r.no): r for r in found.select("*", features.shape_area(F.col("r")).alias("area"), F.transform(features.parts(F.col("r")), F.size).alias("parts")).collect()}
    first = rows[1, 0]
    assert first.n == "x" and first.area == 400 - 100 + 4 and sorted(first.parts) == [1, 2] and sorted(r.depth for r in first.r) == [0, 1, 2]
    turn = {r.depth: sum(a.x * b.y - b.x * a.y for a, b in zip(r.ring, r.ring[1:] + r.ring[:1])) for r in first.r}
    assert turn[0] > 0 > turn[1] and turn[2] > 0
    assert rows[4, 0].area == 0 and rows[4, 0].r == []  # a line is no ring
    shapes = ['{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[2,1],[2,2],[1,2],[1,1]]]}', '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1]]],[[[5,5],[7,5],[7,7],[5,7]]]]}', '{"type":"Point","coordinates":[1,2]}', "no json", None]
    areas = spark.createDataFrame([(s,) for s in shapes], "g string").select(features.shape_area(features.nested(features.geojson_rings(F.col("g")))).alias("a")).collect()
    assert [r.a for r in areas] == [15.0, 4.5, 0.0, 0.0, 0.0]


def smallest(points):
    best = None
    for k in (1, 2, 3):
        for c in combinations(points, k):
            if k == 1:
                x, y, r = *c[0], 0.0
            elif k == 2:
                x, y, r = (c[0][0] + c[1][0]) / 2, (c[0][1] + c[1][1]) / 2, math.dist(*c) / 2
            else:
                (ax, ay), (bx, by), (cx, cy) = c
                d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
                if d == 0:
                    continue
                x = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
                y = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
                r = math.dist((x, y), c[0])
            if all(math.dist((x, y), p) <= r + 1e-7 for p in points) and (best is None or r < best):
                best = r
    return best


def test_enclosing_circles(spark):
    rng = random.Random(5)
    groups = {i: [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(rng.randint(1, 14))] for i in range(8)}
    groups |= {20: [(0.0, 0.0), (10.0, 0.0), (4.0, 0.0), (4.0, 0.0)], 21: [(1.0, 1.0)] * 5, 22: [(x, y) for x in (0.0, 2.0) for y in (0.0, 2.0)]}
    data = [(g, x, y) for g, points in groups.items() for x, y in points] + [(None, 1.0, 1.0), (1, None, 2.0)]
    got = {r.g: r for r in circles.free_centres(spark.createDataFrame(data, "g long, x double, y double"), "g", "x", "y", 60.0, 10.0).collect()}
    assert got.keys() == groups.keys()
    for g, points in groups.items():
        assert got[g].radius == pytest.approx(smallest(points), abs=1e-6) and got[g].points == len(points)
        assert all(math.dist((got[g].x, got[g].y), p) <= got[g].radius + 1e-6 for p in points) and got[g].fits == (got[g].radius + 10 <= 60)


def test_gaps_and_levels(spark):
    held = spark.createDataFrame([(1, 0, 5), (1, 3, 4), (1, 8, 9), (1, 9, 9), (2, -5, 30), (3, 4, 4)], "k long, a int, b int")
    wanted = spark.createDataFrame([(1, 0, 10), (2, 0, 10), (3, 0, 10), (4, 0, 3), (5, 3, 3)], "k long, a int, b int")
    assert sorted((r.k, r.a, r.b) for r in scans.gaps(held, ["k"], "a", "b", wanted).collect()) == [(1, 5, 8), (1, 9, 10), (3, 0, 10), (4, 0, 3)]
    steps = [("c", "a", None), ("c", "b", ["a", "other"]), ("c", "d", ["b", "a"]), ("c", "x", ["y"]), ("c", "y", ["x"]), ("c", "z", ["y", "a"]), ("e", "a", ["a"])]
    got = {(r.case, r.name): (r.level, r.cyclic) for r in scans.levels(spark.createDataFrame(steps, "case string, name string, needs array<string>"), "case", "name", "needs").collect()}
    assert got == {("c", "a"): (0, False), ("c", "b"): (1, False), ("c", "d"): (2, False), ("c", "x"): (None, True), ("c", "y"): (None, True), ("c", "z"): (None, True), ("e", "a"): (None, True)}


def test_full_tiles_are_cut_and_points_counted_once(spark):
    rng = random.Random(8)
    points = [("s", rng.choice([0.0, 8.0, rng.uniform(-20, 40)]), rng.uniform(0, 30)) for _ in range(300)] + [("t", 1.0, 1.0)] * 50 + [(None, 1.0, None)]
    rows = scans.adaptive_tiles(spark.createDataFrame(points, "site string, x double, y double"), "site", 16.0, 10, 3).collect()
    assert sum(r.n for r in rows) == 350 and all(r.truncated == (r.n > 10) and (r.n <= 10 or r.level == 3) for r in rows)
    for r in rows:
        side = 16 / 2**r.level
        assert r.n == sum(s == r.site and math.floor(x / side) == r.i and math.floor(y / side) == r.j for s, x, y in points if y is not None)


def test_zones_of_rules(spark):
    slices = spark.createDataFrame([("a", [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]), ("b", [(100.0, 0.0), (200.0, 0.0), (200.0, 100.0), (100.0, 100.0)])], "s string, ring array<struct<x:double,y:double>>")
    roads = spark.createDataFrame([(1, "일반국도", [(0.0, 0.0), (200.0, 0.0)]), (2, " 군도 ", [(0.0, 20.0), (200.0, 20.0)]), (3, "농로", [(0.0, 90.0), (200.0, 90.0)])], "k long, rank string, p array<struct<x:double,y:double>>")
    rules = spark.createDataFrame([("a", "road_major", 20, False), ("a", "road_minor", 10, False), ("b", "road_minor", 30, True)], "s string, kind string, metres int, certain boolean")
    found = setbacks.zones(slices, "s", "ring", setbacks.road_sources(roads, "k", "rank", "p"), rules, 10.0)
    areas = {r.s: (r.area, r.blocked, r.uncertain, r.open) for r in setbacks.zone_areas(slices, "s", "ring", found, 10.0).collect()}
    assert areas == {"a": (10_000.0, 2_000.0, 1_000.0, 7_000.0), "b": (10_000.0, 5_000.0, 0.0, 5_000.0)}


PIECES = [
    "(1) ", "2. ", "가. ", " ", "10호 이상 ", "5호 미만의 주택", "취락지역", "으로부터 ", "500미터", "1,000m ", "2천미터", "(단, 군도는 500미터)", "(반경 500미터 안에 10호 이상)", "도로와 철도에서는 ", "도로", "경계", "울타리 높이 ", "폭 ", "길로부터 ", "0m", "와의 ", "\n", "  ", "주택 간 ",
    "이상", "다만 ", "(10호 미만 300m, 높이 5m)", "철도·역사와의 거리 ", "미터", "3km", "폭. ",
]


def plain_distances(text):
    """The rules, item by item and number by number."""
    found, seen = [], set()

    def told(before):
        rest = re.sub(ordinances.ITEM_MARK, "", before.strip(" "))
        for pattern in (ordinances.HOUSES, ordinances.ROADS):
            if m := re.findall(pattern, rest):
                return m[-1].replace(" ", "")
        if m := re.search(ordinances.FROM, rest):
            return re.sub(r"\s+", " ", m[1]).strip()[:40]
        return re.sub(r"\s+", " ", rest).strip()[:40]

    def metres(m):
        value = float(m[1].replace(",", "")) * {"천": 1000, "만": 10000}.get(m[2], 1) * (1000 if m[3] in ("킬로미터", "km", "KM") else 1)
        return int(value) or None

    kept = lambda t: [(m, metres(m)) for m in re.finditer(ordinances.DISTANCE, t) if metres(m) and not any(w in t[max(0, m.start() - 40) : m.start()] for w in ordinances.NO_DISTANCE)]
    for item, line in enumerate(re.split(ordinances.ITEM, text)):
        base = re.sub(ordinances.BRACKET, "", line)
        target = next((c for c, p in ordinances.TARGETS.items() if re.search(p, line)), "OTHER")
        rows, parent = [], ""
        for m, d in kept(base):
            rows.append((told(base[: m.start()] or base), d))
            parent = parent or rows[-1][0]
        for b in re.finditer(ordinances.BRACKET, line):
            bare = re.sub(r"^[\s,]*(?:단|다만|이하)[\s,]*", "", re.sub(ordinances.DISTANCE, " ", b[1]))
            bare = re.sub(r"\s+", " ", bare).strip().strip(" ,.·")[:60] or "단서"
            for _, d in kept(b[1]):
                label = ordinances.COUNTED_LABEL if re.search(ordinances.COUNTED, b[1]) else told(b[1]) if re.search(r"\d+호\s*(?:이상|미만)", b[1]) else f"{parent[:40]}({bare})" if parent else bare
                rows.append((label, d))
        for label, d in rows:
            if (target, label) not in seen:
                seen.add((target, label))
                found.append((target, label, d))
    return sorted(found)


@pytest.mark.parametrize("blank", [" ", "　", "\xa0"])
def test_distances_equal_a_plain_reading(spark, blank):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 22))) for _ in range(250)]
    rows = ordinances.distances(spark.createDataFrame([(i, t.replace(" ", blank)) for i, t in enumerate(texts)], "k long, t string"), "k", "t").collect()
    got = {}
    for r in rows:
        got.setdefault(r.k, []).append((r.target, r.detail, r.metres))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == plain_distances(t), t


def test_many_distances_cost_in_proportion(spark):
    text = "".join(f"도로 {i % 97}호 이상 집과 {i}미터 " for i in range(1, 4000))
    df = spark.createDataFrame([(0, text)], "k long, t string")
    ordinances.distances(df.where("k = 1"), "k", "t").collect()
    began = time.time()
    assert len(ordinances.distances(df, "k", "t").collect()) == 97
    assert time.time() - began < 10


def test_reach_can_be_a_column(spark):
    df = spark.createDataFrame([("a", [(0.0, 0.0)], 20.0), ("b", [(0.0, 0.0)], 5.0)], "k string, p array<struct<x:double,y:double>>, r double")
    got = {r.k: r["count"] for r in geometry.cells_near(df, "k", "p", F.col("r"), 1.0).groupBy("k").count().collect()}
    assert got["a"] == pytest.approx(math.pi * 400, rel=0.02) and got["b"] == pytest.approx(math.pi * 25, rel=0.1)


def from_line(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    long = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / long)) if long else 0.0
    return math.hypot(a[0] + t * dx - p[0], a[1] + t * dy - p[1])


def plain_simplified(line, tolerance):
    if len(line) < 3:
        return line
    far = [from_line(p, line[0], line[-1]) for p in line[1:-1]]
    if max(far) <= tolerance:
        return [line[0], line[-1]]
    at = far.index(max(far)) + 1
    return plain_simplified(line[: at + 1], tolerance)[:-1] + plain_simplified(line[at:], tolerance)


def test_simplified_outlines(spark):
    rng = random.Random(3)
    lines = {i: [(float(k), rng.uniform(0, 30)) for k in range(rng.randint(3, 16))] for i in range(8)}
    lines |= {20: [(1.0, 1.0)], 21: [(0.0, 0.0), (5.0, 5.0)], 22: [(0.0, 0.0), (0.0, 0.0), (0.0, 0.0)], 23: [(float(k), 0.0) for k in range(20)]}
    kind = "k long, p array<struct<x:double,y:double>>"
    df = spark.createDataFrame([*lines.items(), (30, []), (31, None)], kind)
    got = {r.k: [tuple(p) for p in r.points] for r in outlines.simplified(df, "k", "p", 9.0).collect()}
    assert got == {k: plain_simplified(v, 9.0) for k, v in lines.items()}
    rings = {i: star(rng, 12, 0.0, 0.0, 50.0) for i in range(4)}
    got = {r.k: [tuple(p) for p in r.points] for r in outlines.simplified(spark.createDataFrame(list(rings.items()), kind), "k", "p", 6.0, closed=True).collect()}
    for k, ring in rings.items():
        closed = plain_simplified([*ring, ring[0]], 6.0)
        assert got[k] == closed[:-1]
        assert all(min(from_line(p, a, b) for a, b in zip(closed, closed[1:])) <= 6.0 for p in ring)


def plain_table(text, mine, other):
    """The first table with rows, row by row."""
    for head in re.finditer(ordinances.TABLE_HEAD, text):
        top = text[head.end() : head.end() + 80]
        if mine not in top or other not in top:
            continue
        body = re.split(ordinances.TABLE_END, text[head.end() :], maxsplit=1)[0]
        out = []
        for m in re.finditer(ordinances.TABLE_ROW, body):
            label = re.sub(ordinances.HEAD_REST, "", re.sub(r"\s+", " ", m[1]).strip(" ·,")).strip(" ·,")
            number = int(float((m[3] if top.find(mine) > top.find(other) else m[2]).replace(",", "").rstrip(".")))
            if label and number:
                named = re.findall(ordinances.APPENDIX, text[: head.start()])
                out.append((named[-1] if named else None, label[:60], number))
        if out:
            return out
    return []


def test_tables_of_two_columns_equal_a_plain_reading(spark):
    rng = random.Random(11)
    pieces = ["구 분 ", "구분 ", "태양에너지 설비 ", "풍력에너지 설비 ", "비고 ", "도로 ", "주거밀집지역 (5호 이상) ", "500미터 이상 이격 ", "1,000m 이상 이격 ", "2미터 이상 이격 ", "\n", "* 상기 ", "(비고)", "[별표 3] ", "[별표 29의 2] ", "0미터 이상 이격 ", "구 분 태양광 풍력 비고 ", "구분 풍력 태양광 ", "철도 5미터 이상 이격 6,000m 이상 이격 ", "학교 300미터 이상 이격 0미터 이상 이격 "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(4, 26))) for _ in range(300)]
    df = spark.createDataFrame([*enumerate(texts), (None, None)], "k long, t string")
    for source, mine, other in (("WIND", "풍력", "태양"), ("SOLAR", "태양", "풍력")):
        got = {}
        for r in ordinances.table_distances(df, "k", "t", source).orderBy("k", "row").collect():
            got.setdefault(r.k, []).append((r.appendix, r.detail, r.metres))
        want = {i: w for i, t in enumerate(texts) if (w := plain_table(t, mine, other))}
        assert len(want) > 20 and got == want
