"""Shapes from feature documents: rings of GML and GeoJSON, repaired, nested and turned the right way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.operators.geometry import inside, ring_area
from gridlark.operators.overlay import RINGS, edge_distance

RING = "array<struct<x:double,y:double>>"


def _once(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def members(docs: DataFrame, key: str, text: str, tag: str) -> DataFrame:
    """(key, no, body) of every element ``tag`` of a document, whatever its namespace prefix; an element that is never closed is left out."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), rf"<(?:\w+:)?{tag}(?=[\s>])[^>]*(?<!/)>")
    bodies = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.regexp_extract(p, rf"^([\s\S]*?)</(?:\w+:)?{tag}\s*>", 1))
    return docs.select(key, F.posexplode(bodies).alias("no", "body")).where("body <> ''")


def element_text(body: Column, tag: str) -> Column:
    """The trimmed text of the first element ``tag``; null without one."""
    return F.nullif(F.trim(F.regexp_extract(body, rf"<(?:\w+:)?{tag}(?:\s[^>]*)?>([^<]*)<", 1)), F.lit(""))


def position_rings(body: Column, y_first: bool = False) -> Column:
    """The rings of all position lists of a text; numbers alternate x and y, a list with an unreadable number gives no ring."""
    lists = F.regexp_extract_all(body, F.lit(r"<(?:\w+:)?posList(?:\s[^>]*)?>([^<]*)<"), 1)
    a, b = (1, 0) if y_first else (0, 1)

    def ring(numbers: Column) -> Column:
        n = F.floor(F.size(numbers) / 2).cast("int")
        points = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.get(numbers, 2 * i + a).alias("x"), F.get(numbers, 2 * i + b).alias("y")))
        return F.when((n > 0) & F.forall(numbers, lambda v: v.isNotNull()), points).otherwise(F.array().cast(RING))

    numbers = lambda t: F.transform(F.filter(F.split(t, r"\s+"), lambda v: v != ""), lambda v: v.try_cast("double"))
    return F.transform(lists, lambda t: _once(numbers(t), ring))


def geojson_rings(geometry: Column) -> Column:
    """The rings of a GeoJSON Polygon or MultiPolygon; none for other geometries and unreadable text."""
    kind, at = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    one = F.from_json(at, "array<array<array<double>>>")
    many = F.flatten(F.from_json(at, "array<array<array<array<double>>>>"))
    rings = F.transform(F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many), lambda r: F.transform(r, point))
    whole = F.filter(rings, lambda r: F.forall(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    return F.coalesce(whole, F.array().cast(RINGS))


def repaired(rings: Column) -> Column:
    """Rings without their closing point and points that repeat the one before; those of under three points or without area are left out, and repeated rings stay once."""

    def bare(ring: Column) -> Column:
        kept = F.filter(ring, lambda p, i: (i == 0) | (F.get(ring, i - 1) != p))
        return _once(kept, lambda r: F.when((F.size(r) > 1) & (F.get(r, F.lit(0)) == F.element_at(r, -1)), F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0)))).otherwise(r))

    return F.array_distinct(F.filter(F.transform(rings, bare), lambda r: (F.size(r) >= 3) & (F.coalesce(ring_area(r), F.lit(0.0)) > 0)))


def _signed(ring: Column) -> Column:
    step = lambda p, i: p["x"] * _next(ring, i)["y"] - _next(ring, i)["x"] * p["y"]
    return F.aggregate(F.transform(ring, step), F.lit(0.0), lambda s, v: s + v)


def _next(ring: Column, i: Column) -> Column:
    return F.get(ring, F.when(i + 1 < F.size(ring), i + 1).otherwise(0))


def nested(rings: Column) -> Column:
    """(ring, depth) of repaired rings: the depth is the number of rings around a ring; even ones are outlines, turned left, odd ones holes, turned right.

    A ring is inside a larger one if some corner of it is, and not on its edge; documents do not cross their own rings.
    """

    def around(one: Column, others: Column) -> Column:
        holds = lambda o: F.exists(one["ring"], lambda p: inside(o, p["x"], p["y"]) & (edge_distance(F.array(o), p["x"], p["y"]) > 0))
        return F.size(F.filter(others, lambda o: (o["m2"] > one["m2"]) & holds(o["ring"])))

    def turned(ring: Column, depth: Column) -> Column:
        left = _signed(ring) > 0
        return F.struct(F.when(left == (depth % 2 == 0), ring).otherwise(F.reverse(ring)).alias("ring"), depth.alias("depth"))

    sized = F.transform(repaired(rings), lambda r: F.struct(r.alias("ring"), ring_area(r).alias("m2")))
    return _once(sized, lambda held: F.transform(held, lambda r: _once(around(r, held), lambda depth: turned(r["ring"], depth))))


def shape_area(nested_rings: Column) -> Column:
    """The area of nested rings, holes taken off."""
    each = F.transform(nested_rings, lambda r: F.when(r["depth"] % 2 == 0, ring_area(r["ring"])).otherwise(-ring_area(r["ring"])))
    return F.aggregate(each, F.lit(0.0), lambda s, v: s + v)


def parts(nested_rings: Column) -> Column:
    """The polygons of nested rings: arrays of rings, each an outline and the holes directly in it."""

    def of(outline: Column) -> Column:
        inner = F.filter(nested_rings, lambda r: (r["depth"] == outline["depth"] + 1) & F.exists(r["ring"], lambda p: inside(outline["ring"], p["x"], p["y"])))
        return F.concat(F.array(outline["ring"]), F.transform(inner, lambda r: r["ring"]))

    return F.transform(F.filter(nested_rings, lambda r: r["depth"] % 2 == 0), of)
