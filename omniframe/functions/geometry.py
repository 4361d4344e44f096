"""Geometry: points are structs (x, y), other shapes GeoJSON structs (type, coordinates).

Measures of shapes run on their GeoJSON text in Arrow-batched UDFs.
"""

from __future__ import annotations

import json
import math
from typing import TYPE_CHECKING, Any

from pyspark.sql import types as T

from omniframe.plans.values import Val

if TYPE_CHECKING:
    from omniframe.plans.compiler import Scope

EARTH = 6378137.0


def shape(text: str) -> tuple[str, Any]:
    g = json.loads(text)
    if "x" in g:
        return "Point", [g["x"], g["y"]]
    if g["type"] == "GeometryCollection":
        return g["type"], [shape(json.dumps(x)) for x in g["geometries"]]
    return g["type"], g["coordinates"]


def rings(kind: str, c: Any) -> list[list[list[list[float]]]]:
    return {"Polygon": lambda: [c], "MultiPolygon": lambda: c}.get(kind, list)()


def ring_area(ring: list[list[float]]) -> float:
    """Area on the sphere by the trapezoids under a ring's edges."""
    total = 0.0
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        total += math.radians(x2 - x1) * (2 + math.sin(math.radians(y1)) + math.sin(math.radians(y2)))
    return abs(total * EARTH * EARTH / 2)


def area(text: str) -> float:
    kind, c = shape(text)
    if kind == "GeometryCollection":
        return sum(sum(ring_area(p[0]) - sum(map(ring_area, p[1:])) for p in rings(k, x)) for k, x in c)
    return float(sum(ring_area(p[0]) - sum(map(ring_area, p[1:])) for p in rings(kind, c)))


def _flat(c: Any) -> list[list[float]]:
    return [c] if c and isinstance(c[0], (int, float)) else [p for x in c for p in _flat(x)]


def centroid(text: str) -> str:
    kind, c = shape(text)
    polygons = rings(kind, c)
    if polygons:
        ax = ay = at = 0.0
        for p in polygons:
            for k, ring in enumerate(p):
                a = cx = cy = 0.0
                for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                    w = x1 * y2 - x2 * y1
                    a, cx, cy = a + w / 2, cx + (x1 + x2) * w / 6, cy + (y1 + y2) * w / 6
                sign = (1 if a >= 0 else -1) * (-1 if k else 1)
                at, ax, ay = at + sign * a, ax + sign * cx, ay + sign * cy
        if at:
            return f"{ax / at!r} {ay / at!r}"
    if kind in ("LineString", "MultiLineString"):
        total = x = y = 0.0
        for line in [c] if kind == "LineString" else c:
            for (x1, y1), (x2, y2) in zip(line, line[1:]):
                n = math.hypot(x2 - x1, y2 - y1)
                total, x, y = total + n, x + n * (x1 + x2) / 2, y + n * (y1 + y2) / 2
        if total:
            return f"{x / total!r} {y / total!r}"
    points = _flat(c)
    return f"{sum(p[0] for p in points) / len(points)!r} {sum(p[1] for p in points) / len(points)!r}"


def is_valid(text: str) -> bool:
    kind, c = shape(text)
    if kind == "GeometryCollection":
        return True
    points = _flat(c)
    if any(not all(math.isfinite(v) for v in p) for p in points):
        return False
    return all(len(r) >= 4 and r[0] == r[-1] for p in rings(kind, c) for r in p)


def inside(point: list[float], polygon: list[list[list[float]]]) -> bool:
    def hit(ring: list[list[float]]) -> bool:
        x, y = point
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    return hit(polygon[0]) and not any(map(hit, polygon[1:]))


def _cross(a: list[float], b: list[float], c: list[float], d: list[float]) -> bool:
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0 and max(min(a[0], b[0]), min(c[0], d[0])) <= min(max(a[0], b[0]), max(c[0], d[0])) and max(min(a[1], b[1]), min(c[1], d[1])) <= min(max(a[1], b[1]), max(c[1], d[1]))


def _edges(kind: str, c: Any) -> list[tuple[list[float], list[float]]]:
    lines = {"LineString": lambda: [c], "MultiLineString": lambda: c}.get(kind, lambda: [r for p in rings(kind, c) for r in p])()
    return [(a, b) for line in lines for a, b in zip(line, line[1:])]


def contains(a: str, b: str) -> bool:
    (ka, ca), (kb, cb) = shape(a), shape(b)
    return bool(rings(ka, ca)) and all(any(inside(p, poly) for poly in rings(ka, ca)) for p in _flat(cb)) or (ka, ca) == (kb, cb)


def intersects(a: str, b: str) -> bool:
    (ka, ca), (kb, cb) = shape(a), shape(b)
    if any(inside(p, poly) for poly in rings(ka, ca) for p in _flat(cb)) or any(inside(p, poly) for poly in rings(kb, cb) for p in _flat(ca)):
        return True
    return any(_cross(*e, *f) for e in _edges(ka, ca) for f in _edges(kb, cb)) or "Point" in (ka, kb) and any(p == q for p in _flat(ca) for q in _flat(cb))


UDFS = {"geo_area": (area, "double"), "geo_centroid": (centroid, "string"), "geo_is_valid": (is_valid, "boolean"), "geo_contains": (contains, "boolean"), "geo_intersects": (intersects, "boolean")}


def build(name: str, scope: Scope, args: list[Val]) -> Val:
    from omniframe.functions.python_udfs import register
    from omniframe.plans.compiler import typed

    v = args[0]
    if name == "geo_is_valid" and isinstance(v.type, T.StructType) and v.type.names == ["x", "y"] and all(isinstance(f.dataType, T.DoubleType) for f in v.type.fields):
        far = "double('infinity')"
        return Val(f"if({v.sql} IS NULL, CAST(NULL AS BOOLEAN), coalesce(abs({v.sql}.x) < {far} AND abs({v.sql}.y) < {far}, false))", T.BooleanType())
    f = f"{register(scope, name)}(to_json({v.sql}))"
    if name == "geo_centroid":
        return typed(scope, f"named_struct('x', double(split_part({f}, ' ', 1)), 'y', double(split_part({f}, ' ', 2)))")
    return Val(f, T.DoubleType() if name == "geo_area" else T.BooleanType())


def relation(op: str, a: Val, b: Val, scope: Scope) -> str:
    from omniframe.functions.python_udfs import register

    f = register(scope, "geo_contains" if op == "CONTAINS" else "geo_intersects")
    sql = f"coalesce({f}(to_json({a.sql}), to_json({b.sql})), false)"
    return f"(NOT {sql})" if op == "OUTSIDE" else sql
