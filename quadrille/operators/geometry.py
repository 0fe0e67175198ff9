"""Geometry as arrays of parts: WKB, measures, box clipping, projection and crossings of grid lines.

A geometry is a struct of a type code (0 point, 1 line, 2 polygon, 3 to 5 their collections) and parts,
each an array of (x, y); the rings of a polygon are parts, the outer one first, and an empty part stands
between the polygons of a collection. Measures are expressions; WKB and clipping, which take bytes and loops apart, are Arrow UDFs."""

from __future__ import annotations

import math
import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions import let, neighbours

GEOMETRY = "struct<type:tinyint,parts:array<array<struct<x:double,y:double>>>>"


def polygons(parts: list[list]) -> list[list[list]]:
    """The rings of each polygon of a collection."""
    out: list[list[list]] = [[]] if parts else []
    for part in parts:
        if part:
            out[-1].append(part)
        else:
            out.append([])
    return out


def joined(each: list[list[list]]) -> list[list]:
    """The parts of a collection of polygons; those without a ring are left out."""
    return [part for k, rings in enumerate(filter(None, each)) for part in ([[]] if k else []) + rings]


def from_wkb(data: bytes) -> tuple[int, list[list[tuple[float, float]]]]:
    """Type code and parts of little- or big-endian WKB; further dimensions are dropped."""
    at = 0

    def number(kind: str, order: str):
        nonlocal at
        size = struct.calcsize(kind)
        value = struct.unpack_from(order + kind, data, at)[0]
        at += size
        return value

    def one() -> tuple[int, list]:
        nonlocal at
        order = "<" if data[at] else ">"
        at += 1
        raw = number("I", order)
        extra = (raw >> 31 & 1) + (raw >> 30 & 1)
        if raw & 0x20000000:
            number("I", order)
        kind, thousands = (raw & 0xFFFF) % 1000, (raw & 0xFFFF) // 1000
        extra += {0: 0, 1: 1, 2: 1, 3: 2}[thousands]

        def points(n: int) -> list[tuple[float, float]]:
            return [(number("d", order), number("d", order), [number("d", order) for _ in range(extra)])[:2] for _ in range(n)]

        if kind == 1:
            return 0, [points(1)]
        if kind == 2:
            return 1, [points(number("I", order))]
        if kind == 3:
            return 2, [points(number("I", order)) for _ in range(number("I", order))]
        if kind == 6:
            return 5, joined([[ring for ring in one()[1] if ring] for _ in range(number("I", order))])
        if kind in (4, 5):
            return kind - 1, [part for _ in range(number("I", order)) for part in one()[1]]
        raise ValueError(f"unknown geometry type {kind}")

    return one()


def to_wkb(kind: int, parts: list[list[tuple[float, float]]]) -> bytes:
    """Little-endian WKB of points, lines, polygons and their collections."""
    line = lambda p: struct.pack("<I", len(p)) + b"".join(struct.pack("<2d", *q) for q in p)
    head = lambda k: struct.pack("<BI", 1, k)
    if kind == 0:
        return head(1) + struct.pack("<2d", *parts[0][0])
    if kind == 1:
        return head(2) + line(parts[0])
    if kind == 2:
        return head(3) + struct.pack("<I", len(parts)) + b"".join(map(line, parts))
    if kind in (3, 4):
        return head(kind + 1) + struct.pack("<I", len(parts)) + b"".join(to_wkb(kind - 3, [p]) for p in parts)
    if kind == 5:
        each = polygons(parts)
        return head(6) + struct.pack("<I", len(each)) + b"".join(to_wkb(2, rings) for rings in each)
    raise ValueError(f"can't write geometry type {kind}")


def decode(wkb: Column | str) -> Column:
    """The geometry of a WKB column, put together as flat arrays with offsets."""

    def run(values: pa.Array) -> pa.Array:
        kinds, xs, ys, points, parts, missing = [], [], [], [0], [0], []
        for v in values.to_pylist():
            kind, found = (None, []) if v is None else from_wkb(v)
            kinds.append(kind)
            missing.append(v is None)
            for part in found:
                xs += [p[0] for p in part]
                ys += [p[1] for p in part]
                points.append(len(xs))
            parts.append(len(points) - 1)
        point = pa.StructArray.from_arrays([pa.array(xs, pa.float64()), pa.array(ys, pa.float64())], names=["x", "y"])
        each = pa.ListArray.from_arrays(pa.array(points, pa.int32()), point)
        gone = pa.array(missing, pa.bool_())
        whole = pa.ListArray.from_arrays(pa.array(parts, pa.int32()), each, mask=gone)
        return pa.StructArray.from_arrays([pa.array(kinds, pa.int8()), whole], names=["type", "parts"])

    return F.arrow_udf(run, GEOMETRY)(wkb)


def encode(kind: Column | str, parts: Column | str) -> Column:
    """WKB of a geometry's type code and parts."""

    def run(kinds: pa.Array, each: pa.Array) -> pa.Array:
        return pa.array([None if p is None else to_wkb(int(k), [[(q["x"], q["y"]) for q in part] for part in p]) for k, p in zip(kinds.to_pylist(), each.to_pylist())], pa.binary())

    return F.arrow_udf(run, "binary")(kind, parts)


def _pairs(points: Column) -> Column:
    """Neighbouring points as (a, b)."""
    return neighbours(points)


def length(points: Column) -> Column:
    return F.aggregate(_pairs(points), F.lit(0.0), lambda s, p: s + F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"]))


def signed_area(ring: Column) -> Column:
    """Positive counter-clockwise."""
    return F.aggregate(_pairs(ring), F.lit(0.0), lambda s, p: s + (p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"])) / 2


def area(parts: Column) -> Column:
    """Of a polygon or several: the outer rings without their holes."""

    def add(state: Column, ring: Column) -> Column:
        size = F.abs(signed_area(ring))
        return F.struct((F.size(ring) == 0).alias("outer"), (state["total"] + F.when(state["outer"], size).otherwise(-size)).alias("total"))

    return F.aggregate(parts, F.struct(F.lit(True).alias("outer"), F.lit(0.0).alias("total")), add, lambda s: s["total"])


def bounds(parts: Column) -> Column:
    points = F.flatten(parts)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def closed(points: Column, tolerance: float = 1e-6) -> Column:
    """At least four points, with the ends together."""
    a, b = F.element_at(points, 1), F.element_at(points, -1)
    return (F.size(points) >= 4) & (F.hypot(a["x"] - b["x"], a["y"] - b["y"]) <= tolerance)


def edge_of(x: Column, y: Column, side: float = 250.0, tolerance: float = 1e-6) -> Column:
    """The edge of a cell that a point lies on: W before E, N (y = 0), S; null inside."""
    return F.when(F.abs(x) <= tolerance, "W").when(F.abs(x - side) <= tolerance, "E").when(F.abs(y) <= tolerance, "N").when(F.abs(y - side) <= tolerance, "S")


def end_relation(a: Column, z: Column) -> Column:
    """How a line lies to the edges of its cell, by the edges that its ends are on."""
    return F.when(a.isNull() & z.isNull(), "inside").when(a.isNull() | z.isNull(), "one end").when(a == z, "same edge").otherwise("two edges")


def canonical_ring(ring: Column, hole: bool = False) -> Column:
    """The same ring from its least vertex on, counter-clockwise (a hole clockwise), closed again."""

    def turned(r: Column) -> Column:
        wrong = signed_area(r) > 0 if hole else signed_area(r) < 0
        return F.slice(F.when(wrong, F.reverse(r)).otherwise(r), F.lit(1), F.size(r) - 1)

    def from_least(body: Column) -> Column:
        return let(F.array_position(body, F.array_min(body)).cast("int"), lambda at: F.concat(F.slice(body, at, F.size(body)), F.slice(body, F.lit(1), at)))

    return let(ring, lambda r: let(turned(r), from_least))


def clip_line(points: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[list[tuple[float, float]]]:
    """The stretches of a line inside a box (min_x, min_y, max_x, max_y), in order; touches in one point are
    not stretches."""
    x0, y0, x1, y1 = box
    out: list[list[tuple[float, float]]] = []
    for (ax, ay), (bx, by) in zip(points, points[1:]):
        dx, dy, low, high = bx - ax, by - ay, 0.0, 1.0
        for p, q in ((-dx, ax - x0), (dx, x1 - ax), (-dy, ay - y0), (dy, y1 - ay)):
            if p == 0:
                if q < 0:
                    low, high = 1.0, 0.0
            elif p < 0:
                low = max(low, q / p)
            else:
                high = min(high, q / p)
        if low >= high:
            continue
        a = (ax, ay) if low == 0 else (ax + low * dx, ay + low * dy)
        b = (bx, by) if high == 1 else (ax + high * dx, ay + high * dy)
        if out and out[-1][-1] == a:
            out[-1].append(b)
        else:
            out.append([a, b])
    return out


def clip_ring(ring: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """A ring cut to a box, side by side; closed, or empty. What falls into several pieces stays one ring
    that runs along the box between them: the area is right, the number of pieces isn't told."""
    x0, y0, x1, y1 = box
    points = ring[:-1] if ring and ring[0] == ring[-1] else list(ring)
    for inside, cross in (
        (lambda p: p[0] >= x0, lambda a, b: (x0, a[1] + (b[1] - a[1]) * (x0 - a[0]) / (b[0] - a[0]))),
        (lambda p: p[0] <= x1, lambda a, b: (x1, a[1] + (b[1] - a[1]) * (x1 - a[0]) / (b[0] - a[0]))),
        (lambda p: p[1] >= y0, lambda a, b: (a[0] + (b[0] - a[0]) * (y0 - a[1]) / (b[1] - a[1]), y0)),
        (lambda p: p[1] <= y1, lambda a, b: (a[0] + (b[0] - a[0]) * (y1 - a[1]) / (b[1] - a[1]), y1)),
    ):
        new = []
        for a, b in zip([points[-1], *points[:-1]] if points else [], points):
            if inside(b):
                if not inside(a):
                    new.append(cross(a, b))
                new.append(b)
            elif inside(a):
                new.append(cross(a, b))
        points = new
    return [*points, points[0]] if points else []


def clip(kind: Column | str, parts: Column | str, *box: Column) -> Column:
    """Lines and polygons cut to a box (min_x, min_y, max_x, max_y), points kept if inside (upper sides excluded)."""

    def run(kinds: pa.Array, each: pa.Array, min_x: pa.Array, min_y: pa.Array, max_x: pa.Array, max_y: pa.Array) -> pa.Array:
        out = []
        for k, geometry, *sides in zip(*(column.to_pylist() for column in (kinds, each, min_x, min_y, max_x, max_y))):
            if geometry is None:
                out.append(None)
                continue
            lists = [[(q["x"], q["y"]) for q in part] for part in geometry]
            if k in (0, 3):
                found = [[p] for part in lists for p in part if sides[0] <= p[0] < sides[2] and sides[1] <= p[1] < sides[3]]
            elif k in (1, 4):
                found = [piece for part in lists for piece in clip_line(part, tuple(sides))]
            else:
                # What is left of a polygon begins with its outer ring: holes don't reach beyond it.
                found = joined([[ring for part in rings if (ring := clip_ring(part, tuple(sides)))] for rings in polygons(lists)])
            out.append([[{"x": x, "y": y} for x, y in part] for part in found])
        return pa.array(out, each.type)

    return F.arrow_udf(run, "array<array<struct<x:double,y:double>>>")(kind, parts, *box)


def line_crossings(points: list[tuple[float, float]], step: float) -> list[tuple[int, int, float]]:
    """(axis, line number, position along the line) where a line passes a grid line, in order; axis 0 are
    lines of constant x. Running along a line or touching it isn't passing it."""
    out = []
    for (ax, ay), (bx, by) in zip(points, points[1:]):
        here = []
        for axis, (a, b, c, d) in enumerate(((ax, bx, ay, by), (ay, by, ax, bx))):
            if a == b:
                continue
            for k in range(math.ceil(min(a, b) / step), math.floor(max(a, b) / step) + 1):
                t = (k * step - a) / (b - a)
                if 0 < t < 1 or (t == 1 and (bx, by) != points[-1]):
                    here.append((t, axis, k, c + t * (d - c)))
        out += [(axis, k, at) for _, axis, k, at in sorted(here)]
    return out


# The ellipsoid and the scale on the central meridian of the projections in use.
SEMI_MAJOR, FLATTENING, UTM_SCALE = 6378137.0, 1 / 298.257222101, 0.9996


def utm_zone(lon: Column) -> Column:
    return F.floor((lon + 180) / 6).cast("int") + 1


def transverse_mercator(lon: Column, lat: Column, lon0: Column | float, scale: float = UTM_SCALE, false_x: float = 500_000.0, false_y: float = 0.0) -> Column:
    """(x, y) in metres, by the series in the third flattening to its third power (well below a millimetre
    within a zone)."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alphas = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - lon0)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(alphas, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return F.struct((scale * radius * x + false_x).alias("x"), (scale * radius * y + false_y).alias("y"))
