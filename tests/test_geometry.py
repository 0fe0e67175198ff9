import math
import random

import pytest
from pyspark.sql import functions as F

from quadrille.operators import geometry as g
from quadrille.operators.tokens import thin


def test_wkb_both_ways():
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)]
    for kind, parts in ((0, [[(1.5, -2.0)]]), (1, [ring[:3]]), (2, [ring, ring[::-1]]), (3, [[(1.0, 2.0)], [(3.0, 4.0)]]), (4, [ring[:2], ring[1:]])):
        assert g.from_wkb(g.to_wkb(kind, parts)) == (kind, parts)
    big = b"\x00\x00\x00\x00\x01" + __import__("struct").pack(">2d", 7.0, 8.0)
    assert g.from_wkb(big) == (0, [[(7.0, 8.0)]])


def test_measures_and_udfs(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0), (1.0, 1.0)]
    rows = [(1, g.to_wkb(2, [square, hole])), (2, g.to_wkb(1, [[(0.0, 0.0), (3.0, 4.0)]])), (3, None)]
    df = spark.createDataFrame(rows, "id int, wkb binary").withColumn("geo", g.decode("wkb"))
    got = {r.id: r for r in df.select("id", g.area(F.col("geo.parts")).alias("area"), g.length(F.col("geo.parts")[0]).alias("length"), g.bounds(F.col("geo.parts")).alias("b"), g.closed(F.col("geo.parts")[0]).alias("c"), (g.encode("geo.type", "geo.parts") == F.col("wkb")).alias("same")).where("id < 3").collect()}
    assert got[1].area == 15 and got[1].length == 16 and got[1].c and got[1].same and tuple(got[1].b) == (0, 0, 4, 4)
    assert got[2].length == 5 and not got[2].c and got[2].same
    assert df.where("id = 3").first().geo.parts is None
    ring = spark.createDataFrame([([{"x": x, "y": y} for x, y in square[::-1]],)], "r array<struct<x:double,y:double>>")
    assert [tuple(p) for p in ring.select(g.canonical_ring(F.col("r")).alias("r")).first().r] == square
    cut = df.where("id < 3").select("id", g.clip("geo.type", "geo.parts", F.lit(0.0), F.lit(0.0), F.lit(1.5), F.lit(1.5)).alias("p")).withColumn("a", g.area(F.col("p")))
    assert cut.where("id = 1").first().a == pytest.approx(1.5 * 1.5 - 0.25)
    assert [tuple(q) for q in cut.where("id = 2").first().p[0]] == [(0, 0), (1.125, 1.5)]


def test_several_polygons(spark):
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    parts = [box(0.0, 0.0, 3.0, 2.0), box(1.0, 0.5, 1.0, 1.0), [], box(10.0, 0.0, 3.0, 1.0)]  # areas 5 and 3
    wkb = g.to_wkb(5, parts)
    assert g.from_wkb(wkb) == (5, parts) and g.from_wkb(g.to_wkb(5, [])) == (5, [])
    ring = lambda r: __import__("struct").pack(">I", len(r)) + b"".join(__import__("struct").pack(">2d", *q) for q in r)
    head = lambda k, n: b"\x00" + __import__("struct").pack(">II", k, n)
    assert g.from_wkb(head(6, 3) + head(3, 2) + ring(parts[0]) + ring(parts[1]) + head(3, 0) + head(3, 1) + ring(parts[3])) == (5, parts)
    df = spark.createDataFrame([(wkb,)], "wkb binary").withColumn("geo", g.decode("wkb"))
    cut = lambda *sides: g.clip("geo.type", "geo.parts", *map(F.lit, sides))
    got = df.select(
        g.area(F.col("geo.parts")).alias("all"), g.area(cut(0.0, 0.0, 11.0, 9.0)).alias("both"), g.area(cut(9.0, 0.0, 20.0, 0.5)).alias("second"), g.area(cut(5.0, 5.0, 6.0, 6.0)).alias("none"),
        g.encode("geo.type", "geo.parts").alias("again"), g.bounds(F.col("geo.parts")).alias("bounds"),
    ).first()
    assert (got["all"], got.both, got.second, got.none) == (8, 6, 1.5, 0) and bytes(got.again) == wkb and tuple(got.bounds) == (0, 0, 13, 2)


def test_clipping_keeps_lengths_and_areas():
    rng = random.Random(1)
    length = lambda ps: sum(math.dist(a, b) for p in ps for a, b in zip(p, p[1:]))
    area = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))) / 2
    for _ in range(50):
        line = [(rng.uniform(0, 4), rng.uniform(0, 4)) for _ in range(6)]
        mx, my = sum(p[0] for p in line) / 6, sum(p[1] for p in line) / 6
        ring = sorted(line, key=lambda p: math.atan2(p[1] - my, p[0] - mx))  # around their mean, so it doesn't cross itself
        ring.append(ring[0])
        boxes = [(i, j, i + 1, j + 1) for i in range(4) for j in range(4)]
        assert sum(length(g.clip_line(line, b)) for b in boxes) == pytest.approx(length([line]))
        assert sum(area(g.clip_ring(ring, b)) for b in boxes) == pytest.approx(area(ring))


def test_crossings():
    assert g.line_crossings([(10, 10), (260, 60)], 250) == [(0, 1, 58)]
    assert g.line_crossings([(200, 200), (300, 300)], 250) == [(0, 1, 250), (1, 1, 250)]
    assert g.line_crossings([(10, 250), (240, 250)], 250) == []


def test_projection(spark):
    # On the central meridian x is the false easting, and y the meridian arc; published: 45 N is 4,984,944.378 m from the equator.
    row = spark.range(1).select(g.transverse_mercator(F.lit(9.0), F.lit(45.0), F.lit(9.0), scale=1.0).alias("p")).first().p
    assert row.x == pytest.approx(500_000, abs=1e-6) and row.y == pytest.approx(4_984_944.378, abs=2e-3)
    assert spark.range(1).select(g.utm_zone(F.lit(10.0)).alias("z")).first().z == 32


def test_thinning(spark):
    points = [{"x": x, "y": 0.0} for x in (0.0, 0.2, 0.6, 0.9, 2.0)]
    df = spark.createDataFrame([(points,)], "p array<struct<x:double,y:double>>")
    assert [q.x for q in df.select(thin(F.col("p")).alias("t")).first().t] == [0, 0.6, 2]
