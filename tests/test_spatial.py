"""Shapes against plain forms, and the cases of the tile that is hard to cut."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import measure, spatial, tokens
from quadrille.plans import measures
from quadrille.plans import spatial as plans

SF = "/root/testdata/sf0.001"
GEOMETRY = "id string, type tinyint, parts array<array<struct<x:double,y:double>>>"


def shape(name, kind, *points):
    return (name, kind, [[{"x": float(x), "y": float(y)} for x, y in points]])


@pytest.fixture(scope="module")
def pieces(spark):
    rows = [
        shape("single", 1, (50, 50), (200, 100)), shape("three", 1, (50, 125), (700, 125)), shape("corner", 1, (200, 200), (300, 300)),
        shape("along", 1, (50, 250), (200, 250)), shape("touch", 1, (50, 150), (250, 150)), shape("box", 2, (200, 40), (250, 40), (250, 60), (200, 60), (200, 40)),
        shape("poi", 0, (700, 700)), shape("on", 0, (250, 250)), shape("out", 0, (2000, 10)), shape("zigzag", 1, (240, 10), (260, 20), (240, 30), (260, 40)),
    ]
    return spatial.cell_pieces(spark.createDataFrame(rows, GEOMETRY)).persist()


def test_cells_of_the_hard_shapes(pieces):
    got = {}
    for r in pieces.collect():
        got.setdefault(r.id, set()).add((r.cell_i, r.cell_j))
    assert got == {
        "single": {(0, 0)}, "three": {(0, 0), (1, 0), (2, 0)}, "corner": {(0, 0), (1, 1)}, "along": {(0, 1)}, "touch": {(0, 0)}, "box": {(0, 0), (1, 0)},
        "poi": {(2, 2)}, "on": {(1, 1)}, "zigzag": {(0, 0), (1, 0)},
    }


def test_crossings(spark, pieces):
    assert {(r.id, r.cell_i, r.cell_j, r.corner_i, r.corner_j, r.event) for r in spatial.corner_crossings(pieces, ["id"]).collect()} == {("corner", 0, 0, 1, 1, "enter"), ("corner", 1, 1, 1, 1, "enter")}
    rows = [shape("zigzag", 1, (240, 10), (260, 20), (240, 30), (260, 40)), shape("bend", 1, (200, 10), (250, 10), (300, 10)), shape("ends", 1, (200, 10), (250, 10)), shape("back", 1, (600, 10), (100, 10))]
    lines = spark.createDataFrame(rows, GEOMETRY).withColumn("p", F.get("parts", F.lit(0)))
    got = sorted((r.id, r.axis, r.line, r.position, r.ordinal) for r in spatial.line_crossings(lines, ["id"], "p").collect())
    assert got == [("back", 0, 1, 10, 2), ("back", 0, 2, 10, 1), ("bend", 0, 1, 10, 1), ("zigzag", 0, 1, 15, 1), ("zigzag", 0, 1, 25, 2), ("zigzag", 0, 1, 35, 3)]


def test_the_corner_query(spark):
    got = plans.corner_crossings(spark, SF)
    n = plans.shapes(spark, SF).where("kind = 1").count()
    assert got.count() == 2 * n and got.where("corner_i - cell_i NOT IN (0, 1)").count() == 0


def test_greedy_match_against_the_plain_form(spark):
    rows = plans.shapes(spark, SF).where("kind = 0 AND town < 2").select(F.floor(F.col("x") / 500).alias("k"), "id", "x", "y", "town").collect()
    want = set()
    for k in {r.k for r in rows}:
        free = sorted((r.id, r.x, r.y) for r in rows if r.k == k and r.town == 1)
        for a in sorted((r.id, r.x, r.y) for r in rows if r.k == k and r.town == 0):
            if free:
                b = min(free, key=lambda q: (math.dist(a[1:], q[1:]), q[0]))
                if math.dist(a[1:], b[1:]) <= 200:
                    free.remove(b)
                    want.add((k, a[0], b[0]))
    assert {(r.k, r.a, r.b) for r in plans.greedy_matches(spark, SF).collect()} == want and want


def in_order(rows, reach):
    """The plain form, of rows (id, x, y, left) in whole numbers: squares of distances are exact."""
    rows, out = sorted(rows), []
    free = np.array([r[:3] for r in rows if not r[3]], np.int64).reshape(-1, 3)
    for a, x, y, _ in (r for r in rows if r[3]):
        far = (free[:, 1] - x) ** 2 + (free[:, 2] - y) ** 2
        if len(far) and far[k := far.argmin()] <= reach * reach:
            out.append((a, int(free[k, 0]), math.sqrt(far[k])))
            free = np.delete(free, k, axis=0)
    return out


def matched(spark, rows, reach):
    points = spark.createDataFrame(rows, "id long, x double, y double, own boolean").withColumn("g", F.lit(1))
    return sorted((r.a, r.b, r.distance) for r in measure.greedy_match(points, ["g"], F.col("own"), reach).collect())


def test_greedy_match_of_a_large_group(spark):
    """30,000 a side in one group, many of them at one place or at the same distance, in a minute: not each against each."""
    rng = random.Random(7)
    rows = [(k, rng.randrange(300), rng.randrange(300), k % 2 == 0) for k in rng.sample(range(60_000), 60_000)]
    want, began = in_order(rows, 20), time.monotonic()
    got = matched(spark, [(k, float(x), float(y), own) for k, x, y, own in rows], 20.0)
    assert time.monotonic() - began < 60 and got == want and len(want) > 29_000


def test_greedy_match_of_hard_groups(spark):
    rng = random.Random(8)
    for n, span, share, reach in ((1, 1, 0.0, 9), (9, 1, 0.5, 0), (300, 1, 0.5, 2), (300, 3, 0.9, 1), (300, 3, 0.1, 0), (300, 5000, 0.5, 300), (300, 5000, 0.5, 9000), (40, 9, 1.0, 9), (40, 9, 0.0, 9)):
        rows = [(k, rng.randrange(span), rng.randrange(span), rng.random() < share) for k in range(n)]
        assert matched(spark, [(k, float(x), float(y), own) for k, x, y, own in rows], float(reach)) == in_order(rows, reach)
    # Without a place or an id nothing is matched; a side that isn't known is the other one.
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0.0, True), (2, nan, 0.0, True), (3, inf, 0.0, True), (None, 0.0, 0.0, True), (4, 0.0, 0.0, True), (5, 0.0, None, False), (6, 0.0, nan, False), (None, 0.0, 0.0, False), (7, 0.0, 3.0, None)]
    assert matched(spark, rows, 9.0) == [(4, 7, 3.0)]


def test_greedy_matches_across_strips(spark):
    """Over the whole plane: by strips of 500 m, as test_greedy_match_against_the_plain_form has it, pairs within 200 m were left out with both points free."""
    rows = plans.shapes(spark, SF).where("kind = 0 AND town < 2").collect()
    got, at = plans.greedy_matches(spark, SF).collect(), {r.id: (r.x, r.y) for r in rows}
    want = in_order([(r.id, int(r.x * 2), int(r.y * 2), r.town == 0) for r in rows], 400)
    assert sorted((r.a, r.b, r.distance) for r in got) == [(a, b, d / 2) for a, b, d in want]
    assert all(r.k == at[r.a][0] // 500 for r in got) and any(r.k != at[r.b][0] // 500 for r in got)
    free = [r for r in rows if r.id not in {i for g in got for i in (g.a, g.b)}]
    assert free and not [1 for p in free for q in free if p.town < q.town and math.dist(at[p.id], at[q.id]) <= 200]


def test_greedy_match_without_groups(spark):
    points = spark.createDataFrame([(1, 499.0, 0.0, True, "p"), (2, 501.0, 0.0, False, "q"), (3, 900.0, 0.0, True, "r"), (4, 990.0, 0.0, False, None)], "id long, x double, y double, own boolean, name string")
    one = lambda p, reach: sorted(tuple(r) for r in measure.greedy_match(p, [], F.col("own"), reach, ["name"]).collect())
    assert one(points, 90.0) == [("p", 1, 2, 2.0), ("r", 3, 4, 90.0)]
    assert one(points, 1.0) == [] == one(points.where("id > 9"), 90.0) == one(points.where("own"), 90.0)


def test_clips_to_polygons():
    ell = [(0, 0), (30, 0), (30, 10), (10, 10), (10, 30), (0, 30), (0, 0)]
    assert measure.clip_line_to_ring([(-5, 20), (40, 20)], ell) == [[(0, 20), (10, 20)]]
    assert measure.clip_line_to_ring([(5, 25), (25, 5)], ell) == [[(5, 25), (10, 20)], [(20, 10), (25, 5)]]
    assert measure.clip_line_to_ring([(40, 40), (50, 50)], ell) == []
    area = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))) / 2
    box = [(5, 5), (20, 5), (20, 20), (5, 20), (5, 5)]
    assert area(measure.clip_to_convex(ell, box)) == pytest.approx(15 * 5 + 5 * 10) == area(measure.clip_to_convex(ell, box[::-1]))
    assert measure.clip_to_convex(ell, [(40, 40), (50, 40), (50, 50), (40, 40)]) == []


def test_hausdorff_against_dense_points():
    rng = random.Random(5)
    for _ in range(20):
        a, b = ([(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(rng.randint(2, 5))] for _ in range(2))
        dense = [(x0 + (x1 - x0) * t / 2000, y0 + (y1 - y0) * t / 2000) for (x0, y0), (x1, y1) in zip(b, b[1:]) for t in range(2001)]
        there = max(min(math.dist(p, q) for q in dense) for p in a)
        dense = [(x0 + (x1 - x0) * t / 2000, y0 + (y1 - y0) * t / 2000) for (x0, y0), (x1, y1) in zip(a, a[1:]) for t in range(2001)]
        back = max(min(math.dist(p, q) for q in dense) for p in b)
        assert measure.hausdorff(a, b) == pytest.approx(max(there, back), abs=1e-2)
    assert measure.hausdorff([(0, 0)], [(3, 4)]) == 5


def test_validity():
    square = [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]
    assert measure.valid_ring(square) and measure.valid_ring(square[::-1])
    for bad in ([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)], square[:-1], [(0, 0), (1, 0), (2, 0), (0, 0)], [(0, 0), (2, 0), (1, 0), (1, 1), (0, 0)], [(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)]):
        assert not measure.valid_ring(bad)


def test_points_and_regions(spark):
    ring = F.array(*[spatial.point(F.lit(x), F.lit(y)) for x, y in [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)]])
    rows = [(1, 2.0, 0.5), (2, 2.0, 1.0), (3, 2.0, 2.0), (4, 0.0, 1.0), (5, 0.5, 3.0), (6, 4.0, 4.0), (7, 9.0, 0.0)]
    got = spark.createDataFrame(rows, "id int, x double, y double").select("id", spatial.inside(F.col("x"), F.col("y"), ring).alias("i")).collect()
    assert {r.id for r in got if r.i} == {1, 5}


def test_proximity_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(g, k, rng.uniform(-20, 20), rng.uniform(-20, 20)) for g in range(2) for k in range(60)]
    want = {(g, a, b) for g, a, ax, ay in rows for h, b, bx, by in rows if g == h and a < b and math.hypot(ax - bx, ay - by) <= 3}
    got = spatial.near_pairs(spark.createDataFrame(rows, "g int, k int, x double, y double"), ["g"], "k", 3.0)
    assert {tuple(r) for r in got.collect()} == want and want


def test_lines(spark):
    one = spark.range(1).select(F.array(*[spatial.point(F.lit(x), F.lit(y)) for x, y in [(0, 0), (5, 0), (9, 0), (9, 3), (9, 2)]]).alias("p"))
    kept, turns, gap, none = one.select(measure.without_collinear(F.col("p")), measure.turns(F.col("p")), measure.closure_gap(F.col("p")), measure.closure_gap(F.slice("p", 1, 3))).first()
    assert [(q.x, q.y) for q in kept] == [(0, 0), (9, 0), (9, 3), (9, 2)]
    assert turns == pytest.approx([0, 90, 180]) and gap == pytest.approx(math.hypot(9, 2) / math.hypot(9, 3)) and none is None
    empty = spark.createDataFrame([([],)], "p array<struct<x:double,y:double>>")
    assert empty.select(measure.densify(F.col("p"), 1.0)).first()[0] == [] and empty.select(measure.turns(F.col("p"))).first()[0] == []


def test_cells_of_tokens(spark):
    cells = measures.cell_tokens(spark, SF).collect()
    each = {}
    for r in measures.roads(spark, SF).collect():
        each.setdefault((r.city, r.tile_i, r.tile_j, r.cell_i, r.cell_j), []).append((r.feature_id, r.t))
    assert {tuple(r)[:5] for r in cells} >= set(each) and len(cells) % 64 == 0
    for r in cells:
        assert r.tokens == [t for _, ts in sorted(each.get(tuple(r)[:5], [])) for t in ts]
        assert r.feature_count == len(each.get(tuple(r)[:5], []))


def test_blocks_decode_to_their_points(spark):
    pts = [(10.0, 20.0), (10.0, 20.2), (60.0, 20.0), (60.0, 120.0)]
    one = spark.range(1).select(F.array(*[spatial.point(F.lit(x), F.lit(y)) for x, y in pts]).alias("p"))
    for a, z in ((None, None), (1500, None), (None, 1506), (1501, 1502)):
        t = one.select("p", tokens.encode_part(F.lit(3), F.col("p"), F.lit(a).cast("int"), F.lit(z).cast("int")).alias("t"))
        ids, d = t.select("t", tokens.decode_block(F.col("t"))).first()
        # The second point is nearer than a step and goes; moves are cut at 32 m.
        assert ids[:2] == [509, 3] and ids[-1] == 510 and (a in ids if a else 2 + 4 + 1 <= len(ids))
        got = [(p.x, p.y) for p in d]
        assert got[0] == (10, 20) and (got[-1] == got[-2]) == bool(z)
        last = (60, 20) if z else (60, 120)
        assert math.dist(got[-1], last) < 2
    assert one.select(tokens.decode_block(F.array(F.lit(1)))).first()[0] is None
