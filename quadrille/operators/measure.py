"""Measures of shapes and of how shapes differ: angles, gaps, distances, clips to polygons, water, conservation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import let, neighbours
from quadrille.operators import geometry

PARTS = "array<array<struct<x:double,y:double>>>"


def _points(part: list[dict]) -> list[tuple[float, float]]:
    return [(q["x"], q["y"]) for q in part]


def ring_edges(ring: Sequence[tuple[float, float]]) -> np.ndarray:
    p = np.asarray(ring, float)
    return np.hstack([p[:-1], p[1:]])


def inside_ring(x: float, y: float, edges: np.ndarray) -> bool:
    """In the interior or on the ring."""
    ax, ay, bx, by = edges.T
    cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    on = (np.abs(cross) <= 1e-9) & (np.minimum(ax, bx) <= x) & (x <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= y) & (y <= np.maximum(ay, by))
    if on.any():
        return True
    straddles = (ay > y) != (by > y)
    at = ax[straddles] + (y - ay[straddles]) * (bx[straddles] - ax[straddles]) / (by[straddles] - ay[straddles])
    return bool((at > x).sum() % 2)


def clip_line_to_ring(points: list[tuple[float, float]], ring: Sequence[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """The stretches of a line in a polygon, its sides included: cut where it meets sides, kept where the middle is inside."""
    edges, out = ring_edges(ring), []
    for (ax, ay), (bx, by) in zip(points, points[1:]):
        dx, dy, cuts = bx - ax, by - ay, [0.0, 1.0]
        for ex, ey, fx, fy in edges:
            det = dx * (fy - ey) - dy * (fx - ex)
            if det:
                cuts.append(((ex - ax) * (fy - ey) - (ey - ay) * (fx - ex)) / det)
            elif dx or dy:  # along a side: its ends are places to cut
                cuts += [((qx - ax) * dx + (qy - ay) * dy) / (dx * dx + dy * dy) for qx, qy in ((ex, ey), (fx, fy))]
        cuts = sorted({t for t in cuts if 0 <= t <= 1})
        for s, t in zip(cuts, cuts[1:]):
            if t - s > 1e-12 and inside_ring(ax + (s + t) / 2 * dx, ay + (s + t) / 2 * dy, edges):
                a, b = (ax + s * dx, ay + s * dy), (ax + t * dx, ay + t * dy)
                if out and out[-1][-1] == a:
                    out[-1].append(b)
                else:
                    out.append([a, b])
    return out


def clip_to_convex(ring: list[tuple[float, float]], window: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """A ring, of any shape, cut to a convex ring; closed, or empty. What falls apart stays one ring that runs along the window."""
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(window, window[1:]))
    sides = list(zip(window, window[1:])) if area > 0 else [(b, a) for a, b in zip(window, window[1:])]
    points = list(ring[:-1]) if ring and ring[0] == ring[-1] else list(ring)
    for (ex, ey), (fx, fy) in sides:
        side = lambda p: (fx - ex) * (p[1] - ey) - (fy - ey) * (p[0] - ex)  # noqa: B023, E731
        new = []
        for a, b in zip([points[-1], *points[:-1]] if points else [], points):
            sa, sb = side(a), side(b)
            if (sa < 0) != (sb < 0):
                t = sa / (sa - sb)
                new.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
            if sb >= 0:
                new.append(b)
        points = new
    return [*points, points[0]] if points else []


def clip_to_polygon(kind: Column | str, parts: Column | str, ring: Column) -> Column:
    """Points, lines and convex polygons cut to a polygon (closed ring) of any shape. Polygons are cut the other way round: the polygon to
    each of them, so that it may be concave; holes are cut alike and stay holes."""

    def run(kinds: pa.Array, each: pa.Array, rings: pa.Array) -> pa.Array:
        out = []
        for k, geometry_, window in zip(kinds.to_pylist(), each.to_pylist(), rings.to_pylist()):
            if geometry_ is None or window is None:
                out.append(None)
                continue
            window, lists = _points(window), [_points(p) for p in geometry_]
            if k in (0, 3):
                edges = ring_edges(window)
                found = [[p] for part in lists for p in part if inside_ring(*p, edges)]
            elif k in (1, 4):
                found = [piece for part in lists for piece in clip_line_to_ring(part, window)]
            else:
                found = geometry.joined([[r for part in rings_ if (r := clip_to_convex(window, part))] for rings_ in geometry.polygons(lists)])
            out.append([[{"x": x, "y": y} for x, y in part] for part in found])
        return pa.array(out, each.type)

    return F.arrow_udf(run, PARTS)(kind, parts, ring)


def hausdorff(a: Sequence[tuple[float, float]], b: Sequence[tuple[float, float]]) -> float:
    """The greatest distance from a vertex of either line to the other line."""

    def one(p, q) -> float:
        p, q = np.asarray(p, float), np.asarray(q, float)
        s, t = (q[:-1], q[1:]) if len(q) > 1 else (q, q)
        d = t - s
        with np.errstate(divide="ignore", invalid="ignore"):
            u = ((p[:, None] - s) * d).sum(-1) / (d * d).sum(-1)
        u = np.clip(np.nan_to_num(u), 0, 1)
        return float(np.sqrt((((s + u[..., None] * d) - p[:, None]) ** 2).sum(-1)).min(1).max())

    return max(one(a, b), one(b, a))


def hausdorff_distance(a: Column | str, b: Column | str) -> Column:
    """Between two arrays of points; null if either is null or empty."""

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([hausdorff(_points(x), _points(y)) if x and y else None for x, y in zip(left.to_pylist(), right.to_pylist())], pa.float64())

    return F.arrow_udf(run, "double")(a, b)


def valid_ring(ring: Sequence[tuple[float, float]]) -> bool:
    """Closed, at least four points, with area, and no two sides that meet but for neighbours at their ends."""
    if len(ring) < 4 or ring[0] != ring[-1]:
        return False
    p = ring[:-1]
    if len(set(p)) != len(p) or not sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])):
        return False
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    on = lambda a, b, c: min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])
    n = len(p)
    for i in range(n):
        a, b = p[i], p[(i + 1) % n]
        for j in range(i + 1, n):
            c, d = p[j], p[(j + 1) % n]
            if j == i + 1 or (i == 0 and j == n - 1):
                shared, far_a, far_d = (b, a, d) if j == i + 1 else (a, b, c)
                if not turn(far_a, shared, far_d) and (far_a[0] - shared[0]) * (far_d[0] - shared[0]) + (far_a[1] - shared[1]) * (far_d[1] - shared[1]) > 0:
                    return False
                continue
            t1, t2, t3, t4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
            if t1 * t2 < 0 and t3 * t4 < 0:
                return False
            if (not t1 and on(a, b, c)) or (not t2 and on(a, b, d)) or (not t3 and on(c, d, a)) or (not t4 and on(c, d, b)):
                return False
    return True


def is_valid(kind: Column | str, parts: Column | str) -> Column:
    """Points and lines of two different points are valid; polygons if each ring is."""

    def run(kinds: pa.Array, each: pa.Array) -> pa.Array:
        out = []
        for k, g in zip(kinds.to_pylist(), each.to_pylist()):
            lists = None if g is None else [_points(p) for p in g if p]
            out.append(None if lists is None else bool(lists) and all(len(p) > 0 if k in (0, 3) else len(set(p)) > 1 if k in (1, 4) else valid_ring(p) for p in lists))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")(kind, parts)


def centroid(ring: Column) -> Column:
    """(x, y) of a closed ring's area; the mean of its points if it has none."""

    def of(e: Column) -> Column:
        cross = lambda p: p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]
        total = lambda f: F.aggregate(e, F.lit(0.0), lambda s, p: s + f(p))
        area, n = total(cross), F.size(e)
        part = lambda c: F.coalesce(F.try_divide(total(lambda p: (p["a"][c] + p["b"][c]) * cross(p)), 3 * area), total(lambda p: p["a"][c]) / n)
        return F.struct(part("x").alias("x"), part("y").alias("y"))

    return let(neighbours(ring), of)


def corner_angles(ring: Column) -> Column:
    """Degrees between the two sides at each vertex of a closed ring, from the second vertex around to the first."""

    def around(e: Column) -> Column:
        nexts = F.concat(F.slice(e, F.lit(2), F.greatest(F.lit(0), F.size(e) - 1)), F.slice(e, 1, 1))

        def angle(a: Column, b: Column) -> Column:
            ux, uy, vx, vy = a["a"]["x"] - a["b"]["x"], a["a"]["y"] - a["b"]["y"], b["b"]["x"] - b["a"]["x"], b["b"]["y"] - b["a"]["y"]
            cosine = F.try_divide(ux * vx + uy * vy, F.hypot(ux, uy) * F.hypot(vx, vy))
            return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))

        return F.zip_with(e, nexts, angle)

    return let(neighbours(ring), around)


def turns(points: Column) -> Column:
    """Signed degrees of the turn at each inner vertex, to the left positive."""

    def each(e: Column) -> Column:
        n = F.greatest(F.lit(0), F.size(e) - 1)

        def turn(a: Column, b: Column) -> Column:
            ux, uy, vx, vy = a["b"]["x"] - a["a"]["x"], a["b"]["y"] - a["a"]["y"], b["b"]["x"] - b["a"]["x"], b["b"]["y"] - b["a"]["y"]
            return F.degrees(F.atan2(ux * vy - uy * vx, ux * vx + uy * vy))

        return F.zip_with(F.slice(e, F.lit(1), n), F.slice(e, F.lit(2), n), turn)

    return let(neighbours(points), each)


def without_collinear(points: Column) -> Column:
    """Vertices at which the line goes on along the same axis in the same direction are left out; neighbours are those of the line as it was."""

    def keep(e: Column) -> Column:
        def straight(k: Column) -> Column:
            a, b = F.get(e, k - 1), F.get(e, k)
            step = lambda s, c: F.signum(s["b"][c] - s["a"][c])
            along_x = (step(a, "y") == 0) & (step(b, "y") == 0) & (step(a, "x") == step(b, "x")) & (step(a, "x") != 0)
            along_y = (step(a, "x") == 0) & (step(b, "x") == 0) & (step(a, "y") == step(b, "y")) & (step(a, "y") != 0)
            return along_x | along_y

        return F.filter(points, lambda p, i: F.when((i == 0) | (i == F.size(points) - 1), True).otherwise(~straight(i)))

    return let(neighbours(points), keep)


def densify(points: Column, longest: float) -> Column:
    """The same line with further points, evenly spaced, so that no side is longer than longest."""

    def cut(e: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil(F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]) / longest).cast("int"))
        at = lambda k, c: e["a"][c] + (e["b"][c] - e["a"][c]) * k / n
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(at(k, "x").alias("x"), at(k, "y").alias("y")))

    last = F.when(F.size(points) > 0, F.slice(points, F.greatest(F.lit(1), F.size(points)), F.lit(1))).otherwise(points)
    return F.concat(F.flatten(F.transform(neighbours(points), cut)), last)


def closure_gap(points: Column) -> Column:
    """How far the ends are apart, as a share of the diagonal of the bounds (0 if there is none); null below four points."""
    b = geometry.bounds(F.array(points))
    a, z = F.element_at(points, 1), F.element_at(points, -1)
    diagonal = F.hypot(b["max_x"] - b["min_x"], b["max_y"] - b["min_y"])
    return F.when(F.size(points) >= 4, F.coalesce(F.try_divide(F.hypot(a["x"] - z["x"], a["y"] - z["y"]), diagonal), F.lit(0.0)))


def bearing_error(decoded: Column, source: Column, least: float = 2.0) -> Column:
    """The greatest difference in degrees of the bearings of aligned sides, of those that are at least so long as decoded; null if the
    lines have different numbers of points, or fewer than two."""
    bearing = lambda e: F.degrees(F.atan2(e["b"]["y"] - e["a"]["y"], e["b"]["x"] - e["a"]["x"]))

    def one(a: Column, b: Column) -> Column:
        d = F.pmod(F.abs(bearing(a) - bearing(b)), F.lit(360.0))
        return F.when(F.hypot(a["b"]["x"] - a["a"]["x"], a["b"]["y"] - a["a"]["y"]) >= least, F.least(d, 360.0 - d)).otherwise(0.0)

    return F.when((F.size(decoded) == F.size(source)) & (F.size(decoded) >= 2), F.array_max(F.zip_with(neighbours(decoded), neighbours(source), one)))


def share_inside(kind: Column, low: Column, high: Column, height: Column, border: Column) -> Column:
    """The share of a shape that lies below a border along its extent: points by touch, lines by length, boxes by area."""
    return F.when(kind == 0, F.when(low <= border, 1.0).otherwise(0.0)).otherwise(F.coalesce(F.try_divide(F.greatest(F.lit(0.0), F.least(high, border) - low), high - low), F.lit(0.0)))


def water(cells: DataFrame, pieces: DataFrame, features: DataFrame, key: list[str], tolerance: float = 1e-9) -> DataFrame:
    """key, sea, water, dropped for each of cells(key, area): pieces(key, a, w) are parts of the sea and of inland water in a cell, as areas.
    A cell without area is dropped, and one that is all sea and has no row in features."""
    wet = pieces.groupBy(*key).agg(F.sum(F.when(F.col("w") == "sea", F.col("a"))).alias("__s"), F.sum(F.when(F.col("w") != "sea", F.col("a"))).alias("__i"))
    counts = features.groupBy(*key).agg(F.count("*").alias("__n"))
    found = cells.join(wet, key, "left").join(counts, key, "left")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("area")), F.lit(0.0))
    sea = share("__s")
    dropped = (F.col("area") <= 0) | ((sea >= 1 - tolerance) & (F.coalesce("__n", F.lit(0)) == 0))
    return found.select(*key, F.round(sea, 9).alias("sea"), F.round(F.least(F.lit(1.0), sea + share("__i")), 9).alias("water"), dropped.alias("dropped"))


def lossy(source: DataFrame, parts: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    """key, source, parts: what the parts don't add up to within the tolerance."""
    both = source.join(parts, key, "left").withColumn("parts", F.coalesce("parts", F.lit(0.0)))
    return both.where(F.abs(F.col("source") - F.col("parts")) > tolerance).select(*key, F.round("source", 6).alias("source"), F.round("parts", 6).alias("parts"))


class FreePoints:
    """Points (one at least) of which the nearest is taken, one after the other. Points of one place are a queue. Places are dealt out to the leaves of
    a k-d tree, each node halved along the wider side of its box; nodes without free points are passed by. Node i has the children 2i and 2i + 1."""

    LEAF = 8

    def __init__(self, x: np.ndarray, y: np.ndarray, rank: np.ndarray) -> None:
        """rank, ascending, decides between points at the same distance."""
        self.left = len(x)
        order = np.lexsort((y, x))  # stable, so that the points of a place stay in order
        x, y, rank = x[order], y[order], rank[order]
        first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        ends, x, y = np.r_[first[1:], len(rank)], x[first], y[first]
        n, at, boxes, live = len(first), np.arange(len(first)), [np.zeros((1, 4))], [np.zeros(1, int)]
        self.leaves = 2 ** max(0, math.ceil(math.log2(n / self.LEAF)))
        for d in range(self.leaves.bit_length()):
            bounds = n * np.arange(2**d + 1) // 2**d
            box = np.column_stack([f.reduceat(c[at], bounds[:-1]) for f in (np.minimum, np.maximum) for c in (x, y)])
            boxes.append(box)
            live.append(np.diff(bounds))
            if 2**d < self.leaves:
                node = np.repeat(np.arange(2**d), np.diff(bounds))
                wide = box[:, 2] - box[:, 0] >= box[:, 3] - box[:, 1]
                at = at[np.lexsort((np.where(wide[node], x[at], y[at]), node))]
        self.boxes, self.live, self.bounds = [tuple(b) for b in np.concatenate(boxes).tolist()], np.concatenate(live).tolist(), bounds.tolist()
        self.x, self.y = x[at].tolist(), y[at].tolist()
        self.rank, self.next, self.end = rank.tolist(), first[at].tolist(), ends[at].tolist()

    def nearest(self, x: float, y: float, reach: float) -> tuple[float, int, int, int] | None:
        """(distance, rank, place, leaf) of the nearest free point that is within reach."""
        found, best, rank, leaves, boxes, live = None, reach, math.inf, self.leaves, self.boxes, self.live
        limit = best * best * (1 + 1e-9)  # wider than rounding, so that no point at the same distance is passed by
        todo = [(0.0, 1)] if live[1] else []
        while todo:
            far, i = todo.pop()
            if far > limit:
                continue
            if i >= leaves:
                for k in range(self.bounds[i - leaves], self.bounds[i - leaves + 1]):
                    if self.next[k] < self.end[k]:
                        d = math.hypot(x - self.x[k], y - self.y[k])
                        if d < best or d == best and self.rank[self.next[k]] < rank:
                            best, rank = d, self.rank[self.next[k]]
                            found, limit = (d, rank, k, i), best * best * (1 + 1e-9)
                continue
            pair = []
            for c in (2 * i, 2 * i + 1):
                if live[c]:
                    x0, y0, x1, y1 = boxes[c]
                    dx = x0 - x if x < x0 else x - x1 if x > x1 else 0.0
                    dy = y0 - y if y < y0 else y - y1 if y > y1 else 0.0
                    if (far := dx * dx + dy * dy) <= limit:
                        pair.append((far, c))
            if len(pair) == 2 and pair[0] < pair[1]:
                pair.reverse()
            todo += pair  # the nearer one is next
        return found

    def take(self, place: int, leaf: int) -> None:
        """Its first point isn't free any more."""
        self.left -= 1
        self.next[place] += 1
        if self.next[place] == self.end[place]:
            while leaf:
                self.live[leaf] -= 1
                leaf >>= 1

    def free(self) -> list[int]:
        """Ranks of the points that are left, ascending."""
        return sorted(r for k, z in zip(self.next, self.end) for r in self.rank[k:z])


def greedy_match(points: DataFrame, by: list[str], left: Column, reach: float, keep: Sequence[str] = ()) -> DataFrame:
    """by, keep, a, b, distance: points(by, keep, id, x, y) of the left side in order of id, each with the nearest of the others that isn't taken yet
    and is within reach; ties by id. keep are columns of a. Points without an id or a finite place match nothing. Points of two groups are never a pair:
    by is for classes, and no by is one group; cells of a grid would leave out the pairs across their sides. What a point finds depends on all that went
    before, so a group is one task's; it takes about n log n steps."""

    def run(group: pa.Table) -> pa.Table:
        ids, x, y, own = (group[c].to_numpy(zero_copy_only=False) for c in ("id", "x", "y", "__left"))
        order = np.lexsort((own, y, x, ids))
        order = order[np.isfinite(x[order]) & np.isfinite(y[order])]
        ids, x, y, own = ids[order], x[order], y[order], own[order]
        at = np.flatnonzero(~own)
        points = FreePoints(x[at], y[at], at) if len(at) else None
        built, out = len(at), []
        for k in np.flatnonzero(own).tolist() if len(at) else []:
            if not points.left:
                break
            if (found := points.nearest(float(x[k]), float(y[k]), reach)) is None:
                continue
            d, b, place, leaf = found
            points.take(place, leaf)
            out.append((k, b, d))
            if 64 < points.left < built / 2:  # boxes close around what is left
                at = np.array(points.free())
                points, built = FreePoints(x[at], y[at], at), len(at)
        a, b = (np.array([o[i] for o in out], np.int64) for i in (0, 1))
        columns = {c: group[c].take(pa.array(order[a])) for c in (*by, *keep)}
        return pa.table(columns | {"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64()), "distance": pa.array([o[2] for o in out], pa.float64())})

    kinds = "".join(f"{c} {points.schema[c].dataType.simpleString()}, " for c in (*by, *keep))
    each = points.select(*by, *keep, F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.coalesce(left, F.lit(False)).alias("__left"))
    return each.where("id IS NOT NULL").groupBy(*by).applyInArrow(run, f"{kinds}a long, b long, distance double")
