"""Joins and overlays of shapes: tiles and cells from bounds, polygons around points, pieces, crossings, overlaps.

Shapes meet tiles, cells and each other by numbers of grid squares, which are exploded from their bounds, so that every join
is on equal keys; what the squares can't tell is refined after. Sides are as the operators say: tiles are closed, cells half-open."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import let, neighbours
from quadrille.operators import geometry
from quadrille.operators.grid import CELL_M, SIDE, TILE_M

EPS = 1e-6


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """The closed ring around a box, counter-clockwise."""
    return F.array(point(min_x, min_y), point(max_x, min_y), point(max_x, max_y), point(min_x, max_y), point(min_x, min_y))


def touched(low: Column, high: Column, size: float) -> Column:
    """Numbers of the squares whose closed extent meets [low, high]."""
    return F.sequence(F.ceil(low / size).cast("int") - 1, F.floor(high / size).cast("int"))


def to_tiles(shapes: DataFrame, bounds: Sequence[str] = ("min_x", "min_y", "max_x", "max_y")) -> DataFrame:
    """shapes with tile_i, tile_j: a row for each tile that the bounds touch, sides included, so what lies on the side of two is
    in both."""
    x0, y0, x1, y1 = map(F.col, bounds)
    return shapes.withColumn("tile_i", F.explode(touched(x0, x1, TILE_M))).withColumn("tile_j", F.explode(touched(y0, y1, TILE_M)))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is in the interior of a closed ring, by the edges to its right; not on the ring itself."""

    def judge(edges: Column) -> Column:
        straddles = lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y)
        # Guarded, since both sides of the comparison are worked out for edges along x as well.
        at = lambda e: e["a"]["x"] + (y - e["a"]["y"]) * F.try_divide(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])
        right = F.size(F.filter(edges, lambda e: F.coalesce(straddles(e) & (at(e) > x), F.lit(False))))
        cross = lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])
        on = F.exists(edges, lambda e: (F.abs(cross(e)) <= EPS) & x.between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"])) & y.between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"])))
        return (right % 2 == 1) & ~on

    return let(neighbours(ring), judge)


def region_of(points: DataFrame, regions: DataFrame) -> DataFrame:
    """points (with x, y) and region: the first by name of the regions(name, ring) whose interior a point is in, else null. Regions are
    those of one country, a few hundred rows, and are checked for it."""
    if (n := regions.count()) > 10_000:
        raise ValueError(f"{n} regions; deal them out by tiles first")
    rings = regions.groupBy().agg(F.array_sort(F.collect_list(F.struct("name", "ring"))).alias("__regions"))
    around = lambda r: F.when(inside(F.col("x"), F.col("y"), r["ring"]), r["name"])
    found = points.crossJoin(F.broadcast(rings)).withColumn("region", F.get(F.filter(F.transform("__regions", around), lambda n: n.isNotNull()), F.lit(0)))
    return found.drop("__regions")


def overlap(low: Column, high: Column, low2: Column, high2: Column) -> Column:
    """How long two intervals overlap."""
    return F.greatest(F.lit(0.0), F.least(high, high2) - F.greatest(low, low2))


def cell_pieces(shapes: DataFrame) -> DataFrame:
    """shapes(type, parts: in metres from the tile's corner) with cell_i, cell_j and the parts inside that cell, a row for each cell
    that has any.

    Cells are half-open: a piece that lies on a cell's upper side is the next cell's; one that has shrunk to a point counts only if the
    shape is a point."""
    b = geometry.bounds(F.col("parts"))
    within = lambda low, high: F.sequence(F.greatest(F.lit(0), F.floor(low / CELL_M).cast("int")), F.greatest(F.lit(0), F.least(F.lit(SIDE - 1), F.floor(high / CELL_M).cast("int"))))
    inside_tile = (F.col("__b.max_x") >= 0) & (F.col("__b.max_y") >= 0) & (F.col("__b.min_x") < SIDE * CELL_M) & (F.col("__b.min_y") < SIDE * CELL_M)
    each = shapes.withColumn("__b", b).where(inside_tile)
    each = each.withColumn("cell_i", F.explode(within(F.col("__b.min_x"), F.col("__b.max_x")))).withColumn("cell_j", F.explode(within(F.col("__b.min_y"), F.col("__b.max_y"))))
    x0, y0 = F.col("cell_i") * CELL_M, F.col("cell_j") * CELL_M
    cut = each.withColumn("parts", geometry.clip("type", "parts", x0, y0, x0 + CELL_M, y0 + CELL_M)).where("size(parts) > 0")
    cut = cut.withColumn("__b", geometry.bounds(F.col("parts")))
    wide, high = F.col("__b.max_x") - F.col("__b.min_x"), F.col("__b.max_y") - F.col("__b.min_y")
    collapsed = (wide <= EPS) & (high <= EPS) & ~F.col("type").isin(0, 3)
    upper = ((wide <= EPS) & (F.abs(F.col("__b.min_x") - x0 - CELL_M) <= EPS)) | ((high <= EPS) & (F.abs(F.col("__b.min_y") - y0 - CELL_M) <= EPS))
    return cut.where(~collapsed & ~upper).drop("__b")


def line_crossings(lines: DataFrame, key: Sequence[str], points: str) -> DataFrame:
    """key, axis, line, position, ordinal: where a line passes the grid lines between cells, in the order along the line. axis 0 are lines of
    constant x. Running along a grid line or ending on it isn't passing it."""
    segments = lines.select(*key, F.size(points).alias("__n"), F.posexplode(neighbours(F.col(points))).alias("__k", "__s"))
    out = None
    for axis, (along, across) in enumerate((("x", "y"), ("y", "x"))):
        a, b, c, d = F.col(f"__s.a.{along}"), F.col(f"__s.b.{along}"), F.col(f"__s.a.{across}"), F.col(f"__s.b.{across}")
        lines_between = F.sequence(F.ceil(F.least(a, b) / CELL_M).cast("int"), F.floor(F.greatest(a, b) / CELL_M).cast("int"))
        some = segments.where((a != b) & (F.ceil(F.least(a, b) / CELL_M) <= F.floor(F.greatest(a, b) / CELL_M)))
        each = some.withColumn("line", F.explode(lines_between)).withColumn("__t", (F.col("line") * CELL_M - a) / (b - a))
        passes = ((F.col("__t") > 0) & (F.col("__t") < 1)) | ((F.col("__t") == 1) & (F.col("__k") < F.col("__n") - 2))
        found = each.where(passes).select(*key, F.lit(axis).alias("axis"), "line", (c + F.col("__t") * (d - c)).alias("position"), (F.col("__k") + F.col("__t")).alias("__at"))
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy(*key).orderBy("__at", "axis", "line")
    return out.withColumn("ordinal", F.row_number().over(order).cast("long")).drop("__at")


def interval_cells(low: Column, high: Column) -> Column:
    """A stretch along a grid line, cut at every cell: (cell, from, to) for each part that isn't empty; the middle decides whose it is."""
    first, last = F.floor(low / CELL_M).cast("int"), F.floor(high / CELL_M).cast("int")
    cut = F.transform(F.sequence(first, last), lambda k: F.struct(k.alias("cell"), F.greatest(low, k * CELL_M).alias("from"), F.least(high, (k + 1) * CELL_M).alias("to")))
    return F.filter(cut, lambda c: c["to"] > c["from"])


def edge_cells(axis: Column, line: Column, position: Column) -> Column:
    """(lower_i, lower_j) of the edge that a crossing is on."""
    along = F.floor(position / CELL_M).cast("int")
    return F.struct(F.when(axis == 0, line - 1).otherwise(along).alias("lower_i"), F.when(axis == 0, along).otherwise(line - 1).alias("lower_j"))


def corner_crossings(pieces: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, cell_i, cell_j, corner_i, corner_j, event: pairs of cells of a shape that meet only at a corner, both with 'enter'; each corner once.
    pieces(key, cell_i, cell_j, parts)."""
    there = pieces.select(*key, "cell_i", "cell_j", "parts")
    out = None
    for step in (1, -1):
        other = there.select(*key, (F.col("cell_i") - 1).alias("cell_i"), (F.col("cell_j") - step).alias("cell_j"), F.col("parts").alias("__other"))
        pairs = there.join(other, [*key, "cell_i", "cell_j"])
        corner_i, corner_j = F.col("cell_i") + 1, F.col("cell_j") + (1 if step == 1 else 0)
        near = lambda parts: F.exists(F.flatten(parts), lambda p: F.hypot(p["x"] - corner_i * CELL_M, p["y"] - corner_j * CELL_M) <= EPS)
        pairs = pairs.where(near(F.col("parts")) & near(F.col("__other"))).select(*key, "cell_i", "cell_j", corner_i.alias("corner_i"), corner_j.alias("corner_j"), F.lit(step).alias("__step"))
        for di, dj in ((1, 0), (0, step)):
            beside = there.select(*key, (F.col("cell_i") - di).alias("cell_i"), (F.col("cell_j") - dj).alias("cell_j"))
            pairs = pairs.join(beside, [*key, "cell_i", "cell_j"], "left_anti")
        out = pairs if out is None else out.unionByName(pairs)
    one = out.groupBy(*key, "corner_i", "corner_j").agg(F.min(F.struct("cell_i", "cell_j", "__step")).alias("c"))
    both = F.explode(F.array(F.struct("c.cell_i", "c.cell_j"), F.struct((F.col("c.cell_i") + 1).alias("cell_i"), (F.col("c.cell_j") + F.col("c.__step")).alias("cell_j")))).alias("e")
    return one.select(*key, "corner_i", "corner_j", both).select(*key, "e.cell_i", "e.cell_j", "corner_i", "corner_j", F.lit("enter").alias("event"))


def near_pairs(points: DataFrame, by: Sequence[str], key: str, reach: float) -> DataFrame:
    """by, a, b (a < b): points(by, key, x, y) of different keys within reach of each other.

    Each point is in one square of that size and looks into the nine around it, so squares join on equal numbers."""
    square = points.withColumn("__i", F.floor(F.col("x") / reach)).withColumn("__j", F.floor(F.col("y") / reach))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("__d")
    seen = square.select(*by, F.col(key).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "__i", "__j", around).withColumn("__i", F.col("__i") + F.col("__d.i")).withColumn("__j", F.col("__j") + F.col("__d.j")).drop("__d")
    other = square.select(*by, F.col(key).alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "__i", "__j")
    near = seen.join(other, [*by, "__i", "__j"]).where((F.col("a") < F.col("b")) & (F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) <= reach))
    return near.select(*by, "a", "b").distinct()


def surviving(crossings: DataFrame, pieces: DataFrame, key: Sequence[str]) -> DataFrame:
    """Crossings of shapes that have pieces in two kept cells at least."""
    enough = pieces.select(*key, "cell_i", "cell_j").distinct().groupBy(*key).agg(F.count("*").alias("__n")).where("__n >= 2").select(*key)
    return crossings.join(enough, list(key), "left_semi")


def latest(rows: DataFrame, key: Sequence[str], ordinal: str) -> DataFrame:
    """The last row of each key: of rows of one key the later one counts."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("__r")).select(*key, "__r.*")
