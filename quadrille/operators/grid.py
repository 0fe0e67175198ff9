"""The metric grid: tiles of 2,000 m, each of 8 x 8 cells of 250 m, and the edges between cells.

Everything is half-open: a point on an upper boundary belongs to the next cell or tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TILE_M, CELL_M, SIDE = 2000.0, 250.0, 8
TILE = ["city", "tile_i", "tile_j"]


def tile_of(x: Column) -> Column:
    return F.floor(x / TILE_M).cast("int")


def cell_of(x: Column) -> Column:
    """Within its tile."""
    return F.floor((x - F.floor(x / TILE_M) * TILE_M) / CELL_M).cast("int")


def cells(spark: SparkSession) -> DataFrame:
    """slot, cell_i, cell_j: 64 rows."""
    return spark.range(SIDE * SIDE).select(F.col("id").cast("int").alias("slot"), F.floor(F.col("id") / SIDE).cast("int").alias("cell_i"), (F.col("id") % SIDE).cast("int").alias("cell_j"))


def edges(spark: SparkSession) -> DataFrame:
    """edge, external, lower_i, lower_j, axis: 112 edges inside, then 32 at the rim. The lower cell is the
    one before the edge along the axis (0: i, 1: j); at the low rim it is -1."""
    inner = [(i, j, 0) for i in range(SIDE - 1) for j in range(SIDE)] + [(i, j, 1) for i in range(SIDE) for j in range(SIDE - 1)]
    rim = [(-1, j, 0) for j in range(SIDE)] + [(SIDE - 1, j, 0) for j in range(SIDE)] + [(i, -1, 1) for i in range(SIDE)] + [(i, SIDE - 1, 1) for i in range(SIDE)]
    rows = [(k, k >= len(inner), *e) for k, e in enumerate(inner + rim)]
    return spark.createDataFrame(rows, "edge int, external boolean, lower_i int, lower_j int, axis int")


def sides(spark: SparkSession) -> DataFrame:
    """cell_i, cell_j, side, lower_i, lower_j, axis: the four edges of each cell, 256 rows. N is y = 0."""
    rows = []
    for i in range(SIDE):
        for j in range(SIDE):
            rows += [(i, j, "N", i, j - 1, 1), (i, j, "S", i, j, 1), (i, j, "W", i - 1, j, 0), (i, j, "E", i, j, 0)]
    return spark.createDataFrame(rows, "cell_i int, cell_j int, side string, lower_i int, lower_j int, axis int")


def dense_cells(features: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Every cell of every tile that has rows, with active and n. The 64 cells are broadcast."""
    counts = features.groupBy(*TILE, "cell_i", "cell_j").agg(F.count("*").alias("n"))
    tiles = (present or features).select(*TILE).distinct()
    every = tiles.crossJoin(F.broadcast(cells(features.sparkSession)))
    return every.join(counts, [*TILE, "cell_i", "cell_j"], "left").select(*TILE, "slot", "cell_i", "cell_j", F.col("n").isNotNull().alias("active"), F.coalesce("n", F.lit(0)).alias("n"))


def edge_scopes(dense: DataFrame) -> DataFrame:
    """Every edge of every tile with scope: 0 both cells active, 1 none, 2 one; at the rim 3 if its cell is
    active, else 1. A tile's 64 flags meet its edges as one row, so the edges need no join."""
    active = dense.groupBy(*TILE).agg(F.collect_set(F.when(F.col("active"), F.col("cell_i") * SIDE + F.col("cell_j"))).alias("on"))
    every = active.crossJoin(F.broadcast(edges(dense.sparkSession)))
    upper_i, upper_j = F.col("lower_i") + F.when(F.col("axis") == 0, 1).otherwise(0), F.col("lower_j") + F.when(F.col("axis") == 1, 1).otherwise(0)

    def on(i: Column, j: Column) -> Column:
        inside = i.between(0, SIDE - 1) & j.between(0, SIDE - 1)
        return F.when(inside & F.array_contains("on", i * SIDE + j), 1).otherwise(0)

    n = on(F.col("lower_i"), F.col("lower_j")) + on(upper_i, upper_j)
    scope = F.when(F.col("external"), F.when(n > 0, 3).otherwise(1)).otherwise(F.when(n == 2, 0).when(n == 0, 1).otherwise(2))
    return every.select(*TILE, "edge", "external", "lower_i", "lower_j", "axis", scope.alias("scope"))


def boundary_class(crossings: DataFrame, scopes: DataFrame, major: tuple[str, ...]) -> DataFrame:
    """scopes with class of the edges whose scope is 0: MAJOR over MINOR over NONE among the roads that cross
    them. crossings(TILE, lower_i, lower_j, axis, road_class) has road crossings only; a road of another
    or no class counts as MINOR. Other edges have null."""
    keys = [*TILE, "lower_i", "lower_j", "axis"]
    rank = F.min(F.when(F.col("road_class").isin(*major), 0).otherwise(1))
    votes = crossings.groupBy(*keys).agg(rank.alias("rank"))
    label = F.when(F.col("rank") == 0, "MAJOR").when(F.col("rank") == 1, "MINOR").otherwise("NONE")
    return scopes.join(votes, keys, "left").select(*scopes.columns, F.when(F.col("scope") == 0, label).alias("class"))


def side_contract(labelled: DataFrame, per_cell: DataFrame) -> DataFrame:
    """per_cell (TILE, cell_i, cell_j) with side and class of its four edges; no class reads as NONE."""
    four = per_cell.join(F.broadcast(sides(per_cell.sparkSession)), ["cell_i", "cell_j"])
    found = four.join(labelled.select(*TILE, "lower_i", "lower_j", "axis", "class"), [*TILE, "lower_i", "lower_j", "axis"], "left")
    return found.select(*TILE, "cell_i", "cell_j", "side", F.coalesce("class", F.lit("NONE")).alias("class"))


def asymmetries(contract: DataFrame) -> DataFrame:
    """Pairs of neighbouring cells in a tile that don't agree on the edge they share; empty if all do."""
    step = {"E": (1, 0), "S": (0, 1)}
    back = {"E": "W", "S": "N"}
    out = None
    for side, (di, dj) in step.items():
        a = contract.where(F.col("side") == side).select(*TILE, "cell_i", "cell_j", F.col("class").alias("own"))
        b = contract.where(F.col("side") == back[side]).select(*TILE, (F.col("cell_i") - di).alias("cell_i"), (F.col("cell_j") - dj).alias("cell_j"), F.col("class").alias("other"))
        found = a.join(b, [*TILE, "cell_i", "cell_j"]).where("own <> other").select("*", F.lit(side).alias("side"))
        out = found if out is None else out.unionByName(found)
    return out


def agreement(dense: DataFrame, label: str) -> DataFrame:
    """TILE, n_pairs, share: neighbouring cells that both have the label, and how many have it equal."""
    out = None
    for di, dj in ((1, 0), (0, 1)):
        b = dense.select(*TILE, (F.col("cell_i") - di).alias("cell_i"), (F.col("cell_j") - dj).alias("cell_j"), F.col(label).alias("__other"))
        found = dense.join(b, [*TILE, "cell_i", "cell_j"]).where(F.col(label).isNotNull() & F.col("__other").isNotNull()).select(*TILE, (F.col(label) == F.col("__other")).alias("same"))
        out = found if out is None else out.unionByName(found)
    return out.groupBy(*TILE).agg(F.count("*").alias("n_pairs"), (F.count_if("same") / F.count("*")).alias("share"))
