"""Scores of the small graphs that the roads of a tile form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.grid import TILE


def interior(edges: DataFrame) -> DataFrame:
    """Edges of which both cells are inside the rim: TILE, a, b (cell numbers)."""
    inner = "least(ai, aj, bi, bj) >= 1 AND greatest(ai, aj, bi, bj) <= 6"
    return edges.where(inner).select(*TILE, (F.col("ai") * 8 + F.col("aj")).alias("a"), (F.col("bi") * 8 + F.col("bj")).alias("b")).distinct()


def giant_component(edges: DataFrame, nodes: int = 64) -> DataFrame:
    """TILE, n_edges, n_giant, share: edges in the component that has most of them. A tile has 64 cells at
    most, so labels settle in a number of rounds that is known; its edges are one row."""
    tiles = edges.groupBy(*TILE).agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("e"))
    start = F.transform(F.sequence(F.lit(0), F.lit(nodes - 1)), lambda k: k)

    def relax(labels, e):
        low = F.least(F.get(labels, e["a"]), F.get(labels, e["b"]))
        high = F.greatest(F.get(labels, e["a"]), F.get(labels, e["b"]))
        return F.transform(labels, lambda x: F.when(x == high, low).otherwise(x))

    labelled = tiles.withColumn("l", F.aggregate("e", start, relax))
    of_edge = labelled.withColumn("r", F.transform("e", lambda x: F.get("l", x["a"])))
    sizes = F.transform(F.array_distinct("r"), lambda k: F.size(F.filter("r", lambda x: x == k)))
    return of_edge.select(*TILE, F.size("e").alias("n_edges"), F.array_max(sizes).alias("n_giant")).withColumn("share", F.col("n_giant") / F.col("n_edges"))


def continuity(edges: DataFrame) -> DataFrame:
    """TILE, n_nodes, share: nodes that edges touch, and how many of them two or more do."""
    ends = edges.select(*TILE, F.explode(F.array("a", "b")).alias("node")).groupBy(*TILE, "node").agg(F.count("*").alias("degree"))
    return ends.groupBy(*TILE).agg(F.count("*").alias("n_nodes"), (F.count_if(F.col("degree") >= 2) / F.count("*")).alias("share"))
