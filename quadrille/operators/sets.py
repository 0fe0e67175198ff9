"""Set checks: hold-outs, leaks, bags and covers. Each gives the violations; empty means all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.grid import SIDE, TILE


def without(df: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't held out; null keys match null keys."""
    right = held.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(right, on, "left_anti")


def leaks(lineage: DataFrame, held: DataFrame, keys: list[str], city: str = "city", whole: list | None = None) -> DataFrame:
    """Rows of lineage that refer to a held-out key, to a city held out as a whole, or to nothing."""
    direct = lineage.join(held.select(*keys).distinct(), keys, "left_semi").withColumn("reason", F.lit("tile"))
    nothing = lineage.where(" OR ".join(f"{k} IS NULL" for k in keys)).withColumn("reason", F.lit("null"))
    out = direct.unionByName(nothing)
    return out.unionByName(lineage.where(F.col(city).isin(whole)).withColumn("reason", F.lit("city"))) if whole else out


def bag_difference(expected: DataFrame, actual: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, missing, extra: how often a value is lacking or too many, as bags."""
    both = expected.select(*by, value, F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(actual.select(*by, value, F.lit(0).alias("e"), F.lit(1).alias("a")))
    found = both.groupBy(*by, value).agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    return found.select(*by, value, F.greatest(F.col("e") - F.col("a"), F.lit(0)).alias("missing"), F.greatest(F.col("a") - F.col("e"), F.lit(0)).alias("extra")).where("missing > 0 OR extra > 0")


def set_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side: keys that only one side has."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def uncovered(rows: DataFrame) -> DataFrame:
    """TILE, n_missing, n_double: tiles whose cells aren't each there once."""
    per_cell = rows.groupBy(*TILE, "cell_i", "cell_j").agg(F.count("*").alias("n"))
    found = per_cell.groupBy(*TILE).agg((F.lit(SIDE * SIDE) - F.count_if(F.col("cell_i").between(0, SIDE - 1) & F.col("cell_j").between(0, SIDE - 1))).alias("n_missing"), F.count_if(F.col("n") > 1).alias("n_double"))
    return found.where("n_missing > 0 OR n_double > 0")


def unsorted(rows: DataFrame, ordinal: str, keys: list[str], by: list[str]) -> DataFrame:
    """Rows whose key is below that of the row before, by a stored ordinal within by."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(ordinal)
    return rows.withColumn("__before", F.lag(F.struct(*keys)).over(w)).where(F.col("__before") > F.struct(*keys)).drop("__before")
