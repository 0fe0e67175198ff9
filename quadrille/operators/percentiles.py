"""Quantiles in the conventions that the statistics use; they differ and must not be mixed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def picks(df: DataFrame, by: list[str], value: Column, at: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """by, n and for each name the value at index at[name](n) of those of its group in ascending order; null
    where there is no such index. Nulls don't count.

    Values are counted before they meet, and ranks run along the different values of a group, so no group is
    ever held as one row, and all picks take one pass."""
    counts = df.select(*by, value.alias("__v")).where("__v IS NOT NULL").groupBy(*by, "__v").agg(F.count("*").alias("__k"))
    group = Window.partitionBy(*by)
    placed = counts.select(*by, "__v", F.sum("__k").over(group).alias("n"), F.sum("__k").over(group.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)).alias("__to"), "__k")
    here = lambda i: (i >= F.col("__to") - F.col("__k")) & (i < F.col("__to"))
    return placed.groupBy(*by).agg(F.first("n").alias("n"), *[F.max(F.when(here(index(F.col("n"))), F.col("__v"))).alias(name) for name, index in at.items()])


def nearest_rank(q: float) -> Callable[[Column], Column]:
    """Index round(q (n - 1)), halves to even."""
    return lambda n: F.bround(F.lit(q) * (n - 1)).cast("long")


def ceil_rank(p: float) -> Callable[[Column], Column]:
    """Index ceil(p / 100 n) - 1, from 0 to n - 1; to be used on finite values, with 0 for an empty group."""
    return lambda n: F.greatest(F.lit(0), F.least(n, F.ceil(F.lit(p / 100.0) * n).cast("long")) - 1)


def finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def linear(value: Column, q: float) -> Column:
    """Between order statistics."""
    return F.percentile(value, F.lit(q))


def truncated(q: float) -> Callable[[Column], Column]:
    """Index int(q (n - 1))."""
    return lambda n: F.floor(F.lit(q) * (n - 1)).cast("long")


def exclusive(df: DataFrame, by: list[str], value: Column, cuts: dict[str, tuple[int, int]]) -> DataFrame:
    """by, n and for each name (k, m) the k-th of m - 1 cut points, at k (n + 1) / m; beyond the ends by
    extrapolation, null below two values."""

    def low(k: int, m: int, n: Column) -> Column:
        return F.greatest(F.lit(1), F.least(n - 1, F.floor(F.lit(k) * (n + 1) / F.lit(m)).cast("long")))

    at = {}
    for name, (k, m) in cuts.items():
        at[f"__{name}_a"] = lambda n, k=k, m=m: low(k, m, n) - 1
        at[f"__{name}_b"] = lambda n, k=k, m=m: low(k, m, n)
    found = picks(df, by, value, at)
    n = F.col("n")
    weight = {name: F.lit(k) * (n + 1) - low(k, m, n) * m for name, (k, m) in cuts.items()}
    return found.select(*by, "n", *[F.when(n >= 2, (F.col(f"__{name}_a") * (F.lit(m) - weight[name]) + F.col(f"__{name}_b") * weight[name]) / F.lit(float(m))).alias(name) for name, (_, m) in cuts.items()])


def pearson(x: Column, y: Column) -> Column:
    """0 below two pairs or without variance."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n, sx, sy, sxx, syy, sxy = F.count(x), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y)
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((n >= 2) & (vx > 0) & (vy > 0), (n * sxy - sx * sy) / F.sqrt(vx) / F.sqrt(vy)).otherwise(F.lit(0.0))


def mid_ranks(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """df with the rank of value within by, ties at the middle of their ranks."""
    below = Window.partitionBy(*by).orderBy(value)
    return df.withColumn(name, F.rank().over(below) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0))
