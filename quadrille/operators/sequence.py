"""Operators over ordered rows: alternation, islands, trends, gaps between places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def alternate(crossings: DataFrame, by: list[str], position: str, extent: str) -> DataFrame:
    """crossings with event: interval where the extent isn't zero; the others of a line, by position, enter
    and exit in turn."""
    w = Window.partitionBy(*by, "__point").orderBy(position)
    marked = crossings.withColumn("__point", F.col(extent) == 0)
    turn = F.when((F.row_number().over(w) - 1) % 2 == 0, "enter").otherwise("exit")
    return marked.withColumn("event", F.when(F.col("__point"), turn).otherwise("interval")).drop("__point")


def islands(df: DataFrame, by: list[str], order: str, value: str, amount: str) -> DataFrame:
    """by, island, value, n, total: runs of equal values that follow each other, with the sum over each."""
    w = Window.partitionBy(*by).orderBy(order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("__change", change).withColumn("island", F.sum("__change").over(w))
    return marked.groupBy(*by, "island").agg(F.first(value).alias("value"), F.count("*").alias("n"), F.sum(amount).alias("total"))


def steps(df: DataFrame, by: list[str], order: str, *values: str) -> DataFrame:
    """df with the difference of each value to the row before."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumns({f"d_{v}": F.col(v) - F.lag(v).over(w) for v in values})


def runner_up(df: DataFrame, by: list[str], name: str, score: str) -> DataFrame:
    """by, best, gap: the least score's name, and how far the next one is (null if there is none)."""
    two = F.slice(F.array_sort(F.collect_list(F.struct(score, name))), 1, 2)
    found = df.groupBy(*by).agg(two.alias("t"))
    return found.select(*by, F.get("t", F.lit(0))[name].alias("best"), (F.get("t", F.lit(1))[score] - F.get("t", F.lit(0))[score]).alias("gap"))


def trend(df: DataFrame, x: str, y: str, last: float) -> DataFrame:
    """n, slope, settled over the rows whose x is within last of the greatest: settled if the slope is
    within two standard errors of zero. Fewer than 3 points have no answer."""
    top = df.agg(F.max(x).alias("__top"))
    near = df.crossJoin(F.broadcast(top)).where(F.col(x) >= F.col("__top") - last)
    a = near.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    left = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy"))
    error = F.sqrt(F.try_divide(F.try_divide(left, F.col("n") - 2), F.col("sxx")))
    return a.select("n", F.when(F.col("n") >= 3, F.col("slope")).alias("slope"), F.when(F.col("n") >= 3, F.abs("slope") <= 2 * error).alias("settled"))


def spans_of_parts(features: DataFrame, by: list[str], order: str, parts: str) -> DataFrame:
    """features with first and last: which blocks of a stream belong to each, if it takes parts of them in turn."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return features.withColumn("last", F.sum(parts).over(w) - 1).withColumn("first", F.col("last") - F.col(parts) + 1)


def lengths_ok(tokens: Column, most: int) -> Column:
    """empty, too_long or kept, by the number of tokens."""
    return F.when(F.size(tokens) == 0, "empty").when(F.size(tokens) > most, "too_long").otherwise("kept")
