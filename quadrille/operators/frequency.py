"""Categorical frequency profiles: value counts, list lengths, floor cuts and kept sets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Floor:
    """A category is kept from max(floor(share x present rows), least) rows on."""

    name: str
    share: float
    least: int


FLOORS = (Floor("all", 0.0, 1), Floor("ten", 0.0, 10), Floor("permille", 0.001, 10), Floor("half_percent", 0.005, 10), Floor("percent", 0.01, 20))


def value_counts(df: DataFrame, value: Column | str) -> DataFrame:
    """value, n: rows of each non-null value, as a string."""
    column = F.col(value) if isinstance(value, str) else value
    return df.select(column.cast("string").alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))


def presence(df: DataFrame, value: Column | str) -> DataFrame:
    """n_total, n_present."""
    column = F.col(value) if isinstance(value, str) else value
    return df.agg(F.count("*").alias("n_total"), F.count(column).alias("n_present"))


def element_counts(df: DataFrame, values: Column | str) -> DataFrame:
    """value, n: occurrences of each non-null element of a list column."""
    return value_counts(df.select(F.explode(values).alias("element")), "element")


def length_histogram(df: DataFrame, values: Column | str, top: int = 5) -> DataFrame:
    """bucket, n, share: lists by length, 0 to top (which is open); null is 0; all buckets are there."""
    column = F.col(values) if isinstance(values, str) else values
    size = F.least(F.coalesce(F.size(column), F.lit(0)), F.lit(top))
    counts = df.groupBy(size.alias("bucket")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    buckets = df.sparkSession.range(top + 1).select(F.col("id").cast("int").alias("bucket"))
    # Both sides have a fixed number of rows: the buckets and one total.
    found = buckets.join(F.broadcast(counts), "bucket", "left").crossJoin(F.broadcast(total))
    return found.select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)).cast("double"), F.col("total")), F.lit(0.0)).alias("share"))


def floor_cuts(counts: DataFrame, present: DataFrame, floors: Sequence[Floor] = FLOORS) -> DataFrame:
    """strategy, floor, n_kept, n_cut, kept_occurrences, coverage (per cent; 100 without occurrences), for
    counts(value, n) and present(n_present). The floor follows the rows, coverage the occurrences."""
    spark = counts.sparkSession
    cuts = spark.createDataFrame([(f.name, f.share, f.least) for f in floors], "strategy string, share double, least int")
    limits = cuts.crossJoin(F.broadcast(present.select("n_present"))).select("strategy", F.greatest(F.floor(F.col("share") * F.col("n_present")), F.col("least").cast("long")).alias("floor"))
    kept = F.col("n") >= F.col("floor")
    # The strategies are a handful: each count meets each of them once, then partial sums meet.
    found = counts.crossJoin(F.broadcast(limits)).groupBy("strategy", "floor").agg(
        F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_cut"), F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("kept_occurrences"), F.sum("n").alias("all_occurrences")
    )
    return found.select("strategy", "floor", "n_kept", "n_cut", "kept_occurrences", F.coalesce(F.try_divide(F.col("kept_occurrences") * 100.0, F.col("all_occurrences")), F.lit(100.0)).alias("coverage"))


def kept_set(counts: DataFrame, floor: int) -> DataFrame:
    """value, n, place: what reaches the floor, most frequent first, then by name. The kept values are a
    vocabulary, small beside the rows; ranks are taken over it alone."""
    from pyspark.sql import Window

    return counts.where(F.col("n") >= floor).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "value")))


def cumulative_coverage(counts: DataFrame) -> DataFrame:
    """value, n, place, covered, gain: coverage of the first k values, and what each adds to it."""
    from pyspark.sql import Window

    order = Window.orderBy(F.desc("n"), "value")
    return counts.select("value", "n", F.row_number().over(order).alias("place"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("covered"), (F.col("n") - F.coalesce(F.lag("n").over(order), F.lit(0))).alias("gain"))


def histogram(df: DataFrame, value: str, edges: Sequence[float], open_top: bool = False) -> DataFrame:
    """bin, n: half-open bins; the last is closed, or has no end with open_top. What lies outside isn't counted."""
    spark = df.sparkSession
    bins = list(zip(edges, edges[1:])) + ([(edges[-1], None)] if open_top else [])
    which = F.lit(None).cast("int")
    for k in reversed(range(len(bins))):
        low, high = bins[k]
        inside = F.col(value) >= low
        if high is not None:
            inside &= F.col(value) <= high if k == len(bins) - 1 and not open_top else F.col(value) < high
        which = F.when(inside, F.lit(k)).otherwise(which)
    counts = df.select(which.alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    every = spark.range(len(bins)).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def bucket(value: Column, edges: Sequence[float], below: str = "zero") -> Column:
    """The last edge that is at most the value, by number. Below the first: 0, or an error."""
    out = F.lit(0) if below == "zero" else F.when(value < edges[0], F.raise_error(F.lit("below the first edge")).cast("int")).otherwise(F.lit(0))
    for k, edge in enumerate(edges[1:], 1):
        out = F.when(value >= edge, F.lit(k)).otherwise(out)
    return F.when(value.isNotNull(), out)
