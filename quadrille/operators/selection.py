"""Top-k, quotas and samples that don't depend on how rows are partitioned."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows: each task keeps n, so nothing larger meets in one place."""
    return df.orderBy(*order).limit(n)


def quota(df: DataFrame, n: int, by: list[str], order: list[str]) -> DataFrame:
    """The first n rows of each stratum, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def shortfalls(strata: DataFrame, taken: DataFrame, n: int, by: list[str]) -> DataFrame:
    """by, n_taken, short: strata of which fewer than n rows could be taken."""
    found = strata.select(*by).distinct().join(taken.groupBy(*by).agg(F.count("*").alias("n_taken")), by, "left")
    return found.select(*by, F.coalesce("n_taken", F.lit(0)).alias("n_taken")).withColumn("short", F.lit(n) - F.col("n_taken")).where("short > 0")


def digest(seed: str, *key: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in key]).cast("binary"), 256)


def hash_sample(df: DataFrame, n: int, seed: str, key: list[str], by: list[str] | None = None) -> DataFrame:
    """n rows (of each stratum) by the order of a keyed digest."""
    rank = digest(seed, *[F.col(k) for k in key])
    if not by:
        return df.withColumn("__h", rank).orderBy("__h", *key).limit(n).drop("__h")
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(rank, *key))).where(F.col("__r") <= n).drop("__r")


def split(units: DataFrame, key: list[str], share: float, seed: str) -> DataFrame:
    """units with part: 'val' for max(1, round(n share)) of them (halves to even) by keyed digest, else 'train'.
    Each task keeps its first ones, so no more than those of one part meet."""
    n_val = units.agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(share))).cast("int")).first()[0]
    chosen = top(units.select(*key, digest(seed, *[F.col(k) for k in key]).alias("__h")), n_val, "__h", *key).select(*key, F.lit("val").alias("part"))
    return units.join(chosen, key, "left").withColumn("part", F.coalesce("part", F.lit("train")))


def blake2b(*key: Column, size: int = 16) -> Column:
    """The BLAKE2b digest in hexadecimal of the parts joined by colons."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else hashlib.blake2b(t.encode(), digest_size=size).hexdigest() for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(F.concat_ws(":", *[k.cast("string") for k in key]))


def blake_sample(df: DataFrame, n: int, seed: str, key: list[str]) -> DataFrame:
    """The n rows of the least BLAKE2b digests of seed and key."""
    return top(df.withColumn("__h", blake2b(F.lit(seed), *[F.col(k) for k in key])), n, "__h").drop("__h")


def best_per(df: DataFrame, by: list[str], score: Column, order: list[str]) -> DataFrame:
    """The row of the greatest score in each group, the first in order on ties. Partial maxima meet, not rows."""
    rest = [c for c in df.columns if c not in by]
    tie = F.struct((-score).alias("s"), *order)
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), tie).alias("r")).select(*by, "r.*")


def first_mode(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """by, value, n: the most common value, the one seen first in order on ties."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    return counts.groupBy(*by).agg(F.max_by(F.struct(value, "n"), F.struct("n", (-F.col("__first")).alias("f"))).alias("r")).select(*by, f"r.{value}", "r.n")


def donors(df: DataFrame, bucket: list[str], key: str, seed: str) -> DataFrame:
    """key, donor: another row of the same bucket, the next by keyed digest around the bucket; null if it is alone."""
    h = digest(seed, F.col(key))
    w = Window.partitionBy(*bucket).orderBy("__h", key)
    ranked = df.select(*bucket, key, h.alias("__h"))
    first = F.first(key).over(Window.partitionBy(*bucket).orderBy("__h", key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = ranked.withColumn("donor", F.coalesce(F.lead(key).over(w), first)).drop("__h")
    return found.withColumn("donor", F.when(F.col("donor") != F.col(key), F.col("donor")))


def round_robin(units: DataFrame, order: list[str], parts: int) -> DataFrame:
    """units with part: 0 to parts - 1 in turn, in order. units are few beside their rows (tiles, not cells); one task numbers them."""
    return units.withColumn("part", F.pmod(F.row_number().over(Window.orderBy(*order)) - 1, F.lit(parts)).cast("long"))
