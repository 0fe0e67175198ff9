"""Roll-ups over cities and tiles, character of cells, and what reports are made from."""

from __future__ import annotations

import gzip
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.operators import percentiles

# The range of the logarithms of a cell's character.
LOG_LOW, LOG_HIGH = -3.0, 9.0
VALIDATED, FAILED = "validated", "failed"


def log10_clipped(x: Column) -> Column:
    return F.when(x <= 10.0**LOG_LOW, F.lit(LOG_LOW)).otherwise(F.least(F.log10(x), F.lit(LOG_HIGH)))


def character(sizes: DataFrame, key: list[str]) -> DataFrame:
    """key and the seven channels of each cell of sizes(key, layer, size), layer 'building' or 'road': median, spread, skew and number of
    building areas, median road length, and whether there are any of each. A layer that isn't there has 0 throughout; spread and skew need
    two buildings."""
    building = F.when(F.col("layer") == "building", F.col("size"))
    cuts = percentiles.exclusive(sizes, key, building, {"q1": (1, 4), "q3": (3, 4), "p90": (9, 10)}).drop("n")
    middles = sizes.groupBy(*key).agg(F.median(building).alias("m"), F.count(building).alias("n"), F.median(F.when(F.col("layer") == "road", F.col("size"))).alias("r"))
    found = middles.join(cuts, key, "left")
    zero = F.lit(0.0)
    return found.select(
        *key,
        F.when(F.col("n") > 0, log10_clipped(F.col("m"))).otherwise(zero).alias("area"),
        F.when(F.col("n") >= 2, log10_clipped(F.col("q3") - F.col("q1") + 1)).otherwise(zero).alias("spread"),
        F.when((F.col("n") >= 2) & (F.col("m") > 0), log10_clipped(F.try_divide(F.col("p90"), F.col("m")))).otherwise(zero).alias("skew"),
        F.when(F.col("n") > 0, log10_clipped(F.col("n") + 1.0)).otherwise(zero).alias("number"),
        F.when(F.col("r").isNotNull(), log10_clipped(F.col("r") + 1)).otherwise(zero).alias("length"),
        F.when(F.col("n") > 0, 1.0).otherwise(0.0).alias("buildings"),
        F.when(F.col("r").isNotNull(), 1.0).otherwise(0.0).alias("roads"),
    )


def axes(cities: DataFrame, names: Sequence[str], status: str = "status") -> DataFrame:
    """axis, label, n: validated cities for each label that any city has on an axis; 0 where none is validated."""
    each = cities.select(F.col(status).alias("s"), F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("label")) for a in names])).alias("e"))
    return each.groupBy("e.axis", "e.label").agg(F.count_if(F.col("s") == VALIDATED).alias("n"))


def blockers(cities: DataFrame, names: Sequence[str], name: str = "city", status: str = "status") -> DataFrame:
    """reason, what: what keeps the next batch back: cities that failed, labels without a validated city. Empty if it may go."""
    failed = cities.where(F.col(status) == FAILED).select(F.lit("failed").alias("reason"), F.col(name).cast("string").alias("what"))
    holes = axes(cities, names, status).where("n = 0").select(F.lit("uncovered").alias("reason"), F.concat_ws("=", "axis", "label").alias("what"))
    return failed.unionByName(holes)


def totals(cities: DataFrame, amounts: Sequence[str], status: str = "status") -> DataFrame:
    """n_cities and the sum of each amount over the validated cities."""
    good = F.col(status) == VALIDATED
    return cities.agg(F.count_if(good).alias("n_cities"), *[F.coalesce(F.sum(F.when(good, F.col(a))), F.lit(0)).alias(a) for a in amounts])


def projection(cities: DataFrame, old: str, new: str, floor: int) -> DataFrame:
    """done, projected, total, halt: tokens of cities that were derived again, those of the others shrunk by as much as any of the first
    did at most, and whether the sum is below the floor."""
    shrink = F.max(F.when(F.col(new).isNotNull(), 1 - F.col(new) / F.col(old)))
    sums = cities.agg(F.coalesce(F.sum(new), F.lit(0)).alias("done"), F.coalesce(F.sum(F.when(F.col(new).isNull(), F.col(old))), F.lit(0)).alias("pending"), F.coalesce(shrink, F.lit(0.0)).alias("shrink"))
    found = sums.withColumn("projected", F.col("pending") * (1 - F.col("shrink")))
    return found.select("done", "projected", (F.col("done") + F.col("projected")).alias("total"), (F.col("done") + F.col("projected") < floor).alias("halt"))


def assembled(cells: DataFrame, key: list[str], parts: Sequence[tuple[DataFrame, dict]]) -> DataFrame:
    """cells with the columns of each part(key, ...) where it has the cell, else that column's default."""
    for part, defaults in parts:
        cells = cells.join(part, key, "left")
        cells = cells.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if v is not None else F.col(c) for c, v in defaults.items()})
    return cells


def strict_matches(manifest: DataFrame, examples: DataFrame, key: list[str]) -> DataFrame:
    """key, n: rows of the manifest that don't match exactly one example; empty if all do."""
    counts = examples.groupBy(*key).agg(F.count("*").alias("n"))
    return manifest.select(*key).distinct().join(counts, key, "left").select(*key, F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def three_way(a: DataFrame, b: DataFrame, c: DataFrame, key: str, value: str) -> DataFrame:
    """key, a, b, c: keys on whose value three sources don't agree, or that one of them lacks."""
    named = [df.select(key, F.col(value).alias(n)) for df, n in ((a, "a"), (b, "b"), (c, "c"))]
    found = named[0].join(named[1], key, "full_outer").join(named[2], key, "full_outer")
    return found.where("NOT (a <=> b AND b <=> c)")


def union_vocabulary(primary: DataFrame, alternate: DataFrame, prefix: str) -> DataFrame:
    """token, origin for the values of either (value): prefix and value; origin both, primary or alternate."""
    a, b = (d.select("value").distinct().withColumn(n, F.lit(True)) for d, n in ((primary, "p"), (alternate, "a")))
    origin = F.when(F.col("p") & F.col("a"), "both").when(F.col("p"), "primary").otherwise("alternate")
    return a.join(b, "value", "full_outer").select(F.concat(F.lit(prefix), "value").alias("token"), origin.alias("origin"))


def shares_within_type(rows: DataFrame, types: Sequence[str]) -> DataFrame:
    """key, value, type, share: the part that a key (value null) has of all keys' elements of its most common type, the first of types on
    ties; a value (parent in key) takes its key's type and its own count 'n'. Values of keys that aren't there have 0."""
    keys = rows.where("value IS NULL")
    sums = keys.agg(*[F.sum(t).alias(f"__{t}") for t in types])
    best = F.greatest(*[F.struct(F.col(t).alias("n"), F.lit(-i).alias("o")) for i, t in enumerate(types)])
    kinds = keys.select("key", F.get(F.array(*map(F.lit, types)), -best["o"]).alias("type"), best["n"].alias("__k"))
    found = rows.join(kinds, "key", "left").crossJoin(F.broadcast(sums))  # one row of totals
    total = F.coalesce(*[F.when(F.col("type") == t, F.col(f"__{t}")) for t in types])
    share = F.coalesce(F.try_divide(F.when(F.col("value").isNull(), F.col("__k")).otherwise(F.col("n")).cast("double"), total), F.lit(0.0))
    return found.select("key", "value", "type", share.alias("share"))


def redundancy(data: Column) -> Column:
    """How much shorter bytes get by gzip: 1 - compressed / raw; 0 for none."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else 1.0 - len(gzip.compress(v, 6)) / len(v) if v else 0.0 for v in values.to_pylist()], pa.float64())

    return F.arrow_udf(run, "double")(data)


def overlay(*sources: tuple[DataFrame, int], key: list[str], name: str, value: str) -> DataFrame:
    """key, name, value: of the sources' values of a name the one of the greatest rank counts; nulls don't hide others."""
    both = None
    for df, rank in sources:
        part = df.select(*key, name, value, F.lit(rank).alias("__rank")).where(F.col(value).isNotNull())
        both = part if both is None else both.unionByName(part)
    return both.groupBy(*key, name).agg(F.max_by(value, "__rank").alias(value))
