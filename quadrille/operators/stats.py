"""Distribution comparisons: two-sample KS, multiple testing, floors, paired tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ks_pairs(samples: DataFrame, keys: list[str], member: str = "city", value: str = "value", min_n: int = 1) -> DataFrame:
    """keys, a, b, n_a, n_b, ks for each two members (a < b) of a key, both with min_n values at least.

    Values are counted first. Each member's counts then go to the pairs that it is in, and the shares run
    along the pair's own values: what meets are the values of two members, each once, never all of a
    key's values for every pair."""
    counts = samples.where(F.col(value).isNotNull()).groupBy(*keys, F.col(member).alias("m"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys, "m").agg(F.sum("n").alias("total")).where(F.col("total") >= min_n)
    # One row for each key and member: as many as a key has members.
    there = totals.groupBy(*keys).agg(F.collect_list(F.struct("m", "total")).alias("all"))
    pairs = totals.join(there, keys).select(*keys, "m", "total", F.explode("all").alias("o")).where("m <> o.m")
    first = F.col("m") < F.col("o.m")
    pairs = pairs.select(
        *keys, "m", first.alias("first"), F.least("m", "o.m").alias("a"), F.greatest("m", "o.m").alias("b"),
        F.when(first, F.col("total")).otherwise(F.col("o.total")).alias("n_a"), F.when(first, F.col("o.total")).otherwise(F.col("total")).alias("n_b"),
    )
    steps = counts.join(pairs, [*keys, "m"]).groupBy(*keys, "a", "b", "n_a", "n_b", "v").agg(F.sum(F.when(F.col("first"), F.col("n")).otherwise(0)).alias("x"), F.sum(F.when(F.col("first"), 0).otherwise(F.col("n"))).alias("y"))
    upto = Window.partitionBy(*keys, "a", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.sum("x").over(upto) / F.col("n_a") - F.sum("y").over(upto) / F.col("n_b"))
    return steps.select(*keys, "a", "b", "n_a", "n_b", gap.alias("gap")).groupBy(*keys, "a", "b", "n_a", "n_b").agg(F.max("gap").alias("ks"))


def ks_two(df: DataFrame, left: Column, value: Column, keys: list[str]) -> DataFrame:
    """keys, n_left, n_right, ks between the rows where left holds and the others; 1 if either is empty."""
    counts = df.select(*keys, left.alias("l"), value.alias("v")).where("v IS NOT NULL").groupBy(*keys, "v").agg(F.count_if("l").alias("x"), F.count_if(~F.col("l")).alias("y"))
    w = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    steps = counts.select(*keys, F.sum("x").over(w).alias("cx"), F.sum("y").over(w).alias("cy"), F.sum("x").over(whole).alias("nx"), F.sum("y").over(whole).alias("ny"))
    gap = F.max(F.abs(F.try_divide(F.col("cx").cast("double"), F.col("nx")) - F.try_divide(F.col("cy").cast("double"), F.col("ny"))))
    return steps.groupBy(*keys).agg(F.first("nx").alias("n_left"), F.first("ny").alias("n_right"), F.coalesce(gap, F.lit(1.0)).alias("ks"))


def ks_pvalue(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """The asymptotic p-value with the small-sample correction, within 0 and 1."""
    root = F.sqrt(n1 * n2 / (n1 + n2))
    lam = (root + 0.12 + F.lit(0.11) / root) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def ks_critical(n1: Column, n2: Column, c: float = 1.358) -> Column:
    """The critical value of KS at these sizes."""
    return F.lit(c) * F.sqrt((n1 + n2) / (n1 * n2))


def bh_adjust(df: DataFrame, p: str, family: list[str], order: list[str], name: str = "p_bh") -> DataFrame:
    """df with Benjamini and Hochberg's step-up p-values within each family (of all rows, if none is named: pairs
    of groups, which are few beside the samples); ties in the given order."""
    up = Window.partitionBy(*family).orderBy(p, *order)
    ranked = df.withColumn("__rank", F.row_number().over(up)).withColumn("__m", F.count("*").over(Window.partitionBy(*family)))
    down = Window.partitionBy(*family).orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(name, F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__rank")).over(down))).drop("__rank", "__m")


def pair_floors(pairs: DataFrame, held: list, keys: list[str]) -> DataFrame:
    """member, keys, least, middle, least_cross, middle_cross: least and median KS of each held-out member
    to the other held-out ones, and to all. Only where a pair of held-out ones exists."""
    both = pairs.select(*keys, "ks", F.col("a").alias("member"), F.col("b").alias("other")).unionByName(pairs.select(*keys, "ks", F.col("b").alias("member"), F.col("a").alias("other")))
    inside = F.when(F.col("other").isin(held), F.col("ks"))
    found = both.where(F.col("member").isin(held)).groupBy("member", *keys).agg(F.min(inside).alias("least"), F.median(inside).alias("middle"), F.min("ks").alias("least_cross"), F.median("ks").alias("middle_cross"))
    return found.where("least IS NOT NULL")


def discrimination(pairs: DataFrame, metrics: DataFrame, metric: str, alpha: float, effect: float) -> DataFrame:
    """metric, n_pairs, n_significant, verdict for each of metrics and, with a null metric, for all together.

    pairs has p_bh, adjusted over all pairs at once (bh_adjust without a family). A pair is significant if
    p_bh < alpha and ks >= effect. FAIL if there is a significant pair, UNSUPPORTED if there is none to judge, else PASS."""
    good = (F.col("p_bh") < alpha) & (F.col("ks") >= effect)
    found = pairs.groupBy(metric).agg(F.count("*").alias("n_pairs"), F.count_if(good).alias("n_significant"))
    every = metrics.select(metric).distinct().join(found, metric, "left").na.fill(0, ["n_pairs", "n_significant"])
    whole = pairs.agg(F.count("*").alias("n_pairs"), F.count_if(good).alias("n_significant")).select(F.lit(None).cast(pairs.schema[metric].dataType).alias(metric), "n_pairs", "n_significant")
    return every.unionByName(whole).withColumn("verdict", F.when(F.col("n_pairs") == 0, "UNSUPPORTED").when(F.col("n_significant") > 0, "FAIL").otherwise("PASS"))


def excess(scores: DataFrame, floors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ks, floor, excess = max(0, ks - floor), where a floor exists; null keys match null keys."""
    right = floors.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("floor"))
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    return scores.join(right, on).select(*keys, "ks", "floor", F.greatest(F.lit(0.0), F.col("ks") - F.col("floor")).alias("excess"))


def paired(df: DataFrame, arm: str, arms: tuple, seed: str, value: str, keys: list[str]) -> DataFrame:
    """keys, seed, delta: first arm minus second, of seeds that have both."""
    a, b = (F.max(F.when(F.col(arm) == x, F.col(value))) for x in arms)
    return df.groupBy(*keys, seed).agg(a.alias("__a"), b.alias("__b")).where("__a IS NOT NULL AND __b IS NOT NULL").select(*keys, seed, (F.col("__a") - F.col("__b")).alias("delta"))


def rank_biserial(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, r: signed share of mid-ranks of the absolute deltas; zeros don't count, none gives 0."""
    w = Window.partitionBy(*keys).orderBy("__abs")
    some = deltas.where("delta <> 0").withColumn("__abs", F.abs("delta"))
    ranked = some.withColumn("__rank", F.rank().over(w) + (F.count("*").over(Window.partitionBy(*keys, "__abs")) - 1) / F.lit(2.0))
    sums = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.signum("delta") * F.col("__rank")).alias("__s"), F.sum("__rank").alias("__t"))
    every = deltas.select(*keys).distinct()
    return every.join(sums, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide(F.col("__s"), F.col("__t")), F.lit(0.0)).alias("r"))


def binomial_tail(k: Column, n: Column) -> Column:
    """P(X >= k) of n fair coins: terms as logarithms, each from the one before, so that many coins don't underflow."""
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.lit(0.0).alias("s"))

    def step(a: Column, i: Column) -> Column:
        # At i the term is that of i heads; the next one is times (n - i) / (i + 1).
        after = F.when(i < n, a["t"] + F.log((n - i) / (i + 1.0))).otherwise(a["t"])
        return F.struct(after.alias("t"), (a["s"] + F.when(i >= k, F.exp(a["t"])).otherwise(0.0)).alias("s"))

    return F.least(F.lit(1.0), F.aggregate(F.sequence(F.lit(0), n.cast("int")), start, step, lambda a: a["s"]))


def sign_test(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, n_positive, p_one (more positive than a fair coin), p_two; zeros are left out."""
    counts = deltas.groupBy(*keys).agg(F.count_if(F.col("delta") != 0).alias("n"), F.count_if(F.col("delta") > 0).alias("n_positive"))
    n, k = F.col("n"), F.col("n_positive")
    return counts.select(*keys, "n", "n_positive", binomial_tail(k, n).alias("p_one"), F.least(F.lit(1.0), 2 * binomial_tail(F.greatest(k, n - k), n)).alias("p_two"))


def seed_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, mean, sem (sample deviation over the root of n), spread (population deviation)."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"), F.stddev_pop(value).alias("spread"))


def log_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope, intercept of log y over log x."""
    lx, ly = F.log(F.col(x)), F.log(F.col(y))
    return df.where((F.col(x) > 0) & (F.col(y) > 0)).agg(F.regr_slope(ly, lx).alias("slope"), F.regr_intercept(ly, lx).alias("intercept"))
