"""Verdicts and gates over scores: floors, memorisation, bindings, emergence, sizes and quotas. Each is a table, so that what was refused can be read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The constants of the decisions.
KS_C, OVER_RHO, OVER_FLOOR, EMERGENCE_SHARE = 1.358, 0.5, 0.005, 0.25
SIZE_EDGES = (10, 20, 40, 80, 160, 320, 640, 1280, 2560)


def over_threshold(rate: Column) -> Column:
    return F.greatest(F.lit(OVER_RHO) * rate, F.lit(OVER_FLOOR))


def over_emission(rates: DataFrame, faithful: DataFrame, by: str) -> DataFrame:
    """by, rate, faithful, over: strata of rates(by, n, rate) whose rate is above the faithful one by more than its threshold; with a null
    stratum all together, weighted by n. A stratum without a faithful rate is held against 0."""
    each = rates.join(faithful.withColumnRenamed("rate", "faithful"), by, "left").withColumn("faithful", F.coalesce("faithful", F.lit(0.0)))
    whole = each.agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.col("rate") * F.col("n")), F.sum("n")).alias("rate"), F.try_divide(F.sum(F.col("faithful") * F.col("n")), F.sum("n")).alias("faithful"))
    both = each.select(by, "rate", "faithful").unionByName(whole.select(F.lit(None).cast(rates.schema[by].dataType).alias(by), "rate", "faithful"))
    return both.withColumn("over", F.col("rate") - F.col("faithful") > over_threshold(F.col("faithful")))


def memorisation(scores: DataFrame, pair: list[str]) -> DataFrame:
    """pair, n, own, train, verdict for scores(pair, ks_own, ks_train) by strata: PASS if the median distance to the own city is strictly less
    than to the training city."""
    found = scores.groupBy(*pair).agg(F.count("*").alias("n"), F.median("ks_own").alias("own"), F.median("ks_train").alias("train"))
    return found.withColumn("verdict", F.when(F.col("own") < F.col("train"), "PASS").otherwise("FAIL"))


def discriminating(pairs: DataFrame, by: list[str], alpha: float, delta: float) -> DataFrame:
    """by and strata: for each pair the strata in which it differs enough; empty where it does in none."""
    good = (F.col("ks") >= delta) & (F.col("p_bh") < alpha)
    return pairs.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(good, F.col("stratum")))).alias("strata"))


def sane(pairs: DataFrame, low: float = 0.049, high: float = 0.5) -> DataFrame:
    """n, middle, sane: whether there are pairs and their median distance is in the range that real cities have."""
    found = pairs.agg(F.count("*").alias("n"), F.median("ks").alias("middle"))
    return found.withColumn("sane", (F.col("n") > 0) & F.coalesce(F.col("middle").between(low, high), F.lit(False)))


def binding(scores: DataFrame) -> DataFrame:
    """city, winner, runner_up, gap, floor, place, decisive, binds for scores(model, city, ks, n, sem).

    Cities by the mean over models, the worst first. One decides if the gap between its two best models is above both c / sqrt(n) and the
    greater of their errors; the first that decides binds."""
    per = Window.partitionBy("city").orderBy("ks", "model")
    ranked = scores.withColumn("r", F.row_number().over(per)).withColumn("mean", F.avg("ks").over(Window.partitionBy("city")))
    pick = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    each = ranked.groupBy("city", "mean").agg(pick("model", 1).alias("winner"), pick("model", 2).alias("runner_up"), (pick("ks", 2) - pick("ks", 1)).alias("gap"), F.greatest(KS_C / F.sqrt(pick("n", 1)), pick("sem", 1), pick("sem", 2)).alias("floor"))
    decided = each.withColumn("decisive", F.col("gap") > F.col("floor")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), "city")))
    first = F.min(F.when(F.col("decisive"), F.col("place"))).over(Window.partitionBy())
    return decided.withColumn("binds", F.coalesce(F.col("place") == first, F.lit(False))).drop("mean")


def emergence(polygons: Column, cells: Column, reference: Column) -> Column:
    """Whether buildings have come up: polygons to a cell at least a quarter of the reference's."""
    return F.when(F.coalesce(F.try_divide(polygons, cells), F.lit(0.0)) >= EMERGENCE_SHARE * reference, "SCOREABLE").otherwise("ROADS_ONLY")


def stratum_size(target: Column, headroom: float, floor_n: Column, available: Column) -> Column:
    """(wanted, selected, ceiling): cells that give target features with headroom, at most those there are."""
    wanted = F.ceil(target * headroom * available / floor_n)
    return F.struct(wanted.alias("wanted"), F.least(wanted, available).alias("selected"), (wanted > available).alias("ceiling"))


def binding_metric(owed: DataFrame, by: list[str], scarce: str, common: str) -> DataFrame:
    """by, metric: the scarce metric where it is owed, else the common one."""
    return owed.groupBy(*by).agg(F.when(F.bool_or(F.col("metric") == scarce), scarce).otherwise(common).alias("metric"))


def quota_needed(units: DataFrame, strata: list[str], order: list[str], kind: str, amount: str, floors: DataFrame) -> DataFrame:
    """kind, needed: the least uniform quota (units of each stratum, in order) at which amount adds up to the floors(kind, least) of a kind; null if
    all units together fall short. units has a row for each unit and kind. No loop: each unit comes in at its place, and sums run over the
    places, of which there are as many as a stratum has units."""
    place = F.dense_rank().over(Window.partitionBy(*strata).orderBy(*order))
    by_place = units.withColumn("__place", place).groupBy(kind, "__place").agg(F.sum(amount).alias("__a"))
    upto = Window.partitionBy(kind).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    reached = by_place.withColumn("__sum", F.sum("__a").over(upto)).join(floors, kind)
    found = reached.where(F.col("__sum") >= F.col("least")).groupBy(kind).agg(F.min("__place").cast("long").alias("needed"))
    return floors.select(kind).join(found, kind, "left")


def ratio_bucket(ratio: Column, n: int) -> Column:
    return F.least(F.floor(ratio * n), F.lit(n - 1)).cast("int")


def size_bucket(area: Column) -> Column:
    """0 for none, then 1 and one more for each edge that the area is above."""
    out = F.lit(1)
    for edge in SIZE_EDGES:
        out = out + F.when(area > edge, 1).otherwise(0)
    return F.when(area.isNull(), 0).otherwise(out)


def bucket_matches(stored: Column, value: Column, edges: Sequence[float], tolerance: float = 1e-9) -> Column:
    """Whether a stored bucket is that of the value, or of one within the tolerance."""
    of = lambda v: F.greatest(F.lit(0), sum((F.when(v >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1)
    return stored.isin(of(value), of(value - tolerance), of(value + tolerance))


def steers(deltas: DataFrame, by: str, checkpoint: str, expected: int, alpha: float = 0.01, least: int = 2) -> DataFrame:
    """by, n_pass, steers: checkpoints whose deltas lean the expected way (sign test, ties left out), and whether enough do."""
    from quadrille.operators.stats import binomial_tail

    counts = deltas.groupBy(by, checkpoint).agg(F.count_if(F.col("delta") > 0).alias("p"), F.count_if(F.col("delta") < 0).alias("m"))
    n = F.col("p") + F.col("m")
    p = F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(F.greatest("p", "m"), n)))
    passed = (p < alpha) & (F.signum((F.col("p") - F.col("m")).cast("double")) == expected)
    return counts.groupBy(by).agg(F.count_if(passed).alias("n_pass")).withColumn("steers", F.col("n_pass") >= least)


def seed_noise(scores: DataFrame, model: str, score: str, reliable: Column) -> DataFrame:
    """a, b, difference, noise, decisive for each two models: means and the greater population deviation over reliable seeds."""
    each = scores.where(reliable).groupBy(F.col(model).alias("m")).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("spread"))
    # A handful of models, one row each.
    a, b = each.select(F.col("m").alias("a"), F.col("mean").alias("ma"), F.col("spread").alias("sa")), each.select(F.col("m").alias("b"), F.col("mean").alias("mb"), F.col("spread").alias("sb"))
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b"))
    return pairs.select("a", "b", (F.col("ma") - F.col("mb")).alias("difference"), F.greatest("sa", "sb").alias("noise")).withColumn("decisive", F.abs("difference") >= F.col("noise"))


def bootstrap_slopes(points: DataFrame, x: str, y: str, draws: int, seed: int) -> DataFrame:
    """low, high: the 5th and 95th percentile (linear) of the slope of log y over log x over draws resamples. points are the few of a scaling
    curve; who is drawn follows from a hash of seed, draw and place."""
    w = Window.orderBy(x, y)
    numbered = points.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.log(x).alias("lx"), F.log(y).alias("ly"), (F.row_number().over(w) - 1).alias("i"))
    n = numbered.agg(F.count("*").alias("n"))
    picks = points.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(n)).select("draw", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    picks = picks.select("draw", F.pmod(F.xxhash64(F.lit(seed), "draw", "k"), F.col("n")).cast("int").alias("i"))
    slopes = picks.join(F.broadcast(numbered), "i").groupBy("draw").agg(F.when(F.stddev_pop("lx") > 0, F.regr_slope("ly", "lx")).alias("s"))
    return slopes.agg(F.percentile("s", F.lit(0.05)).alias("low"), F.percentile("s", F.lit(0.95)).alias("high"))


def farthest_donor(cells: DataFrame, by: str, key: str, prefix: str) -> DataFrame:
    """key, donor, distance: another cell of the group whose prefix differs in most places, the least key on ties. Each is held against the
    different prefixes of its group, of which the least key of each is kept, not against every cell."""
    kinds = cells.groupBy(by, prefix).agg(F.min(F.struct(key)).alias("k"), F.count("*").alias("n"), F.sort_array(F.collect_list(key)).alias("__all"))
    kinds = kinds.select(by, F.col(prefix).alias("__p"), F.slice("__all", 1, 2).alias("__two"))
    pairs = cells.join(kinds, by)
    other = F.get(F.filter("__two", lambda k: k != F.col(key)), F.lit(0))
    differs = F.size(F.filter(F.zip_with(F.col(prefix), F.col("__p"), lambda a, b: ~a.eqNullSafe(b)), lambda d: d))
    best = pairs.select(key, other.alias("__o"), differs.alias("__d")).where("__o IS NOT NULL").groupBy(key).agg(F.max(F.struct(F.col("__d").alias("d"), (-F.col("__o")).alias("o"))).alias("b"))
    return best.select(key, (-F.col("b.o")).alias("donor"), F.col("b.d").alias("distance"))


def ridge_r2(points: DataFrame, fold: Column, x: Sequence[str], y: str, strength: float, folds: int) -> DataFrame:
    """r2 of ridge regression over the given folds, from sums of products, so only a small matrix for each fold leaves the cluster."""
    import numpy as np

    names = [*x, "__one"]
    rows = points.withColumn("__one", F.lit(1.0)).withColumn("__fold", fold)
    sums = rows.groupBy("__fold").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)], *[F.sum(F.col(a) * F.col(y)).alias(f"v_{i}") for i, a in enumerate(names)], F.sum(F.col(y) * F.col(y)).alias("yy"), F.sum(y).alias("y"), F.count("*").alias("n")).collect()
    k = len(names)
    gram = {r["__fold"]: np.array([[r[f"g_{i}_{j}"] for j in range(k)] for i in range(k)]) for r in sums}
    right = {r["__fold"]: np.array([r[f"v_{i}"] for i in range(k)]) for r in sums}
    error = 0.0
    for r in sums:
        f = r["__fold"]
        g, v = sum(m for h, m in gram.items() if h != f), sum(m for h, m in right.items() if h != f)
        if not isinstance(g, np.ndarray):
            continue
        w = np.linalg.solve(g + strength * np.diag([1.0] * (k - 1) + [0.0]), v)
        error += r["yy"] - 2 * w @ right[f] + w @ gram[f] @ w
    n, total, squares = sum(r["n"] for r in sums), sum(r["y"] for r in sums), sum(r["yy"] for r in sums)
    spread = squares - total * total / n if n else 0.0
    return points.sparkSession.createDataFrame([(float(1 - error / spread) if spread > 0 else 0.0,)], "r2 double")
