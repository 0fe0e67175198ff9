"""Queries: distribution comparisons, tests, selections, hold-outs and set checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import selection, sets, stats
from quadrille.operators.grid import TILE
from quadrille.plans.feat import SQL, features, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that it must agree with."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


KS_SQL = SQL + """, s AS (SELECT stratum, city, w AS v FROM feat),
c AS (SELECT stratum, city, v, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT stratum, city, count(*) AS total FROM s GROUP BY ALL),
steps AS (SELECT t.stratum, t.city, u.v, t.total, sum(coalesce(n, 0)) OVER (PARTITION BY t.stratum, t.city ORDER BY u.v ROWS UNBOUNDED PRECEDING)::DOUBLE / t.total AS share
  FROM t JOIN (SELECT DISTINCT stratum, v FROM s) u ON u.stratum = t.stratum LEFT JOIN c ON c.stratum = t.stratum AND c.city = t.city AND c.v = u.v),
pairs AS (SELECT a.stratum, a.city AS a, b.city AS b, any_value(a.total) AS n_a, any_value(b.total) AS n_b, max(abs(a.share - b.share)) AS ks FROM steps a JOIN steps b ON a.stratum = b.stratum AND a.v = b.v AND a.city < b.city GROUP BY ALL),
lam AS (SELECT *, (sqrt(n_a::DOUBLE * n_b / (n_a + n_b)) + 0.12 + 0.11 / sqrt(n_a::DOUBLE * n_b / (n_a + n_b))) * ks AS l FROM pairs),
p AS (SELECT stratum, a, b, n_a, n_b, ks, greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * l * l))))) AS p FROM lam)
"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ks_pairs(features(spark, sf_dir), ["stratum"], "city", "w")


def tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).withColumn("p", stats.ks_pvalue(F.col("ks"), F.col("n_a").cast("double"), F.col("n_b").cast("double")))


@query(KS_SQL + "SELECT * FROM pairs")
def ks_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir)


@query(KS_SQL + "SELECT stratum, a, b, round(p, 9) AS p FROM p")
def ks_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tested(spark, sf_dir).select("stratum", "a", "b", F.round("p", 9).alias("p"))


BH_SQL = KS_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY p, a, b) AS k, count(*) OVER (PARTITION BY stratum) AS m FROM p),
bh AS (SELECT stratum, a, b, ks, least(1.0, min(p * m / k) OVER (PARTITION BY stratum ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS p_bh FROM r)
"""


@query(BH_SQL + "SELECT stratum, a, b, round(p_bh, 9) AS p_bh FROM bh")
def bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bh_adjust(tested(spark, sf_dir), "p", ["stratum"], ["a", "b"]).select("stratum", "a", "b", F.round("p_bh", 9).alias("p_bh"))


@query(KS_SQL + """, r AS (SELECT *, row_number() OVER (ORDER BY p, stratum, a, b) AS k, count(*) OVER () AS m FROM p),
bh AS (SELECT stratum, ks, least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) < 0.9 AND ks >= 0.01 AS s FROM r),
v AS (SELECT stratum, count(*) AS n_pairs, count(*) FILTER (WHERE s) AS n_significant FROM bh GROUP BY 1 UNION ALL SELECT NULL, count(*), count(*) FILTER (WHERE s) FROM bh UNION ALL SELECT 'none', 0, 0)
SELECT *, CASE WHEN n_pairs = 0 THEN 'UNSUPPORTED' WHEN n_significant > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM v""")
def discrimination_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values adjusted over the pairs of all strata; a stratum without a pair is among those asked for."""
    asked = features(spark, sf_dir).select("stratum").distinct().unionByName(spark.range(1).select(F.lit("none").alias("stratum")))
    return stats.discrimination(stats.bh_adjust(tested(spark, sf_dir), "p", [], ["stratum", "a", "b"]), asked, "stratum", 0.9, 0.01)


@query(KS_SQL + "SELECT stratum, a, b, round(1.358 * sqrt((n_a + n_b)::DOUBLE / (n_a::DOUBLE * n_b)), 9) AS critical FROM pairs")
def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("stratum", "a", "b", F.round(stats.ks_critical(F.col("n_a").cast("double"), F.col("n_b").cast("double")), 9).alias("critical"))


@query(KS_SQL + """SELECT member, stratum, min(ks) FILTER (WHERE other IN (0, 1, 2)) AS least, round(median(ks) FILTER (WHERE other IN (0, 1, 2)), 9) AS middle, min(ks) AS least_cross, round(median(ks), 9) AS middle_cross
FROM (SELECT a AS member, b AS other, stratum, ks FROM pairs UNION ALL SELECT b, a, stratum, ks FROM pairs) WHERE member IN (0, 1, 2) GROUP BY ALL""")
def floors_min_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.pair_floors(pairs(spark, sf_dir), [0, 1, 2], ["stratum"])
    return found.withColumns({c: F.round(c, 9) for c in ("middle", "middle_cross")})


@query(KS_SQL + "SELECT d AS delta, count(ks) AS n FROM (VALUES (0.01), (0.02), (0.03), (0.05)) v(d) LEFT JOIN pairs ON ks >= d GROUP BY 1".replace("d AS delta", "d::DOUBLE AS delta"))
def delta_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    deltas = [0.01, 0.02, 0.03, 0.05]
    one = p.agg(*[F.count_if(F.col("ks") >= d).alias(f"n{k}") for k, d in enumerate(deltas)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(d).alias("delta"), F.col(f"n{k}").alias("n")) for k, d in enumerate(deltas)])).alias("e")).select("e.delta", "e.n")


PER_CITY_SQL = SQL + """, c AS (SELECT city, w AS v, count(*) FILTER (WHERE stratum = 'RF') AS x, count(*) FILTER (WHERE stratum <> 'RF') AS y FROM feat GROUP BY ALL),
s AS (SELECT city, sum(x) OVER w AS cx, sum(y) OVER w AS cy, sum(x) OVER (PARTITION BY city) AS nx, sum(y) OVER (PARTITION BY city) AS ny FROM c WINDOW w AS (PARTITION BY city ORDER BY v ROWS UNBOUNDED PRECEDING)),
k AS (SELECT city, any_value(nx)::BIGINT AS n_left, any_value(ny)::BIGINT AS n_right, coalesce(max(abs(cx::DOUBLE / nx - cy::DOUBLE / ny)), 1.0) AS ks FROM s GROUP BY 1)
"""


def per_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ks_two(features(spark, sf_dir), F.col("stratum") == "RF", F.col("w"), ["city"])


@query(PER_CITY_SQL + "SELECT * FROM k")
def per_city_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_city(spark, sf_dir)


@query(PER_CITY_SQL + "SELECT city, ks, 0.01 AS floor, greatest(0.0, ks - 0.01::DOUBLE) AS excess FROM k".replace("0.01 AS floor", "0.01::DOUBLE AS floor"))
def lane_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = per_city(spark, sf_dir)
    return stats.excess(scores, scores.select("city", F.lit(0.01).alias("floor")), ["city"])


@query(PER_CITY_SQL + "SELECT city, ks FROM k ORDER BY ks DESC, city LIMIT 1")
def worst_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.top(per_city(spark, sf_dir).select("city", "ks"), 1, F.desc("ks"), "city")


PAIRED_SQL = """WITH d AS (SELECT a.k, a.user_id % 50 AS seed, max(CASE WHEN arm = 'a' THEN v END) - max(CASE WHEN arm = 'b' THEN v END) AS delta FROM (
  SELECT user_id, user_id % 3 AS k, CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' END AS arm, CAST(floor(value) AS INT) AS v FROM events) a GROUP BY ALL HAVING delta IS NOT NULL)
"""


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("k"), (F.col("user_id") % 50).alias("seed"), "event_type", F.floor("value").cast("int").alias("v"))
    return stats.paired(e, "event_type", ("click", "view"), "seed", "v", ["k"])


@query(PAIRED_SQL + "SELECT k, seed, delta FROM d")
def paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas(spark, sf_dir)


@query(PAIRED_SQL + """, r AS (SELECT k, delta, rank() OVER (PARTITION BY k ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY k, abs(delta)) - 1) / 2.0::DOUBLE AS r FROM d WHERE delta <> 0)
SELECT k, count(r) AS n, round(coalesce(sum(sign(r.delta) * r) / sum(r), 0), 9) AS r FROM (SELECT DISTINCT k FROM d) LEFT JOIN r USING (k) GROUP BY 1""")
def rank_biserial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rank_biserial(deltas(spark, sf_dir), ["k"]).withColumn("r", F.round("r", 9))


@query(PAIRED_SQL + """, c AS (SELECT k, count(*) FILTER (WHERE delta <> 0) AS n, count(*) FILTER (WHERE delta > 0) AS n_positive FROM d GROUP BY 1)
SELECT k, n, n_positive, round(list_sum(list_transform(range(n_positive, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))), 9) AS p_one,
 round(least(1.0, 2 * list_sum(list_transform(range(greatest(n_positive, n - n_positive), n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))), 9) AS p_two FROM c""")
def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sign_test(deltas(spark, sf_dir), ["k"]).withColumns({c: F.round(c, 9) for c in ("p_one", "p_two")})


@query("""WITH c AS (SELECT user_id % 2 AS k, count(*) AS n, count(*) FILTER (WHERE event_id % 100 < 49) AS n_positive FROM (SELECT e.event_id * 10 + x AS event_id, user_id FROM events e, range(5) r(x)) GROUP BY 1)
SELECT k, n, n_positive, round(list_sum(list_transform(range(n_positive, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))), 6) AS p_one FROM c""")
def sign_test_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of coins, of which the first term alone is far below the least number that a double has."""
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 2).alias("k"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("x"), "event_id")
    d = e.select("k", F.when((F.col("event_id") * 10 + F.col("x")) % 100 < 49, 1).otherwise(-1).alias("delta"))
    return stats.sign_test(d, ["k"]).select("k", "n", "n_positive", F.round("p_one", 6).alias("p_one"))


@query("SELECT event_type, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem, round(stddev_pop(v), 6) AS spread FROM (SELECT event_type, floor(value) AS v FROM events) GROUP BY 1")
def seed_mean_sem(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", F.floor("value").alias("v"))
    return stats.seed_summary(e, ["event_type"], "v").withColumns({c: F.round(c, 6) for c in ("mean", "sem", "spread")})


@query(SQL + "SELECT round(regr_slope(ln(y), ln(x)), 6) AS slope, round(regr_intercept(ln(y), ln(x)), 6) AS intercept FROM (SELECT w AS x, sum(h)::DOUBLE AS y FROM feat GROUP BY 1)")
def scaling_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = features(spark, sf_dir).groupBy(F.col("w").alias("x")).agg(F.sum("h").cast("double").alias("y"))
    return stats.log_fit(by, "x", "y").select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


TILES_SQL = SQL + ", tiles AS (SELECT city, tile_i, tile_j, count(*) AS n, count(*) FILTER (WHERE feature_class = 0) AS roads FROM feat GROUP BY ALL)\n"


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).groupBy(*TILE).agg(F.count("*").alias("n"), F.count_if(F.col("feature_class") == 0).alias("roads"))


@query(TILES_SQL + "SELECT city, tile_i, tile_j, n FROM tiles WHERE n > 0 ORDER BY n DESC, city, tile_i, tile_j LIMIT 12")
def topk_densest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.top(tiles(spark, sf_dir).where("n > 0").drop("roads"), 12, F.desc("n"), *TILE)


@query(TILES_SQL + "SELECT city, tile_i, tile_j, place FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY tile_i, tile_j) AS place FROM tiles) WHERE place <= 3")
def stratum_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.quota(tiles(spark, sf_dir), 3, ["city"], ["tile_i", "tile_j"]).select(*TILE, F.col("place").cast("long").alias("place"))


@query(TILES_SQL + "SELECT city, count(*) AS n_taken, 20 - count(*) AS short FROM tiles GROUP BY 1 HAVING count(*) < 20".replace("count(*) AS n_taken", "least(count(*), 20) AS n_taken"))
def quota_shortfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiles(spark, sf_dir)
    return selection.shortfalls(t, selection.quota(t, 20, ["city"], ["tile_i", "tile_j"]), 20, ["city"])


@query(TILES_SQL + "SELECT city, tile_i, tile_j FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY sha256('7:' || city || ':' || tile_i || ':' || tile_j)) AS r FROM tiles) WHERE r <= 4")
def hash_rank_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.hash_sample(tiles(spark, sf_dir), 4, "7", TILE, ["city"]).select(*TILE)


@query()
def blake_rank_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample in the order of the digest that manifests are made by; SQL has no such digest, a test has."""
    return selection.blake_sample(tiles(spark, sf_dir).select(*TILE), 12, "7", TILE)


@query(TILES_SQL + "SELECT city, tile_i, tile_j, CASE WHEN row_number() OVER (ORDER BY sha256('7:' || city || ':' || tile_i || ':' || tile_j)) <= greatest(1, round_even((SELECT count(*) FROM tiles) * 0.1, 0)) THEN 'val' ELSE 'train' END AS part FROM tiles")
def split_train_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.split(tiles(spark, sf_dir).select(*TILE), TILE, 0.1, "7")


@query(TILES_SQL + "SELECT city, tile_i, tile_j, n FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY n DESC, tile_i, tile_j) AS r FROM tiles) WHERE r = 1")
def representative_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.best_per(tiles(spark, sf_dir), ["city"], F.col("n"), ["tile_i", "tile_j"]).select(*TILE, "n")


@query(SQL + ", c AS (SELECT city, stratum, count(*) AS n, min(feature_id) AS f FROM feat GROUP BY ALL) SELECT city, stratum, n FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY n DESC, f) AS r FROM c) WHERE r = 1")
def mode_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.first_mode(features(spark, sf_dir), ["city"], "stratum", "feature_id")


@query("""WITH h AS (SELECT c_mktsegment, c_custkey, sha256('d:' || c_custkey) AS h FROM customer)
SELECT c_mktsegment, c_custkey, nullif(coalesce(lead(c_custkey) OVER w, first_value(c_custkey) OVER w), c_custkey) AS donor FROM h WINDOW w AS (PARTITION BY c_mktsegment ORDER BY h, c_custkey)""")
def bucket_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.donors(read(spark, sf_dir, "customer"), ["c_mktsegment"], "c_custkey", "d")


@query(TILES_SQL + "SELECT city, tile_i, tile_j FROM tiles WHERE NOT (city = 1 OR city = 2 AND tile_i = 0)")
def anti_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiles(spark, sf_dir).select(*TILE)
    return sets.without(t, t.where("city = 1 OR city = 2 AND tile_i = 0"), TILE)


@query(TILES_SQL + """SELECT city, tile_i, tile_j, 'tile' AS reason FROM tiles WHERE tile_j = 1 AND tile_i = 0 AND city <> 3
UNION ALL SELECT NULL, tile_i, tile_j, 'null' FROM tiles WHERE tile_j = 1 AND city = 3 UNION ALL SELECT city, tile_i, tile_j, 'city' FROM tiles WHERE tile_j = 1 AND city = 4""")
def leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiles(spark, sf_dir).select(*TILE)
    lineage = t.where("tile_j = 1").withColumn("city", F.expr("nullif(city, 3)"))
    return sets.leaks(lineage, t.where("tile_i = 0"), TILE, "city", [4])


@query("""SELECT * FROM (SELECT o_orderpriority, o_orderstatus, greatest(count(*) FILTER (WHERE o_orderkey % 2 = 0) - count(*) FILTER (WHERE o_orderkey % 2 = 1), 0) AS missing, greatest(count(*) FILTER (WHERE o_orderkey % 2 = 1) - count(*) FILTER (WHERE o_orderkey % 2 = 0), 0) AS extra FROM orders GROUP BY 1, 2) WHERE missing > 0 OR extra > 0""")
def bag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return sets.bag_difference(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_orderpriority"], "o_orderstatus")


@query("SELECT k, CASE WHEN a IS NULL THEN 'right' ELSE 'left' END AS side FROM (SELECT DISTINCT o_custkey AS k, 1 AS a FROM orders) FULL JOIN (SELECT DISTINCT c_custkey AS k, 1 AS b FROM customer WHERE c_acctbal > 0) USING (k) WHERE a IS NULL OR b IS NULL")
def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.set_differences(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), ["k"])


@query(SQL + "SELECT city, tile_i, tile_j, 64 - count(*) AS n_missing, count(*) FILTER (WHERE n > 1) AS n_double FROM (SELECT city, tile_i, tile_j, cell_i, cell_j, count(*) AS n FROM feat GROUP BY ALL) GROUP BY ALL HAVING n_missing > 0 OR n_double > 0")
def coverage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.uncovered(features(spark, sf_dir))


@query("SELECT c_nationkey, c_mktsegment, avg(c_custkey) AS mean, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())")
def axis_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.groupingSets([[F.col("c_nationkey")], [F.col("c_mktsegment")], []], F.col("c_nationkey"), F.col("c_mktsegment")).agg(F.avg("c_custkey").alias("mean"), F.count("*").alias("n"))


@query("""WITH t AS (SELECT c_nationkey AS k, c_nationkey % 5 AS g, count(*) AS n FROM customer GROUP BY 1)
SELECT a.k, a.n, median(b.n) AS peers, a.n < 0.95 * median(b.n) OR a.n > 1.05 * median(b.n) AS outlier FROM t a JOIN t b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2 HAVING count(*) >= 2""")
def peer_median_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each against the others of its group, members squared: for cities, which are tens, not for their rows."""
    t = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n")).withColumn("g", F.col("k") % 5)
    other = t.select("g", F.col("k").alias("k2"), F.col("n").alias("n2"))
    found = t.join(other, "g").where("k <> k2").groupBy("k", "n").agg(F.median("n2").alias("peers"), F.count("*").alias("m")).where("m >= 2")
    return found.select("k", "n", "peers", ((F.col("n") < 0.95 * F.col("peers")) | (F.col("n") > 1.05 * F.col("peers"))).alias("outlier"))
