"""Queries: roll-ups of cities and tiles, character of cells, assemblies, verdicts and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import percentiles, rollup, selection, stats, verdicts
from quadrille.operators.grid import TILE
from quadrille.plans import evaluate
from quadrille.plans.evaluate import BH_SQL, KS_SQL
from quadrille.plans.feat import SQL, features, read
from quadrille.plans.registry import Registry

query = Registry()
CELL = [*TILE, "cell_i", "cell_j"]

CELLS_SQL = SQL + ", per_cell AS (SELECT city, tile_i, tile_j, cell_i, cell_j, sum(7 + 2 * (w + h))::BIGINT AS tokens, count(*) AS n, count(*) FILTER (WHERE feature_class = 1) AS n_buildings FROM feat GROUP BY ALL)\n"


def per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).groupBy(*CELL).agg(F.sum(7 + 2 * (F.col("w") + F.col("h"))).alias("tokens"), F.count("*").alias("n"), F.count_if(F.col("feature_class") == 1).alias("n_buildings"))


CITIES_SQL = CELLS_SQL + ", cities AS (SELECT city, city % 2 AS morphology, CASE WHEN city < 3 THEN 'low' ELSE 'high' END AS density, CASE city WHEN 3 THEN 'failed' WHEN 4 THEN 'pending' ELSE 'validated' END AS status, sum(tokens)::BIGINT AS tokens, count(DISTINCT tile_i * 4 + tile_j) AS tiles FROM per_cell GROUP BY 1)\n"


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = per_cell(spark, sf_dir).groupBy("city").agg(F.sum("tokens").alias("tokens"), F.countDistinct("tile_i", "tile_j").alias("tiles"))
    return c.select("city", (F.col("city") % 2).alias("morphology"), F.when(F.col("city") < 3, "low").otherwise("high").alias("density"), F.when(F.col("city") == 3, "failed").when(F.col("city") == 4, "pending").otherwise("validated").alias("status"), "tokens", "tiles")


@query(CITIES_SQL + "SELECT city, tokens, tiles, round(tokens::DOUBLE / tiles, 6) AS per_tile FROM cities")
def city_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cities(spark, sf_dir).select("city", "tokens", "tiles", F.round(F.col("tokens") / F.col("tiles"), 6).alias("per_tile"))


@query(CITIES_SQL + "SELECT count(*) AS n_cities, sum(tokens)::BIGINT AS tokens, sum(tiles)::BIGINT AS tiles FROM cities WHERE status = 'validated'")
def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.totals(cities(spark, sf_dir), ["tokens", "tiles"])


@query(CITIES_SQL + "SELECT axis, label, count(*) FILTER (WHERE status = 'validated') AS n FROM (SELECT 'morphology' AS axis, CAST(morphology AS VARCHAR) AS label, status FROM cities UNION ALL SELECT 'density', density, status FROM cities) GROUP BY 1, 2")
def axis_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.axes(cities(spark, sf_dir), ["morphology", "density"])


@query(CITIES_SQL + "SELECT 'failed' AS reason, CAST(city AS VARCHAR) AS what FROM cities WHERE status = 'failed' UNION ALL SELECT 'uncovered', 'density=high'")
def batch_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.blockers(cities(spark, sf_dir), ["morphology", "density"])


@query(CITIES_SQL + "SELECT morphology, count(*) AS n_cities, sum(tokens)::BIGINT AS tokens, round(sum(tokens)::DOUBLE / sum(tiles), 6) AS per_tile, max(tokens) AS most FROM cities WHERE status <> 'failed' GROUP BY 1")
def cost_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cities(spark, sf_dir).where("status <> 'failed'")
    return c.groupBy("morphology").agg(F.count("*").alias("n_cities"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / F.sum("tiles"), 6).alias("per_tile"), F.max("tokens").alias("most"))


@query(CITIES_SQL + ", d AS (SELECT *, CASE WHEN city < 2 THEN tokens * (9 - city) // 10 END AS again FROM cities), s AS (SELECT max(1 - again::DOUBLE / tokens) AS shrink FROM d) SELECT sum(again)::BIGINT AS done, round(sum(CASE WHEN again IS NULL THEN tokens END)::DOUBLE * (1 - any_value(shrink)), 3) AS projected, round(sum(again) + sum(CASE WHEN again IS NULL THEN tokens END)::DOUBLE * (1 - any_value(shrink)), 3) AS total, false AS halt FROM d, s")
def rederive_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cities(spark, sf_dir).withColumn("again", F.expr("CASE WHEN city < 2 THEN tokens * (9 - city) DIV 10 END"))
    return rollup.projection(c, "tokens", "again", 1000).withColumns({k: F.round(k, 3) for k in ("projected", "total")})


@query(SQL + """, s AS (SELECT city, tile_i, tile_j, cell_i, cell_j, list_sort(list((w * h)::DOUBLE) FILTER (WHERE feature_class = 1)) AS a, list_sort(list(w::DOUBLE) FILTER (WHERE feature_class = 0)) AS r FROM feat WHERE feature_class < 2 GROUP BY ALL),
q AS (SELECT *, coalesce(len(a), 0) AS n, CASE WHEN len(a) > 0 THEN list_median(a) END AS m, CASE WHEN len(r) > 0 THEN list_median(r) END AS rm FROM s),
j AS (SELECT *, greatest(1, least(n - 1, (n + 1) // 4)) AS j1, greatest(1, least(n - 1, (3 * (n + 1)) // 4)) AS j3, greatest(1, least(n - 1, (9 * (n + 1)) // 10)) AS j9 FROM q),
c AS (SELECT *, (a[j1] * (4 - ((n + 1) - j1 * 4)) + a[j1 + 1] * ((n + 1) - j1 * 4)) / 4 AS q1, (a[j3] * (4 - (3 * (n + 1) - j3 * 4)) + a[j3 + 1] * (3 * (n + 1) - j3 * 4)) / 4 AS q3, (a[j9] * (10 - (9 * (n + 1) - j9 * 10)) + a[j9 + 1] * (9 * (n + 1) - j9 * 10)) / 10 AS p9 FROM j)
SELECT city, tile_i, tile_j, cell_i, cell_j, round(CASE WHEN n > 0 THEN log10(m) ELSE 0 END, 6) AS area, round(CASE WHEN n >= 2 THEN log10(q3 - q1 + 1) ELSE 0 END, 6) AS spread, round(CASE WHEN n >= 2 THEN log10(p9 / m) ELSE 0 END, 6) AS skew, round(CASE WHEN n > 0 THEN log10(n + 1) ELSE 0 END, 6) AS number,
 round(CASE WHEN rm IS NOT NULL THEN log10(rm + 1) ELSE 0 END, 6) AS length, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS buildings, CASE WHEN rm IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0 END AS roads FROM c""")
def cell_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir).where("feature_class < 2")
    sizes = f.select(*CELL, F.when(F.col("feature_class") == 1, "building").otherwise("road").alias("layer"), F.when(F.col("feature_class") == 1, F.col("w") * F.col("h")).otherwise(F.col("w")).cast("double").alias("size"))
    found = rollup.character(sizes, CELL)
    return found.withColumns({c: F.round(c, 6) for c in ("area", "spread", "skew", "number", "length")})


@query(CELLS_SQL + ", t AS (SELECT city, tile_i, tile_j, sum(n)::BIGINT AS n FROM per_cell GROUP BY ALL), s AS (SELECT city, list_sort(list(n)) AS s FROM t GROUP BY 1) SELECT city, len(s) AS n, s[1] AS least, round(list_median(s), 6) AS middle, s[greatest(1, least(len(s), CAST(ceil(0.99 * len(s)) AS INT)))] AS p99, s[len(s)] AS most, list_sum(s)::BIGINT AS total FROM s")
def tile_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = per_cell(spark, sf_dir).groupBy(*TILE).agg(F.sum("n").alias("n"))
    sums = t.groupBy("city").agg(F.min("n").alias("least"), F.median("n").alias("middle"), F.max("n").alias("most"), F.sum("n").alias("total"))
    return sums.join(percentiles.picks(t, ["city"], F.col("n"), {"p99": percentiles.ceil_rank(99)}), "city").select("city", "n", "least", F.round("middle", 6).alias("middle"), "p99", "most", "total")


@query(SQL + ", e AS (SELECT city, abs(x0 * 1.37::DOUBLE - round_even(x0 * 1.37::DOUBLE / 0.5, 0) * 0.5) AS e FROM feat), s AS (SELECT city, list_sort(list(e)) AS s FROM e GROUP BY 1) SELECT city, len(s) AS n, round(s[CAST(ceil(0.95::DOUBLE * len(s)) AS INT)], 9) AS p95, round(s[CAST(ceil(0.999::DOUBLE * len(s)) AS INT)], 9) AS p999, s[CAST(ceil(0.999::DOUBLE * len(s)) AS INT)] > 0.25 AS beyond FROM s")
def accuracy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a rounding by city, with a gate on the tail."""
    x = F.col("x0") * 1.37
    e = features(spark, sf_dir).select("city", F.abs(x - F.bround(x / 0.5) * 0.5).alias("e"))
    p = percentiles.picks(e, ["city"], percentiles.finite(F.col("e")), {"p95": percentiles.ceil_rank(95), "p999": percentiles.ceil_rank(99.9)})
    return p.select("city", "n", F.round("p95", 9).alias("p95"), F.round("p999", 9).alias("p999"), (F.col("p999") > 0.25).alias("beyond"))


@query(CELLS_SQL + "SELECT city, round(sum(n_buildings)::DOUBLE / count(*), 9) AS per_cell, CASE WHEN sum(n_buildings)::DOUBLE / count(*) >= 0.25 * 4 * (city + 1) THEN 'SCOREABLE' ELSE 'ROADS_ONLY' END AS verdict FROM per_cell GROUP BY 1")
def emergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons to an active cell, against a reference that grows with the city's number."""
    c = per_cell(spark, sf_dir).groupBy("city").agg(F.sum("n_buildings").alias("p"), F.count("*").alias("c"))
    return c.select("city", F.round(F.col("p") / F.col("c"), 9).alias("per_cell"), verdicts.emergence(F.col("p"), F.col("c"), 4.0 * (F.col("city") + 1)).alias("verdict"))


@query(SQL + ", f AS (SELECT feature_class, city, tile_i, tile_j, cell_i, cell_j, count(*) AS n, sum(2 * w) AS v FROM feat GROUP BY ALL), s AS (SELECT feature_class, list_sort(list(n)) AS s, avg(n) AS mean, avg(v) AS vertices FROM f GROUP BY 1), e AS (SELECT *, greatest(1, least(len(s) - 1, (95 * (len(s) + 1)) // 100)) AS j FROM s) SELECT feature_class, len(s) AS n, round(mean, 6) AS mean, round(vertices, 6) AS vertices, round((s[j] * (100 - (95 * (len(s) + 1) - j * 100)) + s[j + 1] * (95 * (len(s) + 1) - j * 100)) / 100.0::DOUBLE, 6) AS p95 FROM e")
def joint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and vertices to a cell by class."""
    f = features(spark, sf_dir).groupBy("feature_class", *CELL).agg(F.count("*").alias("n"), F.sum(2 * F.col("w")).alias("v"))
    means = f.groupBy("feature_class").agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.avg("v"), 6).alias("vertices"))
    return means.join(percentiles.exclusive(f, ["feature_class"], F.col("n"), {"p95": (95, 100)}), "feature_class").withColumn("p95", F.round("p95", 6))


@query(SQL + ", v AS (SELECT feature_class, count(*) AS n, round_even(avg(w), 0) AS m, max(w) AS most FROM feat GROUP BY 1) SELECT feature_class, n, CAST(7 + 2 * (m - 1) AS BIGINT) AS at_mean, CAST(7 + 2 * (most - 1) AS BIGINT) AS at_most, round((SELECT sum((7 + 2 * (m - 1)) * n) / sum(n) FROM v), 6) AS weighted FROM v")
def compound_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a feature with the mean and the greatest number of vertices, and the mean weighted by features."""
    v = features(spark, sf_dir).groupBy("feature_class").agg(F.count("*").alias("n"), F.bround(F.avg("w")).alias("m"), F.max("w").alias("most"))
    cost = lambda c: (7 + 2 * (F.col(c) - 1)).cast("long")
    each = v.select("feature_class", "n", cost("m").alias("at_mean"), cost("most").alias("at_most"))
    whole = each.agg(F.round(F.sum(F.col("at_mean") * F.col("n")) / F.sum("n"), 6).alias("weighted"))
    return each.crossJoin(F.broadcast(whole))


@query("""WITH k AS (SELECT p_brand AS key, CAST(NULL AS VARCHAR) AS value, count(*) FILTER (WHERE p_size < 20) AS ways, count(*) FILTER (WHERE p_size BETWEEN 20 AND 35) AS nodes, count(*) FILTER (WHERE p_size > 35) AS relations, count(*) AS n FROM part GROUP BY 1),
t AS (SELECT sum(ways) AS tw, sum(nodes) AS tn, sum(relations) AS tr FROM k), m AS (SELECT key, CASE WHEN ways >= nodes AND ways >= relations THEN 'ways' WHEN nodes >= relations THEN 'nodes' ELSE 'relations' END AS type, greatest(ways, nodes, relations) AS k FROM k),
v AS (SELECT p_brand AS key, p_type AS value, count(*) AS n FROM part GROUP BY 1, 2)
SELECT key, value, type, round(CASE WHEN value IS NULL THEN m.k ELSE n END::DOUBLE / CASE type WHEN 'ways' THEN tw WHEN 'nodes' THEN tn ELSE tr END, 9) AS share FROM (SELECT key, value, n FROM k UNION ALL SELECT key, value, n FROM v) JOIN m USING (key), t""")
def tag_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    sizes = {"ways": F.col("p_size") < 20, "nodes": F.col("p_size").between(20, 35), "relations": F.col("p_size") > 35}
    keys = part.groupBy(F.col("p_brand").alias("key")).agg(F.lit(None).cast("string").alias("value"), *[F.count_if(c).alias(t) for t, c in sizes.items()], F.count("*").alias("n"))
    values = part.groupBy(F.col("p_brand").alias("key"), F.col("p_type").alias("value")).agg(F.count("*").alias("n"))
    found = rollup.shares_within_type(keys.unionByName(values, allowMissingColumns=True), list(sizes))
    return found.withColumn("share", F.round("share", 9))


@query("SELECT split_part(p_type, ' ', 1) AS key, count(*) AS n, count(*) FILTER (WHERE p_size = 1 OR p_brand LIKE '%5') AS n_sentinel, count(*) FILTER (WHERE p_size = 1 OR p_brand LIKE '%5')::DOUBLE / count(*) >= 0.1 AS flagged FROM part GROUP BY 1")
def unknown_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = (F.col("p_size") == 1) | F.col("p_brand").endswith("5")
    return read(spark, sf_dir, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("key")).agg(F.count("*").alias("n"), F.count_if(odd).alias("n_sentinel"), (F.count_if(odd) / F.count("*") >= 0.1).alias("flagged"))


@query("SELECT c_mktsegment AS key, o_orderpriority AS value, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 > 0 WHERE c_mktsegment IS NOT NULL GROUP BY 1, 2")
def class_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").where("c_custkey % 3 > 0"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.where("c_mktsegment IS NOT NULL").groupBy(F.col("c_mktsegment").alias("key"), F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (WHERE c_custkey IS NULL) AS n_missing, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS n_building, count(*) AS n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 > 0) ON o_custkey = c_custkey WHERE o_orderkey % 5 = 0")
def sentinel_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentinels looked up in a raw source by id; ids that it lacks are counted."""
    o = read(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").join(read(spark, sf_dir, "customer").where("c_custkey % 7 > 0"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.agg(F.count_if(F.col("c_custkey").isNull()).alias("n_missing"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("n_building"), F.count("*").alias("n"))


@query(CELLS_SQL + "SELECT c.city, c.tile_i, c.tile_j, c.cell_i, c.cell_j, tokens, coalesce(b, -1) AS bucket, coalesce(r, 0) AS roads FROM per_cell c LEFT JOIN (SELECT city, tile_i, tile_j, cell_i, cell_j, n_buildings % 4 AS b FROM per_cell WHERE n_buildings > 2) d USING (city, tile_i, tile_j, cell_i, cell_j) LEFT JOIN (SELECT city, tile_i, tile_j, cell_i, cell_j, count(*) AS r FROM feat WHERE feature_class = 0 GROUP BY ALL) e USING (city, tile_i, tile_j, cell_i, cell_j)")
def shard_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = per_cell(spark, sf_dir)
    density = cells.where("n_buildings > 2").select(*CELL, (F.col("n_buildings") % 4).alias("bucket"))
    roads = features(spark, sf_dir).where("feature_class = 0").groupBy(*CELL).agg(F.count("*").alias("roads"))
    return rollup.assembled(cells.select(*CELL, "tokens"), CELL, [(density, {"bucket": -1}), (roads, {"roads": 0})])


@query(SQL + ", m AS (SELECT DISTINCT city, tile_i, tile_j FROM feat), e AS (SELECT city, tile_i, tile_j FROM m WHERE (city + tile_i) % 3 > 0 UNION ALL SELECT city, tile_i, tile_j FROM m WHERE tile_j = 2) SELECT m.city, m.tile_i, m.tile_j, count(e.city) AS n FROM m LEFT JOIN e USING (city, tile_i, tile_j) GROUP BY ALL HAVING count(e.city) <> 1")
def strict_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = features(spark, sf_dir).select(*TILE).distinct()
    return rollup.strict_matches(m, m.where("(city + tile_i) % 3 > 0").unionAll(m.where("tile_j = 2")), TILE)


@query("SELECT k AS c_nationkey, a, b, c FROM (SELECT n_nationkey AS k, n_regionkey AS a FROM nation WHERE n_nationkey <> 3) FULL JOIN (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 6 = 0 THEN 9 ELSE n_regionkey END AS b FROM nation) USING (k) FULL JOIN (SELECT n_nationkey AS k, n_regionkey AS c FROM nation WHERE n_nationkey < 20) USING (k) WHERE a IS DISTINCT FROM b OR b IS DISTINCT FROM c")
def three_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("v"))
    return rollup.three_way(n.where("c_nationkey <> 3"), n.withColumn("v", F.when(F.col("c_nationkey") % 6 == 0, 9).otherwise(F.col("v"))), n.where("c_nationkey < 20"), "c_nationkey", "v")


@query("SELECT 'poi_' || value AS token, CASE WHEN p AND a THEN 'both' WHEN p THEN 'primary' ELSE 'alternate' END AS origin FROM (SELECT value, bool_or(p) AS p, bool_or(NOT p) AS a FROM (SELECT p_brand AS value, true AS p FROM part GROUP BY 1 HAVING count(*) >= 80 UNION ALL SELECT p_brand, false FROM part WHERE p_size > 20 GROUP BY 1 HAVING count(*) >= 48) GROUP BY 1)")
def union_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    kept = lambda df, n: df.groupBy(F.col("p_brand").alias("value")).agg(F.count("*").alias("n")).where(F.col("n") >= n)
    return rollup.union_vocabulary(kept(part, 80), kept(part.where("p_size > 20"), 48), "poi_")


@query(SQL + ", v AS (SELECT tile_i, tile_j, 'a' AS k, 1 AS r, CAST(city AS INT) AS x FROM feat UNION ALL SELECT tile_i, tile_j, 'a', 2, CASE WHEN tile_i = 1 THEN 9 END FROM feat UNION ALL SELECT tile_i, tile_j, 'b', 2, 7 FROM feat WHERE tile_j = 0) SELECT tile_i, tile_j, k AS name, CASE WHEN k = 'b' THEN 7 WHEN tile_i = 1 THEN 9 ELSE 0 END AS value FROM (SELECT DISTINCT tile_i, tile_j, k FROM v)")
def conditioning_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults under what a tile says: a null doesn't hide a default."""
    t = features(spark, sf_dir).select("tile_i", "tile_j").distinct()
    low = t.select("tile_i", "tile_j", F.lit("a").alias("name"), F.lit(0).alias("value"))
    own = t.select("tile_i", "tile_j", F.lit("a").alias("name"), F.when(F.col("tile_i") == 1, 9).alias("value")).unionByName(t.where("tile_j = 0").select("tile_i", "tile_j", F.lit("b").alias("name"), F.lit(7).alias("value")))
    return rollup.overlay((low, 1), (own, 2), key=["tile_i", "tile_j"], name="name", value="value")


RATES_SQL = SQL + ", r AS (SELECT stratum, count(*) AS n, count(*) FILTER (WHERE w > 40)::DOUBLE / count(*) AS rate, CASE WHEN stratum <> 'RF' THEN count(*) FILTER (WHERE w > 42)::DOUBLE / count(*) ELSE 0 END AS faithful FROM feat GROUP BY 1)\n"


@query(RATES_SQL + "SELECT stratum, round(rate, 9) AS rate, round(faithful, 9) AS faithful, rate - faithful > greatest(0.5 * faithful, 0.005) AS over FROM (SELECT stratum, rate, faithful FROM r UNION ALL SELECT NULL, sum(rate * n) / sum(n), sum(faithful * n) / sum(n) FROM r)")
def over_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    rates = f.groupBy("stratum").agg(F.count("*").alias("n"), (F.count_if(F.col("w") > 40) / F.count("*")).alias("rate"))
    faithful = f.where("stratum <> 'RF'").groupBy("stratum").agg((F.count_if(F.col("w") > 42) / F.count("*")).alias("rate"))
    return verdicts.over_emission(rates, faithful, "stratum").withColumns({c: F.round(c, 9) for c in ("rate", "faithful")})


@query(RATES_SQL + "SELECT stratum, round(1 - rate, 9) AS ceiling, round(rate - faithful, 9) AS gap FROM r")
def ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir).groupBy("stratum").agg((F.count_if(F.col("w") > 40) / F.count("*")).alias("r"), F.when(F.col("stratum") != "RF", F.count_if(F.col("w") > 42) / F.count("*")).otherwise(0.0).alias("t"))
    return f.select("stratum", F.round(1 - F.col("r"), 9).alias("ceiling"), F.round(F.col("r") - F.col("t"), 9).alias("gap"))


@query(KS_SQL + ", s2 AS (SELECT a AS city, b AS train, stratum, ks AS own, ks * (1 + (a + b) % 2 * 0.1::DOUBLE) - 0.001 AS trained FROM pairs) SELECT city, train, count(*) AS n, round(median(own), 9) AS own, round(median(trained), 9) AS train_ks, CASE WHEN median(own) < median(trained) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM s2 GROUP BY 1, 2")
def memorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = evaluate.pairs(spark, sf_dir).select(F.col("a").alias("city"), F.col("b").alias("other"), "stratum", F.col("ks").alias("ks_own"), (F.col("ks") * (1 + (F.col("a") + F.col("b")) % 2 * 0.1) - 0.001).alias("ks_train"))
    m = verdicts.memorisation(p, ["city", "other"])
    return m.select("city", F.col("other").alias("train"), "n", F.round("own", 9).alias("own"), F.round("train", 9).alias("train_ks"), "verdict")


@query(BH_SQL + "SELECT a, b, coalesce(string_agg(stratum, ',' ORDER BY stratum) FILTER (WHERE ks >= 0.02 AND p_bh < 0.99), '') AS strata FROM bh GROUP BY 1, 2")
def discriminating_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stats.bh_adjust(evaluate.tested(spark, sf_dir), "p", ["stratum"], ["a", "b"])
    return verdicts.discriminating(p, ["a", "b"], 0.99, 0.02).select("a", "b", F.array_join("strata", ",").alias("strata"))


@query(KS_SQL + "SELECT count(*) AS n, round(median(ks), 9) AS middle, count(*) > 0 AND median(ks) BETWEEN 0.049 AND 0.5 AS sane FROM pairs")
def floor_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.sane(evaluate.pairs(spark, sf_dir)).withColumn("middle", F.round("middle", 9))


SCORES_SQL = SQL + ", sc AS (SELECT 'm' || (stratum = 'RF')::INT || (w % 2) AS model, city, sum(w * (feature_id % 7))::DOUBLE / sum(w) / 10 AS ks, count(*) AS n, 0.001::DOUBLE AS sem FROM feat GROUP BY ALL)\n"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.concat(F.lit("m"), (F.col("stratum") == "RF").cast("int").cast("string"), (F.col("w") % 2).cast("string"))
    return features(spark, sf_dir).groupBy(model.alias("model"), "city").agg((F.sum(F.col("w") * (F.col("feature_id") % 7)).cast("double") / F.sum("w") / 10).alias("ks"), F.count("*").alias("n"), F.lit(0.001).alias("sem"))


@query(SCORES_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY ks, model) AS r, avg(ks) OVER (PARTITION BY city) AS mean FROM sc),
c AS (SELECT city, mean, max(model) FILTER (WHERE r = 1) AS winner, max(model) FILTER (WHERE r = 2) AS runner_up, max(ks) FILTER (WHERE r = 2) - max(ks) FILTER (WHERE r = 1) AS gap, greatest(1.358 / sqrt(max(n) FILTER (WHERE r = 1)), 0.001) AS floor FROM r GROUP BY 1, 2),
p AS (SELECT *, gap > floor AS decisive, row_number() OVER (ORDER BY mean DESC, city) AS place FROM c)
SELECT city, winner, runner_up, round(gap, 9) AS gap, round(floor, 9) AS floor, place, decisive, coalesce(place = (SELECT min(place) FROM p WHERE decisive), false) AS binds FROM p""")
def binding_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = verdicts.binding(scores(spark, sf_dir))
    return b.select("city", "winner", "runner_up", F.round("gap", 9).alias("gap"), F.round("floor", 9).alias("floor"), F.col("place").cast("long").alias("place"), "decisive", "binds")


@query(SCORES_SQL + ", e AS (SELECT model AS m, avg(ks) AS mean, stddev_pop(ks) AS spread FROM sc WHERE city <> 2 GROUP BY 1) SELECT x.m AS a, y.m AS b, round(x.mean - y.mean, 9) AS difference, round(greatest(x.spread, y.spread), 9) AS noise, abs(x.mean - y.mean) >= greatest(x.spread, y.spread) AS decisive FROM e x JOIN e y ON x.m < y.m")
def seed_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdicts.seed_noise(scores(spark, sf_dir), "model", "ks", F.col("city") != 2)
    return found.withColumns({c: F.round(c, 9) for c in ("difference", "noise")})


@query(CELLS_SQL + "SELECT city, CAST(ceil(300 * 1.25::DOUBLE * count(*) / sum(n_buildings)) AS BIGINT) AS wanted, least(CAST(ceil(300 * 1.25::DOUBLE * count(*) / sum(n_buildings)) AS BIGINT), count(*)) AS selected, CAST(ceil(300 * 1.25::DOUBLE * count(*) / sum(n_buildings)) AS BIGINT) > count(*) AS ceiling FROM per_cell GROUP BY 1")
def stratum_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = per_cell(spark, sf_dir).groupBy("city").agg(F.count("*").alias("available"), F.sum("n_buildings").alias("floor_n"))
    return c.select("city", verdicts.stratum_size(F.lit(300), 1.25, F.col("floor_n"), F.col("available")).alias("s")).select("city", "s.*")


@query(SQL + "SELECT city, stratum, CASE WHEN bool_or(feature_class = 1 AND w > 48) THEN 'building_area' ELSE 'road_length' END AS metric FROM feat GROUP BY 1, 2")
def binding_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    owed = features(spark, sf_dir).select("city", "stratum", F.when((F.col("feature_class") == 1) & (F.col("w") > 48), "building_area").otherwise("road_length").alias("metric"))
    return verdicts.binding_metric(owed, ["city", "stratum"], "building_area", "road_length")


@query(CELLS_SQL + """, t AS (SELECT city, tile_i, tile_j, (n_buildings % 3)::INT AS class, count(*) AS cells FROM per_cell GROUP BY ALL), u AS (SELECT *, dense_rank() OVER (PARTITION BY city ORDER BY tile_i, tile_j) AS place FROM t),
s AS (SELECT class, place, sum(sum(cells)) OVER (PARTITION BY class ORDER BY place) AS total FROM u GROUP BY 1, 2), f AS (SELECT * FROM (VALUES (0, 40), (1, 200), (2, 100000)) v(class, least))
SELECT f.class, min(place) FILTER (WHERE total >= least) AS needed FROM f LEFT JOIN s USING (class) GROUP BY 1""")
def quota_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of each city that are needed until the cells of a class reach their floor; one floor is out of reach."""
    t = per_cell(spark, sf_dir).groupBy(*TILE, (F.col("n_buildings") % 3).cast("int").alias("class")).agg(F.count("*").alias("cells"))
    floors = spark.createDataFrame([(0, 40), (1, 200), (2, 100000)], "class int, least int")
    return verdicts.quota_needed(t, ["city"], ["tile_i", "tile_j"], "class", "cells", floors)


@query(SQL + "SELECT feature_id, CAST(least(floor(y0 / 250 * 16), 15) AS INT) AS ratio, CASE WHEN w > 45 THEN 0 ELSE 1 + (w * h > 10)::INT + (w * h > 20)::INT + (w * h > 40)::INT + (w * h > 80)::INT + (w * h > 160)::INT + (w * h > 320)::INT + (w * h > 640)::INT + (w * h > 1280)::INT + (w * h > 2560)::INT END AS size FROM feat")
def stratum_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = F.when(F.col("w") <= 45, F.col("w") * F.col("h"))
    return features(spark, sf_dir).select("feature_id", verdicts.ratio_bucket(F.col("y0") / 250, 16).alias("ratio"), verdicts.size_bucket(area).alias("size"))


@query(SQL + ", b AS (SELECT feature_id, w / 100.0::DOUBLE AS v, CASE WHEN w < 5 THEN 0 WHEN w < 15 THEN 1 WHEN w <= 35 THEN 2 ELSE 3 END AS stored FROM feat) SELECT feature_id, v, stored FROM b WHERE stored <> CASE WHEN v < 0.05 THEN 0 WHEN v < 0.15 THEN 1 WHEN v < 0.35 - 1e-12 THEN 2 ELSE 3 END AND abs(v - 0.35) > 1e-9")
def bucket_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored buckets that a value near an edge doesn't excuse; empty if there is none."""
    b = features(spark, sf_dir).select("feature_id", (F.col("w") / 100.0).alias("v"), F.when(F.col("w") < 5, 0).when(F.col("w") < 15, 1).when(F.col("w") <= 35, 2).otherwise(3).alias("stored"))
    return b.where(~verdicts.bucket_matches(F.col("stored"), F.col("v"), [0, 0.05, 0.15, 0.35]))


@query("""WITH d AS (SELECT user_id % 4 AS c, event_id % 3 AS k, CASE WHEN event_id % 10 < 6 + user_id % 4 THEN 1 WHEN event_id % 10 = 9 THEN 0 ELSE -1 END AS delta FROM events), n AS (SELECT c, k, count(*) FILTER (WHERE delta > 0) AS p, count(*) FILTER (WHERE delta < 0) AS m FROM d GROUP BY 1, 2),
t AS (SELECT *, least(1.0, 2 * list_sum(list_transform(range(greatest(p, m), p + m + 1), lambda i: exp(lgamma(p + m + 1) - lgamma(i + 1) - lgamma(p + m - i + 1) - (p + m) * ln(2))))) AS pv FROM n)
SELECT c, count(*) FILTER (WHERE pv < 0.01 AND p > m) AS n_pass, count(*) FILTER (WHERE pv < 0.01 AND p > m) >= 2 AS steers FROM t GROUP BY 1""")
def steering(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id") % 10
    d = read(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("c"), (F.col("event_id") % 3).alias("k"), F.when(e < 6 + F.col("user_id") % 4, 1).when(e == 9, 0).otherwise(-1).alias("delta"))
    return verdicts.steers(d, "c", "k", 1)


@query(SQL + ", u AS (SELECT DISTINCT city, tile_i, tile_j FROM feat) SELECT city, tile_i, tile_j, (row_number() OVER (ORDER BY city, tile_i, tile_j) - 1) % 8 AS part FROM u")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.round_robin(features(spark, sf_dir).select(*TILE).distinct(), TILE, 8)


@query(SQL + """, c AS (SELECT city, feature_id, [tile_i, tile_j, feature_class, h] AS p, w FROM feat WHERE w > 48 AND h < 4), k AS (SELECT city, min(feature_id) AS feature_id, p FROM c GROUP BY city, p),
d AS (SELECT a.feature_id, b.feature_id AS o, list_sum(list_transform(range(1, 5), lambda i: (a.p[i] <> b.p[i])::INT))::INT AS d FROM k a JOIN k b ON a.city = b.city AND a.feature_id <> b.feature_id)
SELECT feature_id, arg_max(o, d * 10000000 - o) AS donor, max(d) AS distance FROM d GROUP BY 1""")
def farthest_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = features(spark, sf_dir).where("w > 48 AND h < 4").select("city", "feature_id", F.array("tile_i", "tile_j", "feature_class", "h").alias("p"))
    one = c.groupBy("city", "p").agg(F.min("feature_id").alias("feature_id"))
    return verdicts.farthest_donor(one, "city", "feature_id", "p")


@query()
def scaling_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slope's interval over resamples; which are drawn is a matter of the hash, so a test has the plain form."""
    by = features(spark, sf_dir).groupBy(F.col("w").alias("x")).agg(F.sum("h").cast("double").alias("y"))
    return verdicts.bootstrap_slopes(by, "x", "y", 200, 7)


@query()
def ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size explained by place and class over five folds; a test has the plain form."""
    f = features(spark, sf_dir).select("feature_id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "h")], (F.col("h") * 3 + F.col("w") / 50 + F.col("x0") / 100).alias("y"))
    return verdicts.ridge_r2(f, F.col("feature_id") % 5, ["x0", "y0", "h"], "y", 1.0, 5)


@query()
def token_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each document compresses; a test has the plain form."""
    d = read(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    return d.select("source", "doc_id", F.round(rollup.redundancy(F.col("b")), 9).alias("redundancy"))
