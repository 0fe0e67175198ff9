"""Queries: graphs of roads, rings, projections, sealed and re-read artefacts, gates on what a sample can resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille import sinks
from quadrille.operators import geometry, graph, policy, rollup, selection, sets, tokens, verdicts
from quadrille.operators.grid import TILE
from quadrille.operators.spatial import point
from quadrille.plans import evaluate, measures
from quadrille.plans.evaluate import KS_SQL
from quadrille.plans.feat import SQL, features, read
from quadrille.plans.registry import Registry
from quadrille.sources import tables

query = Registry()

#: Edges of a tile's interior cells: to the right where a long road is, down where another one is.
EDGES_SQL = SQL + """, raw AS (SELECT city, tile_i, tile_j, cell_i AS ai, cell_j AS aj, cell_i + (h % 2) AS bi, cell_j + 1 - (h % 2) AS bj FROM feat WHERE feature_class = 0 AND w > 46),
e AS (SELECT DISTINCT city, tile_i, tile_j, ai * 8 + aj AS a, bi * 8 + bj AS b FROM raw WHERE least(ai, aj, bi, bj) >= 1 AND greatest(ai, aj, bi, bj) <= 6)
"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir).where("feature_class = 0 AND w > 46")
    return graph.interior(f.select(*TILE, F.col("cell_i").alias("ai"), F.col("cell_j").alias("aj"), (F.col("cell_i") + F.col("h") % 2).alias("bi"), (F.col("cell_j") + 1 - F.col("h") % 2).alias("bj")))


@query(EDGES_SQL + "SELECT * FROM e")
def road_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


@query(EDGES_SQL + ", d AS (SELECT city, tile_i, tile_j, node, count(*) AS k FROM (SELECT city, tile_i, tile_j, unnest([a, b]) AS node FROM e) GROUP BY ALL) SELECT city, tile_i, tile_j, count(*) AS n_nodes, round(count(*) FILTER (WHERE k >= 2)::DOUBLE / count(*), 9) AS share FROM d GROUP BY ALL")
def road_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.continuity(edges(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query(EDGES_SQL.replace("WITH feat", "WITH RECURSIVE feat") + """, ends AS (SELECT city, tile_i, tile_j, a, b FROM e UNION SELECT city, tile_i, tile_j, b, a FROM e), reach AS (SELECT city, tile_i, tile_j, a AS n, a AS r FROM ends UNION SELECT x.city, x.tile_i, x.tile_j, y.b, x.r FROM reach x JOIN ends y ON x.city = y.city AND x.tile_i = y.tile_i AND x.tile_j = y.tile_j AND x.n = y.a),
root AS (SELECT city, tile_i, tile_j, n, min(r) AS root FROM reach GROUP BY ALL), c AS (SELECT e.city, e.tile_i, e.tile_j, root, count(*) AS k FROM e JOIN root t ON t.city = e.city AND t.tile_i = e.tile_i AND t.tile_j = e.tile_j AND t.n = e.a GROUP BY ALL)
SELECT city, tile_i, tile_j, sum(k)::BIGINT AS n_edges, max(k) AS n_giant, round(max(k)::DOUBLE / sum(k), 9) AS share FROM c GROUP BY ALL""")
def giant_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph.giant_component(edges(spark, sf_dir))
    return g.select(*TILE, F.col("n_edges").cast("long").alias("n_edges"), F.col("n_giant").cast("long").alias("n_giant"), F.round("share", 9).alias("share"))


@query(SQL + "SELECT feature_id, '(' || x0 || ' ' || y0 || ') (' || (x0 + w) || ' ' || y0 || ') (' || (x0 + w) || ' ' || (y0 + h) || ') (' || x0 || ' ' || (y0 + h) || ') (' || x0 || ' ' || y0 || ')' AS ring FROM feat")
def canonical_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes given clockwise from another corner, in their one form."""
    x, y, w, h = (F.col(c).cast("double") for c in ("x0", "y0", "w", "h"))
    ring = F.array(point(x + w, y + h), point(x + w, y), point(x, y), point(x, y + h), point(x + w, y + h))
    f = features(spark, sf_dir).select("feature_id", geometry.canonical_ring(ring).alias("r"))
    return f.select("feature_id", F.array_join(F.transform("r", lambda p: F.concat(F.lit("("), p["x"].cast("string"), F.lit(" "), p["y"].cast("string"), F.lit(")"))), " ").alias("ring"))


@query(SQL + "SELECT feature_class, count(*) AS n, count(*) FILTER (WHERE feature_class = 1 AND h > 2) AS n_promoted FROM feat GROUP BY 1")
def promoted_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed rings of blocks with a building's token become polygons; others stay lines."""
    x, y, w, h = (F.col(c).cast("double") for c in ("x0", "y0", "w", "h"))
    end = F.when(F.col("h") > 2, 0.0).otherwise(1.0)
    ring = F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h), point(x, y + end))
    f = features(spark, sf_dir).select("feature_class", geometry.closed(ring).alias("closed"), F.arrays_overlap(F.array(F.col("feature_class")), F.array(F.lit(1), F.lit(9))).alias("building"))
    return f.groupBy("feature_class").agg(F.count("*").alias("n"), F.count_if(F.col("closed") & F.col("building")).alias("n_promoted"))


@query(SQL + "SELECT city, count(*) AS n, count(*) FILTER (WHERE w % 3 > 0) AS n_ended FROM feat GROUP BY 1")
def terminated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("w") % 3 > 0, F.array("w", "h")).otherwise(F.array().cast("array<int>"))
    f = features(spark, sf_dir).select("city", tokens.terminated(t).alias("t"))
    return f.groupBy("city").agg(F.count("*").alias("n"), F.count_if(F.try_element_at("t", F.lit(-1)) == tokens.CELL_END).alias("n_ended"))


@query("SELECT p_partkey, CASE split_part(p_type, ' ', 1) WHEN 'STANDARD' THEN 1 WHEN 'SMALL' THEN 2 ELSE 200 END AS token_id FROM part")
def resolved_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag's own id, else that of its key's unknown."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("building="), F.split_part("p_type", F.lit(" "), F.lit(1))).alias("tag"))
    vocabulary = spark.createDataFrame([("building=STANDARD", 1), ("building=SMALL", 2), ("<unknown_building>", 200)], "tag string, id int")
    return policy.resolved_tag(p, vocabulary).select("p_partkey", "token_id")


@query("SELECT n_regionkey, 5::BIGINT AS n_rows, 6::BIGINT AS n_now FROM nation WHERE n_regionkey = 2 GROUP BY 1")
def broken_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sealed table into which a row came afterwards."""
    n, path = read(spark, sf_dir, "nation"), sinks.scratch(spark, "sealed")
    sinks.seal(n, path, ["n_regionkey"])
    n.where("n_regionkey = 2").limit(1).write.mode("append").parquet(f"{path}/data")
    return sinks.unsealed(spark, path, ["n_regionkey"])


@query("SELECT count(*) AS n_rows, count(*) * 200 AS n_bytes, count(*) * 200 > 1000000 AS too_large FROM orders")
def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.estimate(read(spark, sf_dir, "orders")).withColumn("too_large", F.col("n_bytes") > 1_000_000)


LON, LAT = "(c_custkey % 60 - 30) / 10.0", "(c_custkey % 70) + 0.25"
TM_SQL = f"""WITH k AS (SELECT c_custkey, radians(({LON})::DOUBLE) AS lam, radians(({LAT})::DOUBLE) AS phi, (1 / 298.257222101::DOUBLE) / (2 - 1 / 298.257222101::DOUBLE) AS n FROM customer),
t AS (SELECT *, sinh(atanh(sin(phi)) - 2 * sqrt(n) / (1 + n) * atanh(2 * sqrt(n) / (1 + n) * sin(phi))) AS t FROM k), c AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t),
s AS (SELECT *, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1, 13 * n * n / 48 - 3 * n * n * n / 5 AS a2, 61 * n * n * n / 240 AS a3, 6378137.0::DOUBLE / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS r FROM c)
SELECT c_custkey, round(0.9996 * r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) + 500000, 3) AS x,
 round(0.9996 * r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 3) AS y FROM s"""


@query(TM_SQL)
def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees to metres around the meridian of 0."""
    c = read(spark, sf_dir, "customer")
    lon, lat = (F.col("c_custkey") % 60 - 30) / 10.0, (F.col("c_custkey") % 70) + 0.25
    p = c.select("c_custkey", geometry.transverse_mercator(lon, lat, 0.0).alias("p"))
    return p.select("c_custkey", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query("SELECT p_brand AS key, sum(p_size)::BIGINT AS total, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1")
def tag_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of tags as a CSV with a header, written and read by its names."""
    path = sinks.scratch(spark, "tags")
    read(spark, sf_dir, "part").select(F.col("p_size").alias("count_all"), F.col("p_brand").alias("key"), F.lit("a, \"b\"").alias("value")).write.option("header", True).csv(path)
    rows = tables.read_table(spark.read.option("header", True).csv(path), "key string, count_all bigint, value string")
    return rows.where("count_all > 10 AND value = 'a, \"b\"'").groupBy("key").agg(F.sum("count_all").alias("total"), F.count("*").alias("n"))


@query(KS_SQL + "SELECT stratum, a, b, round(ks, 9) AS ks FROM pairs")
def pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written as JSON records and read back in their types."""
    path = sinks.scratch(spark, "pairs")
    evaluate.pairs(spark, sf_dir).write.json(path)
    back = tables.read_table(spark.read.schema("stratum string, a int, b int, n_a bigint, n_b bigint, ks double").json(path), "stratum string, a int, b int, ks double")
    return back.withColumn("ks", F.round("ks", 9))


@query(measures.ROADS_SQL + "SELECT feature_id FROM s WHERE feature_id % 50 = 3 AND outbound IS NULL AND n <= 64")
def redecode_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored points against those that the tokens decode to again; some were moved."""
    short = F.bround((F.get("p", F.lit(1))["x"] - F.get("p", F.lit(0))["x"]) / 0.5) <= 64
    d = measures.roads(spark, sf_dir).where(short).select("feature_id", "t", tokens.decode_block(F.col("t")).alias("d")).where(~tokens.is_boundary(F.get("t", F.size("t") - 2)))
    stored = F.transform("d", lambda p: F.struct((p["x"] + F.when(F.col("feature_id") % 50 == 3, 1.0).otherwise(0.0)).alias("x"), p["y"].alias("y")))
    again = d.withColumn("stored", stored)
    return again.where(F.exists(F.arrays_zip(F.col("stored").alias("s"), F.col("d").alias("d")), lambda z: F.hypot(z["s"]["x"] - z["d"]["x"], z["s"]["y"] - z["d"]["y"]) > 1e-9)).select("feature_id")


@query(SQL + "SELECT city, stratum, n, round(1.358 * sqrt(2.0::DOUBLE / n), 9) AS resolved, CAST(ceil(2 * (1.358 / 0.05::DOUBLE) * (1.358 / 0.05::DOUBLE)) AS BIGINT) AS needed, 1.358 * sqrt(2.0::DOUBLE / n) > 0.05 AS refused FROM (SELECT city, stratum, count(*) AS n FROM feat GROUP BY 1, 2)")
def power_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What difference a stratum's sample can tell, how many it would take for a twentieth, and whether it is refused."""
    c = features(spark, sf_dir).groupBy("city", "stratum").agg(F.count("*").alias("n"))
    resolved = F.lit(verdicts.KS_C) * F.sqrt(F.lit(2.0) / F.col("n"))
    ratio = F.lit(verdicts.KS_C) / F.lit(0.05)
    return c.select("city", "stratum", "n", F.round(resolved, 9).alias("resolved"), F.ceil(2 * ratio * ratio).alias("needed"), (resolved > 0.05).alias("refused"))


TILES_SQL = SQL + ", tiles AS (SELECT city, tile_i, tile_j, count(*) AS n FROM feat GROUP BY ALL)\n"


@query(TILES_SQL + ", q AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY tile_i, tile_j) AS place FROM tiles), h AS (SELECT * FROM q WHERE place <= 2) SELECT city, count(*) AS n_tiles, sum(n)::BIGINT AS population, round(1.358 * sqrt(2.0::DOUBLE / sum(n)), 9) AS gap, 1.358 * sqrt(2.0::DOUBLE / sum(n)) <= 0.05 AS met FROM h GROUP BY 1")
def evaluation_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tiles of each city, how much is in them and what difference that resolves."""
    t = features(spark, sf_dir).groupBy(*TILE).agg(F.count("*").alias("n"))
    held = selection.quota(t, 2, ["city"], ["tile_i", "tile_j"])
    gap = F.lit(verdicts.KS_C) * F.sqrt(F.lit(2.0) / F.sum("n"))
    return held.groupBy("city").agg(F.count("*").alias("n_tiles"), F.sum("n").alias("population"), F.round(gap, 9).alias("gap"), (gap <= 0.05).alias("met"))


@query(TILES_SQL + ", q AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY tile_i, tile_j) AS place FROM tiles) SELECT city, tile_i, tile_j, 'tile' AS reason FROM q WHERE place <= 2 AND city <> 4")
def frozen_holdout_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hold-out that is sealed, opened and held against the tiles that a training set goes back to."""
    t = features(spark, sf_dir).select(*TILE).distinct()
    path = sinks.scratch(spark, "holdout")
    sinks.seal(selection.quota(t, 2, ["city"], ["tile_i", "tile_j"]).select(*TILE), path, ["city"])
    held = sinks.open_sealed(spark, path, ["city"])
    return sets.leaks(t.where("city <> 4"), held, TILE, "city", [])


@query(SQL + "SELECT feature_class % 2 AS axis, count(*) AS n, count(*) FILTER (WHERE w > 45) AS n_failed, round(count(*) FILTER (WHERE w > 45)::DOUBLE / sum(count(*) FILTER (WHERE w > 45)) OVER (), 9) AS share FROM feat GROUP BY 1")
def failure_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    each = f.groupBy((F.col("feature_class") % 2).alias("axis")).agg(F.count("*").alias("n"), F.count_if(F.col("w") > 45).alias("n_failed"))
    whole = f.agg(F.count_if(F.col("w") > 45).alias("all"))
    return each.crossJoin(F.broadcast(whole)).select("axis", "n", "n_failed", F.round(F.col("n_failed") / F.col("all"), 9).alias("share"))


@query(SQL + ", a AS (SELECT DISTINCT feature_id % 300 AS k FROM feat WHERE w > 40), b AS (SELECT DISTINCT feature_id % 300 AS k FROM feat WHERE h > 6 AND w > 44) SELECT k FROM a EXCEPT SELECT k FROM b")
def absent_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir).withColumn("k", F.col("feature_id") % 300)
    return f.where("w > 40").select("k").distinct().join(f.where("h > 6 AND w > 44").select("k").distinct(), "k", "left_anti")


@query(SQL + "SELECT city, count(*) AS n, count(*) FILTER (WHERE h % 2 = 1) AS n_other FROM feat GROUP BY 1")
def vertex_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose points are the same but in another order."""
    x, y, w = F.col("x0").cast("double"), F.col("y0").cast("double"), F.col("w").cast("double")
    a = F.array(point(x, y), point(x + w, y), point(x + 2 * w, y))
    b = F.when(F.col("h") % 2 == 1, F.reverse(a)).otherwise(a)
    f = features(spark, sf_dir).select("city", (a == b).alias("same"), (F.array_sort(a) == F.array_sort(b)).alias("alike"))
    return f.groupBy("city").agg(F.count("*").alias("n"), F.count_if(~F.col("same") & F.col("alike")).alias("n_other"))


@query(SQL + "SELECT city, round(avg(w), 6) AS back FROM feat GROUP BY 1")
def character_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithms of sizes and back, as a display shows them."""
    v = rollup.log10_clipped(F.col("w").cast("double") + 1)
    return features(spark, sf_dir).groupBy("city").agg(F.round(F.avg(F.greatest(F.lit(0.0), F.pow(F.lit(10.0), v) - 1)), 6).alias("back"))


@query(SQL + "SELECT tile_i, count(DISTINCT city) AS n_cities, count(*) AS n FROM feat WHERE w BETWEEN 10 AND 20 GROUP BY 1")
def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived table read by the columns and the partition that are asked for."""
    path = sinks.scratch(spark, "derived")
    features(spark, sf_dir).write.partitionBy("city").parquet(path)
    rows = tables.read_table(spark.read.parquet(path), "city int, tile_i int, w int").where("w BETWEEN 10 AND 20")
    return rows.groupBy("tile_i").agg(F.countDistinct("city").alias("n_cities"), F.count("*").alias("n"))
