"""Queries: what a corpus is put together from, and what is known about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille import sinks
from quadrille.operators import corpus, grid, policy, selection, tokens
from quadrille.operators.grid import TILE
from quadrille.plans import measures
from quadrille.plans.feat import SQL, features, read
from quadrille.plans.registry import Registry
from quadrille.plans.rollups import CELLS_SQL, per_cell

query = Registry()
CELL = [*TILE, "cell_i", "cell_j"]


@query(SQL + "SELECT feature_id, feature_class AS number, CASE feature_class WHEN 0 THEN 'road' WHEN 1 THEN 'building' WHEN 2 THEN 'poi' ELSE 'base' END AS name FROM feat")
def enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of numbers, and the numbers of the names again."""
    f = features(spark, sf_dir).select("feature_id", corpus.decode_enum(F.col("feature_class"), corpus.FEATURE_CLASSES).alias("name"))
    return f.select("feature_id", corpus.encode_enum(F.col("name"), corpus.FEATURE_CLASSES).alias("number"), "name")


@query("SELECT c_custkey, CASE WHEN lat >= 0 AND floor((lon + 180) / 6) = floor((lon + 1 + 180) / 6) AND floor((lon + 0.5 + 180) / 6) + 1 BETWEEN 28 AND 38 THEN 'EPSG:258' || CAST(floor((lon + 0.5 + 180) / 6) + 1 AS INT) END AS crs FROM (SELECT c_custkey, c_custkey % 90 - 30.0::DOUBLE AS lon, c_custkey % 70 - 5.0::DOUBLE AS lat FROM customer)")
def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    lon, lat = F.col("c_custkey") % 90 - 30.0, F.col("c_custkey") % 70 - 5.0
    return c.select("c_custkey", corpus.zone_code(lon, lat, lon + 1, lat + 1).alias("crs"))


THEMES_SQL = "WITH p AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE split_part(p_type, ' ', 1) END AS class, p_size FROM part), b AS (SELECT p_partkey, coalesce(class, 'B__UNK__') AS class FROM p WHERE p_size < 25), r AS (SELECT p_partkey, class FROM p WHERE p_size >= 25 AND class IS NOT NULL)\n"


def themes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    p = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.split_part("p_type", F.lit(" "), F.lit(1))).alias("class"), "p_size")
    given = {"buildings": p.where("p_size < 25"), "transportation": p.where("p_size >= 25")}
    rules = [("buildings", "class", "token", "B__UNK__", ["STANDARD", "SMALL", "PROMO"]), ("transportation", "class", "drop", None, ["ECONOMY", "LARGE", "MEDIUM"]), ("base", "class", "drop", None, ["x"])]
    return corpus.apply_policies(given, rules)


@query(THEMES_SQL + "SELECT 'buildings' AS theme, class, count(*) AS n FROM b WHERE class IN ('STANDARD', 'SMALL', 'PROMO', 'B__UNK__') GROUP BY 2 UNION ALL SELECT 'transportation', class, count(*) FROM r WHERE class IN ('ECONOMY', 'LARGE', 'MEDIUM') GROUP BY 2")
def policies_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = themes(spark, sf_dir)
    both = t["buildings"].select(F.lit("buildings").alias("theme"), "class").unionByName(t["transportation"].select(F.lit("transportation").alias("theme"), "class"))
    return both.groupBy("theme", "class").agg(F.count("*").alias("n"))


@query("SELECT theme, theme_order, count(*) AS n, count(height) AS n_height, count(category) AS n_category FROM (SELECT 'roads' AS theme, 0 AS theme_order, NULL AS height, NULL AS category, p_size FROM part WHERE p_size % 3 = 0 UNION ALL SELECT 'buildings', 1, p_size, NULL, p_size FROM part WHERE p_size % 3 = 1 UNION ALL SELECT 'places', 2, NULL, p_brand, p_size FROM part WHERE p_size % 3 = 2) WHERE p_size % 7 <> 0 GROUP BY 1, 2")
def themes_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").withColumn("geometry", F.when(F.col("p_size") % 7 != 0, F.lit(b"g")))
    each = [("roads", p.where("p_size % 3 = 0").select("geometry")), ("buildings", p.where("p_size % 3 = 1").select("geometry", F.col("p_size").alias("height"))), ("places", p.where("p_size % 3 = 2").select("geometry", F.col("p_brand").alias("category")))]
    return corpus.united(each).groupBy("theme", "theme_order").agg(F.count("*").alias("n"), F.count("height").alias("n_height"), F.count("category").alias("n_category"))


@query("SELECT n_name AS name FROM nation WHERE n_regionkey = 2 AND n_nationkey % 4 <> 0 AND n_nationkey % 3 <> 0")
def division_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a country that have a name and a shape."""
    n = read(spark, sf_dir, "nation")
    d = n.select(F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).alias("name"), F.when(F.col("n_nationkey") % 3 != 0, F.lit(b"g")).alias("geometry"), F.lit("region").alias("subtype"), F.col("n_regionkey").cast("string").alias("country"))
    return corpus.divisions(d, "2").select("name")


@query(SQL + """, t AS (SELECT DISTINCT city, tile_i, tile_j FROM feat), e AS (SELECT CAST(row_number() OVER (ORDER BY o, p, q) - 1 AS INT) AS edge, i, j, a FROM (SELECT 0 AS o, i AS p, j AS q, i, j, 0 AS a FROM range(7) x(i), range(8) y(j) UNION ALL SELECT 1, i, j, i, j, 1 FROM range(8) x(i), range(7) y(j))),
r AS (SELECT DISTINCT city, tile_i, tile_j, feature_id % 97 AS source FROM feat WHERE feature_class = 0), c AS (SELECT f.city, f.tile_i, f.tile_j, cell_i, cell_j, h % 2 AS a, count(*) AS n FROM feat f SEMI JOIN r ON r.city = f.city AND r.tile_i = f.tile_i AND r.tile_j = f.tile_j AND r.source = f.feature_id % 97 WHERE w > 30 GROUP BY ALL)
SELECT t.city, t.tile_i, t.tile_j, edge, coalesce(n, 0) AS n FROM t CROSS JOIN e LEFT JOIN c ON c.city = t.city AND c.tile_i = t.tile_i AND c.tile_j = t.tile_j AND c.cell_i = e.i AND c.cell_j = e.j AND c.a = e.a""")
def skeleton_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings of roads on each of the 112 edges of a tile."""
    f = features(spark, sf_dir).withColumn("source", F.col("feature_id") % 97)
    c = f.where("w > 30").select(*TILE, "source", F.col("cell_i").alias("lower_i"), F.col("cell_j").alias("lower_j"), (F.col("h") % 2).alias("axis"))
    return corpus.edge_counts(c, f, grid.edges(spark), TILE, "source")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(floor(value) + 0.5::DOUBLE AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN event_type ELSE CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END END AS value FROM events")
def tagged_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    rows = e.select("event_id", (F.col("event_id") % 4).alias("value_type"), (F.floor("value") + 0.5).cast("double").alias("value_float"), F.col("user_id").alias("value_int"), F.col("event_type").alias("value_string"), (F.col("user_id") % 2 == 0).alias("value_bool"))
    return corpus.tagged(rows).select("event_id", "value")


MACRO_SQL = SQL + ", m AS (SELECT city, tile_i, tile_j, k AS slot_kind, CAST(i AS INT) AS slot, CASE WHEN k = 0 AND (i + tile_i) % 5 > 0 THEN i % 4 END AS density, CASE WHEN k = 1 AND (i + tile_j) % 6 > 0 THEN i % 3 END AS skeleton FROM (SELECT DISTINCT city, tile_i, tile_j FROM feat) t, (VALUES (0, 64), (1, 112)) v(k, n), range(112) r(i) WHERE i < n)\n"


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = features(spark, sf_dir).select(*TILE).distinct()
    slots = spark.createDataFrame([(k, i) for k, n in ((0, 64), (1, 112)) for i in range(n)], "slot_kind int, slot_index int")
    i = F.col("slot_index")
    return tiles.crossJoin(F.broadcast(slots)).select("*", F.when((F.col("slot_kind") == 0) & ((i + F.col("tile_i")) % 5 > 0), i % 4).alias("cell_density_bucket"), F.when((F.col("slot_kind") == 1) & ((i + F.col("tile_j")) % 6 > 0), i % 3).alias("road_skeleton_class"))


@query(MACRO_SQL + "SELECT city, tile_i, tile_j, 'density' AS kind, slot, density::INT AS value FROM m WHERE density IS NOT NULL UNION ALL SELECT city, tile_i, tile_j, 'skeleton', slot, skeleton::INT FROM m WHERE skeleton IS NOT NULL")
def macro_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.macro_targets(macro(spark, sf_dir), TILE)


@query(MACRO_SQL + """, z AS (SELECT city, tile_i, tile_j, density::INT AS v, count(*) AS n, min(slot) AS s FROM m WHERE density IS NOT NULL GROUP BY ALL), e AS (SELECT city, tile_i, tile_j, skeleton::INT AS v, count(*) AS n, min(slot) AS s FROM m WHERE skeleton IS NOT NULL GROUP BY ALL)
SELECT t.city, t.tile_i, t.tile_j, 64::BIGINT AS n_cells, (SELECT arg_max(v, n * 1000 - s) FROM z WHERE z.city = t.city AND z.tile_i = t.tile_i AND z.tile_j = t.tile_j) AS zoning, (SELECT arg_max(v, n * 1000 - s) FROM e WHERE e.city = t.city AND e.tile_i = t.tile_i AND e.tile_j = t.tile_j) AS skeleton FROM (SELECT DISTINCT city, tile_i, tile_j FROM m) t""")
def tile_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = macro(spark, sf_dir)
    cells = m.where("slot_kind = 0").select(*TILE, F.col("slot_index").alias("slot"), F.col("cell_density_bucket").alias("zoning"))
    edges = m.where("slot_kind = 1").select(*TILE, F.col("slot_index").alias("slot"), F.col("road_skeleton_class").alias("skeleton"))
    return corpus.tile_labels(cells, edges)


TILES_SQL = SQL + ", tiles AS (SELECT city, tile_i, tile_j, count(*) AS n FROM feat GROUP BY ALL)\n"


@query(TILES_SQL + "SELECT city, count(*) AS n, string_agg(tile_i || ':' || tile_j, ',' ORDER BY tile_i, tile_j) AS lineage FROM tiles WHERE NOT (tile_i = 0 AND city = 1) GROUP BY 1")
def training_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = features(spark, sf_dir).select(*TILE).distinct().where("NOT (tile_i = 0 AND city = 1)")
    found = corpus.lineage(t, ["city"])
    return found.select("city", "n", F.array_join(F.transform("lineage", lambda x: F.concat_ws(":", x["tile_i"].cast("string"), x["tile_j"].cast("string"))), ",").alias("lineage"))


@query("SELECT 3 AS k, 'both' AS problem UNION ALL SELECT 4, 'both' UNION ALL SELECT 40, 'unknown'")
def holdout_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    extra = spark.createDataFrame([(40,)], "k int")
    return corpus.overlaps(n.where("k BETWEEN 3 AND 8"), n.where("k < 5").unionByName(extra), n, "k")


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey < 2 AND n_nationkey % 7 = 0 THEN 'floors,manifest' WHEN n_nationkey < 2 THEN 'manifest' ELSE 'floors' END AS lacking FROM nation WHERE n_nationkey < 2 OR n_nationkey % 7 = 0")
def city_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    return corpus.unequal_sets({"manifest": n.where("k >= 2"), "floors": n.where("k % 7 <> 0"), "real": n, "generated": n}, "k")


@query(CELLS_SQL + "SELECT city, city % 2 AS zoning, -1 AS density, count(*) AS n FROM per_cell WHERE n % 5 > 0 AND city = 3 GROUP BY ALL UNION ALL SELECT city, city % 2, CAST(n_buildings % 3 AS INT), count(*) FROM per_cell WHERE n % 5 > 0 AND city <> 3 GROUP BY ALL")
def stratum_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = per_cell(spark, sf_dir).select("city", (F.col("city") % 2).alias("zoning"), F.when(F.col("city") != 3, F.col("n_buildings") % 3).alias("density"), F.when(F.col("n") % 5 > 0, F.array("n")).otherwise(F.array().cast("array<bigint>")).alias("tokens"))
    return corpus.census(c, ["city", "zoning", "density"])


@query(SQL + ", m AS (SELECT DISTINCT city, feature_class AS macro FROM feat) SELECT count(*) AS n, count(*) AS n_donors, count(*) AS n_other, count(*) AS n_same_city FROM (SELECT DISTINCT feature_id FROM feat WHERE w > 49)")
def deranged_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell gets a donor of its city with another value; the share whose prefix differs is the whole."""
    c = features(spark, sf_dir).where("w > 49").groupBy("feature_id").agg(F.min("city").alias("city"), F.min("feature_class").alias("macro"))
    d = corpus.deranged(c, "city", "feature_id", "macro", "7")
    other = c.select(F.col("feature_id").alias("donor"), F.col("city").alias("c2"), F.col("macro").alias("m2"))
    both = c.join(d, "feature_id").join(other, "donor", "left")
    return both.agg(F.count("*").alias("n"), F.count("donor").alias("n_donors"), F.count_if(F.col("macro") != F.col("m2")).alias("n_other"), F.count_if(F.col("city") == F.col("c2")).alias("n_same_city"))


@query("SELECT p_type AS value, n, (row_number() OVER (ORDER BY n DESC, p_type) - 1)::INT AS token_id FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1)")
def ranked_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.rank_categories(read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("value")).agg(F.count("*").alias("n"))).withColumn("token_id", F.col("token_id").cast("int"))


@query(CELLS_SQL + "SELECT low, high, count(n) AS n FROM (VALUES (0, 4), (4, 9), (9, 14), (14, NULL)) v(low, high) LEFT JOIN (SELECT n FROM per_cell) ON n >= low AND (high IS NULL OR n < high) GROUP BY 1, 2")
def open_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = corpus.open_ended([0, 4, 9, 14])
    n = F.col("n")
    one = per_cell(spark, sf_dir).agg(*[F.count_if((n >= a) & (F.lit(True) if b is None else n < b)).alias(f"k{a}") for a, b in ranges])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).cast("int").alias("high"), F.col(f"k{a}").alias("n")) for a, b in ranges])).alias("e")).select("e.*")


@query(measures.ROADS_SQL + "SELECT cell_i, 0::BIGINT AS sealed, 0::BIGINT AS unsealed, count(*) AS road, 0::BIGINT AS node, 0::BIGINT AS undecodable FROM s GROUP BY 1")
def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of the blocks of each column of cells, all roads here; a test has the other kinds."""
    t = measures.roads(spark, sf_dir).select("cell_i", F.col("t").alias("tokens"))
    return corpus.classify_blocks(t, ["cell_i"], [99])


INFLATION_SQL = SQL + ", r AS (SELECT city, city % 2 AS morphology, feature_class, w, CASE WHEN h / 3.0::DOUBLE < 1 THEN 0 WHEN h / 3.0::DOUBLE < 1.5 THEN 1 WHEN h / 3.0::DOUBLE < 2 THEN 2 WHEN h / 3.0::DOUBLE < 4 THEN 3 ELSE 4 END AS bucket FROM feat)\n"


@query(INFLATION_SQL + "SELECT morphology, city, feature_class, bucket, count(*) AS n, sum(w)::BIGINT AS tokens FROM r GROUP BY GROUPING SETS ((bucket), (bucket, feature_class), (bucket, morphology), (bucket, morphology, feature_class), (bucket, city), (bucket, city, feature_class))")
def inflation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and tokens by how much longer they decode, over all, by morphology and by city, each by class and together."""
    f = features(spark, sf_dir).select("city", (F.col("city") % 2).alias("morphology"), "feature_class", "w", corpus.inflation_class(F.col("h").cast("double"), F.lit(3.0)).alias("bucket"))
    b, m, c, k = (F.col(x) for x in ("bucket", "morphology", "city", "feature_class"))
    return f.groupingSets([[b], [b, k], [b, m], [b, m, k], [b, c], [b, c, k]], b, k, m, c).agg(F.count("*").alias("n"), F.sum("w").alias("tokens")).select("morphology", "city", "feature_class", "bucket", "n", "tokens")


@query(TILES_SQL + ", p AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY tile_i, tile_j) - 1 AS p, count(*) OVER (PARTITION BY city) AS k FROM tiles) SELECT city, tile_i, tile_j FROM p WHERE p % greatest(1, k // 5) = 0 AND p // greatest(1, k // 5) < 5")
def spaced_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.spaced_sample(features(spark, sf_dir).select(*TILE).distinct(), ["city"], ["tile_i", "tile_j"], 5)


@query(SQL + "SELECT city, count(*) AS n, round(max(h / 3.0::DOUBLE), 6) AS most, round(quantile_cont(h / 3.0::DOUBLE, 0.95), 6) AS p95 FROM feat WHERE cell_i BETWEEN 1 AND 6 AND cell_j BETWEEN 1 AND 6 AND w > 20 GROUP BY 1")
def path_spot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir).where(corpus.interior(F.col("cell_i"), F.col("cell_j")) & (F.col("w") > 20))
    r = F.col("h") / 3.0
    return f.groupBy("city").agg(F.count("*").alias("n"), F.round(F.max(r), 6).alias("most"), F.round(F.percentile(r, F.lit(0.95)), 6).alias("p95"))


@query(CELLS_SQL + ", c AS (SELECT city, tile_i, tile_j, cell_i, cell_j, n_buildings % 3 AS z FROM per_cell), e AS (SELECT a.city, a.tile_i, a.tile_j, a.z = b.z AS same FROM c a JOIN c b ON a.city = b.city AND a.tile_i = b.tile_i AND a.tile_j = b.tile_j AND (b.cell_i = a.cell_i + 1 AND b.cell_j = a.cell_j OR b.cell_i = a.cell_i AND b.cell_j = a.cell_j + 1)) SELECT city, tile_i, tile_j, round(avg(same::INT), 9) AS real, true AS near FROM e GROUP BY ALL")
def permutation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of neighbours against that of dealt labels; the gap is small, as these labels have no order in space."""
    c = per_cell(spark, sf_dir).select(*TILE, (F.col("cell_i") * 8 + F.col("cell_j")).alias("cell"), (F.col("n_buildings") % 3).alias("label"))
    right = c.where("cell < 56").select(*TILE, F.col("cell").alias("a"), (F.col("cell") + 8).alias("b"))
    down = c.where("cell % 8 < 7").select(*TILE, F.col("cell").alias("a"), (F.col("cell") + 1).alias("b"))
    found = corpus.permutation_gap(right.unionByName(down), c, TILE, 8, 5)
    return found.select(*TILE, F.round("real", 9).alias("real"), (F.abs("gap") < 0.5).alias("near"))


@query(CELLS_SQL + "SELECT city, tile_i, tile_j, count(*) AS n, string_agg(cell_i || ':' || cell_j || ':' || tokens, ',' ORDER BY cell_i, cell_j) AS cells FROM per_cell GROUP BY ALL")
def shard_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells written by city and read back as one row of cells for each tile."""
    path = sinks.scratch(spark, "shards")
    sinks.write_sorted(per_cell(spark, sf_dir).select(*CELL, "tokens"), path, TILE, ["cell_i", "cell_j"], ["city"])
    back = corpus.regrouped(spark.read.parquet(path), TILE, ["cell_i", "cell_j"])
    text = F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["cell_i"].cast("string"), c["cell_j"].cast("string"), c["tokens"].cast("string"))), ",")
    return back.select(*TILE, F.size("cells").cast("long").alias("n"), text.alias("cells"))


@query(CELLS_SQL + "SELECT city, tile_i, tile_j, cell_i, cell_j, tokens, CASE WHEN tokens = 0 THEN 'empty' WHEN tokens > 900 THEN 'too_long' ELSE 'kept' END AS state FROM per_cell WHERE tokens > 800")
def long_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_cell(spark, sf_dir).where("tokens > 800").select(*CELL, "tokens", F.when(F.col("tokens") == 0, "empty").when(F.col("tokens") > 900, "too_long").otherwise("kept").alias("state"))


@query(SQL + ", c AS (SELECT city, tile_i, tile_j, cell_i, cell_j, sum(7 + 2 * (w + h)) AS t, sum(CASE WHEN feature_class = 0 THEN 7 + 2 * (w + h) ELSE 0 END) AS road, sum(CASE WHEN feature_class = 1 THEN 7 + 2 * (w + h) ELSE 0 END) AS building, count(*) AS n FROM feat GROUP BY ALL) SELECT city, count(*) AS n_cells, sum(n)::BIGINT AS n_features, round(avg(road::DOUBLE / t), 6) AS road, round(avg(building::DOUBLE / t), 6) AS building, max(t)::BIGINT AS most FROM c WHERE t > 700 GROUP BY 1")
def long_cell_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What over-long cells are made of."""
    t = 7 + 2 * (F.col("w") + F.col("h"))
    part = lambda k: F.sum(F.when(F.col("feature_class") == k, t).otherwise(0))
    c = features(spark, sf_dir).groupBy(*CELL).agg(F.sum(t).alias("t"), part(0).alias("road"), part(1).alias("building"), F.count("*").alias("n")).where("t > 700")
    return c.groupBy("city").agg(F.count("*").alias("n_cells"), F.sum("n").alias("n_features"), F.round(F.avg(F.col("road") / F.col("t")), 6).alias("road"), F.round(F.avg(F.col("building") / F.col("t")), 6).alias("building"), F.max("t").alias("most"))


@query(SQL + ", c AS (SELECT city, tile_i, tile_j, cell_i, cell_j, sum(7 + 2 * ceil(w * 2 / 64.0::DOUBLE) + 2 * ceil(h * 2 / 64.0::DOUBLE)) AS chunked, sum(7 + 2 * 2) AS whole FROM feat GROUP BY ALL) SELECT city, round(quantile_cont(chunked, 0.999), 6) AS chunked, round(quantile_cont(whole, 0.999), 6) AS whole, CAST(ceil(quantile_cont(chunked, 0.999) / 128) * 128 AS BIGINT) AS padded FROM c GROUP BY 1")
def chunked_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens to a cell with long moves cut and without, and the budget that holds nearly all cells."""
    cut = 7 + 2 * F.ceil(F.col("w") * 2 / 64.0) + 2 * F.ceil(F.col("h") * 2 / 64.0)
    c = features(spark, sf_dir).groupBy(*CELL).agg(F.sum(cut).cast("double").alias("chunked"), F.sum(F.lit(11)).cast("double").alias("whole"))
    p = c.groupBy("city").agg(F.percentile("chunked", F.lit(0.999)).alias("c"), F.percentile("whole", F.lit(0.999)).alias("w"))
    return p.select("city", F.round("c", 6).alias("chunked"), F.round("w", 6).alias("whole"), (F.ceil(F.col("c") / 128) * 128).cast("long").alias("padded"))


@query("SELECT c_custkey, array_to_string([1 + c_nationkey % 63, 64 + 1 + c_custkey % 4, 128 + CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 + c_custkey % 5 END], ',') AS prefix FROM customer")
def conditioning_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of values by position, 64 to each; no value is 0."""
    c = read(spark, sf_dir, "customer")
    ids = [tokens.prefix_id(0, F.col("c_nationkey"), "int"), tokens.prefix_id(1, F.col("c_custkey") % 4, "int"), tokens.prefix_id(2, F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 5), "int")]
    return c.select("c_custkey", F.array_join(F.transform(F.array(*ids), lambda x: x.cast("string")), ",").alias("prefix"))


@query("WITH p AS (SELECT c_mktsegment AS city, [c_nationkey % 2, 5, c_custkey % 3] AS p FROM customer), e AS (SELECT city, unnest(p) AS v, generate_subscripts(p, 1) - 1 AS position FROM p) SELECT city, position::INT AS position, count(DISTINCT v) AS n FROM e GROUP BY ALL HAVING count(DISTINCT v) > 1")
def varying_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("city"), F.posexplode(F.array((F.col("c_nationkey") % 2).cast("long"), F.lit(5).cast("long"), F.col("c_custkey") % 3)).alias("position", "v"))
    return c.groupBy("city", "position").agg(F.countDistinct("v").alias("n")).where("n > 1")


@query("SELECT source, count(*) AS n, min(bytes) AS least FROM (SELECT source, strlen(coalesce(text, '')) AS bytes FROM documents) GROUP BY 1 HAVING count(*) > 0")
def source_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("source", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.min("bytes").alias("least"))


@query("SELECT c.role, c.metric, count(*) AS n, sum(sample)::BIGINT AS total FROM (SELECT o_orderpriority AS role, 'price' AS metric, o_custkey AS sample FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderpriority, 'key', o_orderkey FROM orders) c GROUP BY 1, 2")
def long_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested samples as long rows, and both ways back."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("role"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("price"), F.col("o_orderkey").alias("key"))
    long = o.unpivot(["role"], ["price", "key"], "metric", "sample").where("sample IS NOT NULL")
    return long.groupBy("role", "metric").agg(F.count("*").alias("n"), F.sum("sample").alias("total"))


@query("SELECT file, n, changed FROM (VALUES ('all', 3::BIGINT, 0::BIGINT)) v(file, n, changed)")
def file_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of all files and digests of some against what was recorded; nothing has changed here, and a test changes some."""
    scan = lambda: corpus.file_facts(spark.read.format("binaryFile").load([f"{sf_dir}/{t}.parquet" for t in ("region", "nation", "supplier")]))
    recorded = scan()
    bad = corpus.changed_files(recorded, scan(), F.lit(True))
    return recorded.agg(F.lit("all").alias("file"), F.count("*").alias("n")).crossJoin(F.broadcast(bad.agg(F.count("*").alias("changed")))).select("file", "n", "changed")


@query("SELECT r AS scale, r * 20 <= 1000000 AS feasible FROM (VALUES (10000), (30000), (50000), (100000)) v(r)")
def feasible_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales that the tokens at hand are enough for, at so many tokens to a parameter."""
    return spark.createDataFrame([(10000,), (30000,), (50000,), (100000,)], "scale int").withColumn("feasible", F.col("scale") * 20 <= 1_000_000)


@query(SQL + "SELECT city, tile_i, tile_j, count(*) FILTER (WHERE feature_class = 0 AND cell_i BETWEEN 1 AND 6 AND cell_j BETWEEN 1 AND 6) AS n_interior, count(*) FILTER (WHERE feature_class = 0 AND cell_i BETWEEN 1 AND 6 AND cell_j BETWEEN 1 AND 6) >= 3 AS usable FROM feat GROUP BY ALL")
def usable_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = (F.col("feature_class") == 0) & corpus.interior(F.col("cell_i"), F.col("cell_j"))
    return features(spark, sf_dir).groupBy(*TILE).agg(F.count_if(inner).alias("n_interior"), (F.count_if(inner) >= 3).alias("usable"))


@query(SQL + "SELECT feature_class, count(*) AS n, count(*) FILTER (WHERE s) AS n_sentinel FROM (SELECT feature_class, CASE WHEN w % 7 = 0 THEN true WHEN w % 11 = 0 THEN true WHEN w % 13 = 0 THEN true ELSE false END AS s FROM feat) GROUP BY 1")
def unknown_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("w") % 7 == 0, "unknown").when(F.col("w") % 11 == 0, "x__UNK__").when(F.col("w") % 13 == 0, "B_other").when(F.col("w") % 2 == 0, "house")
    return features(spark, sf_dir).groupBy("feature_class").agg(F.count("*").alias("n"), F.count_if(policy.sentinel(raw)).alias("n_sentinel"))


@query(SQL + ", d AS (SELECT feature_class, feature_id, sha256('9:' || feature_id) AS h FROM (SELECT DISTINCT feature_class, feature_id FROM feat)), r AS (SELECT *, row_number() OVER (PARTITION BY feature_class ORDER BY h) AS r FROM d) SELECT feature_class, feature_id FROM r WHERE r <= 25")
def reference_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """So many of each class, by the digest of seed and id."""
    d = features(spark, sf_dir).select("feature_class", "feature_id").distinct()
    return selection.hash_sample(d, 25, "9", ["feature_id"], ["feature_class"])


@query(SQL + ", u AS (SELECT city, tile_i, w FROM feat WHERE city < 2 UNION ALL SELECT city, tile_i, w FROM feat WHERE city >= 3) SELECT city, count(*) AS n, sum(w)::BIGINT AS total FROM u GROUP BY 1")
def united_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir).select("city", "tile_i", "w")
    return f.where("city < 2").unionByName(f.where("city >= 3")).groupBy("city").agg(F.count("*").alias("n"), F.sum("w").alias("total"))


@query(SQL + "SELECT city, stratum, round(avg(w - 25.5::DOUBLE), 9) AS mean, round(stddev_pop(w - 25.5::DOUBLE), 9) AS spread, round(avg((w > 25)::INT), 9) AS positive FROM feat GROUP BY 1, 2")
def stratum_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("w") - 25.5
    return features(spark, sf_dir).groupBy("city", "stratum").agg(F.round(F.avg(g), 9).alias("mean"), F.round(F.stddev_pop(g), 9).alias("spread"), F.round(F.avg((F.col("w") > 25).cast("int")), 9).alias("positive"))


@query(SQL + ", v AS (SELECT 'city' AS variant, CAST(city AS VARCHAR) AS s, w FROM feat UNION ALL SELECT 'class', CAST(feature_class AS VARCHAR), w FROM feat UNION ALL SELECT 'size', CAST(h AS VARCHAR), w FROM feat) SELECT variant, s, count(*) AS n, round(median(w), 6) AS middle FROM v GROUP BY 1, 2")
def stratified_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same samples in several stratifications: one scan, a row for each."""
    f = features(spark, sf_dir)
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(c).cast("string").alias("s")) for v, c in (("city", "city"), ("class", "feature_class"), ("size", "h"))])).alias("e")
    return f.select("w", each).groupBy("e.variant", "e.s").agg(F.count("*").alias("n"), F.round(F.median("w"), 6).alias("middle"))
