"""Queries: rates, budgets, evidence tables, ordered sequences and invariant checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import frequency, grid, policy, sequence
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


@query(SQL + "SELECT city, tile_i, tile_j, count(*) AS n_rows, count(DISTINCT cell_i * 8 + cell_j) AS n_cells FROM feat GROUP BY ALL")
def tile_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).groupBy(*TILE).agg(F.count("*").alias("n_rows"), F.countDistinct("cell_i", "cell_j").alias("n_cells"))


@query(SQL + "SELECT feature_id, coalesce(c IN ('ocean', 'strait', 'bay'), FALSE) OR coalesce(s = 'ocean', FALSE) AS is_sea, coalesce(c IN ('lake', 'river', 'reservoir', 'pond', 'canal', 'stream', 'lagoon', 'water'), FALSE) AS is_inland FROM (SELECT feature_id, CASE w % 4 WHEN 0 THEN 'ocean' WHEN 1 THEN 'lake' WHEN 2 THEN 'other' END AS c, CASE WHEN h = 3 THEN 'ocean' END AS s FROM feat)")
def water_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("w") % 4 == 0, "ocean").when(F.col("w") % 4 == 1, "lake").when(F.col("w") % 4 == 2, "other")
    s = F.when(F.col("h") == 3, "ocean")
    return features(spark, sf_dir).select("feature_id", policy.sea(c, s).alias("is_sea"), policy.inland(c).alias("is_inland"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS family, p_size BETWEEN 1 AND 6 AS inner_size FROM part")
def key_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("family"), F.col("p_size").between(1, 6).alias("inner_size"))


@query(SQL + "SELECT city, tile_i, tile_j, count(*) AS n_interior FROM (SELECT DISTINCT city, tile_i, tile_j, cell_i, cell_j FROM feat WHERE feature_class = 0 AND cell_i BETWEEN 1 AND 6 AND cell_j BETWEEN 1 AND 6) GROUP BY ALL HAVING count(*) >= 3")
def usable_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = features(spark, sf_dir).where("feature_class = 0 AND cell_i BETWEEN 1 AND 6 AND cell_j BETWEEN 1 AND 6").select(*TILE, "cell_i", "cell_j").distinct()
    return inner.groupBy(*TILE).agg(F.count("*").alias("n_interior")).where("n_interior >= 3")


@query("SELECT CASE WHEN n = 0 THEN 'empty' WHEN n > 400 THEN 'too_long' ELSE 'kept' END AS state, count(*) AS n FROM (SELECT len(string_split(coalesce(text, ''), ' ')) - CASE WHEN coalesce(text, '') = '' THEN 1 ELSE 0 END AS n FROM documents) GROUP BY 1")
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.when(F.coalesce("text", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("text", " "))
    return read(spark, sf_dir, "documents").select(sequence.lengths_ok(words, 400).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query(SQL + "SELECT city, stratum, n FROM (SELECT city, stratum, count(*) AS n FROM feat GROUP BY ALL) WHERE n >= 30")
def thin_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).groupBy("city", "stratum").agg(F.count("*").alias("n")).where("n >= 30")


EVIDENCE_SQL = SQL + """, ev AS (SELECT city, tile_i, tile_j, cell_i, cell_j, 'count' AS metric, count(*)::DOUBLE AS value FROM feat GROUP BY ALL
UNION ALL SELECT city, tile_i, tile_j, cell_i, cell_j, 'area', sum(w * h)::DOUBLE FROM feat GROUP BY ALL)
"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the features; a row for each metric."""
    wide = features(spark, sf_dir).groupBy(*TILE, "cell_i", "cell_j").agg(F.count("*").cast("double").alias("count"), F.sum(F.col("w") * F.col("h")).cast("double").alias("area"))
    return wide.unpivot([*TILE, "cell_i", "cell_j"], ["count", "area"], "metric", "value")


@query(EVIDENCE_SQL + "SELECT * FROM ev")
def evidence_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir)


@query(EVIDENCE_SQL + "SELECT city, tile_i, tile_j, cell_i, cell_j, max(value) FILTER (WHERE metric = 'count') AS count, max(value) FILTER (WHERE metric = 'area') AS area FROM ev GROUP BY ALL")
def evidence_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).groupBy(*TILE, "cell_i", "cell_j").pivot("metric", ["count", "area"]).agg(F.max("value"))


@query(EVIDENCE_SQL + "SELECT city, tile_i, tile_j, sum(value) AS total, max(value) AS most, count(*) AS n FROM ev WHERE metric = 'count' GROUP BY ALL")
def tile_evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).where("metric = 'count'").groupBy(*TILE).agg(F.sum("value").alias("total"), F.max("value").alias("most"), F.count("*").alias("n"))


@query("SELECT source, count(*) AS n, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.99) AS p99, max(n) AS most, avg(CASE WHEN n > 300 THEN 1.0::DOUBLE ELSE 0 END) AS over FROM (SELECT source, n_chars AS n FROM documents) GROUP BY 1".replace("quantile_cont(n, 0.5)", "round(quantile_cont(n, 0.5), 6)").replace("quantile_cont(n, 0.99)", "round(quantile_cont(n, 0.99), 6)").replace("avg(CASE", "round(avg(CASE").replace("ELSE 0 END) AS over", "ELSE 0 END), 9) AS over"))
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.percentile(n, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(n, F.lit(0.99)), 6).alias("p99"), F.max(n).alias("most"), F.round(F.avg((n > 300).cast("double")), 9).alias("over"))


@query(SQL + "SELECT CAST(ceil(n / 128.0) * 128 AS BIGINT) AS padded, count(*) AS n_cells, sum(n)::BIGINT AS n_tokens FROM (SELECT sum(7 + 2 * (w + h))::BIGINT AS n FROM feat GROUP BY city, tile_i, tile_j, cell_i, cell_j) GROUP BY 1")
def budget_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = features(spark, sf_dir).groupBy(*TILE, "cell_i", "cell_j").agg(F.sum(7 + 2 * (F.col("w") + F.col("h"))).alias("n"))
    return n.groupBy((F.ceil(F.col("n") / 128) * 128).cast("long").alias("padded")).agg(F.count("*").alias("n_cells"), F.sum("n").alias("n_tokens"))


@query(SQL + """, c AS (SELECT *, sum(7 + 2 * (w + h)) OVER (PARTITION BY city, tile_i, tile_j, cell_i, cell_j) AS n FROM feat)
SELECT feature_class, count(*) AS n, count(*) FILTER (WHERE n > 900) AS n_dropped, count(*) FILTER (WHERE n <= 900)::DOUBLE / count(*) AS retained FROM c GROUP BY 1""")
def tail_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    per_cell = f.groupBy(*TILE, "cell_i", "cell_j", "feature_class").agg(F.sum(7 + 2 * (F.col("w") + F.col("h"))).alias("t"), F.count("*").alias("k"))
    cells = per_cell.groupBy(*TILE, "cell_i", "cell_j").agg(F.sum("t").alias("n"), F.collect_list(F.struct("feature_class", "k")).alias("c"))
    each = cells.select("n", F.explode("c").alias("c")).groupBy("c.feature_class").agg(F.sum("c.k").alias("n"), F.sum(F.when(F.col("n") > 900, F.col("c.k")).otherwise(0)).alias("n_dropped"))
    return each.select("feature_class", "n", "n_dropped", ((F.col("n") - F.col("n_dropped")) / F.col("n")).alias("retained"))


@query("SELECT f AS level, count(n) AS n FROM (VALUES (10), (50), (80), (100)) v(f) LEFT JOIN (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) ON n >= f GROUP BY 1")
def floor_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = [10, 50, 80, 100]
    one = frequency.value_counts(read(spark, sf_dir, "part"), "p_brand").agg(*[F.count_if(F.col("n") >= x).alias(f"n{x}") for x in levels])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"n{x}").alias("n")) for x in levels])).alias("e")).select("e.level", "e.n")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_high, round(count(*) FILTER (WHERE value > 50)::DOUBLE / count(*), 9) AS rate FROM events GROUP BY ROLLUP (event_type)")
def stratified_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = F.col("value") > 50
    return read(spark, sf_dir, "events").rollup("event_type").agg(F.count("*").alias("n"), F.count_if(high).alias("n_high"), F.round(F.count_if(high) / F.count("*"), 9).alias("rate"))


@query(SQL + "SELECT city, stratum, n, CASE WHEN n >= 2000 THEN 'ok' WHEN n >= 200 THEN 'ceiling' ELSE 'error' END AS state FROM (SELECT city, stratum, count(*) AS n FROM feat GROUP BY ALL)")
def stratum_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = features(spark, sf_dir).groupBy("city", "stratum").agg(F.count("*").alias("n"))
    return n.withColumn("state", F.when(F.col("n") >= 2000, "ok").when(F.col("n") >= 200, "ceiling").otherwise("error"))


@query("""SELECT event_id, user_id, CASE WHEN floor(value) % 3 <> 0 THEN 'interval' WHEN (row_number() OVER (PARTITION BY user_id, floor(value) % 3 <> 0 ORDER BY event_id) - 1) % 2 = 0 THEN 'enter' ELSE 'exit' END AS event FROM events""")
def alternate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", (F.floor("value") % 3).alias("extent"))
    return sequence.alternate(e, ["user_id"], "event_id", "extent").select("event_id", "user_id", "event")


@query("""WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM m)
SELECT user_id, CAST(island AS BIGINT) AS island, any_value(event_type) AS value, count(*) AS n, sum(event_id)::BIGINT AS total FROM i GROUP BY 1, 2""")
def run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.islands(read(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type", "event_id")


@query("SELECT event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS d_event_id FROM events")
def segment_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.steps(read(spark, sf_dir, "events"), ["user_id"], "event_id", "event_id").select("event_id", "d_event_id")


@query("SELECT n_regionkey, s[1].k AS best, s[2].n - s[1].n AS gap FROM (SELECT n_regionkey, list_sort(list({'n': n, 'k': k})) AS s FROM (SELECT n_regionkey, c_nationkey AS k, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2) GROUP BY 1)")
def winner_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    joined = c.join(read(spark, sf_dir, "nation"), F.col("k") == F.col("n_nationkey"))
    return sequence.runner_up(joined, ["n_regionkey"], "k", "n")


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*)::DOUBLE AS y FROM orders GROUP BY 1), x AS (SELECT date_diff('day', DATE '1990-01-01', day)::DOUBLE AS x, y FROM d), n AS (SELECT * FROM x WHERE x >= (SELECT max(x) FROM x) - 365)
SELECT n, round(slope, 6) AS slope, abs(slope) <= 2 * sqrt(greatest(0, syy - slope * sxy) / (n - 2) / sxx) AS settled FROM (SELECT count(*) AS n, regr_slope(y, x) AS slope, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM n)""")
def saturation_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").cast("double").alias("y"))
    x = d.select(F.datediff("day", F.lit("1990-01-01").cast("date")).cast("double").alias("x"), "y")
    return sequence.trend(x, "x", "y", 365).withColumn("slope", F.round("slope", 6))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(sum(l_linenumber) OVER w - l_linenumber AS BIGINT) AS first, CAST(sum(l_linenumber) OVER w - 1 AS BIGINT) AS last FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber ROWS UNBOUNDED PRECEDING)")
def part_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct().withColumn("o", F.struct("l_partkey", "l_linenumber"))
    return sequence.spans_of_parts(d, ["l_orderkey"], "o", "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey", "first", "last")


@query("SELECT p_type AS value, n, round(n::DOUBLE / (SELECT count(*) FROM part), 9) AS share FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, p_type LIMIT 20")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    best = frequency.value_counts(part, "p_type").orderBy(F.desc("n"), "value").limit(20)
    return best.crossJoin(F.broadcast(part.agg(F.count("*").alias("all")))).select("value", "n", F.round(F.col("n") / F.col("all"), 9).alias("share"))


@query(SQL + "SELECT feature_class, count(*) AS n, list_sort(list(DISTINCT city * 16 + tile_i * 4 + tile_j))[1] AS first_tile, min(w) AS least, max(w) AS most, median(w) AS middle FROM feat WHERE w > 45 GROUP BY 1")
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).where("w > 45").groupBy("feature_class").agg(F.count("*").alias("n"), F.min(F.col("city") * 16 + F.col("tile_i") * 4 + F.col("tile_j")).alias("first_tile"), F.min("w").alias("least"), F.max("w").alias("most"), F.median("w").alias("middle"))


@query(SQL + "SELECT feature_id, city FROM feat WHERE NOT (x0 >= 0 AND x0 < 250 AND y0 >= 0 AND y0 < 250 AND x0 + w <= 250)")
def bbox_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = (F.col("x0") >= 0) & (F.col("x0") < grid.CELL_M) & (F.col("y0") >= 0) & (F.col("y0") < grid.CELL_M) & (F.col("x0") + F.col("w") <= grid.CELL_M)
    return features(spark, sf_dir).where(~inside).select("feature_id", "city")


@query(SQL + "SELECT city, count(*) AS n, count(*) FILTER (WHERE w > 48) AS n_long, count(*) FILTER (WHERE w > 48)::DOUBLE / count(*) > 0.05 AS too_many FROM feat GROUP BY 1")
def drop_rate_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = F.col("w") > 48
    return features(spark, sf_dir).groupBy("city").agg(F.count("*").alias("n"), F.count_if(long).alias("n_long"), (F.count_if(long) / F.count("*") > 0.05).alias("too_many"))


@query("SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n_values, count(*) FILTER (WHERE c_nationkey IS NULL) = count(*) AS all_null FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) >= 2")
def carrier_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.countDistinct("c_nationkey").alias("n_values"), (F.count("c_nationkey") == 0).alias("all_null")).where("n_values >= 2")


@query("SELECT k AS n, CAST(ceil(1.96 * 1.96 * 0.25 / (d * d)) AS BIGINT) AS cells, round(1.358 * sqrt(2.0 / k), 9) AS resolution FROM (VALUES (50, 0.1::DOUBLE), (200, 0.05::DOUBLE), (1000, 0.03::DOUBLE)) v(k, d)")
def sample_size_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(50, 0.1), (200, 0.05), (1000, 0.03)], "n int, d double")
    return rows.select("n", F.ceil(F.lit(1.96) * 1.96 * 0.25 / (F.col("d") * F.col("d"))).alias("cells"), F.round(1.358 * F.sqrt(2.0 / F.col("n")), 9).alias("resolution"))
