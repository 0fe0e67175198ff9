"""Queries: scans, frequency profiles, policies, quantiles and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import frequency, percentiles, policy
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


FLOORS_SQL = "(VALUES ('all', 0.0, 1), ('ten', 0.0, 10), ('permille', 0.001, 10), ('half_percent', 0.005, 10), ('percent', 0.01, 20)) s(strategy, share, least)"


@query("SELECT p_brand AS value, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1")
def freq_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.value_counts(read(spark, sf_dir, "part"), "p_brand")


@query("SELECT CAST(p_size AS VARCHAR) AS value, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1")
def freq_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.value_counts(read(spark, sf_dir, "part"), F.when(F.col("p_size") > 10, F.col("p_size")))


@query("SELECT count(*) AS n_total, count(nullif(event_type, 'click')) AS n_present FROM events")
def freq_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.presence(read(spark, sf_dir, "events"), F.expr("nullif(event_type, 'click')"))


@query(f"""
WITH c AS (SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1), t AS (SELECT count(*) AS n_present FROM part),
f AS (SELECT strategy, greatest(CAST(floor(share * n_present) AS BIGINT), least) AS floor FROM {FLOORS_SQL}, t)
SELECT strategy, floor, count(*) FILTER (WHERE n >= floor) AS n_kept, count(*) FILTER (WHERE n < floor) AS n_cut,
  CAST(coalesce(sum(n) FILTER (WHERE n >= floor), 0) AS BIGINT) AS kept_occurrences, coalesce(CAST(coalesce(sum(n) FILTER (WHERE n >= floor), 0) AS BIGINT) * 100.0::DOUBLE / CAST(sum(n) AS BIGINT), 100.0) AS coverage
FROM c, f GROUP BY 1, 2""")
def freq_floor_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return frequency.floor_cuts(frequency.value_counts(part, "p_type"), frequency.presence(part, "p_type"))


@query("SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS place FROM (SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1) WHERE n >= 15")
def kept_set_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frequency.kept_set(frequency.value_counts(read(spark, sf_dir, "part"), "p_type"), 15)
    return found.withColumn("place", F.col("place").cast("long"))


@query("SELECT value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS value FROM part) GROUP BY 1")
def freq_list_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.element_counts(read(spark, sf_dir, "part"), F.split("p_name", " "))


@query("""
WITH l AS (SELECT conv_id, list(text) AS texts FROM conversations WHERE role = 'user' GROUP BY 1),
a AS (SELECT DISTINCT conv_id FROM conversations), s AS (SELECT least(coalesce(len(texts), 0), 5) AS b FROM a LEFT JOIN l USING (conv_id))
SELECT CAST(k AS INT) AS bucket, count(b) AS n, count(b)::DOUBLE / (SELECT count(*) FROM s) AS share FROM range(6) r(k) LEFT JOIN s ON b = k GROUP BY 1""")
def list_length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "user", F.col("text"))).alias("texts"))
    return frequency.length_histogram(lists, F.expr("nullif(texts, array())"))


@query("""
WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1)
SELECT value, n, row_number() OVER w AS place, CAST(sum(n) OVER (ORDER BY n DESC, value ROWS UNBOUNDED PRECEDING) AS BIGINT) AS covered, n - coalesce(lag(n) OVER w, 0) AS gain FROM c WINDOW w AS (ORDER BY n DESC, value)""")
def marginal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frequency.cumulative_coverage(frequency.value_counts(read(spark, sf_dir, "part"), "p_brand"))
    return found.withColumn("place", F.col("place").cast("long"))


@query("""
SELECT CAST(k AS INT) AS bin, count(v) AS n FROM (VALUES (0, 1.0, 10.0), (1, 10.0, 20.0), (2, 20.0, 35.0), (3, 35.0, 50.0)) b(k, lo, hi)
LEFT JOIN (SELECT l_quantity AS v FROM lineitem) ON v >= lo AND (v < hi OR k = 3 AND v = hi) GROUP BY 1""")
def hist_closed_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.histogram(read(spark, sf_dir, "lineitem"), "l_quantity", [1, 10, 20, 35, 50])


@query("""
SELECT CAST(k AS INT) AS bin, count(v) AS n FROM (VALUES (0, 0, 5), (1, 5, 20), (2, 20, NULL)) b(k, lo, hi)
LEFT JOIN (SELECT p_size AS v FROM part) ON v >= lo AND (hi IS NULL OR v < hi) GROUP BY 1""")
def hist_open_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.histogram(read(spark, sf_dir, "part"), "p_size", [0, 5, 20], open_top=True)


@query("SELECT event_id, CASE WHEN value < 20 THEN 0 WHEN value < 50 THEN 1 WHEN value < 90 THEN 2 ELSE 3 END AS bucket FROM events")
def bucketise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", frequency.bucket(F.col("value"), [0, 20, 50, 90]).alias("bucket"))


@query("""SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#11'), '__UNK__') AS brand FROM part""")
def policy_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", F.expr("nullif(p_brand, 'Brand#11')").alias("brand"))
    return policy.missing(part, "brand", "token")


@query("""SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#11'), '__UNK__') AS first, p_type AS rest FROM part""")
def policy_struct_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", F.struct(F.expr("nullif(p_brand, 'Brand#11')").alias("first"), F.col("p_type").alias("rest")).alias("names"))
    return policy.missing(part, "names.first", "token").select("p_partkey", "names.*")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '__UNK__')")
def policy_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.known(read(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey", "o_orderpriority")


@query("SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= (SELECT count(*) / 25 FROM part))")
def policy_known_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    words = frequency.value_counts(part, "p_brand").crossJoin(F.broadcast(part.agg((F.count("*") / 25).alias("least")))).where("n >= least")
    return policy.known(part, "p_brand", words, token=None).select("p_partkey")


@query("SELECT p_partkey, p_brand = 'unknown' OR contains(p_brand, '__UNK__') OR starts_with(p_brand, 'B_') AS is_unknown FROM part")
def sentinel_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", policy.sentinel(F.col("p_brand")).alias("is_unknown"))


@query(SQL + "SELECT feature_id, CASE feature_class WHEN 0 THEN 'highway' WHEN 1 THEN 'building' WHEN 2 THEN 'amenity' ELSE 'natural' END || '=' || coalesce(nullif(road, 'A'), '') AS tag FROM feat")
def class_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("feature_id", policy.tag(F.col("feature_class"), F.expr("nullif(road, 'A')")).alias("tag"))


@query(SQL + "SELECT city, count(*) AS n, sum(CASE WHEN w * h / 100.0 < 0.5 THEN 1 ELSE 0 END)::BIGINT AS n_slivers FROM feat GROUP BY 1")
def sliver_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    small = policy.sliver(F.lit(True), F.lit(False), F.col("w") * F.col("h") / 100.0, F.lit(0.0), 0.5)
    return f.groupBy("city").agg(F.count("*").alias("n"), F.count_if(small).alias("n_slivers"))


Q_SQL = "SELECT l_linenumber, {e} FROM (SELECT l_linenumber, list_sort(list(l_extendedprice)) AS s, len(list(l_extendedprice)) AS n FROM lineitem GROUP BY 1)"


@query(Q_SQL.format(e="s[CAST(round_even(0.5 * (n - 1), 0) AS INT) + 1] AS p50, s[CAST(round_even(0.9 * (n - 1), 0) AS INT) + 1] AS p90, s[CAST(round_even(0.99 * (n - 1), 0) AS INT) + 1] AS p99"))
def summary_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = {f"p{int(q * 100)}": percentiles.nearest_rank(q) for q in (0.5, 0.9, 0.99)}
    return percentiles.picks(read(spark, sf_dir, "lineitem"), ["l_linenumber"], F.col("l_extendedprice"), at).drop("n")


@query(Q_SQL.format(e="s[greatest(1, least(n, CAST(ceil(0.95 * n) AS INT)))] AS p95, s[greatest(1, least(n, CAST(ceil(0.999 * n) AS INT)))] AS p999"))
def summary_ceil_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = percentiles.finite(F.col("l_extendedprice"))
    return percentiles.picks(read(spark, sf_dir, "lineitem"), ["l_linenumber"], v, {"p95": percentiles.ceil_rank(95), "p999": percentiles.ceil_rank(99.9)}).drop("n")


@query(Q_SQL.format(e="s[CAST(floor(0.9 * (n - 1)) AS INT) + 1] AS p90"))
def summary_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.picks(read(spark, sf_dir, "lineitem"), ["l_linenumber"], F.col("l_extendedprice"), {"p90": percentiles.truncated(0.9)}).drop("n")


@query("SELECT l_linenumber, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1")
def summary_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("l_extendedprice")
    return read(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.round(percentiles.linear(v, 0.5), 6).alias("p50"), F.round(percentiles.linear(v, 0.99), 6).alias("p99"))


def _exclusive_sql(k: int, n: int) -> str:
    j = f"greatest(1, least(n - 1, ({k} * (n + 1)) // {n}))"
    return f"(s[{j}] * ({n} - ({k} * (n + 1) - {j} * {n})) + s[{j} + 1] * ({k} * (n + 1) - {j} * {n})) / {n}.0::DOUBLE"


@query("SELECT p_size, CASE WHEN n >= 2 THEN " + _exclusive_sql(1, 4) + " END AS q1, CASE WHEN n >= 2 THEN " + _exclusive_sql(9, 10) + " END AS p90 FROM (SELECT p_size, list_sort(list(p_partkey)) AS s, len(list(p_partkey)) AS n FROM part GROUP BY 1)")
def quantiles_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.exclusive(read(spark, sf_dir, "part"), ["p_size"], F.col("p_partkey"), {"q1": (1, 4), "p90": (9, 10)}).drop("n")


@query("""
SELECT l_linenumber, round(CASE WHEN n >= 2 AND n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0 THEN (n * sxy - sx * sy) / sqrt(n * sxx - sx * sx) / sqrt(n * syy - sy * sy) ELSE 0 END, 9) AS r
FROM (SELECT l_linenumber, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy
  FROM (SELECT l_linenumber, l_quantity::DOUBLE AS x, l_discount * 100 AS y FROM (SELECT l_linenumber, l_quantity, round(l_discount, 2) AS l_discount FROM lineitem)) GROUP BY 1)""")
def pearson_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy("l_linenumber").agg(F.round(percentiles.pearson(F.col("l_quantity"), F.round("l_discount", 2) * 100), 9).alias("r"))


@query("""
WITH a AS (SELECT p_brand, p_size AS x, CAST(round(p_retailprice) AS INT) AS y FROM part),
r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY x) + (count(*) OVER (PARTITION BY p_brand, x) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY p_brand ORDER BY y) + (count(*) OVER (PARTITION BY p_brand, y) - 1) / 2.0::DOUBLE AS y FROM a)
SELECT p_brand, round(coalesce(corr(x, y), 0), 9) AS r FROM r GROUP BY 1""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_brand", "p_size", F.round("p_retailprice").cast("int").alias("y"))
    ranked = percentiles.mid_ranks(percentiles.mid_ranks(part, "p_size", ["p_brand"], "rx"), "y", ["p_brand"], "ry")
    return ranked.groupBy("p_brand").agg(F.round(percentiles.pearson(F.col("rx"), F.col("ry")), 9).alias("r"))
