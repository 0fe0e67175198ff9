"""Queries: grid assignment, dense cells, edges, boundary classes, zoning and density labels, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import grid, tokens
from quadrille.operators.frequency import bucket
from quadrille.operators.grid import TILE
from quadrille.plans.feat import SQL, features

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


@query(SQL + """SELECT feature_id, CAST(floor(gx / 2000) AS INT) AS tile_i, CAST(floor(gy / 2000) AS INT) AS tile_j, CAST(floor((gx - floor(gx / 2000) * 2000) / 250) AS INT) AS cell_i, CAST(floor((gy - floor(gy / 2000) * 2000) / 250) AS INT) AS cell_j
FROM (SELECT feature_id, x0 * 40 - 3000 AS gx, y0 * 40 AS gy FROM feat)""")
def tile_cell_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    gx, gy = F.col("x0") * 40 - 3000, F.col("y0") * 40
    return features(spark, sf_dir).select("feature_id", grid.tile_of(gx).alias("tile_i"), grid.tile_of(gy).alias("tile_j"), grid.cell_of(gx).alias("cell_i"), grid.cell_of(gy).alias("cell_j"))


@query(SQL + "SELECT feature_id, x0, y0 FROM feat WHERE x0 <= 120 AND x0 + w >= 80 AND y0 <= 60 AND y0 + h >= 20")
def bbox_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.sources.tables import overlaps

    return features(spark, sf_dir).where(overlaps(F.col("x0"), F.col("x0") + F.col("w"), F.col("y0"), F.col("y0") + F.col("h"), (80, 20, 120, 60))).select("feature_id", "x0", "y0")


@query(SQL + "SELECT count(*) AS n_rows, count(*) * 200 AS n_bytes FROM feat WHERE x0 <= 120 AND x0 + w >= 80 AND y0 <= 60 AND y0 + h >= 20")
def bbox_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.sources.tables import estimate, overlaps

    f = features(spark, sf_dir)
    return estimate(f.where(overlaps(F.col("x0"), F.col("x0") + F.col("w"), F.col("y0"), F.col("y0") + F.col("h"), (80, 20, 120, 60))))


CELLS_SQL = """, cells AS (SELECT CAST(i * 8 + j AS INT) AS slot, CAST(i AS INT) AS cell_i, CAST(j AS INT) AS cell_j FROM range(8) a(i), range(8) b(j)),
counts AS (SELECT city, tile_i, tile_j, cell_i, cell_j, count(*) AS n FROM feat WHERE feature_class <> 3 OR w > 25 GROUP BY ALL),
dense AS (SELECT t.*, slot, c.cell_i, c.cell_j, n IS NOT NULL AS active, coalesce(n, 0) AS n FROM (SELECT DISTINCT city, tile_i, tile_j FROM feat) t CROSS JOIN cells c LEFT JOIN counts k ON t.city = k.city AND t.tile_i = k.tile_i AND t.tile_j = k.tile_j AND c.cell_i = k.cell_i AND c.cell_j = k.cell_j)
"""


def sparse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = features(spark, sf_dir)
    return f, f.where("feature_class <> 3 OR w > 25")


@query(SQL.rstrip() + CELLS_SQL + "SELECT * FROM dense")
def cell_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, some = sparse(spark, sf_dir)
    return grid.dense_cells(some, f)


EDGES_SQL = """, edges AS (
  SELECT CAST(row_number() OVER (ORDER BY o, p, q) - 1 AS INT) AS edge, external, CAST(lower_i AS INT) AS lower_i, CAST(lower_j AS INT) AS lower_j, CAST(axis AS INT) AS axis FROM (
    SELECT 0 AS o, i AS p, j AS q, FALSE AS external, i AS lower_i, j AS lower_j, 0 AS axis FROM range(7) a(i), range(8) b(j)
    UNION ALL SELECT 1, i, j, FALSE, i, j, 1 FROM range(8) a(i), range(7) b(j)
    UNION ALL SELECT 2, j, 0, TRUE, -1, j, 0 FROM range(8) b(j) UNION ALL SELECT 3, j, 0, TRUE, 7, j, 0 FROM range(8) b(j)
    UNION ALL SELECT 4, i, 0, TRUE, i, -1, 1 FROM range(8) a(i) UNION ALL SELECT 5, i, 0, TRUE, i, 7, 1 FROM range(8) a(i))),
scopes AS (
  SELECT t.city, t.tile_i, t.tile_j, edge, external, lower_i, lower_j, axis, CASE WHEN external THEN CASE WHEN n > 0 THEN 3 ELSE 1 END WHEN n = 2 THEN 0 WHEN n = 0 THEN 1 ELSE 2 END AS scope
  FROM (SELECT t.city, t.tile_i, t.tile_j, e.*, CAST(coalesce(a.active, FALSE) AS INT) + CAST(coalesce(b.active, FALSE) AS INT) AS n
    FROM (SELECT DISTINCT city, tile_i, tile_j FROM dense) t CROSS JOIN edges e
    LEFT JOIN dense a ON a.city = t.city AND a.tile_i = t.tile_i AND a.tile_j = t.tile_j AND a.cell_i = lower_i AND a.cell_j = lower_j
    LEFT JOIN dense b ON b.city = t.city AND b.tile_i = t.tile_i AND b.tile_j = t.tile_j AND b.cell_i = lower_i + CASE axis WHEN 0 THEN 1 ELSE 0 END AND b.cell_j = lower_j + CASE axis WHEN 1 THEN 1 ELSE 0 END) t)
"""


@query(SQL.rstrip() + CELLS_SQL + EDGES_SQL + "SELECT * FROM scopes")
def edge_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, some = sparse(spark, sf_dir)
    return grid.edge_scopes(grid.dense_cells(some, f))


@query("SELECT edge, external, CAST(lower_i AS INT) AS lower_i, CAST(lower_j AS INT) AS lower_j, axis FROM edges".join(["WITH x AS (SELECT 1)" + EDGES_SQL.split(",\nscopes AS")[0] + "\n", ""]))
def edge_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.edges(spark)


CROSS_SQL = """, crossings AS (SELECT city, tile_i, tile_j, cell_i AS lower_i, cell_j AS lower_j, CAST(h % 2 AS INT) AS axis, road AS road_class FROM feat WHERE feature_class = 0),
labelled AS (
  SELECT s.*, CASE WHEN scope = 0 THEN CASE WHEN v = 0 THEN 'MAJOR' WHEN v = 1 THEN 'MINOR' ELSE 'NONE' END END AS class
  FROM scopes s LEFT JOIN (SELECT city, tile_i, tile_j, lower_i, lower_j, axis, min(CASE WHEN road_class = 'R' THEN 0 ELSE 1 END) AS v FROM crossings GROUP BY ALL) USING (city, tile_i, tile_j, lower_i, lower_j, axis))
"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, some = sparse(spark, sf_dir)
    crossings = f.where("feature_class = 0").select(*TILE, F.col("cell_i").alias("lower_i"), F.col("cell_j").alias("lower_j"), (F.col("h") % 2).cast("int").alias("axis"), F.col("road").alias("road_class"))
    return grid.boundary_class(crossings, grid.edge_scopes(grid.dense_cells(some, f)), ("R",))


@query(SQL.rstrip() + CELLS_SQL + EDGES_SQL + CROSS_SQL + "SELECT city, tile_i, tile_j, edge, scope, class FROM labelled")
def boundary_class_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select(*TILE, "edge", "scope", "class")


@query(SQL.rstrip() + CELLS_SQL + EDGES_SQL + CROSS_SQL + """, sides AS (SELECT * FROM (VALUES ('N', 0, -1, 1), ('S', 0, 0, 1), ('W', -1, 0, 0), ('E', 0, 0, 0)) s(side, di, dj, axis))
SELECT d.city, d.tile_i, d.tile_j, d.cell_i, d.cell_j, side, coalesce(class, 'NONE') AS class FROM dense d CROSS JOIN sides s
LEFT JOIN labelled l ON l.city = d.city AND l.tile_i = d.tile_i AND l.tile_j = d.tile_j AND l.lower_i = d.cell_i + di AND l.lower_j = d.cell_j + dj AND l.axis = s.axis WHERE d.active""")
def cell_edge_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, some = sparse(spark, sf_dir)
    active = grid.dense_cells(some, f).where("active").select(*TILE, "cell_i", "cell_j")
    return grid.side_contract(labelled(spark, sf_dir), active)


CONTRACT_SQL = """, sides AS (SELECT * FROM (VALUES ('N', 0, -1, 1), ('S', 0, 0, 1), ('W', -1, 0, 0), ('E', 0, 0, 0)) s(side, di, dj, axis)),
contract AS (SELECT d.city, d.tile_i, d.tile_j, d.cell_i, d.cell_j, side, CASE WHEN side = 'E' AND (d.cell_i + d.cell_j) % 5 = 0 OR side = 'N' AND d.city = 2 AND d.cell_j = 3 THEN 'NONE' ELSE coalesce(class, 'NONE') END AS class
  FROM dense d CROSS JOIN sides s LEFT JOIN labelled l ON l.city = d.city AND l.tile_i = d.tile_i AND l.tile_j = d.tile_j AND l.lower_i = d.cell_i + di AND l.lower_j = d.cell_j + dj AND l.axis = s.axis WHERE d.active)
"""


@query(SQL.rstrip() + CELLS_SQL + EDGES_SQL + CROSS_SQL + CONTRACT_SQL + """SELECT a.city, a.tile_i, a.tile_j, a.cell_i, a.cell_j, a.class AS own, b.class AS other, a.side
FROM contract a JOIN contract b ON a.city = b.city AND a.tile_i = b.tile_i AND a.tile_j = b.tile_j AND (a.side = 'E' AND b.side = 'W' AND b.cell_i = a.cell_i + 1 AND b.cell_j = a.cell_j OR a.side = 'S' AND b.side = 'N' AND b.cell_i = a.cell_i AND b.cell_j = a.cell_j + 1)
WHERE a.class <> b.class""")
def symmetry_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract in which some sides were lost: each side of an edge has its own word on it."""
    lost = (F.col("side") == "E") & ((F.col("cell_i") + F.col("cell_j")) % 5 == 0) | (F.col("side") == "N") & (F.col("city") == 2) & (F.col("cell_j") == 3)
    return grid.asymmetries(cell_edge_contract(spark, sf_dir).withColumn("class", F.when(lost, "NONE").otherwise(F.col("class"))))


ZONING_SQL = """SELECT t.*, CAST(c AS INT) AS class, coalesce(n, 0) AS n FROM (SELECT DISTINCT city, tile_i, tile_j, cell_i, cell_j FROM feat) t CROSS JOIN range(4) r(c)
LEFT JOIN (SELECT city, tile_i, tile_j, cell_i, cell_j, feature_class, count(*) AS n FROM feat GROUP BY ALL) k ON k.city = t.city AND k.tile_i = t.tile_i AND k.tile_j = t.tile_j AND k.cell_i = t.cell_i AND k.cell_j = t.cell_j AND feature_class = c"""

CELL = [*TILE, "cell_i", "cell_j"]


def zoning(f: DataFrame) -> DataFrame:
    """One row per active cell with a count for each class: the classes are fixed, so no join is needed."""
    return f.groupBy(*CELL).agg(*[F.count_if(F.col("feature_class") == c).alias(f"c{c}") for c in range(4)])


@query(SQL + ZONING_SQL)
def zoning_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = zoning(features(spark, sf_dir))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"c{c}").alias("n")) for c in range(4)])).alias("e")
    return counts.select(*CELL, each).select(*CELL, "e.class", "e.n")


@query(SQL + f"SELECT city, tile_i, tile_j, cell_i, cell_j, arg_max(class, n * 10 - class) AS dominant FROM ({ZONING_SQL}) GROUP BY ALL")
def zoning_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = zoning(features(spark, sf_dir))
    best = F.greatest(*[F.struct(F.col(f"c{c}").alias("n"), F.lit(-c).alias("tie")) for c in range(4)])
    return counts.select(*CELL, (-best["tie"]).alias("dominant"))


RATIO_SQL = "SELECT city, tile_i, tile_j, cell_i, cell_j, sum(CASE WHEN feature_class = 1 THEN w * h ELSE 0 END)::DOUBLE / 62500 AS ratio FROM feat GROUP BY ALL"


def ratios(f: DataFrame) -> DataFrame:
    """Building area over the cell's area."""
    return f.groupBy(*CELL).agg((F.sum(F.when(F.col("feature_class") == 1, F.col("w") * F.col("h")).otherwise(0)).cast("double") / 62500).alias("ratio"))


@query(SQL + f"SELECT *, CASE WHEN ratio < 0.05 THEN 0 WHEN ratio < 0.15 THEN 1 WHEN ratio < 0.35 THEN 2 ELSE 3 END AS bucket FROM ({RATIO_SQL})")
def density_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratios(features(spark, sf_dir)).withColumn("bucket", bucket(F.col("ratio"), [0, 0.05, 0.15, 0.35]))


@query(SQL + f"SELECT city, tile_i, tile_j, round(avg(ratio), 9) AS mean, s[CAST(round_even(0.5 * (n - 1), 0) AS INT) + 1] AS p50, s[CAST(round_even(0.75 * (n - 1), 0) AS INT) + 1] AS p75 FROM (SELECT city, tile_i, tile_j, unnest(s) AS ratio, s, n FROM (SELECT city, tile_i, tile_j, list_sort(list(ratio)) AS s, count(*) AS n FROM ({RATIO_SQL}) GROUP BY ALL)) GROUP BY ALL")
def pop_density_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.operators.percentiles import nearest_rank, picks

    each = ratios(features(spark, sf_dir))
    mean = each.groupBy(*TILE).agg(F.round(F.avg("ratio"), 9).alias("mean"))
    return mean.join(picks(each, TILE, F.col("ratio"), {"p50": nearest_rank(0.5), "p75": nearest_rank(0.75)}).drop("n"), TILE)


@query(SQL + """, d AS (SELECT city, tile_i, tile_j, cell_i, cell_j, arg_max(class, n * 10 - class) AS z FROM (""" + ZONING_SQL + """) GROUP BY ALL),
p AS (SELECT a.city, a.tile_i, a.tile_j, a.z = b.z AS same FROM d a JOIN d b ON a.city = b.city AND a.tile_i = b.tile_i AND a.tile_j = b.tile_j AND (b.cell_i = a.cell_i + 1 AND b.cell_j = a.cell_j OR b.cell_i = a.cell_i AND b.cell_j = a.cell_j + 1))
SELECT city, tile_i, tile_j, count(*) AS n_pairs, count(*) FILTER (WHERE same)::DOUBLE / count(*) AS share FROM p GROUP BY ALL""")
def zoning_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.agreement(zoning_dominant(spark, sf_dir), "dominant")


@query(SQL + "SELECT city, tile_i, tile_j, count(*) FILTER (WHERE feature_class = 0) AS c0, count(*) FILTER (WHERE feature_class = 1) AS c1, count(*) FILTER (WHERE feature_class = 2) AS c2, count(*) FILTER (WHERE feature_class = 3) AS c3 FROM feat GROUP BY ALL")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).groupBy(*TILE).agg(*[F.count_if(F.col("feature_class") == c).alias(f"c{c}") for c in range(4)])


@query(SQL + "SELECT city, round(sum(w * h * y0) / sum(h), 6) AS weighted FROM feat GROUP BY 1")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).groupBy("city").agg(F.round(F.try_divide(F.sum(F.col("w") * F.col("h") * F.col("y0")), F.sum("h")), 6).alias("weighted"))


@query(SQL + """SELECT city, tile_i, tile_j, CASE WHEN sea AND len >= 2000 THEN 3 WHEN len >= 2000 THEN 2 WHEN sea THEN 1 ELSE 0 END AS coastal
FROM (SELECT city, tile_i, tile_j, bool_or(feature_class = 3 AND w > 50) AS sea, sum(CASE WHEN feature_class = 3 THEN w ELSE 0 END) AS len FROM feat GROUP BY ALL)""")
def coastal_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("feature_class") == 3
    t = features(spark, sf_dir).groupBy(*TILE).agg(F.bool_or(base & (F.col("w") > 50)).alias("sea"), F.sum(F.when(base, F.col("w")).otherwise(0)).alias("len"))
    river = F.col("len") >= 2000
    return t.select(*TILE, F.when(F.col("sea") & river, 3).when(river, 2).when(F.col("sea"), 1).otherwise(0).alias("coastal"))


@query(SQL + """SELECT feature_id, CAST(round_even(x0 / 0.5, 0) AS INT) AS qx, CAST(round_even(y0 / 0.5, 0) AS INT) AS qy FROM feat""")
def quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("feature_id", tokens.quantise(F.col("x0")).alias("qx"), tokens.quantise(F.col("y0")).alias("qy"))


DIRECTION_SQL = "CAST(((floor((degrees(atan2({y}, {x})) + 360) - floor((degrees(atan2({y}, {x})) + 360) / 360) * 360)) + 360) % 360 AS INT)"


@query(SQL + f"SELECT feature_id, {DIRECTION_SQL.format(x='w', y='h')} AS bin FROM feat WHERE w <> h")
def direction_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).where("w <> h").select("feature_id", tokens.direction(F.col("w"), F.col("h")).alias("bin"))


@query(SQL + "SELECT feature_id, array_to_string(list_transform(range((greatest(1, w * 4) - 1) // 64 + 1), lambda k: least(64, greatest(1, w * 4) - k * 64)), ',') AS pieces FROM feat")
def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("feature_id", F.array_join(F.transform(tokens.chunks(F.col("w") * 4), lambda q: q.cast("string")), ",").alias("pieces"))


ANCHOR_SQL = "[300 + CAST(floor(qx / 23.0::DOUBLE) AS INT), 323 + ((qx % 23) + 23) % 23, 346 + CAST(floor(qy / 23.0::DOUBLE) AS INT), 369 + ((qy % 23) + 23) % 23]"


@query(SQL + f", q AS (SELECT feature_id, CAST(round_even((x0 - 100) / 0.5, 0) AS INT) AS qx, CAST(round_even((y0 - 30) / 0.5, 0) AS INT) AS qy FROM feat) SELECT feature_id, array_to_string({ANCHOR_SQL}, ',') AS anchor FROM q")
def anchor_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("feature_id", F.array_join(F.transform(tokens.anchor(F.col("x0") - 100, F.col("y0") - 30), lambda t: t.cast("string")), ",").alias("anchor"))


def line() -> list:
    """Two axis-aligned moves, so that lengths are exact."""
    x, y = F.col("x0"), F.col("y0")
    points = F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + F.col("w")).alias("x"), y.alias("y")), F.struct((x + F.col("w")).alias("x"), (y + F.col("h")).alias("y")))
    return points


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature_id, feature_class, p (points), t (tokens), each a column of its own: what is used many times
    is then worked out once for each row."""
    p = features(spark, sf_dir).select("feature_id", "feature_class", line().alias("p"))
    return p.select("*", tokens.encode(F.col("feature_class"), F.col("p")).alias("t"))


ENCODE_SQL = SQL + """, q AS (SELECT feature_id, feature_class, x0, y0, w, h, CAST(round_even(x0 / 0.5, 0) AS INT) AS qx, CAST(round_even(y0 / 0.5, 0) AS INT) AS qy FROM feat),
t AS (SELECT *, [509, feature_class, 300 + qx // 23, 323 + qx % 23, 346 + qy // 23, 369 + qy % 23]
  || flatten(list_transform(range((w * 2 - 1) // 64 + 1), lambda k: [511, 443 + CAST(least(64, w * 2 - k * 64) AS INT)])) || flatten(list_transform(range((h * 2 - 1) // 64 + 1), lambda k: [601, 443 + CAST(least(64, h * 2 - k * 64) AS INT)])) || [510] AS tokens FROM q)
"""


@query(ENCODE_SQL + "SELECT feature_id, array_to_string(tokens, ',') AS tokens, len(tokens) AS n FROM t")
def encode_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = encoded(spark, sf_dir)
    return t.select("feature_id", F.array_join(F.transform("t", lambda x: x.cast("string")), ",").alias("tokens"), F.size("t").cast("long").alias("n"))


@query(ENCODE_SQL + "SELECT feature_class, sum(len(tokens))::BIGINT AS cost FROM t GROUP BY 1")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = features(spark, sf_dir).select("feature_class", line().alias("p"))
    return p.groupBy("feature_class").agg(F.sum(tokens.cost(F.col("p"))).alias("cost"))


#: Sequences with a feature that begins anew, ends without a beginning, features that are whole and an unfinished tail.
MALFORMED_SQL = ENCODE_SQL + """, m AS (SELECT row_number() OVER () AS r, CASE feature_id % 4 WHEN 0 THEN [510, 7] ELSE [] END || CASE feature_id % 3 WHEN 0 THEN [509, 1] ELSE [] END || tokens || CASE feature_id % 5 WHEN 0 THEN [510, 8, 510] ELSE [9] END || tokens || [509, 1] AS s FROM t),
e AS (SELECT r, unnest(s) AS t, generate_subscripts(s, 1) AS i, s FROM m),
k AS (SELECT r, t, i, s, lead(t) OVER w AS t2, lead(i) OVER w AS i2 FROM e WHERE t IN (509, 510) WINDOW w AS (PARTITION BY r ORDER BY i)),
b AS (SELECT array_to_string(s[i:i2], ',') AS block, row_number() OVER (PARTITION BY r ORDER BY i) - 1 AS place FROM k WHERE t = 509 AND t2 = 510)
"""


@query(MALFORMED_SQL + "SELECT place::INT AS place, block, count(*) AS n FROM b GROUP BY ALL")
def split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<int>")
    some = lambda n, ids: F.when(F.col("feature_id") % n == 0, F.array(*map(F.lit, ids))).otherwise(none)
    tail = F.when(F.col("feature_id") % 5 == 0, F.array(F.lit(510), F.lit(8), F.lit(510))).otherwise(F.array(F.lit(9)))
    m = encoded(spark, sf_dir).select(F.concat(some(4, [510, 7]), some(3, [509, 1]), "t", tail, "t", F.array(F.lit(509), F.lit(1))).alias("s"))
    b = m.select(F.posexplode(tokens.blocks(F.col("s"))).alias("place", "b"))
    return b.groupBy("place", F.array_join(F.transform("b", lambda x: x.cast("string")), ",").alias("block")).agg(F.count("*").alias("n"))


@query(SQL + ", q AS (SELECT feature_id, round_even(x0 / 0.5, 0) * 0.5 AS x, round_even(y0 / 0.5, 0) * 0.5 AS y FROM feat) SELECT feature_id, x, y FROM q")
def decode_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = encoded(spark, sf_dir)
    return t.select("feature_id", tokens.decode_anchor(F.col("t")).alias("p")).select("feature_id", "p.x", "p.y")


@query(SQL + "SELECT feature_id, round(round_even(x0 / 0.5, 0) * 0.5 + w * cos(radians(0.5)) + h * cos(radians(90.5)), 6) AS x, round(round_even(y0 / 0.5, 0) * 0.5 + w * sin(radians(0.5)) + h * sin(radians(90.5)), 6) AS y FROM feat")
def decode_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = encoded(spark, sf_dir)
    return t.select("feature_id", tokens.decode_end(F.col("t")).alias("p")).select("feature_id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("SELECT c_custkey, (64 + c_nationkey % 63 + 1)::BIGINT AS nation_id, CAST(('0x' || substr(sha256(c_mktsegment), 1, 8)) AS BIGINT) % 63 + 1 AS segment_id FROM customer")
def prefix_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.plans.feat import read

    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", tokens.prefix_id(1, F.col("c_nationkey"), "int").alias("nation_id"), tokens.prefix_id(0, F.col("c_mktsegment"), "string").alias("segment_id"))
