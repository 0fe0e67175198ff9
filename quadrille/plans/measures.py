"""Queries: measures of lines and rings, and tokens of whole cells with their boundary references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import geometry, measure, tokens
from quadrille.operators.spatial import box_ring, point
from quadrille.plans.feat import SQL, features
from quadrille.plans.labels import DIRECTION_SQL
from quadrille.plans.registry import Registry

query = Registry()


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature as a triangle (ring), as a line of four points, as the same line a little off, and as a box."""
    x, y, w, h = (F.col(c).cast("double") for c in ("x0", "y0", "w", "h"))
    triangle = F.array(point(x, y), point(x + w, y), point(x, y + h), point(x, y))
    line = F.array(point(x, y), point(x + w, y), point(x + w + w, y), point(x + 2 * w, y + h))
    off = F.array(point(x, y), point(x + w, y), point(x + 2 * w, y), point(x + 2 * w, y + h + 1))
    return features(spark, sf_dir).select("feature_id", "city", "feature_class", "x0", "y0", "w", "h", triangle.alias("triangle"), line.alias("line"), off.alias("off"), box_ring(x, y, x + w, y + h).alias("box"))


@query(SQL + "SELECT feature_id, round(degrees(atan2(w, h)), 6) AS a, round(degrees(atan2(h, w)), 6) AS b, round(90.0::DOUBLE, 6) AS c FROM feat")
def corner_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lines(spark, sf_dir).select("feature_id", measure.corner_angles(F.col("triangle")).alias("a"))
    return a.select("feature_id", F.round(F.get("a", F.lit(1)), 6).alias("a"), F.round(F.get("a", F.lit(0)), 6).alias("b"), F.round(F.get("a", F.lit(2)), 6).alias("c"))


@query(SQL + "SELECT city, count(*) * 4 AS n, count(*) * 4 AS n_right FROM feat GROUP BY 1")
def right_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of boxes within ten degrees of a right angle."""
    a = lines(spark, sf_dir).select("city", F.explode(measure.corner_angles(F.col("box"))).alias("a"))
    return a.groupBy("city").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("a") - 90) <= 10).alias("n_right"))


@query(SQL + "SELECT feature_id, round(0.0::DOUBLE, 6) AS first, round(90.0::DOUBLE, 6) AS second FROM feat")
def line_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir).select("feature_id", measure.turns(F.col("line")).alias("t"))
    return t.select("feature_id", F.round(F.get("t", F.lit(0)), 6).alias("first"), F.round(F.get("t", F.lit(1)), 6).alias("second"))


@query(SQL + "SELECT feature_id, 3::INT AS n, x0 + 2.0::DOUBLE * w AS x, y0 AS y FROM feat")
def collinear_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lines(spark, sf_dir).select("feature_id", measure.without_collinear(F.col("line")).alias("k"))
    return k.select("feature_id", F.size("k").alias("n"), F.get("k", F.lit(1))["x"].alias("x"), F.get("k", F.lit(1))["y"].alias("y"))


@query(SQL + "SELECT feature_id, CAST(2 * ceil(w / 7.0::DOUBLE) + ceil(h / 7.0::DOUBLE) + 1 AS INT) AS n, round(2.0::DOUBLE * w + h, 6) AS length FROM feat")
def densified(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(spark, sf_dir).select("feature_id", measure.densify(F.col("line"), 7.0).alias("d"))
    return d.select("feature_id", F.size("d").alias("n"), F.round(geometry.length(F.col("d")), 6).alias("length"))


@query(SQL + "SELECT feature_id, round(x0 + w / 3.0::DOUBLE, 6) AS x, round(y0 + h / 3.0::DOUBLE, 6) AS y FROM feat")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lines(spark, sf_dir).select("feature_id", measure.centroid(F.col("triangle")).alias("c"))
    return c.select("feature_id", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


@query(SQL + "SELECT feature_class, count(*) AS n, count(*) AS n_boxes, 0::BIGINT AS n_bows FROM feat GROUP BY 1")
def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid boxes, and valid rings of those whose sides were made to cross."""
    li = lines(spark, sf_dir)
    bow = F.array(F.get("box", F.lit(0)), F.get("box", F.lit(2)), F.get("box", F.lit(1)), F.get("box", F.lit(3)), F.get("box", F.lit(0)))
    kind = F.lit(2).cast("byte")
    v = li.select("feature_class", measure.is_valid(kind, F.array("box")).alias("good"), measure.is_valid(kind, F.array(bow)).alias("bad"))
    return v.groupBy("feature_class").agg(F.count("*").alias("n"), F.count_if("good").alias("n_boxes"), F.count_if("bad").alias("n_bows"))


@query(SQL + "SELECT feature_id, round(sqrt(4.0::DOUBLE * w * w + h * h) / sqrt(4.0::DOUBLE * w * w + h * h), 9) AS gap, 0.0::DOUBLE AS ring_gap FROM feat")
def closure_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("feature_id", F.round(measure.closure_gap(F.col("line")), 9).alias("gap"), F.round(measure.closure_gap(F.col("box")), 9).alias("ring_gap"))


@query(SQL + "SELECT feature_id, 1.0::DOUBLE AS distance FROM feat")
def hausdorff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("feature_id", F.round(measure.hausdorff_distance("line", "off"), 6).alias("distance"))


@query(SQL + "SELECT feature_id, round(degrees(atan2(1, 2.0::DOUBLE * w)), 6) AS error FROM feat WHERE w >= 2")
def bearing_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a long side along x against one whose end is a metre off."""
    x, y, w = F.col("x0"), F.col("y0"), F.col("w").cast("double")
    a, b = F.array(point(x, y), point(x + 2 * w, y)), F.array(point(x, y), point(x + 2 * w, y + 1))
    return features(spark, sf_dir).where("w >= 2").select("feature_id", F.round(measure.bearing_error(a, b), 6).alias("error"))


ENDS_SQL = SQL + """, e AS (SELECT feature_id, city, cell_i, cell_j, CASE WHEN x0 <= 1e-6 THEN 'W' WHEN abs(x0 - 250) <= 1e-6 THEN 'E' WHEN y0 <= 1e-6 THEN 'N' WHEN abs(y0 - 250) <= 1e-6 THEN 'S' END AS a,
 CASE WHEN x0 + w <= 1e-6 THEN 'W' WHEN abs(x0 + w - 250) <= 1e-6 THEN 'E' WHEN y0 + h <= 1e-6 THEN 'N' WHEN abs(y0 + h - 250) <= 1e-6 THEN 'S' END AS z FROM feat WHERE feature_class = 0)
"""


@query(ENDS_SQL + "SELECT DISTINCT city, cell_i, cell_j, side FROM (SELECT city, cell_i, cell_j, a AS side FROM e UNION ALL SELECT city, cell_i, cell_j, z FROM e) WHERE side IS NOT NULL")
def road_edge_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and sides at which a road of the cell ends."""
    f = features(spark, sf_dir).where("feature_class = 0")
    sides = F.array(geometry.edge_of(F.col("x0"), F.col("y0")), geometry.edge_of(F.col("x0") + F.col("w"), F.col("y0") + F.col("h")))
    return f.select("city", "cell_i", "cell_j", F.explode(sides).alias("side")).where("side IS NOT NULL").distinct()


@query(ENDS_SQL + "SELECT CASE WHEN a IS NULL AND z IS NULL THEN 'inside' WHEN a IS NULL OR z IS NULL THEN 'one end' WHEN a = z THEN 'same edge' ELSE 'two edges' END AS relation, count(*) AS n FROM e GROUP BY 1")
def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir).where("feature_class = 0")
    a, z = geometry.edge_of(F.col("x0"), F.col("y0")), geometry.edge_of(F.col("x0") + F.col("w"), F.col("y0") + F.col("h"))
    return f.select(geometry.end_relation(a, z).alias("relation")).groupBy("relation").agg(F.count("*").alias("n"))


#: A road from where it is to the right, up to the cell's eastern side at most; what a side's class is follows from the cell.
ROADS_SQL = SQL + f""", r AS (SELECT feature_id, cell_i, cell_j, x0, y0, least(x0 + 3 * w, 250.0::DOUBLE) AS x1, CASE (cell_i + cell_j) % 3 WHEN 0 THEN 'MAJOR' WHEN 1 THEN 'MINOR' ELSE 'NONE' END AS c FROM feat WHERE feature_class = 0 AND x0 < 249),
q AS (SELECT *, CAST(round_even(x0 / 0.5, 0) AS INT) AS qx, CAST(round_even(y0 / 0.5, 0) AS INT) AS qy, CAST(round_even((x1 - x0) / 0.5, 0) AS INT) AS n, CASE c WHEN 'MAJOR' THEN 0 WHEN 'MINOR' THEN 4 END AS k FROM r),
s AS (SELECT *, CASE WHEN x0 = 0 THEN 1503 + k WHEN y0 = 0 THEN 1500 + k WHEN y0 = 250 THEN 1502 + k END AS inbound, CASE WHEN x1 = 250 THEN 1501 + k WHEN y0 = 0 THEN 1500 + k WHEN y0 = 250 THEN 1502 + k END AS outbound FROM q),
t AS (SELECT *, [509, 7] || CASE WHEN inbound IS NULL THEN [] ELSE [inbound] END || [300 + qx // 23, 323 + qx % 23, 346 + qy // 23, 369 + qy % 23]
  || CASE WHEN outbound IS NULL THEN flatten(list_transform(range((greatest(1, n) - 1) // 64 + 1), lambda i: [511, 443 + CAST(least(64, greatest(1, n) - i * 64) AS INT)])) ELSE [outbound] END || [510] AS tokens FROM s)
"""


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir).where("feature_class = 0 AND x0 < 249")
    line = F.array(point(F.col("x0"), F.col("y0")), point(F.least(F.col("x0") + 3 * F.col("w"), F.lit(250.0)), F.col("y0")))
    label = F.get(F.array(F.lit("MAJOR"), F.lit("MINOR"), F.lit("NONE")), (F.col("cell_i") + F.col("cell_j")) % 3)
    sides = F.create_map(*[c for s in tokens.BOUNDARY_SIDES for c in (F.lit(s), label)])
    return f.select("feature_id", "city", "tile_i", "tile_j", "cell_i", "cell_j", line.alias("p"), tokens.encode_shape(F.lit(7), F.array(line), F.lit(True), sides).alias("t"))


def text(ids) -> F:
    return F.array_join(F.transform(ids, lambda t: t.cast("string")), ",")


@query(ROADS_SQL + "SELECT feature_id, array_to_string(tokens, ',') AS tokens FROM t")
def encode_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four forms: with a reference to the boundary at neither end, at one or at both."""
    return roads(spark, sf_dir).select("feature_id", text("t").alias("tokens"))


@query(ROADS_SQL + "SELECT CASE WHEN inbound IS NULL AND outbound IS NULL THEN 'A' WHEN inbound IS NULL THEN 'B' WHEN outbound IS NULL THEN 'C' ELSE 'D' END AS form, count(*) AS n FROM s GROUP BY 1")
def boundary_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = roads(spark, sf_dir)
    first, last = tokens.is_boundary(F.get("t", F.lit(2))), tokens.is_boundary(F.get("t", F.size("t") - 2))
    return t.groupBy(F.when(first & last, "D").when(first, "C").when(last, "B").otherwise("A").alias("form")).agg(F.count("*").alias("n"))


@query(ROADS_SQL + ", b AS (SELECT unnest([inbound, outbound]) AS token FROM s) SELECT token, count(*) AS n FROM b WHERE token IS NOT NULL GROUP BY 1")
def boundary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = roads(spark, sf_dir).select(F.explode(F.filter("t", tokens.is_boundary)).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"))


@query(ROADS_SQL + ", p AS (SELECT cell_i, cell_j, unnest([inbound, outbound]) AS token FROM s) SELECT cell_i, cell_j, token, 0::BIGINT AS missing, count(*) AS extra FROM p WHERE token IS NOT NULL AND (cell_i + cell_j) % 4 = 0 GROUP BY ALL")
def boundary_bijection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that the tokens have against those that ends and contract ask for, where a part of the contract was lost."""
    from quadrille.operators import sets

    t = roads(spark, sf_dir)
    label = F.get(F.array(F.lit("MAJOR"), F.lit("MINOR"), F.lit("NONE")), (F.col("cell_i") + F.col("cell_j")) % 3)
    ends = F.transform(F.array(F.element_at("p", 1), F.element_at("p", -1)), lambda q: tokens.boundary_token(geometry.edge_of(q["x"], q["y"]), label))
    asked = t.where("(cell_i + cell_j) % 4 <> 0").select("cell_i", "cell_j", F.explode(ends).alias("token")).where("token IS NOT NULL")
    there = t.select("cell_i", "cell_j", F.explode(F.filter("t", tokens.is_boundary)).alias("token"))
    return sets.bag_difference(asked, there, ["cell_i", "cell_j"], "token").where("missing > 0 OR extra > 0").select("cell_i", "cell_j", "token", F.col("missing").cast("long").alias("missing"), F.col("extra").cast("long").alias("extra"))


@query()
def cell_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64 cells of each tile with the tokens of their roads in order, and a digest; a test has the plain form."""
    from quadrille.operators import grid

    t = roads(spark, sf_dir)
    key = [*grid.TILE, "cell_i", "cell_j"]
    each = t.groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("feature_id", "t"))), lambda s: s["t"])).alias("tokens"), F.count("*").alias("feature_count"))
    every = t.select(*grid.TILE).distinct().crossJoin(F.broadcast(grid.cells(spark)))
    cells = every.join(each, key, "left").select(*key, "slot", F.coalesce("tokens", F.array().cast("array<int>")).alias("tokens"), F.coalesce("feature_count", F.lit(0)).alias("feature_count"))
    return cells.withColumn("sha256", F.sha2(F.array_join(F.transform("tokens", lambda x: F.lpad(F.hex(x), 4, "0")), "").cast("binary"), 256))


@query(ROADS_SQL + """SELECT feature_id, CASE WHEN outbound IS NULL THEN 2 ELSE 2 END::INT AS n, qx * 0.5::DOUBLE AS x, qy * 0.5::DOUBLE AS y,
 round(CASE WHEN outbound IS NULL THEN qx * 0.5 + greatest(1, n) * 0.5 * cos(radians(0.5)) ELSE qx * 0.5 END, 6) AS last_x, outbound IS NOT NULL AS collapsed FROM s WHERE n <= 64""")
def decode_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the blocks; a road that only goes out over a boundary has collapsed to its anchor."""
    d = roads(spark, sf_dir).where(F.bround((F.get("p", F.lit(1))["x"] - F.get("p", F.lit(0))["x"]) / 0.5) <= 64).select("feature_id", "t", tokens.decode_block(F.col("t")).alias("d"))
    first, last = F.get("d", F.lit(0)), F.element_at("d", -1)
    return d.select("feature_id", F.size("d").alias("n"), first["x"].alias("x"), first["y"].alias("y"), F.round(last["x"], 6).alias("last_x"), tokens.collapsed(F.col("t"), F.col("d")).alias("collapsed"))


@query(ROADS_SQL + "SELECT CASE WHEN outbound IS NULL THEN 'kept' ELSE 'outbound' END AS kind, count(*) AS n, round(max(CASE WHEN outbound IS NULL THEN abs(x0 - qx * 0.5) END), 6) <= 0.25 AS anchor_ok FROM s WHERE n <= 64 GROUP BY 1")
def round_trip_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded roads against what they were made from: the anchor is off by half a step at most."""
    d = roads(spark, sf_dir).where(F.bround((F.get("p", F.lit(1))["x"] - F.get("p", F.lit(0))["x"]) / 0.5) <= 64).select("p", "t", tokens.decode_block(F.col("t")).alias("d"))
    out = tokens.is_boundary(F.get("t", F.size("t") - 2))
    error = F.abs(F.get("d", F.lit(0))["x"] - F.get("p", F.lit(0))["x"])
    return d.groupBy(F.when(out, "outbound").otherwise("kept").alias("kind")).agg(F.count("*").alias("n"), (F.round(F.max(F.when(~out, error)), 6) <= 0.25).alias("anchor_ok"))


@query(ROADS_SQL + """SELECT feature_id, '{"coordinates":[[' || (qx * 0.5::DOUBLE) || ',' || (qy * 0.5::DOUBLE) || ']],"type":"Point"}' AS json FROM s WHERE outbound IS NOT NULL""")
def anchors_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For inspection, with sorted keys."""
    d = roads(spark, sf_dir).where(tokens.is_boundary(F.get("t", F.size("t") - 2))).select("feature_id", F.get(tokens.decode_block(F.col("t")), F.lit(0)).alias("a"))
    return d.select("feature_id", F.to_json(F.struct(F.array(F.array("a.x", "a.y")).alias("coordinates"), F.lit("Point").alias("type"))).alias("json"))


@query(SQL + "SELECT feature_id, array_to_string(list_concat(flatten(list_transform([32, 16, 8, 4, 2, 1], lambda s: list_transform(range((CASE s WHEN 32 THEN w ELSE w % (2 * s) END) // s), lambda i: 'MOVE_E_' || s))), flatten(list_transform([32, 16, 8, 4, 2, 1], lambda s: list_transform(range((CASE s WHEN 32 THEN h ELSE h % (2 * s) END) // s), lambda i: 'MOVE_N_' || s)))), ' ') AS moves FROM feat")
def plain_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w, h = F.col("x0"), F.col("y0"), F.col("w"), F.col("h")
    p = F.array(point(x, y), point(x + w, y), point(x + w, y + h))
    return features(spark, sf_dir).select("feature_id", F.array_join(tokens.plain_moves(p), " ").alias("moves"))


@query(SQL + "SELECT city, count(*) FILTER (WHERE x0 = 0 OR y0 = 0 OR x0 = 250 OR y0 = 250) AS n_on FROM feat GROUP BY 1")
def boundary_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).groupBy("city").agg(F.count_if(tokens.on_boundary(F.col("x0"), F.col("y0"))).alias("n_on"))


@query(SQL + "SELECT feature_id, array_to_string(list_resize([w, h, w + h], 3 + city, 0), ',') AS padded FROM feat")
def padded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("feature_id", text(tokens.padded(F.array("w", "h", F.col("w") + F.col("h")), F.col("city") + 3)).alias("padded"))


@query("WITH m AS (SELECT i, row_number() OVER (ORDER BY sha256('5:' || i), i) <= 6 AS masked FROM range(20) r(i)) SELECT p_partkey, string_agg(CASE WHEN masked THEN '-1' ELSE CAST(p_size + i AS VARCHAR) END, ',' ORDER BY i) AS tokens FROM part, m GROUP BY 1")
def absorbing_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 % of 20 tokens masked, which ones by the digest of seed and place."""
    from quadrille.plans.feat import read

    t = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.col("p_size") + i)
    return read(spark, sf_dir, "part").select("p_partkey", text(tokens.absorbing_mask(t, 0.3, "5", -1)).alias("tokens"))


@query(SQL + f", d AS (SELECT feature_id, {DIRECTION_SQL.format(x='w', y='h')} AS bin, degrees(atan2(h, w)) AS angle FROM feat WHERE w <> h) SELECT count(*) AS n, max(abs(bin + 0.5::DOUBLE - angle)) <= 0.5 AS within FROM d")
def direction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a direction's middle is from the angle: half a degree at most."""
    d = features(spark, sf_dir).where("w <> h").select(tokens.direction(F.col("w"), F.col("h")).alias("bin"), F.degrees(F.atan2(F.col("h"), F.col("w"))).alias("angle"))
    return d.agg(F.count("*").alias("n"), (F.max(F.abs(F.col("bin") + 0.5 - F.col("angle"))) <= 0.5).alias("within"))


@query(SQL + """, g AS (SELECT q, s, abs(w * 1.37::DOUBLE - round_even(w * 1.37::DOUBLE / q, 0) * q) AS e FROM feat, (VALUES (0.25::DOUBLE, 'quarter'), (0.5, 'half'), (1.0, 'one')) v(q, s))
SELECT s AS step, count(*) AS n, round(avg(e), 9) AS mean, round(max(e), 9) AS most FROM g GROUP BY 1""")
def step_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of lengths at several steps: one pass, each row against the few parameters."""
    x = F.col("w") * 1.37
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.abs(x - F.bround(x / q) * q).alias("e")) for q, s in ((0.25, "quarter"), (0.5, "half"), (1.0, "one"))])).alias("g")
    return features(spark, sf_dir).select(each).groupBy("g.step").agg(F.count("*").alias("n"), F.round(F.avg("g.e"), 9).alias("mean"), F.round(F.max("g.e"), 9).alias("most"))
