"""Tables that a corpus is put together from: labels, targets, hold-outs, lineage, donors, samples, censuses, proposals and reports on tokens."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.operators import selection, tokens
from quadrille.operators.grid import SIDE, TILE

# Names on disk and their numbers, the zones that cities may lie in, the kinds of a union value.
GEOMETRY_TYPES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")
FEATURE_CLASSES = ("road", "building", "poi", "base")
ZONES = (28, 38)
VALUE_TYPES = ("float", "int", "string", "bool")
#: Upper ends of the classes of decoded length over length; the last is open.
INFLATION = (1.0, 1.5, 2.0, 4.0)


def encode_enum(label: Column, names: Sequence[str]) -> Column:
    """The number of a name; an unknown one is an error, null stays."""
    at = F.array_position(F.array(*map(F.lit, names)), label)
    return F.when(label.isNull(), F.lit(None).cast("int")).when(at > 0, (at - 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("unknown name "), label)).cast("int"))


def decode_enum(number: Column, names: Sequence[str]) -> Column:
    found = F.get(F.array(*map(F.lit, names)), number)
    return F.when(number.isNull(), F.lit(None).cast("string")).when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown number "), number.cast("string"))).cast("string"))


def zone_code(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """The projected system of bounds that lie in one northern zone of those in use, else null."""
    from quadrille.operators.geometry import utm_zone

    zone = utm_zone((min_lon + max_lon) / 2)
    good = (min_lat >= 0) & (max_lat >= 0) & (utm_zone(min_lon) == utm_zone(max_lon)) & zone.between(*ZONES)
    return F.when(good, F.concat(F.lit("EPSG:258"), zone.cast("string")))


def apply_policies(themes: dict[str, DataFrame], policies: Sequence[tuple[str, str, str, str | None, Sequence[str] | None]]) -> dict[str, DataFrame]:
    """The themes after each policy (theme, field, what to do with null, token, vocabulary or None) in turn; themes that aren't there are passed over.
    The given tables stay as they are."""
    from quadrille.operators import policy

    out = dict(themes)
    for theme, field, how, token, vocabulary in policies:
        if theme not in out:
            continue
        df = policy.missing(out[theme], field, how, *([token] if token is not None else []))
        out[theme] = df if vocabulary is None else policy.known(df, field, vocabulary, token)
    return out


def united(themes: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """One table of all features, each theme's with its own columns (null elsewhere) and its place in the given order; rows without a geometry go."""
    out = None
    for k, (name, df) in enumerate(themes):
        part = df.where("geometry IS NOT NULL").withColumns({"theme": F.lit(name), "theme_order": F.lit(k)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def divisions(df: DataFrame, country: str) -> DataFrame:
    """name, geometry of a country's regions that have both."""
    found = df.where((F.col("subtype") == "region") & (F.col("country") == country) & F.col("name").isNotNull() & F.col("geometry").isNotNull())
    return found.select("name", "geometry")


def edge_counts(crossings: DataFrame, features: DataFrame, lattice: DataFrame, key: Sequence[str], source: str) -> DataFrame:
    """key, edge, n: crossings of roads on every internal edge of a tile, 0 where there is none. crossings(key, source, lower_i, lower_j, axis);
    what isn't the crossing of a road of features(key, source, feature_class) doesn't count."""
    roads = features.where(F.col("feature_class") == 0).select(*key, source).distinct()
    counts = crossings.join(roads, [*key, source], "left_semi").groupBy(*key, "lower_i", "lower_j", "axis").agg(F.count("*").alias("n"))
    every = features.select(*key).distinct().crossJoin(F.broadcast(lattice.where("NOT external")))  # 112 edges
    return every.join(counts, [*key, "lower_i", "lower_j", "axis"], "left").select(*key, "edge", F.coalesce("n", F.lit(0)).alias("n"))


def tagged(rows: DataFrame) -> DataFrame:
    """rows(value_type, value_float, value_int, value_string, value_bool) with value: the one that the type names, as text."""
    value = F.coalesce(*[F.when(F.col("value_type") == k, F.col(f"value_{t}").cast("string")) for k, t in enumerate(VALUE_TYPES)])
    return rows.withColumn("value", value)


def macro_targets(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, kind ('density' or 'skeleton'), slot, value: the targets of cells and of internal edges that have one."""
    cells = rows.where("slot_kind = 0 AND cell_density_bucket IS NOT NULL").select(*key, F.lit("density").alias("kind"), F.col("slot_index").alias("slot"), F.col("cell_density_bucket").alias("value"))
    edges = rows.where("slot_kind = 1 AND road_skeleton_class IS NOT NULL").select(*key, F.lit("skeleton").alias("kind"), F.col("slot_index").alias("slot"), F.col("road_skeleton_class").alias("value"))
    return cells.unionByName(edges)


def lineage(tiles: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, n, lineage: the tiles (tile_i, tile_j) that a manifest goes back to, in order."""
    return tiles.groupBy(*by).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.struct("tile_i", "tile_j"))).alias("lineage"))


def overlaps(held: DataFrame, train: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """key, problem: 'both' for what is held out and trained on, 'unknown' for what isn't known at all."""
    h, t, k = (d.select(key).distinct() for d in (held, train, known))
    both = h.join(t, key, "left_semi").select(key, F.lit("both").alias("problem"))
    return both.unionByName(h.unionByName(t).distinct().join(k, key, "left_anti").select(key, F.lit("unknown").alias("problem")))


def unequal_sets(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """key, lacking: what not all sources have, and the names of those that lack it."""
    both = None
    for name, df in sources.items():
        part = df.select(key).distinct().withColumn("__s", F.lit(name))
        both = part if both is None else both.unionByName(part)
    there = both.groupBy(key).agg(F.collect_set("__s").alias("__there"))
    lacking = F.array_sort(F.array_except(F.array(*map(F.lit, sources)), "__there"))
    return there.select(key, F.array_join(lacking, ",").alias("lacking")).where("lacking <> ''")


def deranged(cells: DataFrame, city: str, key: str, macro: str, seed: str) -> DataFrame:
    """key, donor: a cell of the same city whose macro value differs, by the digest of seed and both; null where the city has but one value.

    Each cell is held against the different values of its city, of which there are few, by one cell each that the digest picks."""
    kinds = cells.groupBy(city, macro).agg(F.min_by(key, selection.digest(seed, F.col(key))).alias("__donor"))
    kinds = kinds.groupBy(city).agg(F.array_sort(F.collect_list(F.struct(F.col(macro).alias("m"), F.col("__donor").alias("d")))).alias("__kinds"))
    others = F.filter("__kinds", lambda k: ~k["m"].eqNullSafe(F.col(macro)))
    pick = F.pmod(F.conv(F.substring(selection.digest(seed, F.col(key)), 1, 8), 16, 10).cast("long"), F.greatest(F.lit(1), F.size("__o"))).cast("int")
    return cells.join(kinds, city).withColumn("__o", others).select(key, F.when(F.size("__o") > 0, F.get("__o", pick)["d"]).alias("donor"))


def rank_categories(counts: DataFrame) -> DataFrame:
    """value, n, token_id: numbered from 0, the most frequent first, then by name. Categories are a vocabulary, small beside the rows."""
    return counts.select("value", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "value")) - 1).alias("token_id"))


def open_ended(bounds: Sequence[int]) -> list[tuple[int, int | None]]:
    """Lower bounds as half-open ranges, the last without an end."""
    return list(zip(bounds, [*bounds[1:], None]))


def census(cells: DataFrame, strata: Sequence[str]) -> DataFrame:
    """strata, n: cells that aren't empty in each stratum, null strata as -1."""
    return cells.where(F.size("tokens") > 0).groupBy(*[F.coalesce(F.col(s).cast("int"), F.lit(-1)).alias(s) for s in strata]).agg(F.count("*").alias("n"))


def classify_blocks(cells: DataFrame, key: Sequence[str], buildings: Sequence[int]) -> DataFrame:
    """key and the number of blocks of each kind: buildings whose ring closes or doesn't, roads, single points, and what can't be decoded."""
    from quadrille.operators.geometry import closed

    blocks = cells.select(*key, F.explode(tokens.blocks(F.col("tokens"))).alias("__b")).withColumn("__d", tokens.decode_block(F.col("__b")))
    building = F.get("__b", F.lit(1)).isin(*buildings)
    kind = F.when(F.col("__d").isNull(), "undecodable").when(building & closed(F.col("__d")), "sealed").when(building, "unsealed").when(F.size("__d") == 1, "node").otherwise("road")
    each = blocks.withColumn("__kind", kind)
    return each.groupBy(*key).agg(*[F.count_if(F.col("__kind") == n).alias(n) for n in ("sealed", "unsealed", "road", "node", "undecodable")])


def inflation_class(decoded: Column, source: Column) -> Column:
    """The class of decoded length over source length, half-open; null without a source length."""
    ratio = F.try_divide(decoded, F.when(source > 0, source))
    out = F.lit(0)
    for edge in INFLATION:
        out = out + F.when(ratio >= edge, 1).otherwise(0)
    return F.when(ratio.isNotNull(), out)


def spaced_sample(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """About n rows of each group, evenly spaced in order: every max(1, size // n)-th, n at most. What is sampled is the feature here."""
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(*order)) - 1
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / n))
    return df.withColumns({"__p": place, "__s": step}).where((F.col("__p") % F.col("__s") == 0) & (F.col("__p") / F.col("__s") < n)).drop("__p", "__s")


def permutation_gap(edges: DataFrame, labels: DataFrame, by: Sequence[str], draws: int, seed: int) -> DataFrame:
    """by, real, null, gap: the share of edges(by, a, b) whose ends have equal labels(by, cell, label), the mean of that share over draws in which the
    labels are dealt out anew among the cells, and the difference. Draws follow from a hash of seed, draw and cell, so they don't depend on partitions."""
    draw = labels.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    w = Window.partitionBy(*by, "draw")
    # Draw 0 is as it is. In the others the n-th cell gets the label of the cell that is n-th by the hash.
    order = F.when(F.col("draw") == 0, F.lit(0)).otherwise(F.xxhash64(F.lit(seed), "draw", "cell"))
    ranked = draw.withColumns({"here": F.row_number().over(w.orderBy("cell")), "from": F.row_number().over(w.orderBy(order, "cell"))})
    dealt = ranked.select(*by, "draw", F.col("cell"), F.col("here").alias("place")).join(ranked.select(*by, "draw", F.col("from").alias("place"), "label"), [*by, "draw", "place"])
    a = dealt.select(*by, "draw", F.col("cell").alias("a"), F.col("label").alias("la"))
    b = dealt.select(*by, "draw", F.col("cell").alias("b"), F.col("label").alias("lb"))
    shares = edges.join(a, [*by, "a"]).join(b, [*by, "draw", "b"]).groupBy(*by, "draw").agg(F.avg((F.col("la") == F.col("lb")).cast("int")).alias("s"))
    found = shares.groupBy(*by).agg(F.max(F.when(F.col("draw") == 0, F.col("s"))).alias("real"), F.avg(F.when(F.col("draw") > 0, F.col("s"))).alias("null"))
    return found.withColumn("gap", F.col("real") - F.col("null"))


def regrouped(cells: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """by, cells: the rows of a key as an array in order; a tile's are SIDE * SIDE at most."""
    rest = [c for c in cells.columns if c not in by and c not in order]
    return cells.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("cells"))


def file_facts(df: DataFrame) -> DataFrame:
    """path, length, sha256 of each row of a binaryFile scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"path": batch.column(0), "length": batch.column(1), "sha256": pa.array([hashlib.sha256(c.as_py()).hexdigest() for c in batch.column(2)], pa.string())})

    return df.select("path", "length", "content").mapInArrow(run, "path string, length long, sha256 string")


def changed_files(recorded: DataFrame, now: DataFrame, sample: Column) -> DataFrame:
    """path, state: files that are gone or have another size, and those of the sample whose bytes have changed."""
    both = recorded.select("path", F.col("length").alias("l"), F.col("sha256").alias("s")).join(now, "path", "left")
    state = F.when(F.col("length").isNull(), "gone").when(F.col("length") != F.col("l"), "size").when(sample & (F.col("sha256") != F.col("s")), "bytes")
    return both.select("path", state.alias("state")).where("state IS NOT NULL")


def interior(i: Column, j: Column) -> Column:
    return i.between(1, SIDE - 2) & j.between(1, SIDE - 2)


def tile_labels(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """TILE, n_cells, zoning, skeleton: of cells(TILE, slot, zoning) the most common zoning and of edges(TILE, slot, skeleton) the most common class,
    the one in the lowest slot on ties."""
    z = selection.first_mode(cells, TILE, "zoning", "slot").drop("n")
    s = selection.first_mode(edges, TILE, "skeleton", "slot").drop("n")
    return cells.groupBy(*TILE).agg(F.count("*").alias("n_cells")).join(z, TILE, "left").join(s, TILE, "left")
