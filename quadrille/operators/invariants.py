"""Checks of derived tables. Each gives the rows that break a rule; empty means that all is well."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.operators.grid import SIDE

EPS = 1e-9
# Kinds of slots, how many slots each has in a tile, scopes and classes on disk.
CELL_SLOT, INTERNAL_SLOT, EXTERNAL_SLOT, TILE_SLOT = 0, 1, 2, 3
SLOTS = {CELL_SLOT: 64, INTERNAL_SLOT: 112, EXTERNAL_SLOT: 32, TILE_SLOT: 1}
ACTIVE, MASKED, SCOPES, AXES, BOUNDARY_CLASSES = 0, 1, (0, 1, 2, 3), (0, 1), (1, 2, 3)


def broken(df: DataFrame, key: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """key, invariant: a row for each rule that a row of df doesn't keep; what can't be told isn't kept. One pass for all rules."""
    names = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return df.select(*key, F.explode(F.array_compact(F.array(*names))).alias("invariant"))


def number(value: Column) -> Column:
    """Null or a number, but not NaN."""
    return value.isNull() | ~F.isnan(value)


def cell_rules() -> dict[str, Column]:
    """Of extracted cells: water_fraction, sea_water_fraction, cell_area_admin_clipped_m2, kept_features_count."""
    water, sea = F.coalesce("water_fraction", F.lit(0.0)), F.coalesce("sea_water_fraction", F.lit(0.0))
    whole = number(F.col("water_fraction")) & number(F.col("sea_water_fraction"))
    return {
        "water_fraction_bounds": whole & (sea >= -EPS) & (sea <= water) & (water <= 1 + EPS),
        "kept_cell_rule": ~((sea >= 1 - EPS) & (F.col("kept_features_count") == 0)),
        "cell_area_positive": F.col("cell_area_admin_clipped_m2") > 0,
        "nan_free": number(F.col("cell_area_admin_clipped_m2")),
    }


def wrong_counts(cells: DataFrame, features: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, stored, actual: cells whose kept_features_count isn't the number of their features."""
    counts = features.groupBy(*key).agg(F.count("*").alias("actual"))
    both = cells.select(*key, F.col("kept_features_count").alias("stored")).join(counts, list(key), "left")
    return both.withColumn("actual", F.coalesce("actual", F.lit(0))).where("stored <> actual")


def uncut(crossings: DataFrame, features: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """by, key: sources of crossings whose features are in fewer than two cells."""
    cells = features.select(*by, key, "cell_i", "cell_j").distinct().groupBy(*by, key).agg(F.count("*").alias("__n")).where("__n >= 2")
    return crossings.select(*by, key).distinct().join(cells.drop("__n"), [*by, key], "left_anti")


def wrong_means(tiles: DataFrame, cells: DataFrame, key: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """key, stored, actual: tiles(key, mean_water_fraction) whose mean isn't that of their cells, weighted by area (0 without any)."""
    sums = cells.groupBy(*key).agg(F.coalesce(F.try_divide(F.sum(F.col("water_fraction") * F.col("cell_area_admin_clipped_m2")), F.sum("cell_area_admin_clipped_m2")), F.lit(0.0)).alias("actual"))
    both = tiles.select(*key, F.col("mean_water_fraction").alias("stored")).join(sums, list(key), "left").withColumn("actual", F.coalesce("actual", F.lit(0.0)))
    return both.where(F.abs(F.col("stored") - F.col("actual")) > tolerance)


def wkb_facts(wkb: Column) -> Column:
    """(type code, min_x, min_y, max_x, max_y) of WKB, read from the bytes alone; null for what isn't WKB."""

    def run(values: pa.Array) -> pa.Array:
        from quadrille.operators.geometry import from_wkb

        out = []
        for v in values.to_pylist():
            try:
                kind, parts = from_wkb(v) if v is not None else (None, [])
            except (ValueError, IndexError, struct.error):
                kind, parts = None, []
            points = [p for part in parts for p in part]
            out.append({"type": kind, "min_x": min(p[0] for p in points), "min_y": min(p[1] for p in points), "max_x": max(p[0] for p in points), "max_y": max(p[1] for p in points)} if points else None)
        return pa.array(out, pa.struct([("type", pa.int32()), *[(c, pa.float64()) for c in ("min_x", "min_y", "max_x", "max_y")]]))

    return F.arrow_udf(run, "struct<type:int,min_x:double,min_y:double,max_x:double,max_y:double>")(wkb)


def feature_rules(facts: Column, tolerance: float = 1e-6) -> dict[str, Column]:
    """Of extracted features, held against what their bytes say: geometry_type and bbox."""
    near = lambda c: F.abs(F.col(f"bbox_{c}") - facts[c]) <= tolerance
    return {"geometry_type_matches_wkb": F.col("geometry_type") == facts["type"], "bbox_matches_wkb": near("min_x") & near("min_y") & near("max_x") & near("max_y")}


def macro_rules() -> dict[str, Column]:
    """Of macro rows: slot_kind, slot_index, scope and the three targets."""
    limit = F.coalesce(*[F.when(F.col("slot_kind") == k, F.lit(n)) for k, n in SLOTS.items()])
    nothing = F.col("zoning_class").isNull() & F.col("cell_density_bucket").isNull() & F.col("road_skeleton_class").isNull()
    return {
        "no_tile_rows": F.col("slot_kind") != TILE_SLOT,
        "slot_range": (F.col("slot_index") >= 0) & (F.col("slot_index") < limit),
        "masked_without_targets": (F.col("scope") != MASKED) | nothing,
    }


def wrong_row_counts(rows: DataFrame, key: Sequence[str], expected: dict[int, int]) -> DataFrame:
    """key, slot_kind, n: kinds of slots of which a tile hasn't the expected number of rows."""
    counts = rows.groupBy(*key).agg(*[F.count_if(F.col("slot_kind") == k).alias(f"n{k}") for k in expected])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("slot_kind"), F.col(f"n{k}").alias("n"), F.lit(n).alias("want")) for k, n in expected.items()])).alias("e")
    return counts.select(*key, each).select(*key, "e.slot_kind", "e.n", "e.want").where("n <> want").drop("want")


def contract_rules(collapsed: bool = False) -> dict[str, Column]:
    """Of boundary rows: slot_kind, slot_index, axis, scope_marker, boundary_class_enum (which is null throughout if collapsed)."""
    rules = {
        "scope_member": F.col("scope_marker").isin(*SCOPES),
        "slot_range": ((F.col("slot_kind") == INTERNAL_SLOT) & F.col("slot_index").between(0, SLOTS[INTERNAL_SLOT] - 1)) | ((F.col("slot_kind") == EXTERNAL_SLOT) & F.col("slot_index").between(0, SLOTS[EXTERNAL_SLOT] - 1)),
        "axis_member": F.col("axis").isin(*AXES),
    }
    known = F.col("boundary_class_enum")
    if collapsed:
        return rules | {"collapsed_without_class": known.isNull()}
    return rules | {"class_iff_active": known.isNotNull() == (F.col("scope_marker") == ACTIVE), "class_member": known.isNull() | known.isin(*BOUNDARY_CLASSES)}


def token_rules(known: Column) -> dict[str, Column]:
    """Of token cells: feature_count, token_sequence, cell_slot_index, provenance_sha256; known: an array of all ids that are in the vocabulary."""
    return {
        "empty_agrees": (F.size("token_sequence") > 0) == (F.col("feature_count") > 0),
        "slot_of_cell": F.col("cell_slot_index") == F.col("cell_i") * SIDE + F.col("cell_j"),
        "tokens_known": F.size(F.array_except("token_sequence", known)) == 0,
        "digest_form": F.col("provenance_sha256").rlike("^[0-9a-f]{64}$"),
    }


def unjustified(emitted: DataFrame, contract: DataFrame, key: Sequence[str]) -> DataFrame:
    """key (with side and class): references that cells emit but the contract doesn't have there."""
    return emitted.select(*key).distinct().join(contract.select(*key).distinct(), list(key), "left_anti")


def silent(contract: DataFrame, emitted: DataFrame, present: DataFrame, key: Sequence[str]) -> DataFrame:
    """key: sides with a road class at which a road of the cell ends, but that emit no reference."""
    asked = contract.where("class <> 'NONE'").select(*key).distinct().join(present.select(*key).distinct(), list(key), "left_semi")
    return asked.join(emitted.select(*key).distinct(), list(key), "left_anti")


def versions_apart(tiles: DataFrame, names: Sequence[str]) -> DataFrame:
    """name, version, n: the versions of a name if tiles don't all have the same."""
    each = tiles.select(F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("string").alias("version")) for v in names])).alias("e"))
    counts = each.groupBy("e.name", "e.version").agg(F.count("*").alias("n"))
    kinds = counts.groupBy("name").agg(F.count("*").alias("__k")).where("__k > 1")
    return counts.join(kinds.drop("__k"), "name", "left_semi")


def compare_version(namespace: str, expected: str, actual: str) -> bool:
    """Whether two versions such as 'tokens/2' are equal; of different namespaces they can't be compared."""
    for v in (expected, actual):
        if v.partition("/")[0] != namespace:
            raise ValueError(f"{v} isn't a version of {namespace}")
    return expected == actual


def repeated_digests(tiles: DataFrame, digest: str) -> DataFrame:
    """digest, n: digests that several tiles share."""
    return tiles.groupBy(digest).agg(F.count("*").alias("n")).where("n > 1")


def digest_drift(manifest: DataFrame, live: DataFrame, key: Sequence[str], digest: str) -> DataFrame:
    """key, state: 'changed', 'missing' (only in the manifest) or 'orphan' (only there)."""
    a, b = manifest.select(*key, F.col(digest).alias("a")), live.select(*key, F.col(digest).alias("b"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "orphan").otherwise("changed")
    return a.join(b, list(key), "full_outer").where("NOT (a <=> b)").select(*key, state.alias("state"))


def terminators(cells: DataFrame, key: Sequence[str], end: int) -> DataFrame:
    """key, n: cells that aren't empty and don't have the terminator exactly once, at the end."""
    n = F.size(F.filter("tokens", lambda t: t == end))
    return cells.where(F.size("tokens") > 0).select(*key, n.alias("n"), F.element_at("tokens", -1).alias("__z")).where((F.col("n") != 1) | (F.col("__z") != end)).drop("__z")


def crossings_by_flanks(crossings: DataFrame, cells: DataFrame, key: Sequence[str]) -> DataFrame:
    """flanks, n: crossings(key, lower_i, lower_j, axis) by how many of the two cells beside them are there."""
    there = cells.select(*key, "cell_i", "cell_j").distinct()
    lower = there.select(*key, F.col("cell_i").alias("lower_i"), F.col("cell_j").alias("lower_j"), F.lit(1).alias("__a"))
    upper = there.select(*key, F.col("cell_i").alias("__ui"), F.col("cell_j").alias("__uj"), F.lit(1).alias("__b"))
    c = crossings.withColumn("__ui", F.col("lower_i") + F.when(F.col("axis") == 0, 1).otherwise(0)).withColumn("__uj", F.col("lower_j") + F.when(F.col("axis") == 1, 1).otherwise(0))
    both = c.join(lower, [*key, "lower_i", "lower_j"], "left").join(upper, [*key, "__ui", "__uj"], "left")
    return both.groupBy((F.coalesce("__a", F.lit(0)) + F.coalesce("__b", F.lit(0))).alias("flanks")).agg(F.count("*").alias("n"))


def edges_without_crossing(labelled: DataFrame, crossings: DataFrame, key: Sequence[str]) -> DataFrame:
    """key: edges with a road class that no road crosses."""
    return labelled.where("class IN ('MAJOR', 'MINOR')").select(*key).distinct().join(crossings.select(*key).distinct(), list(key), "left_anti")


def unconfined(old: DataFrame, new: DataFrame, key: Sequence[str], order: str, excused: str) -> DataFrame:
    """key, place: blocks that changed between two derivations, by their place in order, though nothing in the source excuses it."""
    w = Window.partitionBy(*key).orderBy(order)
    a = old.select(*key, F.row_number().over(w).alias("place"), F.col("block").alias("__a"), excused)
    b = new.select(*key, F.row_number().over(w).alias("place"), F.col("block").alias("__b"))
    both = a.join(b, [*key, "place"], "full_outer")
    return both.where(~F.col("__a").eqNullSafe(F.col("__b")) & ~F.coalesce(F.col(excused), F.lit(False))).select(*key, "place")
