"""Writers: sorted Parquet with a pinned schema, sealed artefacts, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pinned(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """df in the schema's columns and types; a column that is missing, or a value that doesn't fit, is an error."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    lacking = [f.name for f in schema if f.name not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def write_sorted(df: DataFrame, path: str, by: Sequence[str], order: Sequence[str], partition: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet with the rows of a key in one file, in order. The commit is all or nothing; a file that is
    there already is an error unless the mode says otherwise."""
    writer = df.repartition(*by).sortWithinPartitions(*by, *order).write.mode(mode)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def manifest(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, n_rows, digest: a digest of each key's rows that doesn't depend on their order. Rows meet as sums
    of hashes, so that a large key is no larger than a small one."""
    row = F.xxhash64(*df.columns).cast("decimal(38,0)")
    other = F.xxhash64(*df.columns, F.lit("second")).cast("decimal(38,0)")
    sums = df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(row).alias("__a"), F.sum(other).alias("__b"))
    return sums.select(*by, "n_rows", F.sha2(F.concat_ws(":", "n_rows", "__a", "__b").cast("binary"), 256).alias("digest"))


def seal(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Writes df once, with its manifest beside it."""
    df.write.mode("errorifexists").parquet(f"{path}/data")
    manifest(df.sparkSession.read.parquet(f"{path}/data"), by).write.mode("errorifexists").parquet(f"{path}/manifest")


def unsealed(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """Keys whose rows don't agree with the manifest any more, or that one of them lacks; empty if all is well."""
    now = manifest(spark.read.parquet(f"{path}/data"), by).withColumnsRenamed({"n_rows": "n_now", "digest": "now"})
    then = spark.read.parquet(f"{path}/manifest")
    return then.join(now, list(by), "full_outer").where("NOT (digest <=> now)").select(*by, "n_rows", "n_now")


def open_sealed(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    if (bad := unsealed(spark, path, by).limit(5).collect()):
        raise ValueError(f"changed since it was sealed: {', '.join(str(tuple(r[b] for b in by)) for r in bad)}")
    return spark.read.parquet(f"{path}/data")


def check_cover(df: DataFrame, by: Sequence[str], expected: int) -> DataFrame:
    """by, n: keys that don't have the expected number of rows."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") != expected)


#: The derived tables: columns and types, the order of rows and how many a tile has (None: any number). Fixed values.
TABLES = {
    "features": ("cell_i tinyint, cell_j tinyint, feature_class tinyint, source_feature_id string, geometry binary, geometry_type tinyint, bbox_min_x double, bbox_min_y double, bbox_max_x double, bbox_max_y double, class_raw string, subtype_raw string, categories_primary string, categories_alternate array<string>, sea_overlap_fraction double", ["cell_i", "cell_j", "feature_class", "source_feature_id"], None),
    "cells": ("cell_i tinyint, cell_j tinyint, water_fraction double, sea_water_fraction double, cell_area_admin_clipped_m2 double, kept_features_count int", ["cell_i", "cell_j"], None),
    "crossings": ("source_feature_id string, lower_cell_i tinyint, lower_cell_j tinyint, axis tinyint, ring_index smallint, event_type tinyint, edge_position_m double, edge_extent_length_m double", ["lower_cell_i", "lower_cell_j", "axis", "source_feature_id", "ring_index", "edge_position_m", "event_type"], None),
    "macro_core": ("slot_kind tinyint, slot_index smallint, cell_i tinyint, cell_j tinyint, lower_cell_i tinyint, lower_cell_j tinyint, axis tinyint, scope tinyint, zoning_class smallint, cell_density_bucket smallint, road_skeleton_class smallint", ["slot_kind", "slot_index"], 208),
    "boundary_contract": ("slot_kind tinyint, slot_index smallint, lower_cell_i tinyint, lower_cell_j tinyint, axis tinyint, scope_marker tinyint, boundary_class_enum smallint", ["slot_kind", "slot_index"], 144),
    "token_cells": ("cell_i tinyint, cell_j tinyint, cell_slot_index tinyint, token_sequence array<smallint>, feature_count smallint, provenance_sha256 string", ["cell_i", "cell_j"], 64),
}
TILE_KEY = "city int, tile_i int, tile_j int"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names; on one machine, where none is named, in its own."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/checkpoints/quadrille"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, path: str) -> None:
    """A derived table of all tiles, partitioned by city: pinned types, each tile's rows together in their order. Tiles that don't have the number of
    rows that the table asks for are an error, and nothing is written then."""
    columns, order, expected = TABLES[name]
    rows = pinned(df, f"{TILE_KEY}, {columns}")
    key = ["city", "tile_i", "tile_j"]
    if expected is not None and (bad := check_cover(rows, key, expected).limit(5).collect()):
        raise ValueError(f"{name}: {', '.join(str(tuple(r)) for r in bad)} rows instead of {expected}")
    write_sorted(rows, path, key, order, ["city"])


def canonical(row: str, exclude: Sequence[str] = ()) -> str:
    """The digest of a JSON object in canonical form: keys in order, without those whose dotted path is excluded ('*x' excludes all that end in x)."""
    import hashlib
    import json

    def kept(value, path: str):
        if not isinstance(value, dict):
            return value
        out = {}
        for k in sorted(value):
            at = f"{path}.{k}" if path else k
            if not any(at == e or (e.startswith("*") and at.endswith(e[1:])) for e in exclude):
                out[k] = kept(value[k], at)
        return out

    return hashlib.sha256(json.dumps(kept(json.loads(row), ""), separators=(",", ":"), sort_keys=True).encode()).hexdigest()


def provenance(outputs: DataFrame, inputs: DataFrame, key: Sequence[str], versions: dict[str, str]) -> DataFrame:
    """key, n_rows, digest, input_digest and the versions: where each tile comes from. A tile is complete if it has a row here."""
    own, theirs = manifest(outputs, key), manifest(inputs, key).select(*key, F.col("digest").alias("input_digest"))
    return own.join(theirs, list(key), "left").select(*key, "n_rows", "digest", "input_digest", *[F.lit(v).alias(k) for k, v in versions.items()])


def region_manifest(tiles: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """by, n_tiles, digest: over the tiles' digests in order, which is the order of the tiles."""
    each = F.array_sort(F.collect_list(F.struct(*order, "digest")))
    return tiles.groupBy(*by).agg(F.count("*").alias("n_tiles"), F.sha2(F.array_join(F.transform(each, lambda t: t["digest"]), ","), 256).alias("digest"))


def freeze_registry(names: Sequence[str], spark: SparkSession, path: str, most: int = 63) -> DataFrame:
    """An ordered list of names, written once: place (from 0) and name. Repeated names and more than most are an error; so is a second freeze."""
    if len(set(names)) != len(names) or len(names) > most:
        raise ValueError("names repeat or are too many")
    df = spark.createDataFrame(list(enumerate(names)), "place int, name string")
    df.coalesce(1).write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def report(title: str, rows: DataFrame, most: int = 1000) -> str:
    """A Markdown table of a report's few rows."""
    found = rows.limit(most).collect()
    head = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found]) + "\n"
