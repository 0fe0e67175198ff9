"""Scans of partitioned feature tables, and what guards them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The one type of each theme, and the columns that it must have. Fixed values.
THEMES = {
    "buildings": ("building", ("id", "geometry", "class", "height", "num_floors")),
    "places": ("place", ("id", "geometry", "categories")),
    "transportation": ("segment", ("id", "geometry", "class", "subtype")),
    "base": ("water", ("id", "geometry", "subtype")),
    "divisions": ("division_area", ("id", "geometry", "country", "subtype")),
}
ROW_BYTES = 200
LARGE = 2 << 30


def theme_path(root: str, theme: str) -> str:
    if theme not in THEMES:
        raise ValueError(f"unknown theme {theme}; known: {', '.join(sorted(THEMES))}")
    return f"{root.rstrip('/')}/theme={theme}/type={THEMES[theme][0]}"


def overlaps(xmin: Column, xmax: Column, ymin: Column, ymax: Column, box: Sequence[float]) -> Column:
    """Boxes that touch or overlap (min_x, min_y, max_x, max_y), sides included."""
    x0, y0, x1, y1 = box
    return (xmin <= x1) & (xmax >= x0) & (ymin <= y1) & (ymax >= y0)


def read_theme(spark: SparkSession, root: str, theme: str, box: Sequence[float] | None = None) -> DataFrame:
    """A theme's rows, with the box on the bbox struct's leaves, where the scan can use it."""
    df = require(spark.read.parquet(theme_path(root, theme)), THEMES[theme][1])
    return df if box is None else df.where(overlaps(F.col("bbox.xmin"), F.col("bbox.xmax"), F.col("bbox.ymin"), F.col("bbox.ymax"), box))


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, if it has the columns; others are allowed."""
    lacking = sorted(set(columns) - set(df.columns))
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def estimate(df: DataFrame) -> DataFrame:
    """n_rows, n_bytes at a fixed size of a row."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_bytes", F.col("n_rows") * ROW_BYTES)


def guard(df: DataFrame, confirmed: bool = False, limit: int = LARGE) -> DataFrame:
    """df, unless it is too large and not confirmed; a confirmed read isn't counted."""
    if not confirmed and (n := estimate(df).first()["n_bytes"]) > limit:
        raise ValueError(f"about {n} bytes; confirm to read them")
    return df


def read_losses(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of epoch, step, train_loss, val_loss without the rows whose step or train_loss is blank."""
    df = spark.read.schema("epoch string, step string, train_loss string, val_loss string").option("header", True).csv(path)
    df = df.where("trim(coalesce(step, '')) <> '' AND trim(coalesce(train_loss, '')) <> ''")
    return df.select(*[F.trim(c).try_cast(t).alias(c) for c, t in (("epoch", "int"), ("step", "long"), ("train_loss", "double"), ("val_loss", "double"))])


def read_records(spark: SparkSession, path: str, schema: str, default_id: str) -> DataFrame:
    """JSON files of {"ckpt_id": ..., "records": [...]}, a row for each record; a missing id gets the default."""
    df = spark.read.schema(f"ckpt_id string, records array<struct<{schema}>>").option("multiLine", True).json(path)
    return df.select(F.coalesce("ckpt_id", F.lit(default_id)).alias("ckpt_id"), F.explode("records").alias("r")).select("ckpt_id", "r.*")


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """A row for each feature of FeatureCollections: type, coordinates (as JSON) and the given properties."""
    df = spark.read.schema(f"features array<struct<geometry: struct<type: string, coordinates: string>, properties: struct<{properties}>>>").option("multiLine", True).json(path)
    return df.select(F.explode("features").alias("f")).select("f.geometry.type", "f.geometry.coordinates", "f.properties.*")


def read_table(df: DataFrame, columns: str) -> DataFrame:
    """The named columns of a scan in the types that are asked for; a missing one is an error. Others aren't read."""
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL(columns)
    require(df, schema.fieldNames())
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
