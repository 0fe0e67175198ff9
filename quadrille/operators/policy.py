"""Missing-value policies and predicates on categorical fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Raw classes of open water, and of water inside the land. Fixed values.
SEA = ("ocean", "strait", "bay")
INLAND = ("lake", "river", "reservoir", "pond", "canal", "stream", "lagoon", "water")


def resolve(schema: T.StructType, path: str) -> T.DataType:
    """The type at a dotted path; names the part that is missing or no struct."""
    kind: T.DataType = schema
    for k, part in enumerate(path.split(".")):
        if not isinstance(kind, T.StructType):
            raise ValueError(f"{'.'.join(path.split('.')[:k])} is no struct")
        if part not in kind.names:
            raise KeyError(f"{path}: no {part}")
        kind = kind[part].dataType
    return kind


def missing(df: DataFrame, field: str, how: str, token: str = "__UNK__") -> DataFrame:
    """Rows whose field is null: with the token ('token'), gone ('drop') or as they are ('pass'). A dotted
    field is set inside its struct; the rest of the struct stays."""
    resolve(df.schema, field)
    if how == "drop":
        return df.where(F.col(field).isNotNull())
    if how == "pass":
        return df
    if how != "token":
        raise ValueError(f"unknown policy {how}")
    head, _, rest = field.partition(".")
    value = F.coalesce(F.col(field), F.lit(token))
    return df.withColumn(head, F.col(head).withField(rest, value) if rest else value)


def known(df: DataFrame, field: str, vocabulary: Sequence[str] | DataFrame, token: str | None = "__UNK__") -> DataFrame:
    """Rows whose field is in the vocabulary or is the token; an empty vocabulary keeps none. A short list
    becomes a predicate that reaches the scan; a DataFrame(value) is joined."""
    if isinstance(vocabulary, DataFrame):
        words = vocabulary.select(F.col("value").alias("__word")).distinct()
        if token is not None:
            words = words.unionByName(words.limit(1).select(F.lit(token).alias("__word"))).distinct()
        return df.join(words, F.col(field) == F.col("__word"), "left_semi")
    if not vocabulary:
        return df.where(F.lit(False))
    return df.where(F.col(field).isin([*vocabulary, *([token] if token is not None else [])]))


def sea(cls: Column, subtype: Column) -> Column:
    """On raw rows; null is not sea."""
    return F.coalesce(cls.isin(*SEA), F.lit(False)) | F.coalesce(subtype == "ocean", F.lit(False))


def inland(cls: Column) -> Column:
    return F.coalesce(cls.isin(*INLAND), F.lit(False))


def sentinel(value: Column) -> Column:
    """Values that stand for unknown."""
    return F.coalesce((value == "unknown") | value.contains("__UNK__") | value.startswith("B_"), F.lit(False))


def tag(kind: Column, raw: Column) -> Column:
    """key=value of a feature class 0 to 3; a null value is empty."""
    keys = F.when(kind == 0, "highway").when(kind == 1, "building").when(kind == 2, "amenity").when(kind == 3, "natural")
    return F.concat(keys, F.lit("="), F.coalesce(raw, F.lit("")))


def sliver(is_area: Column, is_line: Column, area: Column, length: Column, least: float = 0.01) -> Column:
    """Polygons and lines too small to keep."""
    return (is_area & (area < least)) | (is_line & (length < least))


def resolved_tag(df: DataFrame, vocabulary: DataFrame, tag_column: str = "tag") -> DataFrame:
    """df with token_id: the tag's own, else that of <unknown_key>, else an error naming the tag.
    vocabulary(tag, id) is a fixed list and is broadcast."""
    words = vocabulary.select(F.col("tag").alias("__tag"), F.col("id").alias("__id"))
    spare = words.select(F.col("__tag").alias("__spare"), F.col("__id").alias("__spare_id"))
    fallback = F.concat(F.lit("<unknown_"), F.split_part(F.col(tag_column), F.lit("="), F.lit(1)), F.lit(">"))
    found = df.join(F.broadcast(words), F.col(tag_column) == F.col("__tag"), "left").join(F.broadcast(spare), fallback == F.col("__spare"), "left")
    wrong = F.raise_error(F.concat(F.lit("no token for "), F.col(tag_column))).cast(vocabulary.schema["id"].dataType)
    return found.withColumn("token_id", F.coalesce("__id", "__spare_id", F.when(F.lit(True), wrong))).select(*df.columns, "token_id")
