"""Bounded samples of labelled documents, for the classifiers that are trained here."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents of each label that a classifier is fitted on, at most, and the longest text among them.
ROWS_OF_A_LABEL = 3000
LONGEST = 32_768


def fold(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n)), F.lit(0))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int = ROWS_OF_A_LABEL, longest: int = LONGEST) -> tuple[pa.Table, dict[int, int]]:
    """text, y of at most rows labelled documents of each label outside the held-out fold, chosen by a
    hash of doc_id, and how many rows have each label there. Only this sample reaches the driver: its
    size is bounded by rows and longest. Conflicting labels of a doc_id count as the greater one."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col(label)).cast("int").alias("y"))
    counts = {int(y): int(n) for y, n in known.groupBy("y").count().collect()}
    chosen = None
    for y in sorted(counts):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return pa.table({"text": pa.array([], pa.string()), "y": pa.array([], pa.int32())}), counts
    # At most rows of each label, an id and a label each.
    texts = docs.select("doc_id", "text").where(F.octet_length(F.coalesce("text", F.lit(""))) <= longest)
    found = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["__id"]).select("__id", F.coalesce("text", F.lit("")).alias("text"), "y")
    # Rows may repeat a doc_id any number of times; one of them is enough here.
    found = found.groupBy("__id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    table = found.orderBy(F.xxhash64("__id"), "__id").select("text", "y").toArrow()
    return table, counts
