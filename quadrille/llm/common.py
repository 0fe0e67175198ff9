"""What the operators of this subpackage share: scratch tables, Arrow columns as bytes, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one worker takes apart at a time; bounds its memory, never what is read.
SLICE_BYTES = 2 << 20

#: Used only where the session names no shared folder and all runs on one machine, as in tests.
LOCAL_SCRATCH = "file:///tmp/checkpoints/quadrille"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that the cluster names in spark.checkpoint.dir. On a cluster that
    names none there is no folder that all executors see, which is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = LOCAL_SCRATCH
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


_MADE: list[str] = []


def discard(spark: SparkSession) -> int:
    """Deletes what this process has stored, to be called when no result is read any more; how many paths there were."""
    n = len(_MADE)
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: its lineage ends there, and the
    loss of an executor costs a reread. The schema is kept, so an empty table is no special case."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Parts that the rows of one key are dealt to where something is joined to them.
BUCKETS = 1024


def bucketed(df: DataFrame, name: str) -> DataFrame:
    """df, stored, with __bucket: numbers from 0 to BUCKETS - 1 in turn, whatever the rows have in them."""
    return stored(df.withColumn("__bucket", F.pmod(F.monotonically_increasing_id(), F.lit(BUCKETS)).cast("int")), name)


def attach(rows: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """rows (bucketed) with the columns of values, which has each key once. The rows of one key meet their value by
    bucket, so that a key which a large part of all rows has isn't joined in one task; it is there as
    often as it has buckets."""
    there = rows.select(key, "__bucket").distinct().join(values, key)
    return rows.join(there, [key, "__bucket"]).drop("__bucket")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and where each row begins in it (one more
    than the rows). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut between rows so that the column has about limit bytes in each; a row
    longer than that stands alone."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(values.cast(pa.large_binary()).fill_null(b"").to_numpy(zero_copy_only=False), object)
        sizes = np.fromiter(map(len, sizes), np.int64, len(sizes))
        at, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > limit:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += size
        if at < batch.num_rows:
            yield batch.slice(at)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_P = np.uint64(0xD6E8FEB86659FD93)


def powers(n: int, base: np.uint64 = _P) -> np.ndarray:
    """base to the powers 0 .. n - 1, modulo 2^64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, none of which reaches over a row's start."""
    if not mask.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:]
    at = offsets[1:-1]
    at = at[(at > 0) & (at < mask.size)]
    begins[at] = mask[at]
    ends[at - 1] = mask[at - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of the bytes of each run; equal bytes have equal hashes anywhere."""
    if not starts.size:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    rel = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    values = _BYTE[data[rel + np.repeat(starts, lengths)]]
    values *= powers(int(lengths.max()))[rel]
    return mix(np.add.reduceat(values, firsts) + lengths.astype(np.uint64))


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each start lies in."""
    return np.searchsorted(offsets, starts, side="right") - 1


def whole_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ as starts and ends."""
    return runs(~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D))), offsets)
