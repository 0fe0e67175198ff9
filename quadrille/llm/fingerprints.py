"""Document fingerprints: a canonical exact digest.

A text is put in one form (Unicode compatibility normalisation, case folding, each run of white space
one space, none at the ends) and hashed to 128 bits. Texts of equal digests are one group once their
canonical bytes have been compared; should two forms ever share a digest, their groups are kept apart.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import SLICE_BYTES, attach, bucketed, slices, stored

#: Bytes of canonical texts that a task remembers, to send each once.
SEEN_BYTES = 32 << 20


def canonical(text: str | None) -> bytes:
    """Null is empty. Folding twice around the normalisation makes the form stable."""
    text = text or ""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).casefold()
    return " ".join(unicodedata.normalize("NFKC", text).split()).encode("utf-8", "surrogatepass")


def digest(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text))


def likeness(a: str, b: str) -> float:
    """Of two fingerprints: an exact digest knows equal and unequal only."""
    return 1.0 if a == b else 0.0


def fingerprints(docs: DataFrame, hashed=digest) -> DataFrame:
    """doc_id, fingerprint for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fingerprint": pa.array([hashed(t) for t in batch.column(1).to_pylist()], pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


#: Bits of the filter of fingerprints that several rows have: 8 MB, whatever there is of them.
FILTER_BITS = 1 << 26


def repeated(found: DataFrame) -> np.ndarray:
    """A filter of fixed size that has every fingerprint which more than one row of found has (and a few more): the text of any other is
    not to be compared. Its words, FILTER_BITS / 64 at most, are what reaches the driver."""
    slot = F.pmod(F.xxhash64("fingerprint"), F.lit(FILTER_BITS))
    many = found.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select(slot.alias("slot"))
    words = many.groupBy(F.shiftright("slot", 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS INT)))").alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for word, bits in words.collect():
        out[word] = bits
    return out.view(np.uint64)


def collisions(docs: DataFrame, hashed=digest, among: np.ndarray | None = None) -> DataFrame:
    """fingerprint: those that texts of different canonical bytes share. among is the filter of those that several rows have; without it
    all texts are compared.

    Each task sends a canonical text once (as long as it remembers it), so a large group of copies is a
    few rows before the shuffle; the compressed bytes, which are equal exactly if the texts are, are
    then compared in each bucket by their least and greatest."""

    shared = docs.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        pack, seen, size = zstandard.ZstdCompressor(level=1), OrderedDict(), 0
        for batch in slices(batches, "text"):
            keys, values = [], []
            for text in batch.column(1).to_pylist():
                key = hashed(text)
                slot = xxhash.xxh64_intdigest(key, 42) & (FILTER_BITS - 1)
                if words is not None and not int(words[slot >> 6]) >> (slot & 63) & 1:
                    continue
                value = pack.compress(canonical(text))
                if seen.get(key) == value:
                    seen.move_to_end(key)
                    continue
                keys.append(key)
                values.append(value)
                size += len(value) - len(seen.pop(key, b""))
                seen[key] = value
                while size > SEEN_BYTES:
                    size -= len(seen.popitem(last=False)[1])
            yield pa.RecordBatch.from_pydict({"fingerprint": pa.array(keys, pa.string()), "form": pa.array(values, pa.binary())})

    forms = docs.select("doc_id", "text").mapInArrow(run, "fingerprint string, form binary")
    return forms.groupBy("fingerprint").agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a <> b").select("fingerprint")


def exact_groups(docs: DataFrame, hashed=digest) -> DataFrame:
    """doc_id, fingerprint, group_id for each row of docs(doc_id, text); other columns are not looked at.
    group_id is the smallest doc_id with the same canonical text, null if none of them has a doc_id. Null
    and empty texts are alike. Repeated rows stay."""
    return grouped(fingerprints(docs, hashed), docs, hashed)


def grouped(found: DataFrame, docs: DataFrame, hashed=digest) -> DataFrame:
    """found(doc_id, fingerprint, any more columns), the fingerprints of docs, with group_id."""
    found = bucketed(found, "fingerprints")
    shared = stored(collisions(docs, hashed, repeated(found)), "collisions")
    if shared.isEmpty():
        return attach(found, "fingerprint", found.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fingerprint": pa.array([hashed(t) for t in texts], pa.string()), "form": pa.array([canonical(t) for t in texts], pa.binary())})

    # Texts of the same digest, which different ones share, are told apart by their bytes.
    formed = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string, form binary")
    marked = formed.join(shared.withColumn("shared", F.lit(True)), "fingerprint", "left")
    keyed = marked.select("doc_id", "fingerprint", F.when(F.col("shared"), F.col("form")).otherwise(F.lit(b"")).alias("form"))
    groups = keyed.groupBy("fingerprint", "form").agg(F.min("doc_id").alias("group_id"))
    named = keyed.join(groups, ["fingerprint", "form"]).select(F.col("doc_id").alias("__id"), F.col("fingerprint").alias("__print"), "group_id").distinct()
    return found.join(named, found["doc_id"].eqNullSafe(F.col("__id")) & (found["fingerprint"] == F.col("__print")), "left").drop("__id", "__print", "__bucket")


def _cuts(docs: DataFrame, parts: int) -> np.ndarray:
    """Ascending doc_ids that cut the rows into about parts equal ranges."""
    if parts < 2:
        return np.zeros(0)
    found = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [k / parts for k in range(1, parts)], 0.2 / parts)
    return np.unique(np.array(found))


def with_next(docs: DataFrame, row, schema: str, parts: int | None = None) -> DataFrame:
    """One row from row(doc_id, text, next_text) for each row of docs(doc_id, text): next_text is the
    text of the next document by descending doc_id, and of the first after the last. doc_id is an integer; those of
    null come last; rows of one doc_id follow each other in a fixed order. row gives a tuple in the
    order of schema.

    Rows are dealt out by ranges of doc_id, compressed; the largest doc_id of each range also goes to
    the range above as its end, and the largest of all to the lowest. Those are as many as the ranges."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(docs, parts)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, none = np.full(len(cuts) + 1, np.iinfo(np.int64).min), False
        for batch in batches:
            none = none or batch.column(0).null_count > 0
            ids = batch.column(0).cast(pa.int64()).drop_null().to_numpy(zero_copy_only=False)
            np.maximum.at(most, np.searchsorted(cuts, ids, side="right"), ids)
        at = np.flatnonzero(most > np.iinfo(np.int64).min)
        yield pa.RecordBatch.from_pydict({"part": pa.array([-1] * none + at.tolist(), pa.int64()), "most": pa.array([0] * none + most[at].tolist(), pa.int64())})

    tops = dict(map(tuple, docs.select("doc_id").mapInArrow(ranges, "part long, most long").groupBy("part").agg(F.max("most")).collect()))
    unnamed = tops.pop(-1, None) is not None  # a range of their own, -1, below all others
    full = sorted(tops)
    goes = {tops[a]: b for a, b in zip(full, full[1:])}  # the top of a range ends the next one above that has rows
    first = tops[full[-1]] if full else None
    lowest = -1 if unnamed or not full else full[0]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "text"):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                form = pack.compress((text or "").encode())
                to = [(-1 if key is None else int(np.searchsorted(cuts, key, side="right")), False)]
                if key is None and full:
                    to.append((full[0], True))
                if key is not None and key in goes:
                    to.append((goes[key], True))
                if key is not None and key == first:
                    to.append((lowest, True))
                for part, guest in to:
                    for column, value in zip(out, (part, guest, key, form)):
                        column.append(value)
            yield pa.RecordBatch.from_pydict({"part": pa.array(out[0], pa.int64()), "guest": pa.array(out[1], pa.bool_()), "doc_id": pa.array(out[2], batch.schema.field(0).type), "form": pa.array(out[3], pa.binary())})

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        made: list[tuple] = []
        size, part, held, top, ended = 0, None, None, "", False

        for batch in batches:
            for new, guest, key, form in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if new != part:
                    if held is not None:
                        made.append(row(*held, top))
                    part, held, ended = new, None, False
                if ended:
                    continue
                text = unpack.decompress(form).decode()
                if held is not None:
                    made.append(row(*held, text))
                elif not guest:
                    top = text
                held, ended = (None, True) if guest else ((key, text), False)
                size += len(text)
                if size > SLICE_BYTES:
                    yield as_batch(made)
                    made, size = [], 0
        if held is not None:
            made.append(row(*held, top))
        yield as_batch(made)

    target = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def as_batch(made: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*made)) or [[]] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    dealt = docs.select("doc_id", "text").mapInArrow(deal, f"part long, guest boolean, doc_id {kind}, form binary")
    # A range is a partition, so each task has one.
    return dealt.repartitionById(len(cuts) + 2, F.col("part").cast("int") + 1).sortWithinPartitions("part", "guest", F.desc("doc_id"), "form").mapInArrow(walk, schema)


def edited(text: str, after: str) -> str:
    """text with its last third of code points (rounded down) replaced by the first as many of after."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def edit_test(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each
    row: how the fingerprint takes an edit of a third of the text, see with_next() for the order."""

    def row(key, text: str, after: str) -> tuple:
        new = edited(text, after)
        own, other = digest(text), digest(new)
        return key, len(text), hashlib.sha256(new.encode()).hexdigest(), own, other, likeness(own, other), likeness(own, digest(after))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_next(docs, row, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", parts)
