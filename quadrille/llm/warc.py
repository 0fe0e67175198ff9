"""WARC archives and their Merkle fixity audit.

A page is a resource record; an archive is a directory of gzip files of such records. The audit reads
the bytes of two replicas: each file is parsed into its records' offset ranges and digests, the
manifest. From it a tree of bounded fan-out is built. A leaf covers the records of a file whose ids lie
in one slot, so that a lost or an added record doesn't move the others to other leaves; it hashes the
records and their ordered ranges. An inner node hashes its range and its children in order: a file, and
on over the files to the root. Replicas with equal roots are equal. Else the audit goes down from the
root, level by level, and looks only at children of nodes that differ, until the records of differing
leaves are told apart: damaged, lost, added, or whole but at another offset.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.common import scratch_path, stored

#: Ids in a range, and the files that a range's records are dealt to by their digests.
RANGE_IDS = 65_536
RANGE_FILES = 64
#: Records in a physical file, at most; a file that has more is cut into parts of so many.
PART_RECORDS = 4096
#: Slots of a part's leaves, and children of an inner node.
FAN_OUT = 256
END = b"\r\n\r\n"
#: The writer's level of compression.
SPEED = {"zlib.compress.level": "BEST_SPEED"}


def header(page_id: Column, url: Column, length: Column) -> Column:
    """The record's lines up to the empty one. Line ends in a url are spaces; the date is fixed, so that
    equal pages are equal records."""
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        F.translate(F.coalesce(url, F.lit("")), "\r\n", "  "), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"),
    )


def record(page_id: Column, url: Column, body: Column) -> Column:
    """A whole record; a null body is empty."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(header(page_id, url, F.octet_length(body)), body, F.lit("\r\n\r\n"))


def file_of(page_id: Column, sha256: Column) -> Column:
    """The number of the file that a record is in: its range of ids, then a part of its digest, so that
    many records of one id (or without one, in range -1) are dealt to RANGE_FILES files."""
    ids = F.coalesce(F.floor(page_id / F.lit(RANGE_IDS)), F.lit(-1)).cast("long")
    return ids * RANGE_FILES + F.pmod(F.conv(F.substring(sha256, 1, 4), 16, 10).cast("long"), F.lit(RANGE_FILES))


def layout(pages: DataFrame) -> DataFrame:
    """file, page_id, url, sha256, record (text) for each row of pages(page_id, url, html); other columns
    are not looked at. Null ids, urls and bodies are records like any other."""
    own = pages.select("page_id", "url", record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    own = own.withColumn("sha256", F.sha2(F.col("record").cast("binary"), 256))
    return own.select(file_of(F.col("page_id"), F.col("sha256")).alias("file"), "page_id", "url", "sha256", "record")


def write(pages: DataFrame, path: str) -> None:
    """The archive of pages under path; records of a file in order of page_id, url and digest, each
    followed by two line ends, which separate them."""
    order = ["page_id", "url", "sha256"]
    nth = F.row_number().over(Window.partitionBy("file").orderBy(*order)) - 1
    rows = layout(pages).repartition("file").withColumn("part", F.floor(nth / PART_RECORDS)).sortWithinPartitions("file", "part", *order)
    _put(rows.withColumn("value", F.expr("substring(record, 1, length(record) - 4)")), path)


def _put(rows: DataFrame, path: str) -> None:
    """One physical file for each file and part, which lie together in order."""
    rows.select("file", "part", "value").write.partitionBy("file", "part").options(lineSep=END.decode(), compression="gzip", **SPEED).text(path)


def parse(data: bytes, strict: bool = True) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, fields, body) of each record in a file. Where no record can be made out (no
    version, no length, cut off) strict raises ValueError; else the bytes up to what looks like the next
    record are given without fields."""
    at = 0
    while at < len(data):
        end = data.find(END, at)
        wrong = f"no record at {at}" if not data.startswith(b"WARC/", at) or end < 0 else ""
        if not wrong:
            lines = data[at:end].decode(errors="replace").split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
            length = fields.get("content-length", "")
            stop = end + 4 + int(length) if length.isascii() and length.isdigit() else -1
            wrong = f"no length at {at}" if stop < 0 else f"the record at {at} is cut off" if data[stop : stop + 4] != END else ""
        if not wrong:
            yield at, stop + 4 - at, fields, data[end + 4 : stop]
            at = stop + 4
            continue
        if strict:
            raise ValueError(wrong)
        after = data.find(END + b"WARC/", at)
        after = after + 4 if after >= 0 else len(data)
        yield at, after - at, {}, data[at:after]
        at = after


def unzip(data: bytes) -> bytes:
    """All members of a gzip file, as far as they can be read."""
    out = []
    while data:
        machine = zlib.decompressobj(31)
        try:
            out.append(machine.decompress(data))
        except zlib.error:
            break
        data = machine.unused_data
    return b"".join(out)


PLACE = re.compile(r"file=(-?\d+)/part=(\d+)/[^/]*$")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list, bytes]]:
    """(file, part, records, bytes) of each physical file."""
    for batch in batches:
        for source, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = unzip(content.as_py())
            file, part = map(int, PLACE.search(source).groups())
            yield file, part, list(parse(data, strict=False)), data


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, part, offset, length, id, uri, body (binary) of each record of the archive under path. A
    physical file, which has a bounded number of records, is parsed in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, part, found, _ in _records(batches):
            yield pa.RecordBatch.from_pydict({
                "file": pa.array([file] * len(found), pa.int64()), "part": pa.array([part] * len(found), pa.int64()),
                "offset": pa.array([x[0] for x in found], pa.int64()), "length": pa.array([x[1] for x in found], pa.int64()),
                "id": pa.array([x[2].get("warc-record-id") for x in found], pa.string()), "uri": pa.array([x[2].get("warc-target-uri") for x in found], pa.string()), "body": pa.array([x[3] for x in found], pa.binary()),
            })

    return _files(spark, path).mapInArrow(run, "file long, part long, offset long, length long, id string, uri string, body binary")


def slot_of(record_id: str | None) -> int:
    """The leaf of a record within its part: by its number in the range of ids, in their order; those
    without a number are in the first."""
    digits = record_id and re.search(r"(-?\d+)>?$", record_id)
    return int(digits.group(1)) % RANGE_IDS * FAN_OUT // RANGE_IDS if digits else 0


MANIFEST = "file long, part long, slot long, offset long, length long, id string, uri string, sha256 string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, part, slot, offset, length, id, uri, sha256 of each record of the archive under path. What
    can't be made out as a record has a null id and uri."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, part, found, data in _records(batches):
            ids = [x[2].get("warc-record-id") for x in found]
            yield pa.RecordBatch.from_pydict({
                "file": pa.array([file] * len(found), pa.int64()), "part": pa.array([part] * len(found), pa.int64()), "slot": pa.array(map(slot_of, ids), pa.int64()),
                "offset": pa.array([x[0] for x in found], pa.int64()), "length": pa.array([x[1] for x in found], pa.int64()), "id": pa.array(ids, pa.string()),
                "uri": pa.array([x[2].get("warc-target-uri") for x in found], pa.string()), "sha256": pa.array([hashlib.sha256(data[x[0] : x[0] + x[1]]).hexdigest() for x in found], pa.string()),
            })

    return _files(spark, path).mapInArrow(run, MANIFEST)


def _parent(node: Column) -> Column:
    return F.shiftright(node, FAN_OUT.bit_length() - 1)


#: Bits of a part's number in the number of a node; a file has at most so many parts.
PART_BITS = 16


def _unit() -> Column:
    """A part's number among all: file numbers below 0 and from 0 on in turns, then the part."""
    turn = F.when(F.col("file") < 0, -2 * F.col("file") - 1).otherwise(2 * F.col("file"))
    return F.shiftleft(turn, PART_BITS) + F.col("part")


def heights(*manifests: DataFrame) -> int:
    """Levels above the leaves, enough for all the manifests: the last one is a single node."""
    most = max([m.agg(F.max(_unit())).first()[0] or 0 for m in manifests], default=0)
    return 1 + next(k for k in range(1, 64) if FAN_OUT**k > most)


def tree(records: DataFrame, top: int) -> DataFrame:
    """level, node, start, end, digest: the nodes over a manifest. Leaves are level 0; a node's number
    without its last byte is its parent's. A leaf has the records of one slot of one part, at most
    PART_RECORDS; all other nodes have at most FAN_OUT children."""
    each = F.struct("offset", F.concat_ws(":", "offset", "length", "id", "sha256").alias("line"))
    node = F.shiftleft(_unit(), FAN_OUT.bit_length() - 1) + F.col("slot")
    level = records.groupBy(node.alias("node")).agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.array_sort(F.collect_list(each)).alias("below"))
    level = level.select("node", "start", "end", F.sha2(F.array_join(F.transform("below", lambda x: x["line"]), "\n"), 256).alias("digest"))
    out = level.withColumn("level", F.lit(0))
    for k in range(1, top + 1):
        each = F.struct("node", F.concat_ws(":", "start", "end", "digest").alias("line"))
        level = level.groupBy(_parent(F.col("node")).alias("up")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(each)).alias("below"))
        level = level.select(F.col("up").alias("node"), "start", "end", F.sha2(F.array_join(F.transform("below", lambda x: x["line"]), "\n"), 256).alias("digest"))
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out.select("level", "node", "start", "end", "digest")


def _written(records: DataFrame, top: int) -> DataFrame:
    """The tree, written with a directory for each level, so that a level is read alone."""
    spark, path = records.sparkSession, scratch_path(records.sparkSession, "tree")
    nodes = tree(records, top)
    nodes.write.partitionBy("level").parquet(path)
    return spark.read.schema(nodes.schema).parquet(path)


def differing(left: DataFrame, right: DataFrame, top: int) -> DataFrame:
    """node: the leaves that the trees left and right don't agree on, those that one lacks among them.
    Goes down from the root: a level's nodes are compared only below nodes that differ."""
    found = None
    for k in range(top, -1, -1):
        nodes = left.unionByName(right).where(F.col("level") == k).select("node", "digest")
        if found is not None:
            nodes = nodes.join(found.select(F.col("node").alias("up")), _parent(F.col("node")) == F.col("up"), "left_semi")
        told = nodes.groupBy("node").agg(F.count("*").alias("trees"), F.min("digest").alias("a"), F.max("digest").alias("b"))
        found = told.where("trees < 2 OR a <> b").select("node")
    return found


def verdicts(own: DataFrame, other: DataFrame, leaves: DataFrame) -> DataFrame:
    """The records of own in the given leaves and those that other alone has there, with a verdict.

    Records of equal bytes and id are taken together in order of their offsets: intact, or moved if the
    replica has them at another offset. A record of which the replica has other bytes under the same id,
    or nothing that can be made out at its offset, is damaged; else it is lost, or added if only the
    replica has it."""
    node = F.shiftleft(_unit(), FAN_OUT.bit_length() - 1) + F.col("slot")
    def part(records: DataFrame) -> DataFrame:
        found = records.withColumn("node", node).join(leaves, "node", "left_semi")
        return found.withColumn("nth", F.row_number().over(Window.partitionBy("node", "id", "sha256").orderBy("offset")))

    keys = ["file", "part", "slot", "id", "sha256", "nth"]
    a, b = part(own).drop("node"), part(other).drop("node")
    both = a.alias("a").join(b.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    pick = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    rows = both.select(
        *[pick(c) for c in ("file", "part", "slot", "offset", "length", "id", "uri", "sha256")],
        F.when(F.col("a.file").isNull(), "added").when(F.col("b.file").isNull(), "lost").when(F.col("a.offset") != F.col("b.offset"), "moved").otherwise("intact").alias("verdict"),
    )
    rows = stored(rows, "verdicts")
    # What both lack of each other, by id and by place: a few rows for each damaged record.
    lost, added = rows.where("verdict = 'lost'"), rows.where("verdict = 'added'")
    by_id = added.where("id IS NOT NULL").select("file", "part", "id").distinct().withColumn("same_id", F.lit(True))
    by_place = added.where("id IS NULL").select("file", "part", "offset").distinct().withColumn("broken", F.lit(True))
    lost = lost.join(by_id, ["file", "part", "id"], "left").join(by_place, ["file", "part", "offset"], "left")
    lost = lost.withColumn("verdict", F.when(F.col("same_id") | F.col("broken"), "damaged").otherwise("lost"))
    were = lost.where("verdict = 'damaged'")
    gone_id = were.where("same_id").select("file", "part", "id").distinct()
    gone_place = were.where("broken").select("file", "part", "offset").distinct()
    # Their other form in the replica is the same damage, no record more.
    added = added.join(gone_id, ["file", "part", "id"], "left_anti")
    named, unnamed = added.where("id IS NOT NULL"), added.where("id IS NULL").join(gone_place, ["file", "part", "offset"], "left_anti")
    parts = [rows.where("verdict IN ('intact', 'moved')"), lost, named, unnamed]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*out.columns))
    return out


def audit(spark: SparkSession, path: str, replica: str) -> DataFrame:
    """file, part, offset, length, id, uri, sha256, verdict, intact: a row for each record of the archive
    under path, and for each that only the replica has. verdict is intact, moved (the same bytes at
    another offset), damaged, lost or added; intact is true for the first two, whose bytes are right.
    Empty archives have no rows."""
    own, other = (stored(manifest(spark, p), "manifest") for p in (path, replica))
    top = heights(own, other)
    leaves = stored(differing(_written(own, top), _written(other, top), top), "leaves")
    node = F.shiftleft(_unit(), FAN_OUT.bit_length() - 1) + F.col("slot")
    same = own.withColumn("node", node).join(leaves, "node", "left_anti").withColumn("verdict", F.lit("intact"))
    told = verdicts(own, other, leaves)
    out = same.select(*told.columns).unionByName(told)
    return out.select("file", "part", "offset", "length", "id", "uri", "sha256", "verdict", F.col("verdict").isin("intact", "moved").alias("intact"))


def copy(spark: SparkSession, path: str, to: str, change=None) -> None:
    """The archive under path, read and written again under to, where the files are read. change takes
    the rows file, part, offset, id, value (a record's text without the line ends after it) and gives
    them back as it will, to test an audit; without it the copy is a replica."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, part, found, data in _records(batches):
            yield pa.RecordBatch.from_pydict({
                "file": pa.array([file] * len(found), pa.int64()), "part": pa.array([part] * len(found), pa.int64()), "offset": pa.array([x[0] for x in found], pa.int64()),
                "id": pa.array([x[2].get("warc-record-id") for x in found], pa.string()), "value": pa.array([data[x[0] : x[0] + x[1] - 4].decode(errors="replace") for x in found], pa.string()),
            })

    rows = _files(spark, path).mapInArrow(run, "file long, part long, offset long, id string, value string")
    rows = change(rows) if change else rows
    _put(rows.sortWithinPartitions("file", "part", "offset"), to)
