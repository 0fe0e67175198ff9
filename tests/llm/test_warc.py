import gzip
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quadrille.llm import queries, warc
from quadrille.llm.warc import audit, copy, differing, heights, manifest, parse, read, tree, write


@pytest.fixture(autouse=True)
def few_files(monkeypatch, request):
    if "sql" not in request.node.name:
        monkeypatch.setattr(warc, "RANGE_FILES", 4)


def rows(n=900):
    out = [(i, f"http://x/{i}", f"<p>page {i} é</p>\r\n\r\n" * (i % 4)) for i in range(n)]
    return out + [(None, "u", "<p>"), (None, None, None), (5, "http://x/5", "other"), (7, "http://x/7", out[7][2]), (-3, "a\r\nb", "neg")]


def make(spark, data):
    return spark.createDataFrame([(*r, "x") for r in data], "page_id long, url string, html string, offset string")


def archive(spark, tmp_path, name, data):
    path = str(tmp_path / name)
    write(make(spark, data), path)
    return path


def found(spark, path, replica):
    """id and verdict of all records that are not intact at their place."""
    return sorted((r.id, r.verdict) for r in audit(spark, path, replica).collect() if r.verdict != "intact")


def number(n):
    return F.col("id") == f"<urn:page:{n}>"


def test_records_come_back(spark, tmp_path):
    data = rows()
    path = archive(spark, tmp_path, "a", data)
    got = sorted((r.id, r.uri, r.body.decode()) for r in read(spark, path).collect())
    assert got == sorted((f"<urn:page:{'none' if i is None else i}>", (u or "").replace("\r\n", "  "), h or "") for i, u, h in data)
    listed = manifest(spark, path).collect()
    assert len(listed) == len(data)
    files = {(int(f.parent.parent.name.split("=")[1]), int(f.parent.name.split("=")[1])): gzip.decompress(f.read_bytes()) for f in (tmp_path / "a").rglob("*.gz")}
    for r in listed:
        there = files[r.file, r.part][r.offset : r.offset + r.length]
        assert hashlib.sha256(there).hexdigest() == r.sha256 and there.startswith(b"WARC/1.0")


def test_parse_errors():
    good = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [x[3] for x in parse(good * 2)] == [b"abc", b"abc"]
    for bad in (good[:-1], good.replace(b"3", b"x"), b"zzz", good.replace(b"3", b"2")):
        with pytest.raises(ValueError):
            list(parse(bad))
        again = list(parse(bad + b"\r\n\r\n" * (not bad.endswith(b"\r\n\r\n")) + good, strict=False))
        assert again[-1][3] == b"abc" and again[0][2] == {}


def test_replicas_of_equal_bytes(spark, tmp_path):
    path, replica = archive(spark, tmp_path, "a", rows()), str(tmp_path / "b")
    copy(spark, path, replica)
    assert found(spark, path, replica) == []
    assert audit(spark, path, replica).count() == len(rows())


def test_each_damage_is_found_alone(spark, tmp_path):
    path = archive(spark, tmp_path, "a", rows())

    def verdicts(name, change):
        copy(spark, path, str(tmp_path / name), change)
        return [x for x in found(spark, path, str(tmp_path / name)) if x[1] != "moved"]

    flip = lambda d: d.withColumn("value", F.when(number(17), F.regexp_replace("value", "page 17", "page 71")).otherwise(F.col("value")))
    assert verdicts("flipped", flip) == [("<urn:page:17>", "damaged")]
    assert verdicts("lost", lambda d: d.where(~number(300))) == [("<urn:page:300>", "lost")]
    longer = lambda d: d.withColumn("value", F.when(number(0), F.concat(F.regexp_replace("value", "Length: 0", "Length: 2"), F.lit("zz"))).otherwise(F.col("value")))
    assert verdicts("longer", longer) == [("<urn:page:0>", "damaged")]
    header = lambda d: d.withColumn("value", F.when(number(500), F.regexp_replace("value", "^WARC", "warc")).otherwise(F.col("value")))
    assert verdicts("header", header) == [("<urn:page:500>", "damaged")]
    more = lambda d: d.unionByName(d.where(number(41)).withColumn("offset", F.col("offset") + 1).withColumn("value", F.regexp_replace("value", "page:41", "page:9041")))
    assert verdicts("more", more) == [("<urn:page:9041>", "added")]


def test_records_behind_a_longer_one_are_moved_not_damaged(spark, tmp_path):
    path = archive(spark, tmp_path, "a", rows(200))
    copy(spark, path, str(tmp_path / "b"), lambda d: d.where(~number(0)))
    got = audit(spark, path, str(tmp_path / "b")).collect()
    gone = [r for r in got if r.verdict == "lost"]
    assert len(gone) == 1 and not gone[0].intact
    assert {r.file for r in got if r.verdict == "moved"} <= {gone[0].file} and all(r.intact for r in got if r.verdict == "moved")


def test_a_whole_file_and_empty_archives(spark, tmp_path):
    path = archive(spark, tmp_path, "a", rows(40))
    write(make(spark, rows(40) + [(900_000, "far", "a file of its own")]), str(tmp_path / "b"))
    assert found(spark, path, str(tmp_path / "b")) == [("<urn:page:900000>", "added")]
    assert found(spark, str(tmp_path / "b"), path) == [("<urn:page:900000>", "lost")]
    write(make(spark, []), str(tmp_path / "none"))
    assert audit(spark, str(tmp_path / "none"), str(tmp_path / "none")).count() == 0
    assert {v for _, v in found(spark, path, str(tmp_path / "none"))} == {"lost"}


def test_many_records_of_one_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PART_RECORDS", 4)
    data = [(1, "u", f"text {i}") for i in range(600)] + [(1, "u", "copy")] * 20 + [(None, None, "x")] * 3
    path = archive(spark, tmp_path, "a", data)
    assert max(r.part for r in manifest(spark, path).collect()) > 0
    copy(spark, path, str(tmp_path / "b"), lambda d: d.withColumn("value", F.regexp_replace("value", "text 77$", "text zz")))
    assert found(spark, path, str(tmp_path / "b")) == [("<urn:page:1>", "damaged")]


def test_only_differing_branches_are_descended(spark, tmp_path):
    path = archive(spark, tmp_path, "a", rows(600))
    copy(spark, path, str(tmp_path / "b"), lambda d: d.withColumn("value", F.when(number(300), F.lit("#")).otherwise(F.col("value"))))
    a, b = manifest(spark, path), manifest(spark, str(tmp_path / "b"))
    top = heights(a, b)
    left, right = tree(a, top).persist(), tree(b, top).persist()
    root = left.where(F.col("level") == top)
    assert root.count() == 1
    # With the root set equal, nothing below is looked at.
    same = right.join(root.select("level", F.col("digest").alias("d")), "level", "left").withColumn("digest", F.coalesce("d", "digest")).drop("d")
    assert differing(left, same, top).count() == 0 < differing(left, right, top).count()


def test_the_query_against_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = duck.execute(queries.OP6_SQL)
    names = [d[0] for d in want.description]
    got = queries.op6_warc_fixity(spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
