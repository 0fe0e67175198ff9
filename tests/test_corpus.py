"""Operators on corpora against plain forms and at their edges."""

import pytest
from pyspark.sql import functions as F

from quadrille.operators import corpus
from quadrille.plans import corpus as plans

SF = "/root/testdata/sf0.001"


def test_unknown_names_and_numbers(spark):
    df = spark.createDataFrame([("road", 3), (None, None)], "name string, n int")
    assert [tuple(r) for r in df.select(corpus.encode_enum(F.col("name"), corpus.FEATURE_CLASSES), corpus.decode_enum(F.col("n"), corpus.FEATURE_CLASSES)).collect()] == [(0, "base"), (None, None)]
    with pytest.raises(Exception, match="unknown name"):
        df.select(corpus.encode_enum(F.lit("x"), corpus.FEATURE_CLASSES)).collect()
    with pytest.raises(Exception, match="unknown number"):
        df.select(corpus.decode_enum(F.lit(9), corpus.FEATURE_CLASSES)).collect()


def test_policies_leave_the_given_tables_alone(spark):
    df = spark.createDataFrame([("a",), (None,)], "class string")
    given = {"base": df}
    out = corpus.apply_policies(given, [("base", "class", "token", "T", ["a"]), ("places", "class", "drop", None, None)])
    assert sorted(r[0] for r in out["base"].collect()) == ["T", "a"] and given == {"base": df} and df.where("class IS NULL").count() == 1


def test_kinds_of_blocks(spark):
    ring = [509, 99, 300, 323, 346, 369, 511, 453, 601, 453, 691, 453, 781, 453, 510]  # a square of 5 m, by degrees
    open_ = [509, 99, 300, 323, 346, 369, 511, 453, 510]
    road, node, bad = [509, 1, 300, 323, 346, 369, 511, 453, 510], [509, 1, 300, 323, 346, 369, 510], [509, 1, 510]
    df = spark.createDataFrame([(1, ring + open_ + road + node + bad), (2, [])], "k int, tokens array<int>")
    got = [tuple(r) for r in corpus.classify_blocks(df, ["k"], [99]).collect()]
    # The ring's moves go in the middle of each degree, so its ends meet again.
    assert got == [(1, 1, 1, 1, 1, 1)]


def test_permutations_against_a_plain_share(spark):
    cells = spark.createDataFrame([(0, c, c % 2) for c in range(10)] + [(1, c, 0) for c in range(4)], "t int, cell int, label int")
    edges = spark.createDataFrame([(0, c, c + 1) for c in range(9)] + [(1, 0, 1), (1, 2, 3)], "t int, a int, b int")
    got = {r.t: r for r in corpus.permutation_gap(edges, cells, ["t"], 50, 1).collect()}
    assert got[0].real == 0 and 0.25 < got[0].null < 0.65 and got[0].gap == pytest.approx(-got[0].null)
    assert got[1].real == got[1].null == 1
    assert {r.t: r.null for r in corpus.permutation_gap(edges.repartition(7), cells.repartition(5), ["t"], 50, 1).collect()} == {k: r.null for k, r in got.items()}


def test_donors_where_there_is_one_value(spark):
    df = spark.createDataFrame([("x", 1, "a"), ("x", 2, "a"), ("y", 3, "a"), ("y", 4, None), ("y", 5, "b")], "city string, k int, macro string")
    got = {r.k: r.donor for r in corpus.deranged(df, "city", "k", "macro", "s").collect()}
    assert got[1] is None and got[2] is None and got[3] in (4, 5) and got[4] in (3, 5) and got[5] in (3, 4)


def test_changed_files(spark, tmp_path):
    for name in "abcd":
        (tmp_path / name).write_bytes(name.encode() * 5)
    scan = lambda: corpus.file_facts(spark.read.format("binaryFile").load(str(tmp_path)))
    recorded = spark.createDataFrame(scan().collect())
    (tmp_path / "a").unlink()
    (tmp_path / "b").write_bytes(b"b")
    (tmp_path / "c").write_bytes(b"xxxxx")
    got = {r.path[-1]: r.state for r in corpus.changed_files(recorded, scan(), F.lit(True)).collect()}
    assert got == {"a": "gone", "b": "size", "c": "bytes"}
    assert {r.path[-1] for r in corpus.changed_files(recorded, scan(), F.lit(False)).collect()} == {"a", "b"}


def test_spaced_samples_of_small_groups(spark):
    df = spark.createDataFrame([(g, k) for g, n in ((0, 3), (1, 11)) for k in range(n)], "g int, k int")
    got = sorted(map(tuple, corpus.spaced_sample(df, ["g"], ["k"], 5).collect()))
    assert got == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (1, 4), (1, 6), (1, 8)]


def test_zones(spark):
    rows = [(103.6, 1.2, 104.0, 1.5), (8.0, 50.0, 8.5, 50.5), (11.9, 50.0, 12.1, 50.5), (8.0, -1.0, 8.5, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    assert [r[0] for r in df.select(corpus.zone_code(*map(F.col, "abcd"))).collect()] == [None, "EPSG:25832", None, None]


def test_themes(spark):
    assert set(plans.themes(spark, SF)) == {"buildings", "transportation"}
