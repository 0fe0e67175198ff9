"""Checks, caches and writers on small tables, with the edge cases that the driver's tables don't have."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quadrille import sinks
from quadrille.operators import invariants
from quadrille.plans import invariants as plans
from quadrille.sources import regions, tables

SF = "/root/testdata/sf0.001"


def test_cell_rules_at_nan_and_null(spark):
    nan = float("nan")
    rows = [(1, 0.5, 0.2, 10.0, 1), (2, nan, 0.2, 10.0, 1), (3, None, None, 10.0, 0), (4, 1.0, 1.0, 10.0, 0), (5, 1.0, 1.0, 10.0, 2), (6, 0.1, 0.2, 0.0, 1), (7, 1.0 + 1e-12, 0.0, nan, 1)]
    df = spark.createDataFrame(rows, "id int, water_fraction double, sea_water_fraction double, cell_area_admin_clipped_m2 double, kept_features_count int")
    got = sorted(map(tuple, invariants.broken(df, ["id"], invariants.cell_rules()).collect()))
    assert got == [(2, "water_fraction_bounds"), (4, "kept_cell_rule"), (6, "cell_area_positive"), (6, "water_fraction_bounds"), (7, "nan_free")]


def test_contract_rules(spark):
    rows = [(1, 0, 0, 0, 1), (1, 111, 1, 1, None), (2, 31, 0, 3, None), (1, 112, 0, 0, 2), (2, 0, 2, 0, None), (1, 3, 0, 2, 3), (1, 4, 0, 0, 0), (0, 1, 0, 0, 1)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, slot_kind int, slot_index int, axis int, scope_marker int, boundary_class_enum int")
    got = sorted(map(tuple, invariants.broken(df, ["id"], invariants.contract_rules()).collect()))
    assert got == [(3, "slot_range"), (4, "axis_member"), (4, "class_iff_active"), (5, "class_iff_active"), (6, "class_member"), (7, "slot_range")]
    assert invariants.broken(df.where("id = 1"), ["id"], invariants.contract_rules(True)).count() == 0 < invariants.broken(df.where("id = 0"), ["id"], invariants.contract_rules(True)).count()


def test_facts_of_broken_bytes(spark):
    df = spark.createDataFrame([(1, bytearray(b"\x01\x01")), (2, None), (3, bytearray(b"")), (4, bytearray(b"\x01\x63\x00\x00\x00"))], "id int, g binary")
    assert [r[0] for r in df.select(invariants.wkb_facts(F.col("g"))).collect()] == [None] * 4


def test_versions():
    assert invariants.compare_version("macro", "macro/1", "macro/1") and not invariants.compare_version("macro", "macro/1", "macro/2")
    with pytest.raises(ValueError):
        invariants.compare_version("macro", "macro/1", "tokens/1")


def test_checks_of_empty_tables(spark):
    none = plans.cells(spark, SF).limit(0)
    assert invariants.broken(none, ["cell_i"], invariants.cell_rules()).count() == 0
    assert invariants.wrong_counts(none, none, plans.CELL).count() == 0 == invariants.digest_drift(sinks.manifest(none, ["city"]), sinks.manifest(none, ["city"]), ["city"], "digest").count()


def test_the_box_reaches_the_scan(spark):
    plan = plans.theme_scan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    assert "bbox.xmin" in pushed and "bbox.ymax" in pushed
    schema = plan[plan.index("ReadSchema") :]
    assert "num_floors" not in schema and "geometry" not in schema


def test_region_settings():
    known = {"town": {"crs": "EPSG:3414", "bbox": (1, 2, 3, 4)}}
    assert regions.region_of(known, "town").box == (1, 2, 3, 4)
    with pytest.raises(KeyError, match="town"):
        regions.region_of(known, "city")
    for crs, box in (("epsg:3414", (1, 2, 3, 4)), ("EPSG:", (1, 2, 3, 4)), ("EPSG:1", (3, 2, 1, 4))):
        with pytest.raises(ValueError):
            regions.Region("x", crs, box)


def test_region_cache(spark, tmp_path):
    root = plans.themed(spark, SF)
    backend, town = regions.PartitionedBackend(spark, root), regions.Region("town", "EPSG:3414", (0, 0, 300, 300))
    cache = str(tmp_path / "cache")
    load = lambda release, **more: regions.load_region(cache, town, release, backend, ["buildings"], **more)["buildings"]
    n = load("r1").count()
    assert n and load("r1").count() == n
    with pytest.raises(ValueError, match="confirm"):
        load("r2", limit=10)
    assert load("r2", limit=10, confirm=True).count() == n
    spark.read.parquet(f"{cache}/town/buildings").limit(5).write.mode("append").parquet(f"{cache}/town/buildings")
    with pytest.raises(ValueError, match="changed"):
        load("r2")
    assert load("r2", refresh=True).count() == n
    assert regions.invalidate(spark, cache, "town") and not regions.invalidate(spark, cache, "town")
    folder = tmp_path / "mini"
    backend.read_theme("buildings", None).write.parquet(str(folder / "buildings.parquet"))
    mini = regions.FolderBackend(spark, str(folder))
    assert mini.read_theme("buildings", (9, 9, 9, 9)).count() == mini.estimate("buildings", None).first().n_rows > n - 1


def test_tables_are_checked_before_they_are_written(spark, tmp_path):
    rows = spark.range(63).select(F.lit(0).alias("city"), F.lit(1).alias("tile_i"), F.lit(2).alias("tile_j"), F.floor(F.col("id") / 8).alias("cell_i"), (F.col("id") % 8).alias("cell_j"), F.col("id").alias("cell_slot_index"), F.array(F.lit(1)).alias("token_sequence"), F.lit(1).alias("feature_count"), F.lit("0").alias("provenance_sha256"))
    with pytest.raises(ValueError, match="instead of 64"):
        sinks.write_table(rows, "token_cells", str(tmp_path / "t"))
    assert not (tmp_path / "t").exists()
    with pytest.raises(ValueError, match="missing columns"):
        sinks.write_table(rows.drop("cell_i"), "token_cells", str(tmp_path / "t"))


def test_canonical_digests():
    a = sinks.canonical('{"b": 1, "a": {"made_at": 5, "x": 2}}', ["*made_at"])
    assert a == sinks.canonical('{"a": {"x": 2, "made_at": 6}, "b": 1}', ["*made_at"]) == sinks.canonical('{"a": {"x": 2}, "b": 1}')
    assert a != sinks.canonical('{"a": {"x": 3}, "b": 1}') and a == sinks.canonical('{"a": {"x": 2, "y": 1}, "b": 1}', ["a.y"])


def test_registry_and_report(spark, tmp_path):
    path = str(tmp_path / "registry")
    assert [r.name for r in sinks.freeze_registry(["b", "a"], spark, path).orderBy("place").collect()] == ["b", "a"]
    with pytest.raises(Exception, match="exists"):
        sinks.freeze_registry(["c"], spark, path)
    with pytest.raises(ValueError):
        sinks.freeze_registry(["c", "c"], spark, str(tmp_path / "other"))
    assert sinks.report("T", spark.createDataFrame([(1, None)], "a int, b int")) == "## T\n\n| a | b |\n|---|---|\n| 1 |  |\n"


@pytest.fixture(scope="module")
def lineitem(spark, tmp_path_factory):
    """Writes lineitem of rows(partkey, orderkey, linenumber), other columns constant, to a folder of its own."""

    def write(rows):
        folder = str(tmp_path_factory.mktemp("rows"))
        each = rows.selectExpr("CAST(orderkey AS long) AS l_orderkey", "CAST(partkey AS long) AS l_partkey", "5L AS l_suppkey", "CAST(linenumber AS int) AS l_linenumber", "7.0D AS l_quantity", "9.0D AS l_extendedprice", "'R' AS l_returnflag", "'F' AS l_linestatus")
        each.write.parquet(f"{folder}/lineitem.parquet")
        return folder

    return write


def test_cells_of_any_count_agree_with_the_sql(spark, lineitem):
    """A cell of each count from 1 to 230: those of 144 to 199 have the id of a length where an anchor stands."""
    folder = lineitem(spark.range(230).selectExpr("id % 32 AS partkey", "id DIV 32 AS orderkey", "explode(sequence(0, id)) AS linenumber"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    columns = [*plans.CELL, "invariant"]
    want = sorted(c.execute(f"SELECT {', '.join(columns)} FROM ({plans.query.sql['token_violations']})").fetchall())
    assert sorted(map(tuple, plans.token_violations(spark, folder).select(*columns).collect())) == want


def test_a_large_class_is_many_collections(spark, lineitem, tmp_path, monkeypatch):
    """A class of 40,000 features isn't one line of a file, and none of them is lost."""
    folder = lineitem(spark.range(40_000).selectExpr("id AS partkey", "id AS orderkey", "1 AS linenumber"))
    monkeypatch.setattr(sinks, "scratch", lambda spark, name: str(tmp_path / name))
    assert [tuple(r) for r in plans.geojson_features(spark, folder).select("class", "n", "total").collect()] == [(1, 40_000, sum(k * 7 % 1000 / 4 for k in range(40_000)))]
    written = spark.read.schema("type string, features array<struct<type: string, properties: struct<class: bigint>>>").json(str(tmp_path / "geojson"))
    sizes = [(r.type, len(r.features), {f.properties["class"] for f in r.features}) for r in written.collect()]
    assert sum(n for _, n, _ in sizes) == 40_000 and max(n for _, n, _ in sizes) <= 16_384 and all((t, c) == ("FeatureCollection", {1}) for t, _, c in sizes)
