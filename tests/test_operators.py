import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quadrille import sinks, streaming
from quadrille.operators import frequency, graph, grid, percentiles, policy, rollup, selection, sets, stats, tokens, verdicts
from quadrille.sources import tables


def test_dims(spark):
    assert grid.cells(spark).count() == 64
    e = grid.edges(spark)
    assert e.where("NOT external").count() == 112 and e.where("external").count() == 32
    assert grid.sides(spark).join(e, ["lower_i", "lower_j", "axis"]).count() == 256


def test_frequency_literals(spark):
    df = spark.createDataFrame([("restaurant",), ("cafe",), ("restaurant",), (None,)], "v string")
    assert {r.value: r.n for r in frequency.value_counts(df, "v").collect()} == {"restaurant": 2, "cafe": 1}
    assert tuple(frequency.presence(df, "v").first()) == (4, 3)
    lists = spark.createDataFrame([(list(range(k)),) for k in range(8)] + [(None,)], "l array<int>")
    assert [r.n for r in frequency.length_histogram(lists, "l").orderBy("bucket").collect()] == [2, 1, 1, 1, 1, 3]
    values = spark.createDataFrame([(v,) for v in (0.0, 0.049, 0.05, 0.15, 0.349, 0.35, 10.0, -1.0, None)], "v double")
    assert [r.b for r in values.select(frequency.bucket(F.col("v"), [0, 0.05, 0.15, 0.35]).alias("b")).collect()] == [0, 0, 1, 2, 2, 3, 3, 0, None]
    with pytest.raises(Exception, match="below the first edge"):
        values.select(frequency.bucket(F.col("v"), [0, 1], "error")).collect()
    empty = frequency.floor_cuts(frequency.value_counts(df.limit(0), "v"), frequency.presence(df.limit(0), "v"))
    assert empty.count() == 0


def test_policies(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "c string, i int")
    assert [r.c for r in policy.missing(df, "c", "token").orderBy("i").collect()] == ["a", "__UNK__", "b"]
    assert policy.missing(df, "c", "drop").count() == 2 and policy.missing(df, "c", "pass").count() == 3
    assert policy.known(df, "c", []).count() == 0
    assert policy.known(policy.missing(df, "c", "token"), "c", ["a"]).count() == 2
    with pytest.raises(KeyError):
        policy.missing(df, "x", "drop")
    with pytest.raises(ValueError):
        policy.resolve(df.schema, "c.x")
    water = spark.createDataFrame([("ocean", None), (None, "ocean"), (None, None), ("river", "x")], "c string, s string")
    assert [r[0] for r in water.select(policy.sea(F.col("c"), F.col("s"))).collect()] == [True, True, False, False]
    vocabulary = spark.createDataFrame([("highway=primary", 1), ("<unknown_highway>", 2)], "tag string, id int")
    tags = spark.createDataFrame([("highway=primary",), ("highway=odd",)], "tag string")
    assert {r.tag: r.token_id for r in policy.resolved_tag(tags, vocabulary).collect()} == {"highway=primary": 1, "highway=odd": 2}
    with pytest.raises(Exception, match="no token for"):
        policy.resolved_tag(spark.createDataFrame([("sea=x",)], "tag string"), vocabulary).collect()


def test_quantile_conventions(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3)] + [(None,)], "v double")
    v = F.col("v")
    row = percentiles.picks(df, [], v, {"m": percentiles.nearest_rank(0.5), "c": percentiles.ceil_rank(99), "t": percentiles.truncated(0.9)}).first()
    assert (row.n, row.m, row.c, row.t) == (3, 2, 3, 2)
    assert percentiles.exclusive(df, [], v, {"p10": (1, 10)}).first().p10 == pytest.approx(0.4)
    two = percentiles.exclusive(df.where("v < 3"), [], v, {f"q{k}": (k, 4) for k in (1, 2, 3)}).first()
    assert tuple(two) == (2, 0.75, 1.5, 2.25)
    assert percentiles.exclusive(df.where("v < 2"), [], v, {"q": (1, 4)}).first().q is None
    assert percentiles.picks(df, [], percentiles.finite(F.when(v == 1, float("inf")).otherwise(v)), {"c": percentiles.ceil_rank(1)}).first().c == 2
    assert df.agg(percentiles.pearson(v, F.lit(1.0))).first()[0] == 0


def test_no_group_is_one_row(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    plan = percentiles.picks(df, ["g"], F.col("v"), {"m": percentiles.nearest_rank(0.5)})._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    again = stats.ks_pairs(df.withColumn("city", F.col("v") % 4), ["g"], "city", "v")
    assert again.count() == 3 * 6


def test_blocks_of_malformed_sequences(spark):
    def blocks(ids):
        return spark.createDataFrame([(ids,)], "t array<int>").select(tokens.blocks(F.col("t"))).first()[0]

    assert blocks([510, 509, 1, 510]) == [[509, 1, 510]]
    assert blocks([509, 1, 509, 2, 510]) == [[509, 2, 510]]
    assert blocks([509, 1, 510, 510, 3, 509, 4]) == [[509, 1, 510]]
    assert blocks([]) == blocks([1]) == blocks([509]) == []


def test_many_coins(spark):
    row = spark.range(1).select(stats.binomial_tail(F.lit(0), F.lit(2000)).alias("all"), stats.binomial_tail(F.lit(2500), F.lit(5000)).alias("half"), stats.binomial_tail(F.lit(2600), F.lit(5000)).alias("rare")).first()
    assert row["all"] == pytest.approx(1) and row.half == pytest.approx(0.505641, abs=1e-5) and row.rare == pytest.approx(0.0024487, rel=1e-2)


def test_blake_sample(spark):
    rows = [(c, i, j) for c in range(3) for i in range(4) for j in range(4)]
    got = selection.blake_sample(spark.createDataFrame(rows, "city int, tile_i int, tile_j int"), 5, "7", ["city", "tile_i", "tile_j"])
    want = sorted(rows, key=lambda r: hashlib.blake2b(":".join(map(str, (7, *r))).encode(), digest_size=16).hexdigest())[:5]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_anchor_of_negative_coordinates(spark):
    got = spark.range(1).select(tokens.anchor(F.lit(-0.5), F.lit(-12.0))).first()[0]
    q = [divmod(-1, 23), divmod(-24, 23)]
    assert got == [300 + q[0][0], 323 + q[0][1], 346 + q[1][0], 369 + q[1][1]]


def test_statistics(spark):
    rows = [("k", "a", 1.0), ("k", "a", 2.0), ("k", "b", 2.0), ("k", "b", 3.0), ("k", "c", None)]
    df = spark.createDataFrame(rows, "g string, city string, value double")
    assert [(r.a, r.b, r.ks) for r in stats.ks_pairs(df, ["g"]).collect()] == [("a", "b", 0.5)]
    assert stats.ks_two(df, F.col("city") == "z", F.col("value"), ["g"]).first().ks == 1
    want = {(1, 2, 0.5): 1, (-1, -3): -1, (): 0, (0, 0): 0, (2, -2, 1, -1): 0, (1, -1, 2): 0.5}
    for k, (deltas, r) in enumerate(want.items()):
        d = spark.createDataFrame([(k, float(x)) for x in deltas or (0,)], "g int, delta double")
        assert stats.rank_biserial(d, ["g"]).first().r == pytest.approx(r)
    d = spark.createDataFrame([(1, float(x)) for x in (1, 1, 1, -1, 0)], "g int, delta double")
    row = stats.sign_test(d, ["g"]).first()
    assert (row.n, row.n_positive) == (4, 3) and row.p_one == pytest.approx(5 / 16) and row.p_two == pytest.approx(10 / 16)
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5)], "i int, p double").withColumn("f", F.lit(1))
    assert [round(r.p_bh, 9) for r in stats.bh_adjust(p, "p", ["f"], ["i"]).orderBy("i").collect()] == [0.04, round(0.16 / 3, 9), round(0.16 / 3, 9), 0.5]


def test_tokens(spark):
    one = spark.range(1)
    assert one.select(tokens.chunks(F.lit(150))).first()[0] == [64, 64, 22]
    assert one.select(tokens.chunks(F.lit(0))).first()[0] == [1]
    assert one.select(tokens.direction(F.lit(1.0), F.lit(-1.0))).first()[0] == 315
    assert [one.select(tokens.quantise(F.lit(x))).first()[0] for x in (0.25, 0.75, 1.25)] == [0, 2, 2]
    seq = F.array(*[F.lit(x) for x in (1, 509, 5, 510, 509, 6, 7, 510, 509, 8)])
    assert one.select(tokens.blocks(seq)).first()[0] == [[509, 5, 510], [509, 6, 7, 510]]
    assert one.select(tokens.terminated(F.array().cast("array<int>"))).first()[0] == []


def test_selection(spark):
    df = spark.createDataFrame([(i, i % 3, i % 7) for i in range(60)], "id int, g int, v int")
    a = {r.id for r in selection.hash_sample(df, 5, "s", ["id"], ["g"]).collect()}
    assert len(a) == 15 and a == {r.id for r in selection.hash_sample(df.repartition(7), 5, "s", ["id"], ["g"]).collect()}
    parts = selection.split(df.select("id"), ["id"], 0.25, "x").groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"val": 15, "train": 45}
    assert selection.donors(df, ["g"], "id", "z").where("donor IS NULL OR donor = id").count() == 0
    assert selection.best_per(df, ["g"], F.col("v"), ["id"]).count() == 3


def test_sets(spark):
    held = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    df = spark.createDataFrame([(1, None), (2, 3), (4, 5)], "a int, b int")
    assert [tuple(r) for r in sets.without(df, held, ["a", "b"]).collect()] == [(4, 5)]
    rows = spark.createDataFrame([(1, 5), (2, 4), (3, 9)], "o int, k int").withColumn("g", F.lit(1))
    assert [r.o for r in sets.unsorted(rows, "o", ["k"], ["g"]).collect()] == [2]


def test_graph_against_brute_force(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for t in range(12):
        edges = {tuple(sorted(rng.sample(range(20), 2))) for _ in range(rng.randint(1, 14))}
        rows += [(0, t, 0, a, b) for a, b in edges]
        root = list(range(20))
        find = lambda x: x if root[x] == x else find(root[x])  # noqa: E731, B023
        for a, b in edges:
            root[find(a)] = find(b)
        sizes = [sum(find(a) == k for a, _ in edges) for k in range(20)]
        degree = [sum(k in e for e in edges) for k in range(20)]
        want[t] = (max(sizes), sum(d >= 2 for d in degree) / sum(d >= 1 for d in degree))
    df = spark.createDataFrame(rows, "city int, tile_i int, tile_j int, a int, b int")
    assert {r.tile_i: r.n_giant for r in graph.giant_component(df).collect()} == {t: w[0] for t, w in want.items()}
    assert {r.tile_i: r.share for r in graph.continuity(df).collect()} == {t: pytest.approx(w[1]) for t, w in want.items()}


def test_sources(spark, tmp_path):
    assert tables.theme_path("s3a://x/", "base") == "s3a://x/theme=base/type=water"
    with pytest.raises(ValueError, match="unknown theme"):
        tables.theme_path("x", "roads")
    rows = [("a", b"x", "ocean", (0.0, 1.0, 0.0, 1.0)), ("b", b"y", "lake", (5.0, 6.0, 5.0, 6.0))]
    df = spark.createDataFrame(rows, "id string, geometry binary, subtype string, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>")
    df.write.parquet(str(tmp_path / "theme=base" / "type=water"))
    found = tables.read_theme(spark, str(tmp_path), "base", (1, 1, 4, 4))
    assert [r.id for r in found.collect()] == ["a"]
    plan = found.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "bbox.xmin" in plan
    with pytest.raises(ValueError, match="missing columns: height"):
        tables.require(df, ["id", "height"])
    with pytest.raises(ValueError, match="confirm"):
        tables.guard(df, limit=100)
    assert tables.guard(df, True, 100) is df
    (tmp_path / "l.csv").write_text("epoch,step,train_loss,val_loss\n1,10,0.5,\n1, ,0.4,1\n2,20,0.3,0.2\n")
    assert [tuple(r) for r in tables.read_losses(spark, str(tmp_path / "l.csv")).collect()] == [(1, 10, 0.5, None), (2, 20, 0.3, 0.2)]
    (tmp_path / "r.json").write_text('{"records": [{"seed": 1}, {"seed": 2}]}')
    assert [tuple(r) for r in tables.read_records(spark, str(tmp_path / "r.json"), "seed: int", "none").collect()] == [("none", 1), ("none", 2)]
    (tmp_path / "g.json").write_text('{"type": "FeatureCollection", "features": [{"geometry": {"type": "Point", "coordinates": [50, 80]}, "properties": {"class": "cafe"}}]}')
    assert tuple(tables.read_geojson(spark, str(tmp_path / "g.json"), "class: string").first()) == ("Point", "[50, 80]", "cafe")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i, f"v{i}") for i in range(30)], "k int, i int, v string")
    sinks.seal(df, str(tmp_path / "s"), ["k"])
    assert sinks.open_sealed(spark, str(tmp_path / "s"), ["k"]).count() == 30
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.seal(df, str(tmp_path / "s"), ["k"])
    df.where("i = 4").write.mode("append").parquet(str(tmp_path / "s/data"))
    with pytest.raises(ValueError, match="changed"):
        sinks.open_sealed(spark, str(tmp_path / "s"), ["k"])
    a, b = (sinks.manifest(x, ["k"]).orderBy("k").collect() for x in (df, df.repartition(5)))
    assert a == b
    sinks.write_sorted(df, str(tmp_path / "w"), ["k"], ["i"], ["k"])
    assert spark.read.parquet(str(tmp_path / "w")).count() == 30
    assert sinks.pinned(df, "i long, k short").dtypes == [("i", "bigint"), ("k", "smallint")]
    assert [r.k for r in sinks.check_cover(df.where("i > 0"), ["k"], 10).collect()] == [0]


def test_streams_agree_with_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    for name, f in (("w", streaming.windowed), ("s", streaming.sessions)):
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
        mode = "complete" if name == "w" else "append"
        run = f(stream).writeStream.format("memory").queryName(f"out_{name}").outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        run.processAllAvailable()
        run.stop()
        batch = {tuple(r)[:2]: r.n for r in f(events).collect()}
        got = {tuple(r)[:2]: r.n for r in spark.table(f"out_{name}").collect()}
        assert got.items() <= batch.items() and (name == "s" or got == batch)




def test_bootstrap_and_ridge_against_plain_forms(spark):
    import numpy as np

    rng = random.Random(4)
    rows = [(float(x), float(x**1.5 * rng.uniform(0.8, 1.2))) for x in range(1, 30)]
    low, high = verdicts.bootstrap_slopes(spark.createDataFrame(rows, "x double, y double"), "x", "y", 100, 3).first()
    slope = np.polyfit(np.log([x for x, _ in rows]), np.log([y for _, y in rows]), 1)[0]
    assert low < slope < high and high - low < 0.5
    assert verdicts.bootstrap_slopes(spark.createDataFrame(rows, "x double, y double"), "x", "y", 100, 3).first() == (low, high)
    data = [(k, rng.uniform(0, 1), rng.uniform(0, 1)) for k in range(200)]
    data = [(k, a, b, 3 * a - b + 1 + rng.uniform(-0.1, 0.1)) for k, a, b in data]
    got = verdicts.ridge_r2(spark.createDataFrame(data, "k int, a double, b double, y double"), F.col("k") % 5, ["a", "b"], "y", 1.0, 5).first()[0]
    x, y, fold = np.array([[a, b, 1] for _, a, b, _ in data]), np.array([d[3] for d in data]), np.arange(200) % 5
    error = 0
    for f in range(5):
        t = fold != f
        w = np.linalg.solve(x[t].T @ x[t] + np.diag([1.0, 1.0, 0.0]), x[t].T @ y[t])
        error += ((y[~t] - x[~t] @ w) ** 2).sum()
    assert got == pytest.approx(1 - error / ((y - y.mean()) ** 2).sum())


def test_redundancy(spark):
    import gzip

    data = [b"", b"abc" * 500, bytes(range(256))]
    got = spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate(data)] + [(3, None)], "k int, d binary").orderBy("k").select(rollup.redundancy(F.col("d"))).collect()
    assert [r[0] for r in got] == [0.0] + [pytest.approx(1 - len(gzip.compress(d, 6)) / len(d)) for d in data[1:]] + [None]


def test_an_empty_score_table(spark):
    none = spark.createDataFrame([], "model string, city int, ks double, n long, sem double")
    assert verdicts.binding(none).count() == 0 and verdicts.memorisation(none.select("city", F.col("ks").alias("ks_own"), F.col("ks").alias("ks_train")), ["city"]).count() == 0
    assert verdicts.sane(none).first().sane is False
