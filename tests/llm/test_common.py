import pytest

from quadrille.llm import common


class Settings:
    def __init__(self, **settings):
        self.conf = {k.replace("_", "."): v for k, v in settings.items()}


def test_a_cluster_must_name_a_shared_folder(monkeypatch):
    monkeypatch.setattr(common, "_MADE", [])
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.scratch_path(Settings(spark_master=master), "x")
        assert common.scratch_path(type("S", (), {"conf": {"spark.master": master, "spark.checkpoint.dir": "hdfs:///s/"}}), "x").startswith("hdfs:///s/x-")
    assert common.scratch_path(Settings(spark_master="local[4]"), "x").startswith("file:///tmp/")


def test_stored_tables_can_be_discarded(spark):
    common.discard(spark)
    df = common.stored(spark.range(3), "three")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert df.count() == 3 and common.discard(spark) == 1 and common.discard(spark) == 0
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def test_attached_values_with_one_hot_key(spark):
    from pyspark.sql import functions as F

    rows = common.bucketed(spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), "id"), "rows")
    values = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = common.attach(rows, "k", values)
    assert got.columns == ["k", "id", "n"] and got.count() == 3000 and got.where("k = 0 AND n <> 2001").count() == 0
