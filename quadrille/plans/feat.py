"""Deterministic features from lineitem: integer projections, so that any engine computes the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


COLUMNS = {
    "feature_id": "l_orderkey * 10 + l_linenumber",
    "city": "CAST(l_suppkey % 5 AS INT)",
    "tile_i": "CAST(l_partkey % 4 AS INT)",
    "tile_j": "CAST(l_orderkey % 4 AS INT)",
    "cell_i": "CAST((l_partkey DIV 4) % 8 AS INT)",
    "cell_j": "CAST((l_orderkey DIV 4) % 8 AS INT)",
    "feature_class": "CAST((l_partkey + l_linenumber) % 4 AS INT)",
    "x0": "(l_partkey * 7 % 1000) / 4.0D",
    "y0": "(l_suppkey * 13 % 1000) / 4.0D",
    "w": "CAST(1 + CAST(l_quantity AS INT) AS INT)",
    "h": "CAST(1 + l_linenumber AS INT)",
    "price": "l_extendedprice",
    "stratum": "concat(l_returnflag, l_linestatus)",
    "road": "l_returnflag",
}


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in COLUMNS.items()])


#: The same view for DuckDB, to put before a query.
SQL = "WITH feat AS (SELECT " + ", ".join(f"{e.replace(' DIV ', ' // ').replace('4.0D', '4.0::DOUBLE').replace('concat(l_returnflag, l_linestatus)', 'l_returnflag || l_linestatus')} AS {c}" for c, e in COLUMNS.items()) + " FROM lineitem)\n"
