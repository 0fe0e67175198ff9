"""Every registered query of the library against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from quadrille import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([tuple(normal(r[c]) for c in columns) for r in df.collect()], key=str)
    if name not in catalog.ORACLE_SQL:
        return
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted([tuple(normal(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall()], key=str)
    assert got == want


def test_the_flagship_is_registered():
    assert catalog.FLAGSHIP in catalog.QUERIES
