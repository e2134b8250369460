"""Every registered query of the library against DuckDB."""

import os

import duckdb
import pytest

from caselens.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert list(map(repr, got)) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_queries_without_sql_are_stable(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLES)):
        first = sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect()))
        assert first and first == sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.exists("/root/testdata/sf0.001")
