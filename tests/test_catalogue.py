"""Every registered query of the reference's operators gives the rows of its SQL."""

import math
import os
from collections import Counter

import duckdb
import pytest
from plinth.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf}/{file}'")
    return con


def plain(x):
    return (None if math.isnan(x) else round(x, 6)) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    found = duck.sql(SQL[name])
    names = found.columns
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(map(plain, r)) for r in found.fetchall()) == Counter(tuple(plain(r[c]) for c in names) for r in df.collect())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
