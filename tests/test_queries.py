"""Every graph query against its DuckDB statement over the smallest tables."""

import math
import os

import duckdb
import pytest

from vertexloom.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SF}/{name}')")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    ran = con.execute(catalogue.oracles()[name])
    names = [c[0] for c in ran.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, ran.fetchall())


def test_every_query_has_an_oracle():
    assert set(catalogue.queries()) == set(catalogue.oracles())
