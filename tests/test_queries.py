"""Every query against its SQL twin, over whole tables of the smallest data set."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    f = float(v)
    return None if math.isnan(f) else f


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_query(spark, duck, name):
    df = entry_point.queries()[name](spark, SF)
    got = df.collect()
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    twin = duck.execute(sql)
    names = [c[0] for c in twin.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, twin.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
