"""Every query of the library against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from tracklens.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(v)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        assert got
        return
    cur = duck.execute(registry.ORACLE_SQL[name])
    at = [x[0] for x in cur.description]
    assert sorted(at) == columns
    assert got == sorted(repr(tuple(plain(r[at.index(c)]) for c in columns)) for r in cur.fetchall())


def test_entry(spark):
    assert registry.entry(spark, SF).count() > 0


def test_names_match():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
