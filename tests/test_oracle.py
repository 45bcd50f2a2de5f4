"""Every core query that has SQL gives the same rows in both engines."""

import datetime
import decimal
import os

import duckdb
import pytest

from segforge.plans import oracle
from segforge.plans import queries as core

DATA = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, (decimal.Decimal, float)):
        return round(float(v), 6)
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    df = core.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    r = db.execute(SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=str)
    assert sorted((tuple(plain(x[c]) for c in columns) for x in df.collect()), key=str) == want
