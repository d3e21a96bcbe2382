"""Every query against its SQL on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from leafmill.plans import catalog

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return ("f", round(v, 4))
    return ("s", str(v))


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for name in os.listdir(DATA):
        db.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert got
    if name in catalog.ORACLES:
        want = tables.execute(f"select {', '.join(columns)} from ({catalog.ORACLES[name]})").fetchall()
        assert got == sorted(tuple(map(plain, r)) for r in want)
