"""Every query with SQL gives the same rows as DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from worklens.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.ORACLES)[:: int(os.environ.get("ORACLE_STEP", "1"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rel = duck.sql(catalog.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(x) for x in cols]
    assert sorted(repr(tuple(plain(r[k]) for k in cols)) for r in df.collect()) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
