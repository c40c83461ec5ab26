"""Every ledger query against its SQL in DuckDB, and rules that the tables don't exercise."""

import duckdb
import pytest
from slotframe import catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, list):
        return tuple(v)
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name not in catalog.SQL:
        assert got, name
        return
    r = con.execute(catalog.SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
