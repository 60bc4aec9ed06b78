"""Every registered query of the library against its SQL in an independent engine, at the smallest scale."""

import datetime
import decimal

import duckdb
import pytest

from quire.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    found = duckdb.connect()
    for t in TABLES:
        found.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return found


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in registry.ORACLE:
        found = con.sql(registry.ORACLE[name])
        assert sorted(found.columns) == cols
        order = [found.columns.index(c) for c in cols]
        assert rows == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
