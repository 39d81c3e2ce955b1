"""Every query with SQL agrees with it on the small tables."""

import math
import os

import duckdb
import pytest

from viaduct.plans import registry
from viaduct.sources.tables import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    rows = got.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    a = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
    b = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in want.fetchall()), key=repr)
    assert len(a) == len(b)
    assert a == b
