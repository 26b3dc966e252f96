"""Every query of the network engine against its SQL, on the smallest of the given tables."""

import math
import os
from collections import Counter
from decimal import Decimal

import pytest

from pipelens.plans import catalog

FOLDER = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in ("nation", "customer", "part", "orders", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)) and not isinstance(v, bool):
        return None if math.isnan(v) else float(f"{float(v):.6f}") + 0.0
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_as_its_sql(spark, connection, name):
    got = catalog.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    cursor = connection.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert rows == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
