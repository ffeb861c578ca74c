"""Every registered query of the engine against its SQL on the smallest tables, if they are there."""

import os

import duckdb
import pytest

from framealign.plans import registry

DIR = "/root/testdata/sf0.001"


def plain(v):
    return None if v is None or v != v else float(v) if type(v).__name__ in ("float", "int", "float64", "int64", "int32", "Decimal") else str(v)


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DIR):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in os.listdir(DIR):
        c.execute(f"create view {t[:-8]} as select * from read_parquet('{DIR}/{t}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    rows = registry.QUERIES[name](spark, DIR)
    got = sorted(repr([plain(r[c]) for c in sorted(rows.columns)]) for r in rows.collect())
    if name in registry.ORACLE_SQL:
        want = db.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(rows.columns)
        order = [names.index(c) for c in sorted(names)]
        assert got == sorted(repr([plain(r[k]) for k in order]) for r in want.fetchall())
