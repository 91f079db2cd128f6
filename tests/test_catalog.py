"""Every catalogued query against its oracle SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from loomspark.plans.catalog import load

CATALOG = load()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows, columns, order):
    return sorted(tuple(repr(r[columns.index(c)] + 0.0 if isinstance(r[columns.index(c)], float) else r[columns.index(c)]) for c in order) for r in rows)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, sf, duck, name):
    df = CATALOG[name].run(spark, sf)
    got = [tuple(r) for r in df.collect()]
    if CATALOG[name].oracle is None:
        assert got
        return
    found = duck.execute(CATALOG[name].oracle)
    columns, kinds = [c[0] for c in found.description], [str(c[1]) for c in found.description]
    order = sorted(columns)
    assert order == sorted(df.columns)
    assert plain(got, df.columns, order) == plain(found.fetchall(), columns, order)
    for c, kind in df.dtypes:
        assert TYPES.get(kind, kinds[columns.index(c)]) == kinds[columns.index(c)], c
