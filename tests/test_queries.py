"""Queries against their SQL on the smallest tables, where these are at hand."""

import os

import duckdb
import pytest

from pagewright.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows):
    return sorted((tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(tuple(r[c] for c in columns) for r in df.collect())
    if name in catalogue.ORACLE:
        found = db.sql(catalogue.ORACLE[name])
        assert sorted(found.columns) == columns
        rows = found.fetchall()
        at = [found.columns.index(c) for c in columns]
        assert got == plain(tuple(r[i] for i in at) for r in rows)
