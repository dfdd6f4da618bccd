"""Every core query against its SQL on the smallest test data."""

import os

import pytest

from lineweave import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_agrees_with_sql(spark, db, name):
    got = core.queries()[name](spark, SF)
    columns = sorted(got.columns)
    db.execute(core.oracle_sql()[name])
    names = [d[0] for d in db.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(([plain(r[i]) for i in at] for r in db.fetchall()), key=str)
    assert sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert core.queries()[name](spark, SF).count() > 0


def test_flagship_runs(spark):
    assert core.flagship(spark, SF).count() > 0
