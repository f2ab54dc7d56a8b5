"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from calypile.plans import files, problems, reports
from tools.compare import rows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
SQL = problems.SQL | reports.SQL | files.SQL
QUERIES = problems.QUERIES | reports.QUERIES | files.QUERIES


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in sorted(os.listdir(DATA)):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA)
    mine = rows(got.columns, got.collect())
    if name in SQL:
        want = db.execute(SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert mine == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_p4_names_each_heavy_chr_once(spark):
    got = QUERIES["p4_found"](spark, DATA).collect()
    assert len(got) == len(set(got))


def test_nothing_outside_llm_imports_it():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "calypile"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "calypile.llm" not in path.read_text()
