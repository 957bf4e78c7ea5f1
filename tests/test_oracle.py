"""Every query against its SQL in DuckDB, on the smallest tables; skipped where they are not there."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from quirefold.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.is_dir():
        pytest.skip("no test tables")
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def test_entry(spark):
    if not DATA.is_dir():
        pytest.skip("no test tables")
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows(spark, con, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    result = con.execute(catalogue.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    if not DATA.is_dir():
        pytest.skip("no test tables")
    df = catalogue.QUERIES[name](spark, str(DATA))
    assert df.count() > 0
