"""Every registered core query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Puzzles and loops of many rounds, compared elsewhere or slow for their size.
ROWS_ONLY = sorted(set(catalog.QUERIES) - set(catalog.ORACLE))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def text(v):
    return "" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(text, r)) for r in df.select(*columns).collect())
    cur = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted(tuple(text(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
