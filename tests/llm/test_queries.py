"""The registered queries of this subpackage against their SQL, and those without SQL for shape."""

import glob
import os

import duckdb
import pytest

from tessera.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple("" if v is None else str(v) for v in r) for r in df.select(*columns).collect())
    assert got
    if name in catalog.ORACLE:
        cur = duck.execute(catalog.ORACLE[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        assert got == sorted(tuple("" if r[names.index(c)] is None else str(r[names.index(c)]) for c in columns) for r in cur.fetchall())


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 11))
