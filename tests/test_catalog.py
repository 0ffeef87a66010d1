import glob
import os

import duckdb
import pytest

from tessera.plans import catalog, connectors  # noqa: F401 - both add to catalog.QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name in catalog.ORACLES:
        got = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in got.description]
        cols = sorted(df.columns)
        assert cols == sorted(names)
        at = [names.index(c) for c in cols]
        want = sorted(repr(tuple(r[i] for i in at)) for r in got.fetchall())
        assert sorted(repr(tuple(r[c] for c in cols)) for r in rows) == want
