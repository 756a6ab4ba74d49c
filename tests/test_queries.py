"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lattiq.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(str(x.tolist() if hasattr(x, "tolist") else x) for x in r) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
