"""Every query against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from weftlog.plans import catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "customer orders lineitem events conversations".split()
#: One of several that run the same operator over the same rows.
SLOW: set = set()


def plain(rows):
    return sorted(tuple("null" if v is None or v is pd.NA or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{os.path.join(SMALL, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - SLOW))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = df.select(*cols).toPandas()
    want = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(want.columns) == cols
    assert plain(got.itertuples(index=False)) == plain(want[cols].itertuples(index=False))


def test_everything_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
