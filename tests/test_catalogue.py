"""Every query of the catalogue against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quillon.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if hasattr(x, "__len__") and not isinstance(x, str):
        return str([plain(y) for y in x])
    if isinstance(x, float):
        return None if x != x else int(x) if x == int(x) else round(x, 9)
    return plain(x.item()) if hasattr(x, "item") else x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(repr(plain(v)) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, tables, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), tables.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
