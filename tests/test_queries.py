"""Every query of the core against its SQL in DuckDB on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from lodestrata.plans import queries as core

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    return round(float(v), 9) if isinstance(v, (int, float, np.number)) else v


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(repr([plain(v) for v in row]) for row in frame[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got, want = core.QUERIES[name](spark, DATA).toPandas(), duck.sql(core.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_registry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
