"""Every query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quarrystone.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    pd.testing.assert_frame_equal(_ordered(got[columns]), _ordered(want[columns]), check_dtype=False, rtol=0, atol=1.1e-6)


def _ordered(df):
    """Rows in an order that doesn't depend on how either side holds numbers and nulls."""

    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return f"{float(v):024.5f}" if isinstance(v, (int, float, np.number)) else str(v)

    df = df.astype(object)
    keys = df.map(text)
    df = df.where(keys != "", None).map(lambda v: float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else v)
    return df.loc[keys.sort_values(list(keys.columns)).index].reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
