"""The queries that SQL can express against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from quarrystone.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = duck.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda row: tuple(list(v) if isinstance(v, (list, tuple)) else v for v in row)
    rows = sorted(map(plain, want.project(", ".join(columns)).fetchall()), key=str)
    assert sorted(map(plain, map(tuple, got.select(columns).collect())), key=str) == rows and len(rows) == 200
