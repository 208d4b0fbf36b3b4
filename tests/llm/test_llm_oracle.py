"""Queries that SQL can express, against DuckDB on a small table."""

import duckdb
import pytest

from barloom.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    want = sorted((tuple(r) for r in result.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == want
    assert sorted(names) == sorted(df.columns)
