"""Queries over events whose values are 0 at times, against their DuckDB text."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.operators import signals
from barloom.plans.catalog import ORACLE, QUERIES

ZEROS = {40: [0.0, 3.0, 2.0], 71: [4.0, 0.0, 5.0], 100: [6.0, 1.0, 0.0], 131: [0.0, 0.0, 0.0], 132: [2.0, 2.0, 2.0]}
"""Values of hours that begin, dip, end and stay at 0."""


OPENS = {h: [0.0, 3.0 + h % 5, 2.0 + h % 3] for h in [0, 1, 3, 6, 40, 41, 42, 43, 44, 45, 46, 47, 100]}
"""Hours that begin at 0 and move: for the signals' SQL, which has no result for hours that stay there."""


def events(path, odd_hours):
    rows = [(h, k, v) for h in range(200) for k, v in enumerate(odd_hours.get(h, [1 + (h * 7 + k * 5) % 13 / 4 for k in range(3)]))]
    duckdb.execute("create or replace table odd_events (h int, k int, value double)")
    duckdb.executemany("insert into odd_events values (?, ?, ?)", rows)
    duckdb.execute(f"copy (select cast(h * 3 + k as bigint) as event_id, timestamp '2024-01-01' + to_minutes(h * 60 + k * 10) as ts, cast(k % 2 as bigint) as user_id, 'view' as event_type, value from odd_events) to '{path}/events.parquet'")
    return str(path)


def plain(v):
    return "nan" if v != v else float(f"{v:.6g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["micro_cs_spread", "vol_garman_klass", "vol_parkinson", "signal_class", "bars_validation"])
def test_query_equals_oracle_with_prices_of_zero(spark, tmp_path, name):
    odd = events(tmp_path, OPENS if name == "signal_class" else ZEROS)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{odd}/events.parquet'")
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    want = Counter(tuple(map(plain, r)) for r in result.fetchall())
    assert Counter(tuple(plain(r[c]) for c in names) for r in QUERIES[name](spark, odd).collect()) == want


def test_trimmed_deviation_works_each_value_out_once(spark):
    """Nested lambdas repeated the sort for every element: minutes for a few hundred bars."""
    plan = spark.range(1).select(F.array(F.col("id") * 1.0, F.lit(2.0)).alias("v")).select(signals.trimmed_std(F.col("v")).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_sort(") == 1
