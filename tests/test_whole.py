"""Queries take every row: where the registered SQL holds a cut, they equal that SQL without it."""

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.operators import models
from barloom.plans.catalog import ORACLE, QUERIES
from barloom.sources.bars import event_bars

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, cut", [("event_manifest_overlaps", " where event_id < 2000"), ("event_time_split", " where event_id < 2000"), ("ic_kendall", " and n <= 200")])
def test_query_takes_every_row(spark, name, cut):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    result = con.execute(ORACLE[name].replace(cut, ""))
    names = [d[0] for d in result.description]
    want = sorted(result.fetchall(), key=str)
    got = sorted((tuple(r[c] for c in names) for r in QUERIES[name](spark, SF).collect()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-6) if not any(isinstance(v, str) for v in a) else all(x == (pytest.approx(y, abs=2e-6) if isinstance(y, float) else y) for x, y in zip(a, b, strict=True))


def test_trees_are_fitted_on_every_labelled_bar(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "boosted", lambda d, features, label: (seen.append(d.where(F.col(label).isNotNull())), (None, [(f, 0.0) for f in features]))[1])
    QUERIES["model_boosted_trees"](spark, SF)
    bars = event_bars(spark, SF).groupBy("symbol").count().collect()
    assert seen[0].count() == sum(r["count"] - 4 for r in bars) > 5 * 400  # the last 4 bars of a symbol have no label
