"""Conditions, alignment, events, backtests, storage and streams on small fixtures."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import candles, conditions
from barloom.functions import rolling as R
from barloom.operators import align, backtest, ic, labels, search
from barloom.sources import bars as B
from barloom.sources import io
from barloom.streaming import bars as stream

ROLES = {"close": "feature", "volume": "feature", "ret": "outcome"}
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("text", ["__import__('os')", "close.x > 1", "close[0] > 1", "close + 1 > 2", "lambda: 1", "ret > 0", "nope > 1", "1 < 2", "close > 1 or not close > 1", "lag(close, -1) > 0", "close"])
def test_conditions_refused(text):
    with pytest.raises(conditions.ConditionError):
        conditions.parse(text, ROLES)


def test_conditions_are_canonical():
    a = conditions.parse("close > 1 and 2 >= volume", ROLES)
    b = conditions.parse("volume <= 2 and close > 1 and close > 1", ROLES)
    assert a.digest == b.digest and a.columns == {"close", "volume"}
    assert conditions.parse("1 < close < 3", ROLES).digest == conditions.parse("close < 3 and close > 1", ROLES).digest


def test_null_comparisons_are_false(spark):
    df = spark.createDataFrame([("a", 1, 1.0, None), ("a", 2, None, 5.0), ("a", 3, 3.0, 1.0)], "symbol string, ts long, close double, volume double")
    rows = lambda text: [r.ts for r in conditions.where(df, conditions.parse(text, ROLES)).orderBy("ts").collect()]
    assert rows("close > 0") == [1, 3] and rows("not close > 2") == [1, 2]
    assert rows("isnull(volume) or lag(close, 2) == 1") == [1, 3]


def test_rolling_needs_full_frames(spark):
    df = spark.createDataFrame([("a", k, None if k == 2 else float(k)) for k in range(6)], "symbol string, ts long, x double")
    got = [(r.m, r.k) for r in df.select("ts", R.mean("x", 3).alias("m"), R.rank_pct("x", 2).alias("k")).orderBy("ts").collect()]
    assert got == [(None, None), (None, 1.0), (None, None), (None, None), (None, 1.0), (4.0, 1.0)]


def test_asof_sees_closed_bars_only(spark):
    left = spark.createDataFrame([("a", t) for t in (0, 3600, 7200, 10800, 14400, 18000)], "symbol string, ts long")
    right = spark.createDataFrame([("a", 0, 1.5), ("a", 14400, 2.5), ("b", 0, 9.0)], "symbol string, ts long, close double")
    out = align.align_timeframe(left, right, "1h", "4h", ["close"])
    assert [r["4h_close"] for r in out.orderBy("ts").collect()] == [None, None, None, None, 1.5, 1.5]
    assert align.leaks(out, "4h_ts", "4h", "1h").count() == 0
    strict = align.asof(left, right, "ts", "ts", {"close": "c"}, strict=True)
    assert [r.c for r in strict.orderBy("ts").collect()] == [None, 1.5, 1.5, 1.5, 1.5, 2.5]


def test_manifest_by_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(k, s := rng.randrange(400_000), s + rng.randrange(9000)) for k in range(200)]
    df = spark.createDataFrame([(k, "a", s, e) for k, s, e in rows], "event_id long, symbol string, start long, end long")
    got = {r.event_id: r for r in align.manifest(df, gap=600).collect()}
    for k, s, e in rows:
        assert got[k].overlaps == max(1, sum(a < e and b > s for _, a, b in rows))  # half-open; an empty interval counts itself
    reach, cluster = -1, 0
    for k, s, e in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        cluster += s > reach
        reach = max(reach, e, s + 600)
        assert got[k].cluster == cluster


def test_backtest_order_of_exits():
    s = backtest.Strategy(stop=1, reward=2, commission=0)
    flat = [10.0] * 4
    run = lambda h, low, p: backtest.simulate(flat, h, low, flat, [1.0] * 4, p, s)
    assert run([10, 13, 10, 10], [10, 8, 10, 10], [0.9, 0.5, 0.5, 0.5])[0][6] == "stop"
    assert run([10, 13, 10, 10], [10, 10, 10, 10], [0.9, 0.1, 0.5, 0.5])[0][6] == "target"
    assert run([10, 10, 10, 10], [10, 10, 10, 10], [0.9, 0.5, 0.1, 0.5])[0][1:7:5] == (2, "signal")
    assert run([10, 10, 10, 10], [10, 10, 10, 10], [0.9, 0.5, 0.5, 0.5])[0][6] == "end of data"
    assert run([99, 10, 10, 10], [0, 10, 10, 10], [0.9, 0.5, 0.5, 0.5])[0][1] == 3  # the entry bar is not an exit bar
    assert backtest.cooled([True, True, False, True, True], 2) == [True, False, False, True, False]
    assert backtest.kelly(0.6, 2, 0.5) == pytest.approx(0.2) and backtest.cost_levels(10) == [5, 10, 20, 50]


def test_trades_and_equity(spark):
    b = B.event_bars(spark, SF).withColumns({"atr": F.lit(5.0), "p": F.col("taker_ratio")})
    t = backtest.trades(b, backtest.Strategy())
    final = {r.symbol: r.e for r in backtest.equity(b, t).groupBy("symbol").agg(F.max_by("equity", "ts").alias("e")).collect()}
    want = {r.symbol: r.e for r in t.groupBy("symbol").agg(F.product(1 + F.col("gain")).alias("e")).collect()}
    assert all(final[s] == pytest.approx(want.get(s, 1.0)) for s in final)


def test_labels(spark):
    df = spark.createDataFrame([("a", k, c) for k, c in enumerate([1.0, 1.1, 1.2, 1.3, 1.4])], "symbol string, ts long, close double")
    got = [r.r for r in df.select("ts", labels.simple_return(2).alias("r")).orderBy("ts").collect()]
    assert got[:3] == pytest.approx([0.2, 1.3 / 1.1 - 1, 1.4 / 1.2 - 1]) and got[3:] == [None, None]
    assert labels.horizon_bars("12h", "1h") == 12
    for bad in ("5m", "x"):
        with pytest.raises(ValueError):
            labels.horizon_bars(bad, "1h")
    with pytest.raises(ValueError):
        labels.winsorized_return()


def test_kendall_with_ties(spark):
    rows = [("a", float(x), float(y)) for x, y in [(1, 1), (2, 2), (2, 3), (3, 1), (4, 4), (4, 4)]]
    got = ic.kendall(spark.createDataFrame(rows, "symbol string, x double, y double"), "x", "y", ["symbol"]).first()
    s = lambda v: (v > 0) - (v < 0)
    pairs = [(s(a[1] - b[1]), s(a[2] - b[2])) for i, a in enumerate(rows) for b in rows[:i]]
    want = sum(x * y for x, y in pairs) / (sum(x * x for x, _ in pairs) * sum(y * y for _, y in pairs)) ** 0.5
    assert got.ic == pytest.approx(want) and got.n == 6


def test_search_sample_is_stable(spark):
    b = B.event_bars(spark, SF)
    spec = search.Search([("price_change", ">", 0)], sample_limit=5)
    assert [r.case_id for r in search.search(b, spec).collect()] == [r.case_id for r in search.search(b.repartition(3), spec).collect()]
    with pytest.raises(conditions.ConditionError):
        conditions.triples([("close", "between", (2, 1))])


def test_bar_storage(spark, tmp_path):
    b = B.event_bars(spark, SF)
    path = str(tmp_path / "bars")
    B.write_bars(b, path, "1h")
    back = B.read_bars(spark, path, "1h", ["view"])
    assert back.count() == b.where("symbol = 'view'").count()
    B.write_bars(b.where("symbol = 'view'").limit(3), path, "1h")
    assert B.read_bars(spark, path, "1h", ["view"]).count() == 3
    assert B.read_bars(spark, path, "1h").where("symbol != 'view'").count() == b.where("symbol != 'view'").count()
    k = spark.createDataFrame([("x", ["3600000", "1", "3", "0.5", "2", "10", "0", "20", "4", "6", "0", "0"])], "symbol string, kline array<string>")
    row = B.from_klines(k).first()
    assert (row.ts, row.high, row.taker_ratio, row.trades) == (3600, 3.0, 0.6, 4)
    bad = spark.createDataFrame([("x", 0, 1.0, 0.5, 2.0, 1.0, -1.0, 0.0, 0.5)], "symbol string, ts long, open double, high double, low double, close double, volume double, taker_buy_volume double, taker_ratio double")
    assert set(B.bar_faults(bad).first().faults) == {"low", "high", "volume"}


def test_tables_and_ledger(spark, tmp_path):
    df = spark.createDataFrame([(1, (2, 3), [1, 2])], "id int, s struct<a:int,b:int>, v array<int>")
    assert io.flat(df).columns == ["id", "s_a", "s_b", "v"]
    for kind in ("csv", "json", "parquet"):
        io.write(df, f"{tmp_path}/t.{kind}")
        assert io.read(spark, f"{tmp_path}/t.{kind}").count() == 1
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("v", T.DoubleType())])
    path = f"{tmp_path}/ledger"
    for k in range(2):
        io.append_ledger(spark.createDataFrame([(k, 1.0)], "id long, v double"), path, schema)
    assert io.read_ledger(spark, path, schema).count() == 2
    with pytest.raises(ValueError):
        io.append_ledger(spark.createDataFrame([(1.0,)], "v double"), path, schema)
    (tmp_path / "ledger" / "part-bad.json").write_text('{"id": "x"}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_ledger(spark, path, schema).collect()
    runs = spark.createDataFrame([("s", k, k, None if k % 2 else "named", None) for k in range(6)], "symbol string, run_id int, created_at int, alias string, last_generated_at int")
    assert io.latest_run(runs, ["symbol"]).first().run_id == 5 and [r.run_id for r in io.surplus_runs(runs, ["symbol"], 2).collect()] == [1]
    assert {(r.run_id, r.only_in) for r in io.orphans(runs.select("run_id").where("run_id < 4"), runs.select("run_id").where("run_id > 0"), ["run_id"]).collect()} == {(0, "registered"), (4, "found"), (5, "found")}
    up = io.upsert(runs.select("run_id", "alias"), spark.createDataFrame([(0, "new"), (9, "more")], "run_id int, alias string"), ["run_id"])
    assert up.count() == 7 and up.where("run_id = 0").first().alias == "new"


def test_patterns_on_made_candles(spark):
    rows = [("a", k, 10.0, 11.1, 9.9, 11.0) for k in range(12)]
    rows += [("a", 12, 11.0, 11.05, 9.95, 10.0), ("a", 13, 9.9, 11.3, 9.85, 11.2), ("a", 14, 11.0, 11.5, 10.5, 11.0)]
    df = spark.createDataFrame(rows, "symbol string, ts long, open double, high double, low double, close double")
    got = {r.ts: r for r in candles.add_patterns(df).collect()}
    assert len(df.columns) == 6 and len(got[0].asDict()) == 63
    assert got[13].CDLENGULFING == 100 and got[14].CDLDOJI == 100 and got[13].CDLDOJI == 0 and got[0].CDLDOJI == 0


def test_stream_bars_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream.stream_bars(source, late="60 days").writeStream.outputMode("update").foreachBatch(lambda d, k: d.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("symbol", "ts").agg(F.max("trades").alias("trades"), F.max("high").alias("high"), F.min("low").alias("low"))
    want = B.event_bars(spark, SF).select("symbol", F.timestamp_seconds("ts").alias("ts"), "trades", "high", "low")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
