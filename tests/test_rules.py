"""Rules worked by hand or by plain loops: counters, trades, weights, volume imbalance, differencing, ranges, plans."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import names
from barloom.functions import rolling as R
from barloom.operators import align, backtest, evaluate, events, marginal, pit, preprocess, registry, reports, signals, splits, weights
from barloom.operators import recursive as K
from barloom.sources import bars as B
from barloom.sources import features, providers

SF = "/root/testdata/sf0.001"


def series(spark, **columns):
    n = len(next(iter(columns.values())))
    return spark.createDataFrame([("a", k, *(None if v[k] is None else float(v[k]) for v in columns.values())) for k in range(n)], ", ".join(["symbol string, ts long", *(f"{c} double" for c in columns)]))


def column(df, c):
    return [r.x for r in df.select("ts", c.alias("x")).orderBy("ts").collect()]


def test_crosses_by_hand(spark):
    df = series(spark, a=[1, 4, 2, 5, 3, 3, None, 1, 6], b=[3] * 9)  # differences: - + - + 0 0 null - +
    cross = R.crosses("a", "b")
    assert column(df, cross) == [False, True, True, True, False, False, False, False, True]
    df = df.withColumn("_x", cross)
    assert column(df, R.bars_since(F.col("_x"), 2)) == [None, None, 0, 0, 1, None, None, None, 0]
    assert column(df, R.count_in(F.col("_x"), 2)) == [None, None, 2, 2, 1, 0, 0, 0, 1]


def test_state_counters_by_hand(spark):
    from barloom.functions import indicators as I

    close = [10, 10, 11, 12, 11, 10, 9, 9, 10, 11, 12, 13]
    out = I.add(series(spark, open=close, high=close, low=close, close=close, volume=close), I.state_counters(3, 1, 2, 11.0)).orderBy("ts").collect()
    assert [r.consecutive_run for r in out] == [None, None, 1, 2, 1, 2, 3, None, 1, 2, 3, 3]
    assert [r.bars_since_threshold for r in out] == [None, None, None, 1, 2, None, None, None, None, 0, 1, 2]
    assert registry.counter_metadata("cross_count", 5)["warmup"] == 5 and registry.counter_metadata("consecutive_run", 5)["warmup"] == 4


def test_trades_by_hand():
    s = backtest.Strategy(entry=0.5, exit=0.4, commission=0.0, slippage=0.0, trail=None)
    flat = [10.0] * 6
    # No ATR on the entry bar: no stops; the next entry is not on the bar of the exit.
    rows = backtest.simulate(flat, [10, 99, 99, 10, 10, 10], [10, 1, 1, 10, 10, 10], flat, [None, 1, 1, 1, 1, 1], [0.9, 0.9, 0.1, 0.9, 0.9, 0.9], s)
    assert [(r[0], r[1], r[6]) for r in rows] == [(0, 2, "signal"), (3, 5, "end of data")]
    # A trade opened on the last bar ends there.
    assert [(r[0], r[1], r[6]) for r in backtest.simulate(flat, flat, flat, flat, [1.0] * 6, [0.1] * 5 + [0.9], s)] == [(5, 5, "end of data")]
    # The trailing stop follows the high at the current bar's ATR, and only rises.
    t = backtest.Strategy(entry=0.5, exit=0.0, stop=50, reward=50, trail=1.0, commission=0.0, slippage=0.0)
    c = [10.0, 12.0, 13.0, 12.5, 12.4]
    rows = backtest.simulate(c, [10, 12, 14, 13, 13], [10, 11.7, 13, 12.6, 12.0], c, [1, 0.4, 1.0, 0.2, 3.0], [0.9, 0.5, 0.5, 0.5, 0.5], t)
    assert (rows[0][1], rows[0][3], rows[0][6]) == (2, 13.0, "trailing")  # 14 - 1, reached by the low of the same bar
    assert rows[0][7] == pytest.approx(0.1 * 0.3) and rows[0][8] == pytest.approx(0.0) and rows[0][9] == pytest.approx(0.4)
    assert backtest.position_size(backtest.Strategy(sizer="kelly"), 0.8) == pytest.approx(0.25) and backtest.position_size(backtest.Strategy(sizer="scaled"), 0.6) == pytest.approx(0.05)


def test_trade_metrics_by_hand(spark):
    t = spark.createDataFrame([("a", 0.1, 1.0), ("a", -0.2, -4.0), ("a", 0.0, 0.0), ("a", 0.3, 2.0), ("b", 0.1, 1.0)], "symbol string, gain double, pnl double")
    a, b = backtest.trade_metrics(t).orderBy("symbol").collect()
    assert (a.win_rate, a.avg_win, a.avg_loss, a.profit_factor) == (0.5, 1.5, -4.0, 0.75) and a.expectancy == pytest.approx(0.5 * 1.5 - 0.5 * 4)
    assert (b.avg_loss, b.profit_factor, b.sqn) == (0.0, 0.0, 0.0)


def test_sample_weights_by_hand(spark):
    df = spark.createDataFrame([("a", d * 86400, y, r) for d, y, r in [(0, 0, 0.1), (10, 0, -0.4), (20, 0, 0.0), (20, 1, 0.5)]] + [("b", 0, 1, 0.0)], "symbol string, ts long, y int, r double")
    d = df.withColumns({"t": weights.time_decay("ts", 10.0), "lin": weights.time_decay("ts", kind="linear"), "p": weights.by_return("r", "positive"), "s": weights.by_return("r", "squared")})
    d = weights.class_balance(weights.class_balance(weights.class_balance(d, "y", "w"), "y", "q", "sqrt"), "y", "c", "custom", 5.0)
    rows = d.orderBy("symbol", "ts", "y").collect()
    raw = {"t": [0.25, 0.5, 1, 1], "lin": [0.01, 0.5, 1, 1], "p": [0.1, 0.2, 0.01, 0.5], "s": [0.01, 0.16, 0.01, 0.25], "w": [4 / 6, 4 / 6, 4 / 6, 2], "q": [math.sqrt(4 / 3)] * 3 + [2], "c": [1, 1, 1, 5]}
    for name, want in raw.items():
        assert [getattr(r, name) for r in rows[:4]] == pytest.approx([v / np.mean(want) for v in want]), name
        assert getattr(rows[4], name) == 1.0
    rng = random.Random(2)
    spans = [(a := rng.randrange(40), a + rng.randrange(9)) for _ in range(30)]
    base = spark.createDataFrame([("a", k) for k in range(45)], "symbol string, n long")
    got = weights.uniqueness(base, spark.createDataFrame([("a", x, y) for x, y in spans], "symbol string, start long, end long"), "n", "u").orderBy("n").collect()
    want = [1 / max(1, sum(a <= k < b for a, b in spans)) for k in range(45)]
    assert [r.u for r in got] == pytest.approx([v / np.mean(want) for v in want])
    both = d.withColumns({"m": weights.combined(["t", "w"]), "add": weights.combined(["t", "w"], "additive", [3, 1])}).where("symbol = 'a'").collect()
    assert np.mean([r.m for r in both]) == pytest.approx(1) and both[0]["add"] / both[1]["add"] == pytest.approx((3 * both[0].t + both[0].w) / (3 * both[1].t + both[1].w))


def test_volume_imbalance_by_a_plain_loop():
    rng = np.random.default_rng(4)
    close, volume = 100 + np.cumsum(rng.normal(size=140)), rng.integers(1, 50, 140).astype(float)
    close[100:104] = close[100]
    got = K.vpin(close, volume)
    d = np.concatenate([[0], np.diff(close)])
    gap = np.empty(140)
    for i in range(140):
        s = np.std(d[i - 49 : i + 1], ddof=1) if i >= 49 else 0.0
        share = 0.5 * (1 + math.erf(d[i] / s / math.sqrt(2))) if s else 0.5
        gap[i] = abs(2 * share - 1) * volume[i]
    for n in (30, 50):
        want = [gap[i - n + 1 : i + 1].sum() / volume[i - n + 1 : i + 1].sum() if i >= n - 1 else np.nan for i in range(140)]
        assert np.allclose(got[f"vpin_{n}"], want, equal_nan=True)
    v = got["vpin_30"]
    assert got["vpin_zscore_21"][139] == pytest.approx((v[139] - v[119:140].mean()) / v[119:140].std(ddof=1))
    assert (np.nan_to_num(K.vpin(np.full(60, 5.0), volume[:60])["vpin_30"]) == 0).all()


def test_fractional_difference_by_a_plain_loop():
    x = np.cumsum(np.random.default_rng(5).normal(size=300))
    w = K.fracdiff_weights(0.7, 1e-3)
    assert abs(w[-1]) >= 1e-3 and len(K.fracdiff_weights(0.7)) > len(w) and len(K.fracdiff_weights(0.4, most=50)) == 50
    want = [np.nan if i < len(w) - 1 else sum(w[k] * x[i - k] for k in range(len(w))) for i in range(300)]
    assert np.allclose(K.fracdiff(x, 0.7, 1e-3), want, equal_nan=True)
    assert np.isnan(K.fracdiff(x[: len(w) - 1], 0.7, 1e-3)).all()
    white = np.random.default_rng(6).normal(size=400)
    assert K.adf_pvalue(white) < 1e-6 < 0.2 < K.adf_pvalue(np.cumsum(white)) and K.adf_pvalue(white[:10]) == 1.0
    assert K.least_difference(white, most=50) < 0.05


def test_positions_by_quantile_cut(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=160), 1)
    x[5], x[70] = np.nan, np.nan
    df = series(spark, x=[None if v != v else v for v in x])
    got = [r.position for r in pit.positions(df, "x", 5, 30).orderBy("ts").collect()]
    seen, want = [], []
    for v in x:
        if v != v:
            want.append(0.0)
            continue
        seen.append(v)
        q = min(5, len(set(seen)))
        if len(seen) <= 30 or q < 2:
            want.append(0.0)
            continue
        label = pd.qcut(pd.Series(seen), q, labels=False, duplicates="drop").iloc[-1]
        want.append(1.0 if label == q - 1 else -1.0 if label == 0 else 0.0)
    assert got == want


def test_around_by_a_plain_search(spark):
    rng = random.Random(3)
    times = sorted(rng.sample(range(1000), 40))
    b = spark.createDataFrame([("a", t, float(t)) for t in times], "symbol string, ts long, close double")
    centres = [0.0, 999.5, -20.0, 2000.0, *(float(rng.randrange(1000) + rng.choice([0, 0.5])) for _ in range(30))]
    got = B.around(b, spark.createDataFrame([("a", c) for c in centres], "symbol string, centre double"), 2, 3).collect()
    by = {}
    for r in got:
        by.setdefault(r.centre, []).append((r.offset, r.ts))
    for c in set(centres):
        mid = min(range(40), key=lambda k: (abs(times[k] - c), times[k]))
        assert sorted(by[c]) == [(o, times[mid + o]) for o in range(-2, 4) if 0 <= mid + o < 40]


def test_kolmogorov_by_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(float(rng.choice(range(50)) + 10 * p), p) for p in (0, 1) for _ in range(150 + 40 * p)]
    got = evaluate.kolmogorov(spark.createDataFrame(rows, "x double, part int"), "x", "part", 7).first()
    a, b = ([v for v, p in rows if p == k] for k in (0, 1))
    assert got.ks == pytest.approx(max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v, _ in rows)) and (got.n0, got.n1) == (len(a), len(b))


def test_normal_scores_and_marginal_coefficients():
    rng = np.random.default_rng(8)
    n = 400
    s = rng.normal(size=(n, 2))
    y = s[:, 0] + 0.5 * rng.normal(size=n)
    copy, fresh = s[:, 0] + 1e-6 * rng.normal(size=n), y + rng.normal(size=n)
    train, test = np.arange(n) < 250, np.arange(n) >= 250
    z = marginal.normal_scores(np.array([3.0, 1.0, 2.0]))
    assert z[2] == pytest.approx(0) and z[0] == pytest.approx(-z[1]) == pytest.approx(0.67448975)
    cfg = marginal.Settings(draws=50)
    gone, new = marginal.added(copy, s, y, train, test, cfg), marginal.added(fresh, s, y, train, test, cfg)
    assert gone["status"] in ("residual_degenerate", "ok") and new["marginal_ic"] > 0.1 and new["low"] <= new["marginal_ic"] <= new["high"]
    basis = np.column_stack([np.ones(250), *(marginal.normal_scores(s[train, j]) for j in range(2))])
    beta = np.linalg.pinv(basis) @ marginal.normal_scores(fresh[train])
    rest = marginal.normal_scores(fresh[test]) - np.column_stack([np.ones(150), *(marginal.normal_scores(s[test, j]) for j in range(2))]) @ beta
    assert new["marginal_ic"] == pytest.approx(pd.Series(rest).rank().corr(pd.Series(y[test]).rank()))
    assert marginal.added(fresh, s, y, np.arange(n) < 5, test, cfg)["status"] == "insufficient_rows"


def test_combined_factors(spark):
    rng = np.random.default_rng(9)
    y = rng.normal(size=200)
    rows = [("a", k, float(y[k] + rng.normal()), float(-y[k] + rng.normal()), 1.0, float(y[k]), k < 120, k >= 120) for k in range(200)]
    df = spark.createDataFrame(rows, "symbol string, ts long, p double, q double, flat double, y double, train boolean, test boolean")
    r = marginal.combine(df, ["p", "q", "flat"], "y", "train", "test", marginal.Settings(draws=20)).first()
    assert r.status == "ok" and set(r.weights) == {"p", "q"} and r.weights["q"] == -0.5 and r.composite_ic > max(abs(r.top_single_ic), 0.5) and r.low <= r.delta <= r.high


def test_splits_as_tables(spark):
    df = spark.createDataFrame([(s, k) for s, n in (("a", 100), ("b", 60)) for k in range(n)], "symbol string, ts long")
    plan = splits.plan_table(df, lambda n: splits.combinatorial(n, 4, 2, 2, 3))
    for s, n in (("a", 100), ("b", 60)):
        want = splits.combinatorial(n, 4, 2, 2, 3)
        for fold, (train, test) in enumerate(want):
            rows = plan.where((F.col("symbol") == s) & (F.col("fold") == fold)).collect()
            assert sorted((r.start, r.end) for r in rows if r.part == "train") == sorted(train) and sorted((r.start, r.end) for r in rows if r.part == "test") == sorted(test)
    got = {(r.symbol, r.ts): r.part for r in splits.parts_of(df, plan, 0).collect()}
    train, test = splits.combinatorial(60, 4, 2, 2, 3)[0]
    inside = lambda k, rs: any(a <= k < b for a, b in rs)
    assert all(got["b", k] == ("train" if inside(k, train) else "test" if inside(k, test) else None) for k in range(60))
    with pytest.raises(ValueError):
        splits.plan_table(df, lambda n: [], None)
    with pytest.raises(ValueError):
        splits.plan_table(df, lambda n: [((0, 1), (1, 2))], {"a"})


def test_events_and_counterexamples(spark):
    close = [10, 10, 12, 11, 13, 13, 9, 9, 10, 10]
    b = spark.createDataFrame([("a", k * 3600, 10.0, 14.0, 8.0, float(c), 1.0) for k, c in enumerate(close)], "symbol string, ts long, open double, high double, low double, close double, volume double")
    rules = [events.LabelRule("r", 2, 0.05)]
    made = events.generate(b, F.col("close") > 9.5, rules, "1h", primary=False).orderBy("t0").collect()
    want = [(k, int(close[k + 2] / close[k] - 1 >= 0.05)) for k in range(8) if close[k] > 9.5]
    assert [(r.t0 // 3600, r.label) for r in made] == want and made[0].event_id == "a:1h:0:r"
    first = events.generate(b, F.col("close") > 9.5, rules, "1h").orderBy("t0").collect()
    assert [r.t0 // 3600 for r in first] == [0]  # the windows of all hang together
    with pytest.raises(ValueError):
        events.generate(b, F.lit(True), [*rules, *rules], "1h")
    e = spark.createDataFrame([("e1", "a", 7200, 1, 2, 0, None), ("e2", "a", 21600, 1, 2, 0, "c_drop"), ("e3", "a", 0, 1, 2, 0, None), ("e4", "a", 99, 1, 2, 0, None), ("e5", "a", 0, 1, 2, 1, None)], "event_id string, symbol string, t0 long, direction int, horizon int, label int, kind string")
    got = {r.event_id: (r.kind_effective, r.kind_source, r.suggested_kind) for r in events.counterexamples(e, b, follow=0.1).collect()}
    assert got == {"e1": ("a_trigger_no_follow", "platform_auto", None), "e2": ("c_drop", "user", None), "e3": ("b_range", "platform_auto", None), "e4": ("unclassifiable", "platform_auto", None)}
    assert events.provenance(rules, 1, "x")["digest"] != events.provenance(rules, -1, "x")["digest"]


def test_imports_collect_every_failure(spark):
    good = {"row": 0, "event_id": "a", "symbol": "s", "timeframe": "1h", "t0": 1_700_000_000_000, "direction": "long", "entry_price_semantic": "next_open", "scenario": "C", "label": 1, "label_definition": {"rule_id": "r", "canonical_digest": "d"}, "control_kind": "condition", "source_file_digest": "ab" * 32}
    schema = "row long, event_id string, symbol string, timeframe string, t0 long, direction string, entry_price_semantic string, scenario string, label int, label_definition map<string,string>, control_kind string, source_file_digest string"
    table = lambda *rows: spark.createDataFrame([tuple((good | r)[c.split()[0]] for c in schema.replace("map<string,string>", "map").split(", ")) for r in rows], schema)
    fine = table({}, {"row": 1, "event_id": "b", "label": 0})
    assert events.import_failures(fine).collect() == [] and events.checked_import(fine).first().decision_offset_bars == 0
    with pytest.raises(events.ImportErrors) as e:
        events.checked_import(table({"t0": 1_700_000_000}, {"row": 1, "direction": "up", "symbol": None, "label": 3}, {"row": 2, "event_id": "b", "label_definition": {"rule_id": ""}, "direction": "short"}), b"x")
    found = {(f[0], f[2], f[3]) for f in e.value.failures}
    assert found >= {(0, "t0", "invalid_timestamp_unit"), (1, "direction", "enum_violation"), (1, "symbol", "missing_required_field"), (1, "label", "enum_violation"), (2, "label_definition.rule_id", "missing_required_field"), (0, "source_file_digest", "digest_mismatch"), (None, "event_id", "duplicate_event_id"), (None, "direction", "direction_mixed_in_batch"), (None, "label", "missing_control_group")}
    assert {f.reason for f in events.import_failures(fine.limit(0)).collect()} == {"empty_import"}
    with pytest.raises(ValueError):
        events.return_series(spark.createDataFrame([("zz",)], "event_id string"), align.align_events(fine.selectExpr("event_id", "symbol", "1L as t0", "1 as direction"), B.event_bars(spark, SF), "1h"))


def test_feature_store(spark, tmp_path):
    base = str(tmp_path)
    df = spark.createDataFrame([(s, k, float(k), 2.0 * k, None) for s in "ab" for k in range(5)], "symbol string, ts long, x double, y double, z double")
    groups = {"one": ["x"], "two": ["y", "z"]}
    m = features.write_run(df, base, "a", "1h", "h1", groups)
    features.write_run(df, base, "b", "1h", "h2", groups, status="partial")
    assert features.list_features(features.load_manifest(spark, base, "a", "1h", "h1", strict=True)) == ["x", "y", "z"] and m["rows"] == 5
    assert [(g, t.columns) for g, t in features.groups(spark, base, "a", "1h", "h1")] == [("one", ["symbol", "ts", "x"]), ("two", ["symbol", "ts", "y", "z"])]
    got = features.load_columns(spark, base, "a", "1h", "h1", ["y", "x"])
    assert got.columns == ["symbol", "ts", "y", "x"] and features.checked_rows(got, m).count() == 5
    assert features.load_many(spark, base, {"a": "h1", "b": "h2"}, "1h", ["x"]).count() == 10
    for bad in (lambda: features.load_many(spark, base, {"a": "h1", "b": "h2"}, "1h", for_training=True), lambda: features.load_columns(spark, base, "a", "1h", "h1", ["q"]), lambda: features.run_dir(base, "..", "1h", "h"), lambda: features.checked_rows(got.limit(2), m)):
        with pytest.raises((features.NotConsumable, KeyError, ValueError)):
            bad()
    assert features.load_many(spark, base, {"b": "h2"}, "1h", for_training=True, allow_partial=True).count() == 5
    assert features.consumable("complete") and not features.consumable("unknown", True)


def test_providers(spark, tmp_path):
    b = B.event_bars(spark, SF).withColumn("timeframe", F.lit("1h"))
    b.write.parquet(f"{tmp_path}/bars")
    known = providers.Providers()
    known.register("landed", providers.landed(f"{tmp_path}/bars"))
    t0, t1 = b.agg(F.min("ts"), F.max("ts")).first()
    out, failed = providers.ingest(known, "landed", spark, ["view", "click"], t0, t1, "1h")
    assert out.count() == b.where("symbol in ('view', 'click')").count() and failed == []
    assert providers.ingest(known, "nowhere", spark, ["view"], t0, t1, "1h")[1][0][0] == "view"
    assert list(providers.pages(0, 3600 * 5, "1h", 2)) == [(0, 3600), (7200, 10800), (14400, 18000)]
    assert providers.missing_ranges((10, 20), 5, 30, 1) == [(5, 9), (21, 30)] and providers.missing_ranges((10, 20), 12, 15, 1) == [] and providers.missing_ranges(None, 1, 2, 1) == [(1, 2)]
    kinds = [providers.read_through(c, known.known["landed"], spark, "view", t0, t1, "1h")[1] for c in (b, b.where("ts < 0"), b.where(F.col("ts") < t0 + 40000))]
    assert kinds == ["hit" if b.where("symbol = 'view'").agg(F.min("ts")).first()[0] == t0 and b.where("symbol = 'view'").agg(F.max("ts")).first()[0] == t1 else "partial", "miss", "partial"]
    now = [0.0]
    limit = providers.RateLimit(2, 4, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert [limit.acquire(3), limit.acquire(1), limit.acquire(2)] == [0, 0, 1.0]
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise providers.Transient("again")
        return "done"

    assert providers.with_retries(call, sleep=lambda s: None) == "done"
    with pytest.raises(KeyError):
        providers.with_retries(lambda: {}["x"], sleep=lambda s: None)
    assert providers.stale(None, 5, 1) and not providers.stale(5, 5, 1)


def test_names():
    assert names.skips_unit_root("close_1h_momentum_RSI_14") and not names.skips_unit_root("close_1h_momentum_RSI_14", never=("RSI",)) and not names.skips_unit_root("x_SMA_5")
    assert names.blacklisted(["CDL_PATTERN_ALL", "HT_DCPHASE"], ["a_CDLDOJI", "a_HT_DCPHASE", "b"]) == {"a_CDLDOJI", "a_HT_DCPHASE"}
    assert names.selected(["a_1", "b_1", "a_2"], ["a_*"], ["*_2"]) == ["a_1"] and names.shared([["a", "b"], ["b"]]) == ["b"]
    with pytest.raises(ValueError):
        names.shared([["a"], ["b"]])
    assert names.feature_name("close_1h", "momentum", "RSI", {"n": 14}) == "close-1h_momentum_RSI_14"
    assert names.stable_json({"b": np.float64(1), "a": [np.nan, (1, 2)]}) == '{"a":[null,[1,2]],"b":1.0}' and names.merged({"a": {"x": 1}}, {"a": {"y": 2}}, None) == {"a": {"x": 1, "y": 2}}
    assert names.combinations("macd") == [{"fastperiod": 12, "slowperiod": 26, "signalperiod": 9}] and names.combinations("MACD", [(1, 2, 3), (1,)]) == [{"fastperiod": 1, "slowperiod": 2, "signalperiod": 3}]
    assert names.most_warmup([("SMA", 20, "1h"), ("EMA", 10, "4h")], "1h") == 160 and names.ingest_start(10**6, [("SMA", 20, "1h")], "1h") == 10**6 - 22 * 3600
    assert names.time_column(["x", "Timestamp"]) == "Timestamp" and names.available_years(8760, "1h") == 1


def test_reports(spark):
    df = series(spark, x=[None, None, 1, 2, 3], c=[1, 1, 1, 1, 1], y=[1, 2, 3, 4, 5])
    got = [tuple(r) for r in reports.quality_alerts(df, ["x", "c", "y"]).collect()]
    assert got == [("warning", "x", "NaN ratio 40.00% exceeds 10% threshold"), ("warning", "c", "Constant feature detected"), ("info", "x", "Warmup detected: first 2 rows are NaN")]
    t = spark.createDataFrame([(k, float(k), "complete", k) for k in range(8)], "trial int, value double, state string, n_cases int")
    assert [r.trial for r in reports.recommend(t, least_cases=3, most=2).collect()] == [7, 6] and [r.trial for r in reports.recommend(t, least_value=99.0).collect()] == [7]
    assert reports.importance(t.withColumn("p", F.col("trial")), ["p"], 8).first().share > 0.9
    with pytest.raises(ValueError):
        reports.heatmap(t.limit(3), "trial", "value")
    assert reports.least_years(1, 1.0) == 0 and reports.most_trials(2, 1.0) == 2 and reports.eligibility(1.0, None, 1.0)["eligible"] is None
    part = reports.validation_section(reports.eligibility(9.0, 3, 1.0), {"status": "ok"}, {"status": "ok"}, {})
    assert not part["display_downgrade"] and reports.validation_section(reports.eligibility(9.0, 3, 1.0), None, {"status": "ok"}, {})["display_downgrade"]
    assert reports.simplify_rules([{"features": ["a"], "confidence": 0.5, "lift": 1}, {"features": ["a", "b"], "confidence": 0.9, "lift": 2}]) == [{"features": ["a", "b"], "confidence": 0.9, "lift": 2}]
    assert reports.trial_faults({"p_value": 2, "separation": 0.5}) == ["p_value is 2, not within 0 and 1"] and "| a |" in reports.markdown("t", {"s": [{"a": 1.0}]}) and "more" in reports.markdown("t", {"s": [{"a": "x" * 50}] * 99}, 100)
    patterns = spark.createDataFrame([("active", ["x", "y"], "c1", 0.7), ("draft", ["x"], "c2", 0.2)], "status string, tags array<string>, case_id string, performance double")
    assert reports.query_patterns(patterns, tags=["y"], least=0.5).count() == 1 and {(r.kind, r.name, r.n) for r in reports.tag_statistics(patterns).collect()} == {("status", "active", 1), ("status", "draft", 1), ("tag", "x", 2), ("tag", "y", 1)}
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "case_id string")
    assert {(r.fault, r.n) for r in reports.case_faults(ids("a", "b"), ids("b", "z"), ids("a", "b"), 1).collect()} == {("in both", 1), ("unknown", 1)}


def test_registries(spark):
    r = registry.Registry("indicator")
    r.register("sma", lambda n: R.mean("close", n))
    df = series(spark, close=[1, 2, 3, 4])
    assert [x.SMA_2 for x in registry.indicators(df, [{"name": "sma", "parameters": {"n": 2}}], r).orderBy("ts").collect()] == [None, 1.5, 2.5, 3.5]
    for bad in (lambda: r.register("sma", None), lambda: r.build("none")):
        with pytest.raises((ValueError, KeyError)):
            bad()
    s = registry.Strategy(lambda d, p: {"up": F.col("close") > p["k"]}, {"k": int}, {"k": (0, 10)})
    assert s.apply(df, {"k": 2}).where("up").count() == 2 and s.faults({"k": 11}) == ["k is not within 0 and 10"] and s.faults({}) == ["k is missing"]
    assert registry.few_valued(df.withColumn("two", F.col("close") % 2), ["close", "two"]) == ["two"] and len(registry.operators().names()) >= 20


def test_signal_pieces(spark):
    assert column(series(spark, x=[1]), signals.trimmed_std(F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4, 100)])))[0] == pytest.approx(np.std([1, 2, 3, 4], ddof=1))
    pts = spark.createDataFrame([("a", k) for k in range(101)], "symbol string, ts long")
    kept = sorted(r.ts for r in signals.strided(pts, 11, ["symbol"]).collect())
    assert kept == list(range(0, 101, 10)) and signals.strided(pts, 200, ["symbol"]).count() == 101
    chained = preprocess.chain(series(spark, x=[1, None, 3, 4, 50], k=[1, 1, 1, 1, 0]), ["x"], F.col("k") == 1).orderBy("ts").collect()
    filled = np.clip([1, 1, 3, 4], *np.percentile([1, 1, 3, 4], [1, 99]))
    assert [r.x for r in chained[:4]] == pytest.approx(list((filled - filled.mean()) / filled.std(ddof=1)))
