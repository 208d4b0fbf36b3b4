"""Queries of extractors, regimes, reports and trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import indicators as I
from barloom.functions import rolling as R
from barloom.operators import extract as X
from barloom.plans import recursive_sql as Q
from barloom.plans import sql as S
from barloom.plans.registry import bar_query, query, rounded
from barloom.plans.research_queries import EVAL, SCORED, avg_rank, scored
from barloom.sources.bars import event_bars

O = S.OVER
E = "1e-10"
bar_query(
    "extract_price_features", lambda: [X.price_features()],
    [{"ret_oc": f"close / (open + {E}) - 1", "span": f"(high - low) / (open + {E})", "close_position": f"(close - low) / (high - low + {E})", "std_ratio_5": f"{S.std('close', 5)} / ({S.mean('close', 5)} + {E})", "momentum_3": f"close / ({S.lag('close', 3)} + {E}) - 1", "upper_shadow": f"(high - greatest(open, close)) / (open + {E})", "lower_shadow": f"(least(open, close) - low) / (open + {E})", "body": f"abs(close - open) / (open + {E})"}],
    ["ret_oc", "span", "close_position", "std_ratio_5", "momentum_3", "upper_shadow", "lower_shadow", "body"], digits=5,
)
bar_query(
    "extract_volume_features", lambda: [X.volume_features()],
    [{"volume_change": f"volume / ({S.lag('volume')} + {E}) - 1", "volume_ma_ratio_5": f"volume / ({S.mean('volume', 5)} + {E})", "taker_value_ratio": f"taker_buy_volume / (volume + {E})", "cv": f"case when stddev_pop(volume) over {S.w(5)} * stddev_pop(close) over {S.w(5)} > 1e-14 then {S.pair('covar_pop', 'volume', 'close', 5)} / (stddev_pop(volume) over {S.w(5)} * stddev_pop(close) over {S.w(5)}) end", "volume_abnormal": f"coalesce(cast(volume > 2 * ({S.mean('volume', 20)}) as int), 0)"}, {"volume_close_corr_5": "cv"}],
    ["volume_change", "volume_ma_ratio_5", "taker_value_ratio", "volume_close_corr_5", "volume_abnormal"], digits=5,
)
bar_query(
    "rsi_simple_mean", X.simple_rsi,
    [{"g": f"case when {S.lag('close')} is not null then greatest(close - {S.lag('close')}, 0) end", "l": f"case when {S.lag('close')} is not null then greatest({S.lag('close')} - close, 0) end"}, {"rsi_simple": f"100 - 100 / (1 + {S.mean('g', 14)} / ({S.mean('l', 14)} + {E}))"}, {"overbought": "coalesce(cast(rsi_simple > 70 as int), 0)", "oversold": "coalesce(cast(rsi_simple < 30 as int), 0)", "rsi_momentum": f"rsi_simple - {S.lag('rsi_simple', 5)}"}],
    ["rsi_simple", "overbought", "oversold", "rsi_momentum"], digits=5,
)
bar_query(
    "line_signals", lambda: [{"_a": R.mean("close", 5), "_b": R.mean("close", 10), "_d": R.mean("close", 20)}, {k: v.cast("int") for k, v in X.line_signals("_a", "_b", "_d").items()}],
    [{"a": S.mean("close", 5), "b": S.mean("close", 10), "d": S.mean("close", 20)}, {"three_lines": "cast(coalesce(a > b and b > d, false) as int)", "short_long": "cast(coalesce(a > d, false) as int)", "middle_long": "cast(coalesce(b > d, false) as int)"}],
    ["three_lines", "short_long", "middle_long"],
)
_AHEAD = "(partition by symbol order by ts rows between 1 following and 6 following)"
bar_query(
    "forward_extremes", lambda: [X.forward_extremes()],
    [{**{f"return_{h}": f"{S.lead('close', h)} / nullif(close, 0) - 1" for h in (1, 2, 4, 6)}, "max_ahead": f"case when count(close) over {_AHEAD} = 6 then max(high) over {_AHEAD} / nullif(close, 0) - 1 end", "min_ahead": f"case when count(close) over {_AHEAD} = 6 then min(low) over {_AHEAD} / nullif(close, 0) - 1 end"}],
    ["return_1", "return_2", "return_4", "return_6", "max_ahead", "min_ahead"], digits=4,
)


@query("signal_jumps", f"with {S.bars()}, j as (select *, lag(close) over {O} as p from bars) select symbol, ts, close from j where close / nullif(p, 0) - 1 >= 0.1")
def _(spark, sf_dir):
    return event_bars(spark, sf_dir).withColumn("hit", X.jump()).where("hit").select("symbol", "ts", "close")


@query("ema_trio_features", Q.EMA_TRIO)
def _(spark, sf_dir):
    cols = ["ema_5", "ema_20", "ema_60", "distance", "slope"]
    return rounded(X.ema_trio(event_bars(spark, sf_dir)).select("symbol", "ts", *cols, "aligned", "crossed_up"), *cols)


@query("regime_rules", f"""with {S.bars()}, a as (select *, close / nullif(lag(close) over {O}, 0) - 1 as r, {S.mean('close', 20)} as m from bars), v as (select *, {S.std('r', 20)} as vol from a),
 q as (select *, case when count(vol) over {S.RUNNING} >= 100 then quantile_cont(vol, {1 / 3}) over {S.RUNNING} end as lo, case when count(vol) over {S.RUNNING} >= 100 then quantile_cont(vol, {2 / 3}) over {S.RUNNING} end as hi from v)
 select symbol, ts, case when lo is null or vol is null then 'warm-up' else (case when close >= m then 'up' else 'down' end) || '_' || case when vol <= lo then 'calm' when vol <= hi then 'normal' else 'wild' end end as regime from q""")
def _(spark, sf_dir):
    df = event_bars(spark, sf_dir)
    for stage in X.rule_regimes():
        df = df.withColumns(stage)
    return df.select("symbol", "ts", "regime")


@query("regime_kmeans")
def _(spark, sf_dir):
    return X.kmeans_regimes(event_bars(spark, sf_dir))


@query("trend_analysis", f"with {S.bars()}, n as (select symbol, close, cast(row_number() over {O} as double) as n from bars), a as (select symbol, count(*) as n, regr_slope(close, n) as slope, regr_r2(close, n) as r2 from n group by symbol), t as (select *, sign(slope) * sqrt(r2 * (n - 2) / nullif(1 - r2, 0)) as t from a) select symbol, n, round(slope, 6) + 0.0 as slope, round(r2, 6) + 0.0 as r2, round(t, 4) + 0.0 as t, case when abs(t) < 1.96 then 'flat' when slope > 0 then 'up' else 'down' end as trend from t")
def _(spark, sf_dir):
    return rounded(rounded(X.trend(event_bars(spark, sf_dir), "close", ["symbol"]), "slope", "r2"), "t", digits=4)


@query("weekly_sentiment", f"with {S.bars()}, w as (select symbol, ((ts - 345600) // 604800) * 604800 + 345600 as week, round_even(avg(close), 0) as level from bars group by 1, 2) select *, case when level < 40 then 'fear' when level < 60 then 'neutral' else 'greed' end as phase from w")
def _(spark, sf_dir):
    return X.weekly(event_bars(spark, sf_dir), "close", [(40, "fear"), (60, "neutral")], "greed")


_BEFORE = "(partition by symbol order by ts rows between 100 preceding and 1 preceding)"


@query("rolling_auc", SCORED + f""", l as (select symbol, ts, n, list(taker_ratio) filter (where up = 1 and taker_ratio is not null) over {_BEFORE} as p, list(taker_ratio) filter (where up = 0 and taker_ratio is not null) over {_BEFORE} as q from scored)
 select symbol, ts, round(case when n > 100 and len(p) > 0 and len(q) > 0 then list_sum(list_transform(p, lambda a: len(list_filter(q, lambda b: b < a)) + 0.5 * len(list_filter(q, lambda b: b = a)))) / (len(p) * len(q)) end, 6) + 0.0 as auc from l""")
def _(spark, sf_dir):
    return rounded(X.rolling_auc(scored(spark, sf_dir), "taker_ratio", "up", 100), "auc")


@query("warning_zones", f"""with {S.bars()}, a as (select *, coalesce(taker_ratio < 0.4, false) as under from bars), b as (select *, cast(under and not coalesce(lag(under) over {O}, false) as int) as new from a), c as (select *, sum(new) over {S.RUNNING} as run from b)
 select symbol, min(ts) as start, max(ts) as "end", count(*) as rows, round(min(taker_ratio), 6) + 0.0 as lowest from c where under group by symbol, run""")
def _(spark, sf_dir):
    return rounded(X.zones(event_bars(spark, sf_dir), "taker_ratio", 0.4), "lowest")


@query("top_false_positives", EVAL + " select symbol, ts, round(taker_ratio, 6) + 0.0 as taker_ratio from e where up = 0 and taker_ratio > 0.5 order by e.taker_ratio desc, symbol, ts limit 20")
def _(spark, sf_dir):
    return rounded(X.false_positives(scored(spark, sf_dir), "taker_ratio", "up").select("symbol", "ts", "taker_ratio"), "taker_ratio")


@query("score_equity_curve", SCORED + ", d as (select ts, avg(case when taker_ratio > 0.5 then fwd4 / 100 else 0 end) as r from scored where fwd4 is not null group by ts) select ts, round(r, 6) + 0.0 as r, round(sum(r) over (order by ts), 5) + 0.0 as simple from d")
def _(spark, sf_dir):
    d = X.score_curve(scored(spark, sf_dir).withColumn("c", F.col("fwd4") / 100), "taker_ratio", "c", 0.5).drop("compound")
    return rounded(rounded(d, "r"), "simple", digits=5)


@query("event_return_strata", EVAL + ", x as (select symbol, case when mom3 > 0 then 'long' else 'short' end as direction, fwd4 as v, volume as w from e) select symbol, direction, count(v) as n, round(sum(v * w) / sum(w), 6) + 0.0 as mean, round(sum(case when v > 0 then w else 0 end) / sum(w), 6) + 0.0 as win_rate, round(sum(w) * sum(w) / sum(w * w), 5) + 0.0 as n_eff from x group by grouping sets ((), (symbol), (direction))")
def _(spark, sf_dir):
    d = scored(spark, sf_dir).where("up is not null").withColumn("direction", F.when(F.col("mom3") > 0, "long").otherwise("short"))
    return rounded(rounded(X.strata(d, "fwd4", "volume", ["symbol", "direction"]), "mean", "win_rate"), "n_eff", digits=5)


@query("leave_one_symbol_out", SCORED + """, d as (select * from scored where mom3 is not null and fwd4 is not null), p as (select symbol, count(*) as n, sum(mom3) as x, sum(fwd4) as y, sum(mom3 * fwd4) as xy, avg(cast(sign(mom3) = sign(fwd4) as int)) as hit from d group by symbol),
 r as (select symbol, n, hit, (sum(xy) over () - xy) / (sum(n) over () - n) - (sum(x) over () - x) / (sum(n) over () - n) * (sum(y) over () - y) / (sum(n) over () - n) as c from p) select symbol, n, cast(sign(c) as double) as sign, round(case when c >= 0 then hit else 1 - hit end, 6) + 0.0 as hit_rate from r""")
def _(spark, sf_dir):
    return rounded(X.leave_one_out(scored(spark, sf_dir), "mom3", "fwd4"), "hit_rate")


@query("rolling_out_of_sample", SCORED + f""", d as (select symbol, mom3, fwd4, ntile(6) over {O} as block from scored where mom3 is not null and fwd4 is not null), k as (select symbol, block, {avg_rank('mom3', 'symbol, block')} as x, {avg_rank('fwd4', 'symbol, block')} as y from d),
 i as (select symbol, block, corr(x, y) as ic from k group by 1, 2), o as (select symbol, block, ic, lead(ic) over (partition by symbol order by block) as nxt from i) select symbol, block, round(ic, 6) + 0.0 as ic_in, round(nxt, 6) + 0.0 as ic_out, round(1 - nxt / nullif(ic, 0), 4) + 0.0 as lost from o where nxt is not null""")
def _(spark, sf_dir):
    return rounded(rounded(X.in_out_sample(scored(spark, sf_dir), "mom3", "fwd4"), "ic_in", "ic_out"), "lost", digits=4)


@query("leakage_check", SCORED + f", d as (select symbol, mom3, lead(fwd4, 2) over {O} as y from scored), r as (select symbol, corr(mom3, y) as r from d group by symbol) select symbol, round(r, 6) + 0.0 as r, coalesce(abs(r) > 0.3, false) as suspect from r")
def _(spark, sf_dir):
    return rounded(X.leakage(scored(spark, sf_dir), "mom3", "fwd4", 2), "r")


_SYMBOLS = ["click", "error", "purchase", "signup", "view"]


@query("coverage_matrix", SCORED + " " + " union all ".join(f"select '{c}' as feature, " + ", ".join(f"round(coalesce(avg(case when symbol = '{s}' then cast({c} is null as int) end), 1), 6) + 0.0 as {s}" for s in _SYMBOLS) + " from scored" for c in ("mom3", "sma20", "fwd4")))
def _(spark, sf_dir):
    return rounded(X.coverage_matrix(scored(spark, sf_dir), ["mom3", "sma20", "fwd4"], _SYMBOLS), *_SYMBOLS)


TRIALS = """with t as (select o_orderpriority as study, o_orderkey as trial, o_totalprice as value, case when o_orderstatus = 'P' then 'failed' else 'complete' end as state, month(o_orderdate) as month from orders)"""


def trials(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderpriority").alias("study"), F.col("o_orderkey").alias("trial"), F.col("o_totalprice").alias("value"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("complete").alias("state"), F.month("o_orderdate").cast("long").alias("month"))


@query("trials_compare", TRIALS + ", b as (select trial, value from t where state = 'complete' order by value desc, trial limit 10) select trial, value, row_number() over (order by value desc, trial) as place, round(max(value) over () - value, 4) + 0.0 as behind from b")
def _(spark, sf_dir):
    return rounded(X.compare_trials(trials(spark, sf_dir)).select("trial", "value", "place", "behind"), "behind", digits=4)


@query("trials_convergence", TRIALS + """, d as (select *, max(value) over (partition by study order by trial rows between unbounded preceding and current row) as best, row_number() over (partition by study order by trial) as k, count(*) over (partition by study) as n from t where state = 'complete'),
 l as (select * from d where k > n - greatest(floor(n * 0.2), 5)) select study, max(best) as best, round(max(best) - min(best), 4) + 0.0 as moved, max(n) as trials, max(best) - min(best) < abs(max(best)) * 0.01 as converged from l group by study""")
def _(spark, sf_dir):
    return rounded(X.convergence(trials(spark, sf_dir)), "moved", digits=4)


@query("trials_stability", TRIALS + ", p as (select study, month, avg(value) as m, count(*) as n from t where state = 'complete' group by 1, 2 having count(*) >= 2) select study, round(stddev_pop(m) / nullif(abs(avg(m)), 0), 6) + 0.0 as cv, arg_max(month, (m, month)) as best, arg_min(month, (m, month)) as worst from p group by study")
def _(spark, sf_dir):
    return rounded(X.stability(trials(spark, sf_dir), "month"), "cv")


@query("ema_crossover_lags", Q.EMA_LAGS)
def _(spark, sf_dir):
    d = X.ema_trio(event_bars(spark, sf_dir))
    return rounded(I.add(d, I.lags(["ema_5"], [1, 2])).select("symbol", "ts", "ema_5_Lag_1", "ema_5_Lag_2"), "ema_5_Lag_1", "ema_5_Lag_2")
