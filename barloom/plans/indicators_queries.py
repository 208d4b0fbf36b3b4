"""Queries of rolling columns and indicators over hourly event bars."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barloom.functions import indicators as I
from barloom.functions import rolling as R
from barloom.plans import sql as S
from barloom.plans.registry import bar_query

TYP = "(high + low + close) / 3"
RET = f"close / nullif({S.lag('close')}, 0) - 1"
TR = f"case when {S.lag('close')} is not null then greatest(high - low, abs(high - {S.lag('close')}), abs(low - {S.lag('close')})) end"

# Rolling kernels
bar_query(
    "rolling_stats",
    lambda: [{"mean": R.mean("close", 20), "std": R.std("close", 20), "low_n": R.lowest("close", 20), "high_n": R.highest("close", 20), "span": R.highest("close", 20) - R.lowest("close", 20), "z": R.zscore("close", 20)}],
    [{"mean": S.mean("close", 20), "std": S.std("close", 20), "low_n": S.lowest("close", 20), "high_n": S.highest("close", 20)}, {"span": "high_n - low_n", "z": "case when std > 0 then (close - mean) / std end"}],
    ["mean", "std", "low_n", "high_n", "span", "z"],
)
bar_query("rolling_sum_median", lambda: [{"sum_n": R.total("volume", 12), "median_n": R.quantile("close", 12, 0.5), "q25": R.quantile("close", 12, 0.25)}], [{"sum_n": S.total("volume", 12), "median_n": S.quantile("close", 12, 0.5), "q25": S.quantile("close", 12, 0.25)}], ["sum_n", "median_n", "q25"])
bar_query(
    "rolling_rank", lambda: [{"rank_pct": R.rank_pct("close", 10)}],
    [{"l": f"list(close) over {S.w(10)}"}, {"rank_pct": "case when len(l) >= 10 then (len(list_filter(l, lambda x: x < close)) + (len(list_filter(l, lambda x: x = close)) + 1) / 2.0) / 10 end"}], ["rank_pct"],
)
bar_query("rolling_slope", lambda: [{"slope": R.slope("close", 10)}], [{"slope": S.slope("close", 10)}], ["slope"])
bar_query(
    "rolling_skew_kurt", lambda: [{"skew": R.skew("close", 20), "kurt": R.kurt("close", 20)}],
    [{"skew": S.agg("skewness", "close", 20), "kurt": S.agg("kurtosis", "close", 20)}], ["skew", "kurt"],
)
bar_query(
    "ts_argmax_argmin", lambda: [{"arg_top": R.argmax("close", 10), "arg_low": R.argmin("close", 10)}],
    [{"l": f"list(close) over {S.w(10)}"}, {"arg_top": "case when len(l) >= 10 then list_position(l, list_max(l)) - 1 end", "arg_low": "case when len(l) >= 10 then list_position(l, list_min(l)) - 1 end"}], ["arg_top", "arg_low"],
)
bar_query("decay_linear", lambda: [{"decay": R.weighted("close", 6)}], [{"decay": S.weighted("close", 6)}], ["decay"])
bar_query("rolling_corr", lambda: [{"r": R.corr("close", "volume", 30)}], [{"r": S.pair("corr", "close", "volume", 30)}], ["r"])
bar_query("lags", lambda: I.lags(["close", "volume"], [1, 3]), [{f"{c}_Lag_{k}": S.lag(c, k) for c in ("close", "volume") for k in (1, 3)}], ["close_Lag_1", "close_Lag_3", "volume_Lag_1", "volume_Lag_3"])

# Trend
bar_query("ta_sma", I.sma, [{"sma": S.mean("close", 20)}], ["sma"])
bar_query("ta_wma", I.wma, [{"wma": S.weighted("close", 10)}], ["wma"])
bar_query("ta_trima", I.trima, [{"i": S.mean("close", 5)}, {"trima": S.mean("i", 6)}], ["trima"])
bar_query("ta_bbands", I.bbands, [{"m": S.mean("close", 20), "s": S.std("close", 20, 0)}, {"bb_upper": "m + 2 * s", "bb_middle": "m", "bb_lower": "m - 2 * s"}], ["bb_upper", "bb_middle", "bb_lower"])
bar_query(
    "ta_mavp", I.mavp,
    [{"l": f"list(close) over {S.w(8)}", "n": "greatest(2, least(8, trades))"}, {"mavp": "case when rn >= 8 then list_sum(list_slice(l, len(l) - n + 1, len(l))) / n end"}], ["mavp"],
)
bar_query("ta_midpoint", I.midpoint, [{"midpoint": f"({S.highest('close', 14)} + {S.lowest('close', 14)}) / 2"}], ["midpoint"])
bar_query("ta_midprice", I.midprice, [{"midprice": f"({S.highest('high', 14)} + {S.lowest('low', 14)}) / 2"}], ["midprice"])

# Momentum
bar_query("ta_mom", I.mom, [{"mom": f"close - {S.lag('close', 10)}"}], ["mom"])
bar_query("ta_roc", I.roc, [{"r": f"close / nullif({S.lag('close', 10)}, 0)"}, {"roc": "100 * (r - 1)", "rocp": "r - 1", "rocr": "r", "rocr100": "100 * r"}], ["roc", "rocp", "rocr", "rocr100"])
bar_query("ta_apo", I.apo, [{"apo": f"{S.mean('close', 12)} - {S.mean('close', 26)}"}], ["apo"])
bar_query("ta_ppo", I.ppo, [{"f": S.mean("close", 12), "g": S.mean("close", 26)}, {"ppo": "100 * (f - g) / nullif(g, 0)"}], ["ppo"])
bar_query(
    "ta_aroon", I.aroon,
    [
        {"h": f"list_reverse(list(high) over {S.w(15)})", "l": f"list_reverse(list(low) over {S.w(15)})"},
        {"aroon_up": "case when len(h) >= 15 then 100.0 * (15 - list_position(h, list_max(h))) / 14 end", "aroon_down": "case when len(l) >= 15 then 100.0 * (15 - list_position(l, list_min(l))) / 14 end"},
        {"aroon_osc": "aroon_up - aroon_down"},
    ],
    ["aroon_up", "aroon_down", "aroon_osc"],
)
bar_query("ta_bop", I.bop, [{"bop": "case when high > low then (close - open) / (high - low) else 0 end"}], ["bop"])
bar_query(
    "ta_ultosc", I.ultosc,
    [
        {"bp": f"case when {S.lag('close')} is not null then close - least(low, {S.lag('close')}) end", "tr": TR},
        {f"r{n}": f"{S.total('bp', n)} / nullif({S.total('tr', n)}, 0)" for n in (7, 14, 28)},
        {"ultosc": "100 * (4 * r7 + 2 * r14 + r28) / 7"},
    ],
    ["ultosc"],
)
bar_query("ta_willr", I.willr, [{"t": S.highest("high", 14), "b": S.lowest("low", 14)}, {"willr": "case when t > b then -100 * (t - close) / (t - b) when t is not null then 0 end"}], ["willr"])
bar_query(
    "ta_mfi", I.mfi,
    [
        {"typ": TYP}, {"m": f"sign(typ - {S.lag('typ')})"},
        {"u": "case when m is not null then case when m > 0 then typ * volume else 0 end end", "d": "case when m is not null then case when m < 0 then typ * volume else 0 end end"},
        {"su": S.total("u", 14), "sd": S.total("d", 14)}, {"mfi": "case when su + sd < 1 then 0 else 100 * su / (su + sd) end"},
    ],
    ["mfi"],
)
_K = [{"t": S.highest("high", 5), "b": S.lowest("low", 5)}, {"fast_k": "case when t > b then 100 * (close - b) / (t - b) when t is not null then 0 end"}]
bar_query("ta_stochf", I.stochf, [*_K, {"fast_d": S.mean("fast_k", 3)}], ["fast_k", "fast_d"])
bar_query("ta_stoch", I.stoch, [*_K, {"slow_k": S.mean("fast_k", 3)}, {"slow_d": S.mean("slow_k", 3)}], ["slow_k", "slow_d"])
bar_query(
    "ta_cci", I.cci,
    [{"typ": TYP}, {"l": f"list(typ) over {S.w(14)}", "m": S.mean("typ", 14)}, {"dev": "case when m is not null then list_sum(list_transform(l, lambda x: abs(x - m))) / 14 end"}, {"cci": "case when dev > 0 then (typ - m) / (0.015 * dev) when dev is not null then 0 end"}],
    ["cci"],
)

# Volatility and volume
bar_query("ta_trange", I.trange, [{"trange": TR}], ["trange"])
bar_query("ta_obv", I.obv, [{"x": f"case when {S.lag('close')} is null then volume else sign(close - {S.lag('close')}) * volume end"}, {"obv": f"sum(x) over {S.RUNNING}"}], ["obv"])
bar_query("ta_ad", I.ad, [{"x": "case when high > low then ((close - low) - (high - close)) / (high - low) * volume else 0 end"}, {"ad": f"sum(x) over {S.RUNNING}"}], ["ad"])
bar_query("vol_donchian", I.donchian, [{"t": S.highest("high", 20), "b": S.lowest("low", 20)}, {"donchian": "(t - b) / nullif((t + b) / 2, 0)"}], ["donchian"])
bar_query("vol_parkinson", I.parkinson, [{"x": "power(ln(high / low), 2)"}, {"parkinson": f"sqrt({S.mean('x', 20)} / (4 * ln(2)))"}], ["parkinson"])
bar_query("vol_garman_klass", I.garman_klass, [{"x": f"0.5 * power(ln(high / low), 2) - {2 * math.log(2) - 1!r} * power(ln(close / open), 2)"}, {"g": S.mean("x", 20)}, {"garman_klass": "case when g is not null then sqrt(greatest(g, 0)) else 0 end"}], ["garman_klass"])
bar_query("volume_vwap", I.vwap, [{"pv": f"{TYP} * volume"}, {"vwap": f"{S.total('pv', 20)} / nullif({S.total('volume', 20)}, 0)", "volume_ma_ratio": f"volume / nullif({S.mean('volume', 20)}, 0)"}], ["vwap", "volume_ma_ratio"])
bar_query("volume_eom", I.eom, [{"mid": "(high + low) / 2"}, {"x": f"(mid - {S.lag('mid')}) * (high - low) / nullif(volume, 0)"}, {"eom": S.mean("x", 14)}], ["eom"])

# Statistics and price transforms
bar_query("ta_beta", I.beta, [{"ra": f"high / nullif({S.lag('high')}, 0) - 1", "rb": f"low / nullif({S.lag('low')}, 0) - 1"}, {"v": S.var("ra", 5, 0), "c": S.pair("covar_pop", "ra", "rb", 5)}, {"beta": "case when v > 0 then c / v when v is not null then 0 end"}], ["beta"])
bar_query("ta_correl", I.correl, [{"correl": S.pair("corr", "high", "low", 30)}], ["correl"])
bar_query("ta_correl_close_volume", lambda: I.correl(30, "close", "volume"), [{"correl": S.pair("corr", "close", "volume", 30)}], ["correl"])
bar_query(
    "ta_beta_close_volume", lambda: I.beta(5, "close", "volume"),
    [{"ra": f"close / nullif({S.lag('close')}, 0) - 1", "rb": f"volume / nullif({S.lag('volume')}, 0) - 1"}, {"v": S.var("ra", 5, 0), "c": S.pair("covar_pop", "ra", "rb", 5)}, {"beta": "case when v > 0 then c / v when v is not null then 0 end"}], ["beta"],
)
bar_query(
    "ta_linearreg", I.linearreg,
    [{"linreg_slope": S.slope("close", 14), "m": S.mean("close", 14)}, {"linreg": "m + linreg_slope * 6.5", "linreg_intercept": "m - linreg_slope * 6.5", "linreg_angle": "degrees(atan(linreg_slope))", "tsf": "m + linreg_slope * 7.5"}],
    ["linreg", "linreg_slope", "linreg_intercept", "linreg_angle", "tsf"],
)
bar_query("ta_stddev", I.stddev, [{"stddev": S.std("close", 5, 0), "var": S.var("close", 5, 0)}], ["stddev", "var"])
bar_query("price_transforms", I.price_transforms, [{"avgprice": "(open + high + low + close) / 4", "medprice": "(high + low) / 2", "typprice": TYP, "wclprice": "(high + low + 2 * close) / 4"}], ["avgprice", "medprice", "typprice", "wclprice"])

# Microstructure and tail risk
bar_query("micro_amihud", I.amihud, [{"x": f"abs({RET}) / nullif(quote_volume, 0)"}, {"amihud": S.mean("x", 21)}], ["amihud"])
bar_query("micro_kyle_lambda", I.kyle_lambda, [{"p": f"close - {S.lag('close')}"}, {"v": "sign(p) * volume"}, {"kyle_lambda": f"coalesce({S.pair('covar_samp', 'p', 'v', 21)} / nullif({S.var('v', 21)}, 0), 0)"}], ["kyle_lambda"], digits=1)
bar_query("micro_roll_spread", I.roll_spread, [{"d": f"close - {S.lag('close')}"}, {"e": S.lag("d")}, {"c": S.pair("covar_samp", "d", "e", 21)}, {"roll_spread": "2 * sqrt(greatest(-c, 0))"}], ["roll_spread"])
_K2 = 3 - 2 * math.sqrt(2)
bar_query(
    "micro_cs_spread", I.corwin_schultz,
    [
        {"o": "power(ln(high / low), 2)", "ph": S.lag("high"), "pl": S.lag("low")},
        {"b": f"o + {S.lag('o')}", "g": "case when ph is not null then power(ln(greatest(high, ph) / least(low, pl)), 2) end"},
        {"a": f"{math.sqrt(2) - 1!r} * sqrt(b) / {_K2!r} - sqrt(g / {_K2!r})"}, {"x": "case when a is null then 0 else greatest(2 * (exp(a) - 1) / (1 + exp(a)), 0) end"}, {"cs_spread": S.mean("x", 21)},
    ],
    ["cs_spread"],
)
bar_query("micro_ofi", I.ofi, [{"ofi": "2 * taker_ratio - 1"}, {"m": S.mean("ofi", 21), "s": S.std("ofi", 21)}, {"ofi_z": "case when s > 0 then (ofi - m) / s end"}], ["ofi", "ofi_z"])
bar_query("micro_large_trades", I.large_trade_ratio, [{"q": "quote_volume / nullif(trades, 0)"}, {"large_trade_ratio": f"q / nullif({S.quantile('q', 21, 0.5)}, 0)"}], ["large_trade_ratio"])
bar_query("tail_cvar", I.cvar, [{"r": RET}, {"l": f"list(r) filter (where r is not null) over {S.w(55)}", "q": S.quantile("r", 55, 0.05)}, {"f": "list_filter(l, lambda x: x <= q)"}, {"cvar": "case when q is not null then list_sum(f) / len(f) end"}], ["cvar"])
bar_query(
    "tail_semivariance", I.semivariance,
    [
        {"r": RET}, {"u": "case when r is not null then case when r > 0 then r * r else 0 end end", "d": "case when r is not null then case when r < 0 then r * r else 0 end end", "g": "case when r is not null then greatest(r, 0) end", "p": "case when r is not null then greatest(-r, 0) end"},
        {"rv_up": f"sqrt({S.total('u', 21)})", "rv_down": f"sqrt({S.total('d', 21)})", "sg": S.total("g", 21), "sp": S.total("p", 21)},
        {"rv_diff": "rv_up - rv_down", "ud_ratio": "rv_up / nullif(rv_down, 0)", "gpr": "case when sg / nullif(sp, 0) is null then 0 else least(greatest(sg / nullif(sp, 0), 0), 100) end"},
    ],
    ["rv_up", "rv_down", "rv_diff", "ud_ratio", "gpr"],
)
bar_query("tail_drawdown", I.rolling_drawdown, [{"t": S.highest("close", 55)}, {"dd": "(close - t) / nullif(t, 0)"}, {"max_drawdown": f"abs({S.lowest('dd', 55)})"}], ["max_drawdown"])
bar_query("tail_jarque_bera", I.jarque_bera, [{"r": RET}, {"s": S.agg("skewness", "r", 55), "k": S.agg("kurtosis_pop", "r", 55)}, {"jarque_bera": f"55 / 6.0 * (power(s / {math.sqrt(55 * 54) / 53!r}, 2) + k * k / 4)"}], ["jarque_bera"])

# State counters and time
_S = "case when rn > 24 then {} end"  # a cross needs the row before, so 24 full rows of crosses begin at the 25th
bar_query(
    "state_counters", I.state_counters,
    [
        {"f": S.mean("close", 5), "g": S.mean("close", 20), "sg": f"sign(close - {S.lag('close')})", "up": f"coalesce({S.lag('close')} < 50 and 50 <= close, false)", "t": S.highest("close", 24)},
        {"d": "sign(f - g)"}, {"x": f"coalesce((d = 1 and {S.lag('d')} = -1) or (d = -1 and {S.lag('d')} = 1), false)", "turn": f"coalesce(cast(sg <> {S.lag('sg')} as int), 1)"},
        {"bars_since_cross": _S.format(f"rn - max(case when x then rn end) over {S.w(24)}"), "cross_count": _S.format(f"sum(cast(x as int)) over {S.w(24)}"), "bars_since_threshold": _S.format(f"rn - max(case when up then rn end) over {S.w(24)}"), "window_max_ratio": "case when t > 0 then close / t end", "st": f"max(case when turn = 1 then rn end) over {S.RUNNING}"},
        {"consecutive_run": "case when sg <> 0 and rn >= 24 then least(rn - st + 1, 24) end"},
    ],
    ["bars_since_cross", "cross_count", "bars_since_threshold", "window_max_ratio", "consecutive_run"],
)
bar_query("time_features", I.time_features, [{"t": "make_timestamp(ts * 1000000)"}, {"hour": "hour(t)", "weekday": "isodow(t) - 1", "weekend": "cast(isodow(t) >= 6 as int)", "month": "month(t)"}], ["hour", "weekday", "weekend", "month"])
bar_query(
    "consensus_and_interaction",
    lambda: [
        {"_a": R.lag("close") * 0 + F.col("close") - R.lag("close"), "_b": F.col("close") - R.mean("close", 10), "_v": F.col("volume") - R.lag("volume")},
        {"trend_consensus": I.consensus(["_a", "_b"]), "divergence": F.coalesce((F.signum("_a") * F.signum("_v") < 0).cast("int"), F.lit(0)), "interaction": F.col("_a") * F.col("_v")},
    ],
    [
        {"a": f"close - {S.lag('close')}", "b": f"close - {S.mean('close', 10)}", "v": f"volume - {S.lag('volume')}"},
        {"trend_consensus": "case when a is not null or b is not null then (coalesce(sign(a), 0) + coalesce(sign(b), 0)) / (cast(a is not null as int) + cast(b is not null as int)) end", "divergence": "coalesce(cast(sign(a) * sign(v) < 0 as int), 0)", "interaction": "a * v"},
    ],
    ["trend_consensus", "divergence", "interaction"],
)
