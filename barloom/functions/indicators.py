"""Technical indicators that bounded windows express.

Each function gives a list of stages, dicts of new columns to add one after the
other with ``withColumns``; names with a leading underscore are working columns.
:func:`add` applies an indicator to a frame of bars.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import rolling as R

Stages = list[dict[str, Column]]
_c = F.col


def add(df: DataFrame, stages: Stages) -> DataFrame:
    for stage in stages:
        df = df.withColumns(stage)
    return df.drop(*[k for stage in stages for k in stage if k.startswith("_")])


def sma(n: int = 20, c: str = "close") -> Stages:
    return [{"sma": R.mean(c, n)}]


def wma(n: int = 10, c: str = "close") -> Stages:
    return [{"wma": R.weighted(c, n)}]


def trima(n: int = 10, c: str = "close") -> Stages:
    """Mean of means: halves of n / 2 and n / 2 + 1, or two of (n + 1) / 2."""
    a, b = (n // 2, n // 2 + 1) if n % 2 == 0 else ((n + 1) // 2,) * 2
    return [{"_inner": R.mean(c, a)}, {"trima": R.mean("_inner", b)}]


def bbands(n: int = 20, up: float = 2, down: float = 2, c: str = "close") -> Stages:
    m, s = R.mean(c, n), R.std(c, n, 0)
    return [{"bb_upper": m + s * up, "bb_middle": m, "bb_lower": m - s * down}]


def mavp(low: int = 2, high: int = 8, periods: str = "trades", c: str = "close") -> Stages:
    """Mean over a period that each row names, held between ``low`` and ``high``."""
    n = F.greatest(F.lit(low), F.least(F.lit(high), _c(periods).cast("int")))
    v = R.values(c, high)
    last = F.slice(v, F.size(v) - n + 1, n)
    return [{"mavp": F.when(R.row_no() >= high, F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / n)}]


def midpoint(n: int = 14, c: str = "close") -> Stages:
    return [{"midpoint": (R.highest(c, n) + R.lowest(c, n)) / 2}]


def midprice(n: int = 14) -> Stages:
    return [{"midprice": (R.highest("high", n) + R.lowest("low", n)) / 2}]


def mom(n: int = 10, c: str = "close") -> Stages:
    return [{"mom": _c(c) - R.lag(c, n)}]


def roc(n: int = 10, c: str = "close") -> Stages:
    """The four rates of change."""
    r = _c(c) / F.nullif(R.lag(c, n), F.lit(0.0))
    return [{"roc": 100 * (r - 1), "rocp": r - 1, "rocr": r, "rocr100": 100 * r}]


def apo(fast: int = 12, slow: int = 26, c: str = "close") -> Stages:
    return [{"apo": R.mean(c, fast) - R.mean(c, slow)}]


def ppo(fast: int = 12, slow: int = 26, c: str = "close") -> Stages:
    return [{"ppo": 100 * (R.mean(c, fast) - R.mean(c, slow)) / F.nullif(R.mean(c, slow), F.lit(0.0))}]


def aroon(n: int = 14) -> Stages:
    up, down = R.argmax("high", n + 1, last=True) * (100 / n), R.argmin("low", n + 1, last=True) * (100 / n)
    return [{"aroon_up": up, "aroon_down": down, "aroon_osc": up - down}]


def bop() -> Stages:
    return [{"bop": F.when(_c("high") > _c("low"), (_c("close") - _c("open")) / (_c("high") - _c("low"))).otherwise(0.0)}]


def true_range() -> Column:
    before = R.lag("close")
    return F.when(before.isNotNull(), F.greatest(_c("high") - _c("low"), F.abs(_c("high") - before), F.abs(_c("low") - before)))


def trange() -> Stages:
    return [{"trange": true_range()}]


def ultosc(a: int = 7, b: int = 14, c: int = 28) -> Stages:
    before = R.lag("close")
    floor = F.least(_c("low"), before)
    ratio = lambda n: R.total("_bp", n) / F.nullif(R.total("_tr", n), F.lit(0.0))
    return [{"_bp": F.when(before.isNotNull(), _c("close") - floor), "_tr": true_range()}, {"ultosc": 100 * (4 * ratio(a) + 2 * ratio(b) + ratio(c)) / 7}]


def willr(n: int = 14) -> Stages:
    top, bottom = R.highest("high", n), R.lowest("low", n)
    return [{"willr": F.when(top > bottom, -100 * (top - _c("close")) / (top - bottom)).when(top.isNotNull(), 0.0)}]


def mfi(n: int = 14) -> Stages:
    up, down = R.total("_up", n), R.total("_down", n)
    move = F.signum(_c("_typ") - R.lag("_typ"))
    flow = _c("_typ") * _c("volume")
    return [
        {"_typ": (_c("high") + _c("low") + _c("close")) / 3},
        {"_up": F.when(move.isNotNull(), F.when(move > 0, flow).otherwise(0.0)), "_down": F.when(move.isNotNull(), F.when(move < 0, flow).otherwise(0.0))},
        {"mfi": F.when(up + down < 1, 0.0).otherwise(100 * up / (up + down))},
    ]


def stochf(n: int = 5, d: int = 3) -> Stages:
    top, bottom = R.highest("high", n), R.lowest("low", n)
    k = F.when(top > bottom, 100 * (_c("close") - bottom) / (top - bottom)).when(top.isNotNull(), 0.0)
    return [{"fast_k": k}, {"fast_d": R.mean("fast_k", d)}]


def stoch(n: int = 5, k: int = 3, d: int = 3) -> Stages:
    return [{"_fast": stochf(n)[0]["fast_k"]}, {"slow_k": R.mean("_fast", k)}, {"slow_d": R.mean("slow_k", d)}]


def cci(n: int = 14) -> Stages:
    dev = R.mean_abs_dev("_typ", n)
    return [{"_typ": (_c("high") + _c("low") + _c("close")) / 3}, {"cci": F.when(dev > 0, (_c("_typ") - R.mean("_typ", n)) / (0.015 * dev)).when(dev.isNotNull(), 0.0)}]


def obv() -> Stages:
    step = F.when(R.lag("close").isNull(), _c("volume")).otherwise(F.signum(_c("close") - R.lag("close")) * _c("volume"))
    return [{"_step": step}, {"obv": F.sum("_step").over(R.running())}]


def ad() -> Stages:
    span = _c("high") - _c("low")
    flow = F.when(span > 0, ((_c("close") - _c("low")) - (_c("high") - _c("close"))) / span * _c("volume")).otherwise(0.0)
    return [{"_flow": flow}, {"ad": F.sum("_flow").over(R.running())}]


def beta(n: int = 5, a: str = "high", b: str = "low") -> Stages:
    """Slope of b's one-bar returns on a's, over the last n returns."""
    change = lambda x: _c(x) / F.nullif(R.lag(x), F.lit(0.0)) - 1
    spread = R.var("_ra", n, 0)
    return [{"_ra": change(a), "_rb": change(b)}, {"beta": F.when(spread > 0, R.covar("_ra", "_rb", n, 0) / spread).when(spread.isNotNull(), 0.0)}]


def correl(n: int = 30, a: str = "high", b: str = "low") -> Stages:
    return [{"correl": R.corr(a, b, n)}]


def linearreg(n: int = 14, c: str = "close") -> Stages:
    s = R.slope(c, n)
    return [{"linreg": R.forecast(c, n, 0), "linreg_slope": s, "linreg_intercept": R.intercept(c, n), "linreg_angle": F.degrees(F.atan(s)), "tsf": R.forecast(c, n, 1)}]


def stddev(n: int = 5, k: float = 1, c: str = "close") -> Stages:
    return [{"stddev": R.std(c, n, 0) * k, "var": R.var(c, n, 0)}]


def price_transforms() -> Stages:
    o, h, low, c = (_c(k) for k in ("open", "high", "low", "close"))
    return [{"avgprice": (o + h + low + c) / 4, "medprice": (h + low) / 2, "typprice": (h + low + c) / 3, "wclprice": (h + low + 2 * c) / 4}]


# Volatility, volume and microstructure features


def donchian(n: int = 20) -> Stages:
    top, bottom = R.highest("high", n), R.lowest("low", n)
    return [{"donchian": (top - bottom) / F.nullif((top + bottom) / 2, F.lit(0.0))}]


def parkinson(n: int = 20) -> Stages:
    return [{"_x": F.pow(R.log(R.ratio(_c("high"), _c("low"))), 2)}, {"parkinson": F.sqrt(R.mean("_x", n) / (4 * math.log(2)))}]


def garman_klass(n: int = 20) -> Stages:
    x = 0.5 * F.pow(R.log(R.ratio(_c("high"), _c("low"))), 2) - (2 * math.log(2) - 1) * F.pow(R.log(R.ratio(_c("close"), _c("open"))), 2)
    return [{"_x": x}, {"garman_klass": F.sqrt(F.greatest(R.mean("_x", n), F.lit(0.0)))}]


def vwap(n: int = 20) -> Stages:
    typ = (_c("high") + _c("low") + _c("close")) / 3
    return [{"_pv": typ * _c("volume")}, {"vwap": R.total("_pv", n) / F.nullif(R.total("volume", n), F.lit(0.0)), "volume_ma_ratio": _c("volume") / F.nullif(R.mean("volume", n), F.lit(0.0))}]


def eom(n: int = 14) -> Stages:
    mid = (_c("high") + _c("low")) / 2
    return [{"_x": (mid - R.lag(mid)) * (_c("high") - _c("low")) / F.nullif(_c("volume"), F.lit(0.0))}, {"eom": R.mean("_x", n)}]


def amihud(n: int = 21) -> Stages:
    change = _c("close") / F.nullif(R.lag("close"), F.lit(0.0)) - 1
    return [{"_x": F.abs(change) / F.nullif(_c("quote_volume"), F.lit(0.0))}, {"amihud": R.mean("_x", n)}]


def kyle_lambda(n: int = 21) -> Stages:
    move = _c("close") - R.lag("close")
    spread = R.var("_v", n)
    return [{"_p": move, "_v": F.signum(move) * _c("volume")}, {"kyle_lambda": F.coalesce(R.covar("_p", "_v", n) / F.nullif(spread, F.lit(0.0)), F.lit(0.0))}]


def roll_spread(n: int = 21) -> Stages:
    return [{"_d": _c("close") - R.lag("close")}, {"_e": R.lag("_d")}, {"roll_spread": 2 * F.sqrt(F.greatest(-R.covar("_d", "_e", n), F.lit(0.0)))}]


def corwin_schultz(n: int = 21) -> Stages:
    """High-low spread estimate over pairs of bars, negative ones as 0, and its mean."""
    k = 3 - 2 * math.sqrt(2)
    one = F.pow(R.log(R.ratio(_c("high"), _c("low"))), 2)
    two = F.pow(R.log(R.ratio(F.greatest(_c("high"), R.lag("high")), F.least(_c("low"), R.lag("low")))), 2)
    alpha = (math.sqrt(2) - 1) * F.sqrt("_b") / k - F.sqrt(_c("_g") / k)
    return [
        {"_b": one + R.lag(one), "_g": F.when(R.lag("high").isNotNull(), two)},
        {"_a": alpha},
        {"_s": F.greatest(2 * (F.exp("_a") - 1) / (1 + F.exp("_a")), F.lit(0.0))},
        {"cs_spread": R.mean("_s", n)},
    ]


def ofi(n: int = 21) -> Stages:
    return [{"ofi": 2 * _c("taker_ratio") - 1}, {"ofi_z": R.zscore("ofi", n)}]


def large_trade_ratio(n: int = 21) -> Stages:
    return [{"_size": _c("volume") / F.nullif(_c("trades"), F.lit(0)), "_quote": _c("quote_volume") / F.nullif(_c("trades"), F.lit(0))}, {"large_trade_ratio": _c("_quote") / F.nullif(R.quantile("_quote", n, 0.5), F.lit(0.0))}]


def cvar(n: int = 55, alpha: float = 0.05) -> Stages:
    """Mean of the frame's returns at or below its alpha quantile."""
    v = R.values("_r", n)
    low = F.filter(v, lambda x: x <= _c("_q"))
    return [
        {"_r": _c("close") / F.nullif(R.lag("close"), F.lit(0.0)) - 1},
        {"_q": R.quantile("_r", n, alpha)},
        {"cvar": R.full("_r", n, F.aggregate(low, F.lit(0.0), lambda a, x: a + x) / F.size(low))},
    ]


def semivariance(n: int = 21) -> Stages:
    """Upside and downside realised volatility, their difference and ratio, and gain to pain."""
    r = _c("_r")
    up, down = F.sqrt(R.total("_u", n)), F.sqrt(R.total("_d", n))
    gain, pain = R.total("_g", n), R.total("_p", n)
    return [
        {"_r": _c("close") / F.nullif(R.lag("close"), F.lit(0.0)) - 1},
        {"_u": F.when(r.isNotNull(), F.when(r > 0, r * r).otherwise(0.0)), "_d": F.when(r.isNotNull(), F.when(r < 0, r * r).otherwise(0.0)), "_g": F.greatest(r, F.lit(0.0)) + r * 0, "_p": F.greatest(-r, F.lit(0.0)) + r * 0},
        {"rv_up": up, "rv_down": down, "rv_diff": up - down, "ud_ratio": up / F.nullif(down, F.lit(0.0)), "gpr": F.least(F.greatest(gain / F.nullif(pain, F.lit(0.0)), F.lit(0.0)), F.lit(100.0))},
    ]


def jarque_bera(n: int = 55) -> Stages:
    s, k = R.full("_r", n, F.skewness("_r").over(R.frame(n))), R.full("_r", n, F.kurtosis("_r").over(R.frame(n)))
    return [{"_r": _c("close") / F.nullif(R.lag("close"), F.lit(0.0)) - 1}, {"jarque_bera": n / 6 * (s * s + k * k / 4)}]


def rolling_drawdown(n: int = 55) -> Stages:
    return [{"_dd": (_c("close") - R.highest("close", n)) / F.nullif(R.highest("close", n), F.lit(0.0))}, {"max_drawdown": F.abs(R.lowest("_dd", n))}]


def state_counters(n: int = 24, fast: int = 5, slow: int = 20, threshold: float = 50.0) -> Stages:
    """Bars since a cross and since an upward cross of a level, crosses, length of the run of rises or falls, ratio to the maximum."""
    cross = R.crosses("_fast", "_slow")
    up = F.coalesce((_c("close") >= threshold) & (R.lag("close") < threshold), F.lit(False))
    sign = F.signum(_c("close") - R.lag("close"))
    top = R.highest("close", n)
    return [
        {"_fast": R.mean("close", fast), "_slow": R.mean("close", slow), "_sign": sign},
        {"_turn": F.coalesce((_c("_sign") != R.lag("_sign")).cast("int"), F.lit(1)), "bars_since_cross": R.bars_since(cross, n), "cross_count": R.count_in(cross, n), "bars_since_threshold": R.bars_since(up, n), "window_max_ratio": F.when(top > 0, _c("close") / top)},
        {"_start": F.max(F.when(_c("_turn") == 1, R.row_no())).over(R.running())},
        {"consecutive_run": F.when((_c("_sign") != 0) & (R.row_no() >= n), F.least(R.row_no() - _c("_start") + 1, F.lit(n)))},
    ]


def relative_strength(n: int = 20, reference: str = "reference_close") -> Stages:
    """Relative price, beta and idiosyncratic return against a reference price on each row."""
    change = lambda c: _c(c) / F.nullif(R.lag(c), F.lit(0.0)) - 1
    spread = R.var("_m", n)
    return [
        {"_r": change("close"), "_m": change(reference)},
        {"relative_price": _c("close") / F.nullif(_c(reference), F.lit(0.0)), "rs_beta": R.covar("_r", "_m", n) / F.nullif(spread, F.lit(0.0))},
        {"idiosyncratic": _c("_r") - _c("rs_beta") * _c("_m")},
    ]


def consensus(columns: list[str]) -> Column:
    """Mean sign of the columns that are not null."""
    signs = [F.signum(_c(k)) for k in columns]
    n = reduce(lambda a, b: a + b, [s.isNotNull().cast("int") for s in signs])
    return F.when(n > 0, reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in signs]) / n)


def time_features(ts: str = "ts") -> Stages:
    t = F.timestamp_seconds(ts)
    day = F.weekday(t)
    return [{"hour": F.hour(t), "weekday": day, "weekend": (day >= 5).cast("int"), "month": F.month(t)}]


def lags(columns: list[str], steps: list[int]) -> Stages:
    return [{f"{c}_Lag_{k}": R.lag(c, k) for c in columns for k in steps}]
