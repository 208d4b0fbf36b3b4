"""Path-dependent backtests and performance metrics."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# How a trade ended.
REASONS = {"stop": "stop_loss", "target": "take_profit", "trailing": "trailing_stop", "signal": "signal_exit", "end of data": "data_end"}


@dataclass(frozen=True)
class Strategy:
    entry: float = 0.7
    exit: float = 0.4
    stop: float = 2.0
    """Stop distance in ATRs of the entry bar; the target is ``reward`` times as far."""
    reward: float = 3.0
    trail: float | None = 0.05
    """Once up by so many ATRs of the current bar, the stop follows the high at that distance."""
    cooldown: int = 0
    commission: float = 0.001
    slippage: float = 0.0005
    sizer: str = "fixed"
    """``fixed``, ``kelly`` or ``scaled``."""
    size: float = 0.1
    """Size of the fixed sizer."""
    fraction: float = 0.5
    win_loss: float = 1.5
    """Share of the Kelly size that is taken, and the ratio of a win to a loss that it assumes."""
    most: float = 0.25
    """Largest size of the other two."""
    threshold: float = 0.5
    """Probability at which the scaled size is 0."""


def kelly(p: float, reward: float, fraction: float, most: float = 0.25) -> float:
    return min(max((p * reward - (1 - p)) / reward * fraction, 0.0), most)


def position_size(s: Strategy, p: float) -> float:
    p = min(max(p, 0.0), 1.0)
    if s.sizer == "kelly":
        return kelly(p, s.win_loss, s.fraction, s.most)
    if s.sizer == "scaled":
        return min(max((p - s.threshold) / (1 - s.threshold), 0.0), 1.0) * s.most
    return s.size


def cooled(signals: list[bool], bars: int) -> list[bool]:
    """Signals more than ``bars`` bars after the last one kept."""
    out, last = [], None
    for i, on in enumerate(signals):
        keep = on and (last is None or i - last > bars)
        out.append(keep)
        last = i if keep else last
    return out


def simulate(o: list, h: list, low: list, c: list, atr: list, p: list, s: Strategy) -> list[tuple]:
    """Trades (entry bar, exit bar, entry, exit, size, gain share, reason, gain of the size, worst, best) of one symbol.

    Entries are at the close of a signal bar, and without stops where that bar has no
    ATR.  From the next bar on, the stop comes before the target, the target before the
    trailing stop, that before the signal.  The next entry is after the exit bar; what is
    open at the end, be it since the last bar, ends at the last close.
    """
    known = lambda x: x is not None and x == x
    cost = 2 * (s.commission + s.slippage)
    enter = cooled([known(x) and x > s.entry for x in p], s.cooldown)
    trades, n, i = [], len(c), 0
    while i < n:
        if not enter[i]:
            i += 1
            continue
        price, stop, target, trail = c[i], None, None, None
        if known(atr[i]) and atr[i] > 0:
            stop, target = price - atr[i] * s.stop, price + atr[i] * s.stop * s.reward
        out = n - 1, c[-1], "end of data"
        for j in range(i + 1, n):
            if stop is not None and low[j] <= stop:
                out = j, stop, "stop"
                break
            if target is not None and h[j] >= target:
                out = j, target, "target"
                break
            step = atr[j] * s.trail if s.trail is not None and stop is not None and known(atr[j]) and atr[j] > 0 else None
            if step is not None and h[j] >= price + step:
                trail = h[j] - step if trail is None else max(trail, h[j] - step)
            if trail is not None and low[j] <= trail:
                out = j, trail, "trailing"
                break
            if known(p[j]) and p[j] < s.exit:
                out = j, c[j], "signal"
                break
        gain, size, held = out[1] / price - 1 - cost, position_size(s, p[i]), slice(i, out[0] + 1)
        trades.append((i, out[0], price, out[1], size, gain, out[2], size * gain, min(low[held]) / price - 1, max(h[held]) / price - 1))
        i = out[0] + 1
    return trades


_TRADES = "symbol string, entry_ts long, exit_ts long, entry_price double, exit_price double, size double, gain double, reason string, pnl double, mae double, mfe double"


def trades(bars: DataFrame, strategy: Strategy, probability: str = "p", atr: str = "atr") -> DataFrame:
    """Trades of each symbol, ``reason`` being one of :data:`REASONS`; a task walks one symbol's bars."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        at = pdf["ts"].tolist()
        rows = simulate(*(pdf[k].tolist() for k in ("open", "high", "low", "close", atr, probability)), strategy)
        named = [(pdf["symbol"].iloc[0], at[i], at[j], *rest[:4], REASONS[rest[4]], *rest[5:]) for i, j, *rest in rows]
        return pd.DataFrame(named, columns=[c.split()[0] for c in _TRADES.split(", ")])

    return bars.select("symbol", "ts", "open", "high", "low", "close", atr, probability).groupBy("symbol").applyInPandas(run, _TRADES)


def equity(bars: DataFrame, done: DataFrame) -> DataFrame:
    """Equity of each symbol: the product of one plus each trade's gain, at its exit bar."""
    gains = done.groupBy("symbol", F.col("exit_ts").alias("ts")).agg(F.product(1 + F.col("gain")).alias("_g"))
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    joined = bars.select("symbol", "ts").join(gains, ["symbol", "ts"], "left")
    return joined.withColumn("equity", F.product(F.coalesce("_g", F.lit(1.0))).over(w)).drop("_g")


def curve_metrics(curve: DataFrame, per_year: float, risk_free: float = 0.0) -> DataFrame:
    """Return, growth, Sharpe, Sortino, drawdown and its length, Calmar (deviations over n)."""
    w = Window.partitionBy("symbol").orderBy("ts")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = curve.withColumns({"_r": F.col("equity") / F.lag("equity").over(w) - 1, "_dd": F.col("equity") / F.max("equity").over(upto) - 1, "_n": F.row_number().over(w)})
    d = d.withColumn("_top", F.max(F.when(F.col("_dd") >= 0, F.col("_n"))).over(upto))
    n, years = F.count(F.lit(1)), (F.count(F.lit(1)) - 1) / per_year
    whole = F.max_by("equity", "ts") / F.min_by("equity", "ts")
    down = F.stddev_pop(F.when(F.col("_r") < 0, F.col("_r")))
    mean = F.avg("_r") - risk_free / per_year
    root = per_year**0.5
    out = d.groupBy("symbol").agg(
        n.alias("bars"), (whole - 1).alias("total_return"), (F.pow(whole, 1 / F.nullif(years, F.lit(0.0))) - 1).alias("cagr"),
        (mean / F.nullif(F.stddev_pop("_r"), F.lit(0.0)) * root).alias("sharpe"), (mean / F.nullif(down, F.lit(0.0)) * root).alias("sortino"),
        F.min("_dd").alias("max_drawdown"), F.max(F.col("_n") - F.col("_top")).alias("drawdown_bars"),
    )
    return out.withColumn("calmar", F.col("cagr") / F.nullif(F.abs("max_drawdown"), F.lit(0.0)))


def trade_metrics(done: DataFrame) -> DataFrame:
    """Counts, rates and averages over trades by ``pnl`` (the gain of the size), and system quality by ``gain``; zeros where nothing is defined."""
    g, r = F.col("pnl"), F.col("gain")
    win, loss = F.when(g > 0, g), F.when(g < 0, g)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = done.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg((g > 0).cast("int")).alias("win_rate"), zero(F.avg(win)).alias("avg_win"), zero(F.avg(loss)).alias("avg_loss"),
        zero(zero(F.sum(win)) / F.nullif(F.abs(F.sum(loss)), F.lit(0.0))).alias("profit_factor"),
        zero(F.avg(r) / F.nullif(F.stddev_pop(r), F.lit(0.0)) * F.sqrt(F.least(F.count(F.lit(1)), F.lit(100)))).alias("sqn"),
    )
    return out.withColumn("expectancy", F.col("win_rate") * F.col("avg_win") - (1 - F.col("win_rate")) * F.abs("avg_loss"))


def net_returns(gross: str, turnover: str, bps: float) -> dict[str, Column]:
    """Net return after costs, and the cost that breaks even."""
    return {"net": F.col(gross) - F.col(turnover) * (bps / 1e4), "breakeven_bps": F.col(gross) / F.nullif(F.col(turnover), F.lit(0.0)) * 1e4}


def cost_levels(bps: float) -> list[float]:
    """Half, one, two and five times the cost, held to 0.1 .. 1000."""
    return sorted({min(max(bps * k, 0.1), 1000.0) for k in (0.5, 1, 2, 5)})


def factor_metrics(returns: DataFrame, per_year: float, risk_free: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """Sharpe, Sortino (deviations over n - 1), drawdown and win rate of a series ``r`` by key."""
    keys = keys or ["symbol"]
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    d = returns.where("r is not null").withColumn("_e", F.product(1 + F.col("r")).over(w))
    d = d.withColumn("_dd", F.col("_e") / F.greatest(F.max("_e").over(w), F.lit(1.0)) - 1)
    mean, root = F.avg("r") - risk_free / per_year, per_year**0.5
    return d.groupBy(*keys).agg(
        (mean / F.nullif(F.stddev_samp("r"), F.lit(0.0)) * root).alias("sharpe"), (mean / F.nullif(F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))), F.lit(0.0)) * root).alias("sortino"),
        F.min("_dd").alias("max_drawdown"), F.avg((F.col("r") > 0).cast("int")).alias("win_rate"), F.count(F.lit(1)).alias("n"),
    )
