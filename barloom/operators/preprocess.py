"""Clipping, standardising and testing of features; splits by time; windows for sequence models."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions import rolling as R
from barloom.operators.ic import average_rank

_c = F.col


def cross_zscore(c: str) -> Column:
    """z-score over the symbols of each time (deviation over n - 1)."""
    w = Window.partitionBy("ts")
    s = F.stddev_samp(c).over(w)
    return F.when(s > 0, (_c(c) - F.avg(c).over(w)) / s)


def cross_rank(c: str) -> Column:
    """Average rank over the symbols of each time, as a share."""
    return average_rank(c, ["ts"]) / F.nullif(F.count(c).over(Window.partitionBy("ts")), F.lit(0))


def fitted_clip(df: DataFrame, c: str, train: Column, method: str = "percentile", low: float = 0.01, high: float = 0.99, k: float = 3.0) -> DataFrame:
    """``<c>_clip``: held to bounds fitted on the training rows of each symbol (percentile, mad or zscore)."""
    x = F.when(train, _c(c))
    if method == "percentile":
        fit = df.groupBy("symbol").agg(F.percentile(x, low).alias("_lo"), F.percentile(x, high).alias("_hi"))
    elif method == "zscore":
        fit = df.groupBy("symbol").agg((F.avg(x) - k * F.stddev_samp(x)).alias("_lo"), (F.avg(x) + k * F.stddev_samp(x)).alias("_hi"))
    else:
        mid = df.groupBy("symbol").agg(F.percentile(x, 0.5).alias("_m"))
        dev = df.join(mid, "symbol").groupBy("symbol", "_m").agg(F.percentile(F.when(train, F.abs(_c(c) - _c("_m"))), 0.5).alias("_d"))
        fit = dev.select("symbol", (_c("_m") - 1.4826 * k * _c("_d")).alias("_lo"), (_c("_m") + 1.4826 * k * _c("_d")).alias("_hi"))
    out = df.join(fit, "symbol", "left")
    return out.withColumn(f"{c}_clip", F.when(_c(c).isNotNull(), F.greatest(F.least(_c(c), F.coalesce("_hi", c)), F.coalesce("_lo", c)))).drop("_lo", "_hi")


def chain(df: DataFrame, columns: list[str], train: Column, limit: int | None = None) -> DataFrame:
    """``columns`` filled forward, clipped and standardised by symbol, with bounds and moments of the training rows only.

    Columns that are constant on a symbol's training rows become null there.
    """
    for c in columns:
        w = R.order().rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
        df = df.withColumn(c, F.last(c, ignorenulls=True).over(w))
        df = fitted_clip(df, c, train).drop(c).withColumnRenamed(f"{c}_clip", c)
        x = F.when(train, _c(c))
        fit = df.groupBy("symbol").agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
        df = df.join(fit, "symbol", "left").withColumn(c, F.when(_c("_s") > 0, (_c(c) - _c("_m")) / _c("_s"))).drop("_m", "_s")
    return df


def gaussian_rank(c: str, n: int) -> Column:
    """Rolling rank share through the inverse normal distribution (rational approximation, error below 5e-4)."""
    p = R.rank_pct(c, n) * (n / (n + 1))
    q = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.ln(q))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)  # fixed values: a published approximation
    return F.when(p < 0.5, -z).otherwise(z)


def split_by_time(df: DataFrame, train_end: int, test_start: int, validation: float = 0.2) -> DataFrame:
    """``part``: train, validation (the last share of the training rows), test, or null between them."""
    inside = _c("ts") <= train_end
    w = Window.partitionBy("symbol")
    n, k = F.count(F.when(inside, 1)).over(w), F.row_number().over(w.orderBy("ts"))
    late = k > n - F.floor(n * F.lit(validation))
    return df.withColumn("part", F.when(inside, F.when(late, "validation").otherwise("train")).when(_c("ts") >= test_start, "test"))


def sequences(df: DataFrame, columns: list[str], width: int, stride: int = 1) -> DataFrame:
    """(symbol, ts, window): windows of ``width`` rows that start every ``stride`` rows; the last possible one is left out."""
    w = R.order()
    ahead = w.rowsBetween(0, width - 1)
    d = df.withColumns({"_k": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    rows = F.collect_list(F.array(*[_c(c).cast("float") for c in columns])).over(ahead)
    return d.withColumn("window", rows).where((_c("_k") < _c("_n") - width) & (_c("_k") % stride == 0)).select("symbol", "ts", "window")


def eligibility(bars: DataFrame, horizon: int, back: int, step: int) -> DataFrame:
    """Each bar with the first reason why it can't be evaluated (null if it can)."""
    w = R.order()
    span = w.rowsBetween(-back, horizon)
    d = bars.withColumns({"_k": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy("symbol")), "_first": F.min("ts").over(span), "_last": F.max("ts").over(span), "_low": F.min(F.least("open", "close")).over(span)})
    reason = (
        F.when(_c("_k") <= back, "warm-up").when(_c("_k") > _c("_n") - horizon, "tail")
        .when(_c("_last") - _c("_first") != (back + horizon) * step, "gap").when(_c("_low") <= 0, "price")
    )
    return bars.join(d.select("symbol", "ts", reason.alias("reason")), ["symbol", "ts"])


def factor_returns(df: DataFrame, position: str, change: str) -> DataFrame:
    """Position times forward return, its running sum and turnover."""
    r = _c(position) * _c(change)
    return df.withColumns({"factor_return": r, "cumulative": F.sum(r).over(R.running()), "turnover": F.coalesce(F.abs(_c(position) - R.lag(position)), F.lit(0.0))})


def series_tests(df: DataFrame, c: str, lags: int = 10) -> DataFrame:
    """Unit root t statistic, Ljung-Box Q and effective sample share of each symbol's series."""
    from barloom.operators.recursive import adf

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("ts")[c].dropna().to_numpy(float)
        n, e = len(x), x - x.mean() if len(x) else x
        v = e @ e
        rho = [float(e[k:] @ e[:-k] / v) if v > 0 and n > k else 0.0 for k in range(1, lags + 1)]
        q = n * (n + 2) * sum(r * r / (n - k) for k, r in enumerate(rho, 1) if n > k)
        share = 1 / max(1 + 2 * sum(r for r in rho if r > 0), 1)
        return pd.DataFrame([(pdf["symbol"].iloc[0], n, adf(x), q, share)], columns=["symbol", "n", "adf_t", "ljung_box", "effective_share"])

    return df.select("symbol", "ts", c).groupBy("symbol").applyInPandas(run, "symbol string, n long, adf_t double, ljung_box double, effective_share double")


def permutation_band(df: DataFrame, feature: str, label: str, draws: int = 200, seed: int = 7) -> DataFrame:
    """The linear coefficient of each symbol, the 95 % band of permuted labels and a two-sided p value."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values("ts")[[feature, label]].dropna()
        x, y = (d[k].to_numpy(float) for k in (feature, label))
        x, y = x - x.mean(), y - y.mean()
        scale = math.sqrt((x @ x) * (y @ y)) or 1.0
        rng = np.random.default_rng(seed)
        null = np.array([x @ rng.permutation(y) for _ in range(draws)]) / scale
        real = float(x @ y / scale)
        low, high = np.percentile(null, [2.5, 97.5])
        return pd.DataFrame([(pdf["symbol"].iloc[0], real, low, high, (1 + (np.abs(null) >= abs(real)).sum()) / (draws + 1))], columns=["symbol", "coefficient", "low", "high", "p"])

    return df.select("symbol", "ts", feature, label).groupBy("symbol").applyInPandas(run, "symbol string, coefficient double, low double, high double, p double")


def cluster_bootstrap(df: DataFrame, value: str, weight: str, cluster: str, draws: int = 200, seed: int = 7) -> DataFrame:
    """Weighted mean of each symbol with a 95 % interval over resampled clusters.

    Clusters are summed in Spark first; a task holds one symbol's cluster sums.
    """
    sums = df.where(_c(value).isNotNull()).groupBy("symbol", cluster).agg(F.sum(_c(value) * _c(weight)).alias("s"), F.sum(weight).alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cluster)
        s, w = pdf["s"].to_numpy(), pdf["w"].to_numpy()
        pick = np.random.default_rng(seed).integers(0, len(s), (draws, len(s)))
        low, high = np.percentile(s[pick].sum(axis=1) / w[pick].sum(axis=1), [2.5, 97.5])
        return pd.DataFrame([(pdf["symbol"].iloc[0], s.sum() / w.sum(), low, high, len(s))], columns=["symbol", "mean", "low", "high", "clusters"])

    return sums.groupBy("symbol").applyInPandas(run, "symbol string, mean double, low double, high double, clusters long")
