"""Forward labels and derived features, per symbol in time order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import rolling as R
from barloom.sources.bars import seconds


def horizon_bars(duration: str, timeframe: str) -> int:
    """Bars in a duration such as ``12h`` or ``3d``; it must be a whole number of them."""
    m = re.fullmatch(r"(\d+)([mhdw])", duration)
    if not m:
        raise ValueError(f"not a duration: {duration!r}")
    size = int(m[1]) * {"m": 60, "h": 3600, "d": 86400, "w": 604800}[m[2]]
    bars, rest = divmod(size, seconds(timeframe))
    if rest or not bars:
        raise ValueError(f"{duration} is not a whole number of {timeframe} bars")
    return bars


def simple_return(h: int, c: str = "close") -> Column:
    return R.lead(c, h) / F.nullif(F.col(c), F.lit(0.0)) - 1


def log_return(h: int, c: str = "close") -> Column:
    ratio = R.lead(c, h) / F.nullif(F.col(c), F.lit(0.0))
    return F.when(ratio > 0, F.ln(ratio))


def binary(h: int, threshold: float = 0.0, c: str = "close") -> Column:
    return (simple_return(h, c) > threshold).cast("int")


def excess_return(h: int, benchmark: str, c: str = "close") -> Column:
    return simple_return(h, c) - simple_return(h, benchmark)


def risk_adjusted(df: DataFrame, h: int, window: int = 21, name: str = "risk_adjusted", c: str = "close") -> DataFrame:
    """Forward return over the volatility of past one-bar returns."""
    past = F.col(c) / F.nullif(R.lag(c), F.lit(0.0)) - 1
    return df.withColumn("_r", past).withColumn(name, simple_return(h, c) / F.nullif(R.std("_r", window), F.lit(0.0))).drop("_r")


def winsorized_return(*_: object) -> Column:
    raise ValueError("a full-sample winsorised label looks ahead; clip it point in time")


def all_labels(df: DataFrame, horizons: list[int], threshold: float = 0.0) -> DataFrame:
    """Simple, log and binary labels of every horizon: ``label_<kind>_<h>``."""
    new = {}
    for h in horizons:
        new |= {f"label_return_{h}": simple_return(h), f"label_log_{h}": log_return(h), f"label_up_{h}": binary(h, threshold)}
    return df.withColumns(new)


# Derived features


def with_scale(df: DataFrame, c: str) -> DataFrame:
    """The column's median absolute non-zero value per symbol, as ``<c>_scale`` (over the whole sample)."""
    scale = df.groupBy("symbol").agg(F.percentile(F.when(F.col(c) != 0, F.abs(F.col(c))), 0.5).alias(f"{c}_scale"))
    return df.join(scale, "symbol", "left")


def safe_denominator(c: str, eps: float = 1e-6) -> Column:
    """Null where the column is 0, or tiny against its scale (see :func:`with_scale`)."""
    return F.when((F.col(c) != 0) & (F.abs(F.col(c)) >= eps * F.col(f"{c}_scale")), F.col(c))


def distance(price: str, indicator: str) -> Column:
    return (F.col(price) - F.col(indicator)) / safe_denominator(indicator)


def cross(fast: str, slow: str) -> Column:
    """Signed distance, not an event."""
    return F.col(fast) - F.col(slow)


def ratio(a: str, b: str) -> Column:
    return F.col(a) / safe_denominator(b)


def momentum(c: str, n: int) -> Column:
    before = R.lag(c, n)
    return (F.col(c) - before) / F.when((before != 0) & (F.abs(before) >= 1e-6 * F.col(f"{c}_scale")), before)


def binary_signal(c: str, above: float | None = None, below: float | None = None) -> Column:
    rule = F.col(c) > above if above is not None else F.col(c) < below
    return F.coalesce(rule, F.lit(False)).cast("int")


def clipped(c: str, low: float, high: float) -> Column:
    return F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(high)), F.lit(low)))


def winsorized(c: str, n: int = 252, low: float = 0.01, high: float = 0.99, least: int = 63) -> Column:
    """The value held between its rolling quantiles; as it is before ``least`` rows."""
    a, b = R.quantile(c, n, low, least), R.quantile(c, n, high, least)
    return F.when(a.isNull(), F.col(c)).otherwise(F.greatest(F.least(F.col(c), b), a))


def adaptive_zscore(c: str, n: int, eps: float = 1e-8) -> Column:
    m, s = F.avg(c).over(R.frame(n)), F.stddev_samp(c).over(R.frame(n))
    return F.when(F.col(c).isNotNull(), F.when(s > 0, (F.col(c) - m) / (s + eps)).otherwise(0.0))


def filled(c: str, most: int) -> Column:
    """The last value of at most ``most`` rows ago, where null."""
    return F.last(c, ignorenulls=True).over(R.order().rowsBetween(-most, 0))
