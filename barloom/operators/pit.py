"""Point-in-time statistics: of each row, over its symbol's history up to it.

Counts, means and moments are running windows.  Ranks and quantiles need the
history in order: one pass per symbol keeps it in a sorted list.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import rolling as R
from barloom.operators.recursive import NAN, apply

LEAST = 100
"""Rows of history below which a statistic is null."""


def effective_count(c: str) -> Column:
    return F.count(c).over(R.running())


def valid(c: str, least: int = LEAST) -> Column:
    return effective_count(c) >= least


def mean_std(c: str, least: int = LEAST) -> tuple[Column, Column]:
    return F.when(valid(c, least), F.avg(c).over(R.running())), F.when(valid(c, least), F.stddev_samp(c).over(R.running()))


def zscore(c: str, least: int = LEAST) -> Column:
    m, s = mean_std(c, least)
    return F.when(s > 0, (F.col(c) - m) / s)


def _quantile(v: list[float], q: float) -> float:
    at = q * (len(v) - 1)
    k = int(at)
    return v[k] if k + 1 >= len(v) else v[k] + (at - k) * (v[k + 1] - v[k])


def _deviation(v: list[float], middle: float) -> float:
    """Median distance of sorted values from ``middle``: the distances below and above it are sorted runs, merged by binary search."""
    j = bisect.bisect_left(v, middle)
    below, above = j, len(v) - j

    def place(k: int) -> float:
        """The k-th smallest distance (from 0)."""
        low, high = max(0, k + 1 - above), min(k + 1, below)
        while low < high:  # how many of the k + 1 smallest lie below
            i = (low + high) // 2
            if middle - v[j - 1 - i] < v[j + k - i] - middle:
                low = i + 1
            else:
                high = i
        i = low
        return max(middle - v[j - i] if i else -1.0, v[j + k - i] - middle if k + 1 - i else -1.0)

    n = len(v)
    return (place((n - 1) // 2) + place(n // 2)) / 2


def _history(x: np.ndarray, least: int, f: Callable[[list[float], float], tuple]) -> list[tuple | None]:
    held: list[float] = []
    out: list[tuple | None] = []
    for value in x:
        if value == value:
            bisect.insort(held, value)
        out.append(f(held, value) if len(held) >= least and value == value else None)
    return out


def _columns(rows: list[tuple | None], names: list[str]) -> dict[str, np.ndarray]:
    return {n: np.array([NAN if r is None else r[k] for r in rows], float) for k, n in enumerate(names)}


def qcut(v: list[float], value: float, q: int, full: bool = False) -> float:
    """Right-closed bin of a value among the quantiles of sorted values; repeated edges are one (or no bin, if ``full``)."""
    edges = sorted({_quantile(v, k / q) for k in range(q + 1)})
    if len(edges) < 2 or full and len(edges) < q + 1:
        return NAN
    return float(max(0, bisect.bisect_left(edges, value) - 1))


def expanding(df: DataFrame, c: str, low: float = 0.05, high: float = 0.95, q: int = 5, least: int = LEAST, full: bool = False) -> DataFrame:
    """Rank, quantile bounds, median, MAD and quantile label of the current value in its history."""
    names = ["pit_rank", "pit_low", "pit_high", "pit_median", "pit_mad", "pit_bin"]

    def one(v: list[float], x: float) -> tuple:
        left, right = bisect.bisect_left(v, x), bisect.bisect_right(v, x)
        median = _quantile(v, 0.5)
        return (left + right + 1) / 2, _quantile(v, low), _quantile(v, high), median, _deviation(v, median), qcut(v, x, q, full)

    return apply(df, lambda d: _columns(_history(d[c], least, one), names), names, [c])


def positions(df: DataFrame, c: str, q: int = 5, least: int = LEAST) -> DataFrame:
    """+1 in the top bin of the history, -1 in the bottom one, else 0, after ``least`` values.

    There are as many bins as distinct values, ``q`` at most; where repeated edges
    leave fewer, there is no top bin.
    """
    def kernel(d: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        held: list[float] = []
        known: set[float] = set()
        out = np.zeros(len(d[c]))
        for i, x in enumerate(d[c].tolist()):
            if x != x:
                continue
            bisect.insort(held, x)
            if len(known) < q:
                known.add(x)
            bins = min(q, len(known))
            if len(held) > least and bins > 1:
                k = qcut(held, x, bins)
                out[i] = 1.0 if k == bins - 1 else -1.0 if k == 0 else 0.0
        return {"position": out}

    return apply(df, kernel, ["position"], [c])


def rank_rows(v: np.ndarray) -> np.ndarray:
    """Average ranks from 1 within each row."""
    return (v[:, :, None] > v[:, None, :]).sum(axis=2) + ((v[:, :, None] == v[:, None, :]).sum(axis=2) + 1) / 2


def rolling_rank_corr(df: DataFrame, a: str, b: str, n: int, stride: int = 1) -> DataFrame:
    """Spearman correlation over every ``stride``-th window of ``n`` rows; null for constant or incomplete ones."""
    def kernel(d: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = np.full(len(d[a]), NAN)
        if len(out) < n:
            return {"rank_corr": out}
        x, y = (np.lib.stride_tricks.sliding_window_view(d[k], n)[::stride] for k in (a, b))
        at = np.arange(n - 1, len(out), stride)
        whole = np.flatnonzero(np.isfinite(x).all(axis=1) & np.isfinite(y).all(axis=1))
        some = max(1, (1 << 22) // (n * n))  # windows at a time: a square of ranks each
        for k in range(0, len(whole), some):
            rows = whole[k : k + some]
            rx, ry = rank_rows(x[rows]), rank_rows(y[rows])
            rx, ry = rx - rx.mean(axis=1, keepdims=True), ry - ry.mean(axis=1, keepdims=True)
            spread = np.sqrt((rx * rx).sum(axis=1) * (ry * ry).sum(axis=1))
            out[at[rows]] = np.where(spread > 0, (rx * ry).sum(axis=1) / np.where(spread > 0, spread, 1), NAN)
        return {"rank_corr": out}

    return apply(df, kernel, ["rank_corr"], [a, b])


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks from 1."""
    _, inverse, n = np.unique(x, return_inverse=True, return_counts=True)
    upto = np.cumsum(n)
    return (upto - (n - 1) / 2)[inverse]


def turnover(df: DataFrame, position: str = "position") -> DataFrame:
    """Absolute change of position from the row before, 0 at the first."""
    return df.withColumn("turnover", F.coalesce(F.abs(F.col(position) - R.lag(position)), F.lit(0.0)))


def constant_so_far(c: str) -> Column:
    return F.min(c).over(R.running()) >= F.max(c).over(R.running())


def coverage_so_far(c: str) -> Column:
    return F.count(c).over(R.running()) / R.row_no()
