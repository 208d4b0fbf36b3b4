"""Recursive indicators: one numpy pass over each symbol's ordered bars.

A recursion can't be a bounded window, so these run as grouped maps: a task holds
one symbol's bars (its history, not the table).  Kernels take and give arrays of
doubles; the warm-up is NaN inside a kernel and null in the result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

NAN = np.nan


def apply(bars: DataFrame, kernel: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], outputs: list[str], inputs: list[str], keys: list[str] | None = None) -> DataFrame:
    """``keys``, ``ts`` and the kernel's outputs for each bar."""
    keys = keys or ["symbol"]
    types = {f.name: f.dataType.simpleString() for f in bars.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        out = kernel({c: pdf[c].to_numpy(float) for c in inputs})
        return pd.DataFrame({**{k: pdf[k].to_numpy() for k in (*keys, "ts")}, **{o: np.where(np.isfinite(out[o]), out[o], NAN) for o in outputs}})

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"ts {types['ts']}", *(f"{o} double" for o in outputs)])
    found = bars.select(*keys, "ts", *inputs).groupBy(*keys).applyInPandas(run, schema)
    return found.replace(float("nan"), None, subset=outputs)


def ema(x: np.ndarray, n: int, seed: str = "sma", alpha: float | None = None) -> np.ndarray:
    """Exponential mean from the first valid value: seeded by a mean of ``n``, or by the first value with n - 1 masked."""
    a = 2 / (n + 1) if alpha is None else alpha
    out = np.full(len(x), NAN)
    valid = np.flatnonzero(~np.isnan(x))
    if len(valid) < n:
        return out
    k = valid[0]
    if seed == "sma":
        value, at = x[k : k + n].mean(), k + n - 1
    else:
        value, at = x[k], k
    if at >= k + n - 1:
        out[at] = value
    for i in range(at + 1, len(x)):
        value += a * (x[i] - value)
        if i >= k + n - 1:
            out[i] = value
    return out


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's mean: seeded by a mean of ``n``, then weight 1 / n."""
    return ema(x, n, alpha=1 / n)


def wilder_sum(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's running sum: seeded by n - 1 terms, each step lets go of one part in ``n``."""
    out = np.full(len(x), NAN)
    k = np.flatnonzero(~np.isnan(x))
    if len(k) < n:
        return out
    k = k[0]
    value = x[k : k + n - 1].sum()
    for i in range(k + n - 1, len(x)):
        value += x[i] - value / n
        out[i] = value
    return out


def dema(x: np.ndarray, n: int) -> np.ndarray:
    e = ema(x, n)
    return 2 * e - ema(e, n)


def tema(x: np.ndarray, n: int) -> np.ndarray:
    e = ema(x, n)
    ee = ema(e, n)
    return 3 * e - 3 * ee + ema(ee, n)


def t3(x: np.ndarray, n: int = 5, v: float = 0.7) -> np.ndarray:
    e = [x]
    for _ in range(6):
        e.append(ema(e[-1], n))
    return -(v**3) * e[6] + (3 * v**2 + 3 * v**3) * e[5] + (-6 * v**2 - 3 * v - 3 * v**3) * e[4] + (1 + 3 * v + v**3 + 3 * v**2) * e[3]


def kama(x: np.ndarray, n: int = 30) -> np.ndarray:
    fast, slow = 2 / 3, 2 / 31
    out = np.full(len(x), NAN)
    if len(x) <= n:
        return out
    step = np.abs(np.diff(x, prepend=x[0]))
    value = x[n - 1]
    for i in range(n, len(x)):
        noise = step[i - n + 1 : i + 1].sum()
        ratio = abs(x[i] - x[i - n]) / noise if noise else 1.0
        value += (min(ratio, 1.0) * (fast - slow) + slow) ** 2 * (x[i] - value)
        out[i] = value
    return out


def macd(x: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, signal and histogram; both means start where the slow one does."""
    lead = np.full(len(x), NAN)
    lead[slow - fast :] = x[slow - fast :]
    line = ema(lead, fast) - ema(x, slow)
    sig = ema(line, signal)
    return np.where(np.isnan(sig), NAN, line), sig, line - sig


def rsi(x: np.ndarray, n: int = 14) -> np.ndarray:
    d = np.diff(x, prepend=NAN)
    up, down = wilder(np.where(np.isnan(d), NAN, np.maximum(d, 0)), n), wilder(np.where(np.isnan(d), NAN, np.maximum(-d, 0)), n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(up + down > 0, 100 * up / (up + down), np.where(np.isnan(up), NAN, 0.0))


def cmo(x: np.ndarray, n: int = 14) -> np.ndarray:
    return 2 * rsi(x, n) - np.where(np.isnan(rsi(x, n)), NAN, 100.0)


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate([[NAN], close[:-1]])
    out = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    return out


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    return wilder(true_range(high, low, close), n)


def directional(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> dict[str, np.ndarray]:
    """+DM, -DM, +DI, -DI, DX, ADX and ADXR."""
    up, down = np.diff(high, prepend=NAN), -np.diff(low, prepend=NAN)
    plus = np.where(np.isnan(up), NAN, np.where((up > down) & (up > 0), up, 0.0))
    minus = np.where(np.isnan(up), NAN, np.where((down > up) & (down > 0), down, 0.0))
    pdm, mdm, tr = wilder_sum(plus, n), wilder_sum(minus, n), wilder_sum(true_range(high, low, close), n)
    with np.errstate(invalid="ignore", divide="ignore"):
        pdi, mdi = np.where(tr > 0, 100 * pdm / tr, 0.0), np.where(tr > 0, 100 * mdm / tr, 0.0)
        pdi[: n] = mdi[: n] = NAN
        dx = np.where(pdi + mdi > 0, 100 * np.abs(pdi - mdi) / (pdi + mdi), np.where(np.isnan(pdi), NAN, 0.0))
    adx = wilder(dx, n)
    before = np.concatenate([np.full(n - 1, NAN), adx])[: len(adx)]
    return {"plus_dm": pdm, "minus_dm": mdm, "plus_di": pdi, "minus_di": mdi, "dx": dx, "adx": adx, "adxr": (adx + before) / 2}


def sar(high: np.ndarray, low: np.ndarray, start: float = 0.02, most: float = 0.2) -> np.ndarray:
    """Parabolic stop and reverse."""
    return np.abs(sarext(high, low, 0.0, 0.0, start, start, most, start, start, most))


def sarext(high: np.ndarray, low: np.ndarray, first: float = 0.0, offset: float = 0.0, start_l: float = 0.02, step_l: float = 0.02, most_l: float = 0.2, start_s: float = 0.02, step_s: float = 0.02, most_s: float = 0.2) -> np.ndarray:
    """The same with accelerations of its own for each side; short stops are negative."""
    out = np.full(len(high), NAN)
    if len(high) < 2:
        return out
    up, down = high[1] - high[0], low[0] - low[1]
    long = not (down > up and down > 0) if first == 0 else first > 0
    stop = abs(first) or (low[0] if long else high[0])
    extreme, speed = (high[1], start_l) if long else (low[1], start_s)
    before_low, before_high = low[1], high[1]
    for i in range(1, len(high)):
        last_low, last_high, before_low, before_high = before_low, before_high, low[i], high[i]
        if long:
            if low[i] <= stop:
                long = False
                stop = max(extreme, last_high, high[i])
                stop += stop * offset
                out[i] = -stop
                speed, extreme = start_s, low[i]
                stop = max(stop + speed * (extreme - stop), last_high, high[i])
            else:
                out[i] = stop
                if high[i] > extreme:
                    extreme, speed = high[i], min(speed + step_l, most_l)
                stop = min(stop + speed * (extreme - stop), last_low, low[i])
        elif high[i] >= stop:
            long = True
            stop = min(extreme, last_low, low[i])
            stop -= stop * offset
            out[i] = stop
            speed, extreme = start_l, high[i]
            stop = min(stop + speed * (extreme - stop), last_low, low[i])
        else:
            out[i] = -stop
            if low[i] < extreme:
                extreme, speed = low[i], min(speed + step_s, most_s)
            stop = max(stop + speed * (extreme - stop), last_high, high[i])
    return out


def trix(x: np.ndarray, n: int = 30) -> np.ndarray:
    e = ema(ema(ema(x, n), n), n)
    before = np.concatenate([[NAN], e[:-1]])
    return 100 * (e / before - 1)


def adosc(high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray, fast: int = 3, slow: int = 10) -> np.ndarray:
    """Fast less slow mean of the accumulation line; both start at its first value."""
    span = high - low
    with np.errstate(invalid="ignore", divide="ignore"):
        ad = np.cumsum(np.where(span > 0, ((close - low) - (high - close)) / span * volume, 0.0))
    out = ema(ad, fast, "first") - ema(ad, slow, "first")
    return out


def moving(x: np.ndarray, n: int, kind: int) -> np.ndarray:
    """Moving means by number: simple, exponential, weighted, double, triple, triangular, Kaufman, (none), T3."""
    s = pd.Series(x)
    if kind == 0:
        return s.rolling(n).mean().to_numpy()
    if kind == 2:
        weights = np.arange(1, n + 1)
        return s.rolling(n).apply(lambda v: v @ weights / weights.sum(), raw=True).to_numpy()
    if kind == 5:
        a, b = (n // 2, n // 2 + 1) if n % 2 == 0 else ((n + 1) // 2,) * 2
        return s.rolling(a).mean().rolling(b).mean().to_numpy()
    found = {1: ema, 3: dema, 4: tema, 6: kama, 8: t3}.get(kind)
    if found is None:
        raise ValueError(f"unknown kind of moving mean: {kind}")
    return found(x, n)


def macdext(x: np.ndarray, fast: int = 12, fast_kind: int = 0, slow: int = 26, slow_kind: int = 0, signal: int = 9, signal_kind: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    line = moving(x, fast, fast_kind) - moving(x, slow, slow_kind)
    sig = moving(line, signal, signal_kind)
    return np.where(np.isnan(sig), NAN, line), sig, line - sig


def stochrsi(x: np.ndarray, n: int = 14, k: int = 5, d: int = 3) -> tuple[np.ndarray, np.ndarray]:
    r = pd.Series(rsi(x, n))
    low, high = r.rolling(k).min(), r.rolling(k).max()
    fast = (100 * (r - low) / (high - low)).where(high > low, np.where(high.isna(), NAN, 0.0))
    return fast.to_numpy(), fast.rolling(d).mean().to_numpy()


def klinger(high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray, fast: int = 34, slow: int = 55) -> np.ndarray:
    """Volume force by trend, its fast less its slow mean."""
    price, span = high + low + close, high - low
    trend = np.where(np.diff(price, prepend=NAN) > 0, 1.0, -1.0)
    held = np.zeros(len(price))
    force = np.full(len(price), NAN)
    for i in range(1, len(price)):
        same = i > 1 and trend[i] == trend[i - 1]
        held[i] = held[i - 1] + span[i] if same else span[i - 1] + span[i]
        force[i] = volume[i] * abs(2 * (span[i] / held[i] - 1)) * trend[i] * 100 if held[i] else 0.0
    return ema(force, fast, "first") - ema(force, slow, "first")


def keltner(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 20, k: float = 2.0) -> np.ndarray:
    """Width of the channel over its middle."""
    return 2 * k * atr(high, low, close, n) / ema(close, n)


# Hilbert transform family

_HILBERT = (0.0962, 0.5769)  # fixed values: the transform's weights


def hilbert(x: np.ndarray) -> dict[str, np.ndarray]:
    """Dominant cycle by a homodyne discriminator: period, smoothed period, in-phase and quadrature parts, smoothed price."""
    n = len(x)
    a, b = _HILBERT
    smooth = np.zeros(n)
    for i in range(3, n):
        smooth[i] = (4 * x[i] + 3 * x[i - 1] + 2 * x[i - 2] + x[i - 3]) / 10
    detrended, q1, i1, ji, jq, i2, q2, re, im, period, settled = (np.zeros(n) for _ in range(11))
    for i in range(6, n):
        back = lambda v, k: v[i - k] if i >= k else 0.0  # noqa: B023, E731
        turn = lambda v: (a * back(v, 0) + b * back(v, 2) - b * back(v, 4) - a * back(v, 6)) * (0.075 * period[i - 1] + 0.54)  # noqa: B023, E731
        detrended[i] = turn(smooth)
        q1[i], i1[i] = turn(detrended), back(detrended, 3)
        ji[i], jq[i] = turn(i1), turn(q1)
        i2[i] = 0.2 * (i1[i] - jq[i]) + 0.8 * i2[i - 1]
        q2[i] = 0.2 * (q1[i] + ji[i]) + 0.8 * q2[i - 1]
        re[i] = 0.2 * (i2[i] * i2[i - 1] + q2[i] * q2[i - 1]) + 0.8 * re[i - 1]
        im[i] = 0.2 * (i2[i] * q2[i - 1] - q2[i] * i2[i - 1]) + 0.8 * im[i - 1]
        p = 2 * np.pi / np.arctan(im[i] / re[i]) if im[i] and re[i] else period[i - 1]
        before = period[i - 1]
        p = min(max(p, 0.67 * before), 1.5 * before) if before else p
        period[i] = 0.2 * min(max(p, 6), 50) + 0.8 * before
        settled[i] = 0.33 * period[i] + 0.67 * settled[i - 1]
    return {"period": period, "settled": settled, "in_phase": i1, "quadrature": q1, "smooth": smooth}


def cycle(x: np.ndarray) -> dict[str, np.ndarray]:
    """Dominant cycle period and phase, phasor, sine and lead sine, trend line and trend mode."""
    h = hilbert(x)
    n = len(x)
    phase, sine, lead, line, mode = np.full(n, NAN), np.full(n, NAN), np.full(n, NAN), np.full(n, NAN), np.full(n, NAN)
    means: list[float] = []
    days, before = 0, 0.0
    for i in range(n):
        span = int(h["settled"][i] + 0.5)
        k = max(1, min(span, i + 1))
        means.append(x[i - k + 1 : i + 1].mean() if span else x[i])
        if i < 12:
            continue
        at = np.arange(span)
        w = h["smooth"][i - at] if span <= i else h["smooth"][max(0, i - span + 1) : i + 1][::-1]
        angle = 2 * np.pi * at[: len(w)] / max(span, 1)
        real, imag = float((np.sin(angle) * w).sum()), float((np.cos(angle) * w).sum())
        p = np.degrees(np.arctan(real / imag)) if abs(imag) > 0.001 else 90.0 * np.sign(real)
        p += 90 + 360 / h["settled"][i] if h["settled"][i] else 90
        if imag < 0:
            p += 180
        phase[i] = p - 360 if p > 315 else p
        sine[i], lead[i] = np.sin(np.radians(phase[i])), np.sin(np.radians(phase[i] + 45))
        line[i] = (4 * means[i] + 3 * means[i - 1] + 2 * means[i - 2] + means[i - 3]) / 10
        crossed = not np.isnan(sine[i - 1]) and (sine[i] - lead[i]) * (sine[i - 1] - lead[i - 1]) < 0
        days = 0 if crossed else days + 1
        trend = days >= 0.5 * h["settled"][i]
        turn = phase[i] - before
        if h["settled"][i] and 0.67 * 360 / h["settled"][i] < turn < 1.5 * 360 / h["settled"][i]:
            trend = False
        if line[i] and abs((h["smooth"][i] - line[i]) / line[i]) >= 0.015:
            trend = True
        before, mode[i] = phase[i], float(trend)
    late = np.arange(n) < 32
    late2 = np.arange(n) < 63
    mask = lambda v, m: np.where(m, NAN, v)
    return {
        "dc_period": mask(h["settled"], late), "dc_phase": mask(phase, late2), "in_phase": mask(h["in_phase"], late), "quadrature": mask(h["quadrature"], late),
        "sine": mask(sine, late2), "lead_sine": mask(lead, late2), "trendline": mask(line, late2), "trend_mode": mask(mode, late2),
    }


def mama(x: np.ndarray, fast: float = 0.5, slow: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Mean adapted to the rate of change of phase, and its follower."""
    h = hilbert(x)
    m = f = x[0] if len(x) else 0.0
    out, follow, before = np.full(len(x), NAN), np.full(len(x), NAN), 0.0
    for i in range(len(x)):
        i1, q1 = h["in_phase"][i], h["quadrature"][i]
        phase = np.degrees(np.arctan(q1 / i1)) if i1 else 0.0
        alpha = min(max(fast / max(before - phase, 1.0), slow), fast)
        before = phase
        m += alpha * (x[i] - m)
        f += 0.5 * alpha * (m - f)
        if i >= 32:
            out[i], follow[i] = m, f
    return out, follow


# Entropy and fractal features over a window


def windowed(x: np.ndarray, n: int, f: Callable[[np.ndarray], np.ndarray], rows: int = 2048) -> np.ndarray:
    """``f`` of the windows of ``n`` values without a gap, as rows of matrices of ``rows`` windows at most."""
    out = np.full(len(x), NAN)
    if len(x) < n:
        return out
    v = np.lib.stride_tricks.sliding_window_view(x, n)
    gaps = np.concatenate([[0], np.cumsum(np.isnan(x))])
    full = np.flatnonzero(gaps[n:] == gaps[:-n])
    for k in range(0, len(full), rows):
        at = full[k : k + rows]
        out[at + n - 1] = f(v[at])
    return out


def _share_entropy(counts: np.ndarray) -> np.ndarray:
    """Entropy in bits of each row's counts."""
    p = counts / counts.sum(axis=1, keepdims=True)
    return -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0.0).sum(axis=1)


def _counts(codes: np.ndarray, kinds: int) -> np.ndarray:
    """How often each code stands in each row."""
    flat = codes + kinds * np.arange(len(codes))[:, None]
    return np.bincount(flat.reshape(-1), minlength=kinds * len(codes)).reshape(len(codes), kinds)


def shannon_rows(v: np.ndarray, bins: int = 10) -> np.ndarray:
    """Entropy over equal bins between each row's extremes, closed on the left but for the last."""
    low, high = v.min(axis=1, keepdims=True), v.max(axis=1, keepdims=True)
    edges = np.linspace(low[:, 0], high[:, 0], bins + 1, axis=1)
    at = np.zeros(v.shape, np.int64)
    for k in range(1, bins):
        at += v >= edges[:, k : k + 1]
    return np.where(low[:, 0] == high[:, 0], 0.0, _share_entropy(_counts(at, bins)))


def permutation_rows(v: np.ndarray, m: int = 3) -> np.ndarray:
    order = np.argsort(np.lib.stride_tricks.sliding_window_view(v, m, axis=1), axis=2, kind="stable")
    return _share_entropy(_counts(order @ (m ** np.arange(m)), m**m)) / np.log2(np.prod(np.arange(1, m + 1)))


def _matches(v: np.ndarray, m: int, r: np.ndarray, own: bool) -> np.ndarray:
    """For each row and stretch of ``m``, the stretches of the row within the row's tolerance."""
    t = np.lib.stride_tricks.sliding_window_view(v, m, axis=1)
    near = np.abs(t[:, :, None, 0] - t[:, None, :, 0]) <= r[:, None, None]
    for k in range(1, m):
        near &= np.abs(t[:, :, None, k] - t[:, None, :, k]) <= r[:, None, None]
    return near.sum(axis=2) - (0 if own else 1)


def approximate_rows(v: np.ndarray, m: int = 2, r: float = 0.2) -> np.ndarray:
    tolerance = r * v.std(axis=1)
    phi = [np.log(_matches(v, k, tolerance, True) / (v.shape[1] - k + 1)).mean(axis=1) for k in (m, m + 1)]
    return np.where(tolerance == 0, 0.0, phi[0] - phi[1])


def sample_rows(v: np.ndarray, m: int = 2, r: float = 0.2) -> np.ndarray:
    tolerance = r * v.std(axis=1)
    b, a = _matches(v[:, :-1], m, tolerance, False).sum(axis=1), _matches(v, m + 1, tolerance, False).sum(axis=1)
    some = (a > 0) & (b > 0)
    return np.where(tolerance == 0, 0.0, np.where(some, -np.log(np.where(some, a, 1) / np.where(some, b, 1)), NAN))


def hurst_rows(v: np.ndarray) -> np.ndarray:
    """Slope of log rescaled range on log size; null for poor fits and short windows."""
    n = v.shape[1]
    if n < 20:
        return np.full(len(v), NAN)
    sizes = [s for s in (n // 8, n // 4, n // 2, n) if s >= 4]
    y = np.full((len(v), len(sizes)), NAN)
    for k, s in enumerate(sizes):
        part = v[:, : n // s * s].reshape(len(v), n // s, s)
        walk = np.cumsum(part - part.mean(axis=2, keepdims=True), axis=2)
        spread = part.std(axis=2)
        ok = spread > 0
        scaled = np.where(ok, (walk.max(axis=2) - walk.min(axis=2)) / np.where(ok, spread, 1), 0.0).sum(axis=1)
        many = ok.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            y[:, k] = np.where(many > 0, np.log(scaled / np.maximum(many, 1)), NAN)
    known = np.isfinite(y)
    x, y, m = np.where(known, np.log(sizes), 0.0), np.where(known, y, 0.0), known.sum(axis=1)
    least = np.maximum(m, 1)
    dx, dy = np.where(known, x - (x.sum(axis=1) / least)[:, None], 0.0), np.where(known, y - (y.sum(axis=1) / least)[:, None], 0.0)
    sxx, sxy, syy = (dx * dx).sum(axis=1), (dx * dy).sum(axis=1), (dy * dy).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = sxy / sxx
        fit = np.where(syy > 0, sxy * slope / syy, 0.0)
    return np.where((m >= 3) & (fit >= 0.1), slope, NAN)


def higuchi_rows(v: np.ndarray, most: int = 8) -> np.ndarray:
    """Fractal dimension by curve lengths at steps 1..most."""
    n, lengths = v.shape[1], []
    for k in range(1, most + 1):
        each = []
        for m in range(k):
            steps = (n - 1 - m) // k
            if steps > 0:
                each.append(np.abs(np.diff(v[:, m::k], axis=1)).sum(axis=1) * (n - 1) / (steps * k) / k)
        lengths.append(np.mean(each, axis=0))
    y = np.array(lengths).T
    x = np.log(1 / np.arange(1, most + 1))
    dx = x - x.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (np.log(y) * dx).sum(axis=1) / (dx * dx).sum()
    return np.where(y.min(axis=1) > 0, slope, NAN)


def _of_one(rows: Callable) -> Callable[[np.ndarray], float]:
    """The same feature of a single window."""
    return lambda v, **parameters: float(rows(np.asarray(v, float)[None], **parameters)[0]) if len(v) else NAN


shannon, permutation_entropy, hurst, higuchi = map(_of_one, (shannon_rows, permutation_rows, hurst_rows, higuchi_rows))
approximate_entropy, sample_entropy = map(_of_one, (approximate_rows, sample_rows))


def vpin(close: np.ndarray, volume: np.ndarray, windows: tuple[int, ...] = (30, 50), zscores: tuple[int, ...] = (21, 55)) -> dict[str, np.ndarray]:
    """Rolling imbalance of bulk-classified volume over volume, and z-scores of the first window's.

    A change of price is taken in deviations over the longest window; without a
    deviation, volume is half bought.
    """
    from math import erf, sqrt

    d = pd.Series(close).diff().fillna(0.0)
    spread = d.rolling(max(windows)).std().fillna(0.0)
    z = (d / spread.where(spread.abs() > EPSILON)).fillna(0.0)
    share = z.map(lambda v: 0.5 * (1 + erf(v / sqrt(2)))).where(spread != 0, 0.5)
    v = pd.Series(volume)
    gap = (2 * share * v - v).abs()
    out = {}
    for n in windows:
        total = v.rolling(n).sum()
        out[f"vpin_{n}"] = gap.rolling(n).sum() / total.where(total.abs() > EPSILON) if (spread != 0).any() else 0 * d
    first = out[f"vpin_{windows[0]}"]
    for n in zscores:
        s = first.rolling(n).std()
        out[f"vpin_zscore_{n}"] = (first - first.rolling(n).mean()) / s.where(s > EPSILON)
    return {k: x.to_numpy() for k, x in out.items()}


# Fractional differencing

EPSILON = 1e-12


def fracdiff_weights(d: float, threshold: float = 1e-5, most: int = 0) -> np.ndarray:
    """Weights of a fractional difference, the current row's first, down to ``threshold`` or ``most`` of them (0: any number)."""
    w = [1.0]
    while not most or len(w) < most:
        nxt = -w[-1] * (d - len(w) + 1) / len(w)
        if abs(nxt) < threshold:
            break
        w.append(nxt)
    return np.array(w)


def fracdiff(x: np.ndarray, d: float, threshold: float = 1e-5, most: int = 0) -> np.ndarray:
    """Fixed-width fractional difference; inner gaps are filled forward; null throughout if there are fewer values than weights."""
    w = fracdiff_weights(d, threshold, most)
    out = np.full(len(x), NAN)
    first = np.flatnonzero(~np.isnan(x))
    if len(first) >= len(w):
        k = first[0]
        full = np.convolve(pd.Series(x[k:]).ffill().to_numpy(), w)[: len(x) - k]
        full[: len(w) - 1] = NAN
        out[k:] = full
    return out


def adf(x: np.ndarray, lag: int = 1) -> float:
    """t statistic of a unit root test with a constant."""
    x = x[~np.isnan(x)]
    d = np.diff(x)
    if len(d) <= lag + 3:
        return NAN
    rows = len(d) - lag
    a = np.column_stack([np.ones(rows), x[lag:-1], *[d[lag - k : len(d) - k] for k in range(1, lag + 1)]])
    y = d[lag:]
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    rest = y - a @ beta
    spread = rest @ rest / max(rows - a.shape[1], 1) * np.linalg.pinv(a.T @ a)[1, 1]
    return float(beta[1] / np.sqrt(spread)) if spread > 0 else NAN


# Fixed value: 5 % critical value of the unit root test with a constant, large samples.
ADF_5 = -2.86


# MacKinnon's response surface of the test's p-value, with a constant: polynomials for small and large
# values of the statistic, the value between them, and the range beyond which it is 0 or 1.
_SMALL, _LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
_BETWEEN, _RANGE = -1.61, (-18.83, 2.74)


def _regressed(x: np.ndarray, d: np.ndarray, lag: int, skip: int) -> tuple[float, float]:
    """t statistic of the level and AIC of the unit root regression on ``lag`` differences, from row ``skip`` on."""
    rows = len(d) - skip
    a = np.column_stack([np.ones(rows), x[skip:-1], *[d[skip - k : len(d) - k] for k in range(1, lag + 1)]])
    y = d[skip:]
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    rest = float(((y - a @ beta) ** 2).sum())
    if rest <= 0 or rows <= a.shape[1]:
        return NAN, float("inf")
    error = rest / (rows - a.shape[1]) * np.linalg.pinv(a.T @ a)[1, 1]
    return float(beta[1] / np.sqrt(error)), rows * np.log(2 * np.pi * rest / rows) + rows + 2 * a.shape[1]


def adf_pvalue(x: np.ndarray) -> float:
    """p-value of the unit root test with a constant, its lag chosen by AIC; 1 where it can't be computed."""
    from math import erf, sqrt

    x = x[np.isfinite(x)]
    if len(x) < 20 or np.ptp(x) == 0:
        return 1.0
    d = np.diff(x)
    most = max(0, min(int(np.ceil(12 * (len(x) / 100) ** 0.25)), len(x) // 2 - 2))
    lag = min(range(most + 1), key=lambda k: _regressed(x, d, k, most)[1])
    t = _regressed(x, d, lag, lag)[0]
    if t != t:
        return 1.0
    if not _RANGE[0] <= t <= _RANGE[1]:
        return 0.0 if t < 0 else 1.0
    z = sum(c * t**k for k, c in enumerate(_SMALL if t <= _BETWEEN else _LARGE))
    return 0.5 * (1 + erf(z / sqrt(2)))


def least_difference(x: np.ndarray, precision: float = 0.02, low: float = 0.0, high: float = 1.0, level: float = 0.05, sample: int = 500, most: int = 0) -> float:
    """The least order of differencing whose last ``sample`` values pass the test, by bisection; ``high`` if none does."""
    def passes(d: float) -> bool:
        v = fracdiff(x, d, most=most)
        v = v[np.isfinite(v)]
        return len(v) >= 20 and adf_pvalue(v[-sample:]) <= level

    best = high
    while high - low > max(precision, 1e-9):
        mid = (low + high) / 2
        if passes(mid):
            best = high = mid
        else:
            low = mid
    return round(best, 4)
