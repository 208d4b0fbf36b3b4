"""Recursive kernels, candles and selection against plain loops and known values."""

import math

import numpy as np
import pytest

from barloom.operators import recursive as K
from barloom.operators import selection as X
from barloom.operators import splits


@pytest.fixture
def bars():
    rng = np.random.default_rng(42)
    close = 100 + np.cumsum(rng.normal(size=300))
    open_ = close + rng.normal(size=300) * 0.3
    return {"open": open_, "close": close, "high": np.maximum(open_, close) + rng.random(300), "low": np.minimum(open_, close) - rng.random(300), "volume": rng.integers(1, 100, 300).astype(float)}


def test_ema_seeds(bars):
    x, n = bars["close"], 10
    a = 2 / 11
    want = [x[:n].mean()]
    for v in x[n:]:
        want.append(want[-1] + a * (v - want[-1]))
    got = K.ema(x, n)
    assert np.isnan(got[: n - 1]).all() and np.allclose(got[n - 1 :], want)
    first = [x[0]]
    for v in x[1:]:
        first.append(first[-1] + a * (v - first[-1]))
    got = K.ema(x, n, "first")
    assert np.isnan(got[: n - 1]).all() and np.allclose(got[n - 1 :], first[n - 1 :])
    assert np.isnan(K.ema(x[:5], 10)).all()


def test_wilder_rsi(bars):
    x, n = bars["close"], 14
    d = np.diff(x)
    up, down = np.maximum(d, 0), np.maximum(-d, 0)
    u, w = up[:n].mean(), down[:n].mean()
    want = [100 * u / (u + w)]
    for a, b in zip(up[n:], down[n:], strict=True):
        u, w = (u * (n - 1) + a) / n, (w * (n - 1) + b) / n
        want.append(100 * u / (u + w))
    got = K.rsi(x, n)
    assert np.isnan(got[:n]).all() and np.allclose(got[n:], want)
    assert np.allclose(K.cmo(x, n)[n:], 2 * got[n:] - 100)
    assert (K.rsi(np.arange(30.0))[14:] == 100).all() and (K.rsi(np.ones(30))[14:] == 0).all()


def test_directional_bounds(bars):
    out = K.directional(bars["high"], bars["low"], bars["close"], 14)
    for name in ("plus_di", "minus_di", "dx", "adx", "adxr"):
        v = out[name][~np.isnan(out[name])]
        assert len(v) and (v >= 0).all() and (v <= 100).all()
    assert np.flatnonzero(~np.isnan(out["adx"]))[0] == 27


def test_sar_stays_on_its_side(bars):
    stop = K.sarext(bars["high"], bars["low"])
    for i in range(2, 300):
        if stop[i] > 0 and stop[i - 1] > 0:
            assert stop[i] <= bars["low"][i]
    assert np.allclose(np.abs(stop[1:]), K.sar(bars["high"], bars["low"])[1:])


def test_means_of_a_constant_are_constant():
    x = np.full(300, 7.0)
    for kind in (0, 1, 2, 3, 4, 5, 6, 8):
        v = K.moving(x, 10, kind)
        assert np.allclose(v[~np.isnan(v)], 7) and (~np.isnan(v)).sum() > 200
    line, signal, hist = K.macd(x)
    assert np.allclose(hist[40:], 0) and np.allclose(K.trix(x, 10)[60:], 0)
    with pytest.raises(ValueError):
        K.moving(x, 10, 7)


def test_hilbert_finds_a_period():
    x = 100 + 5 * np.sin(2 * np.pi * np.arange(400) / 20)
    period = K.cycle(x)["dc_period"]
    assert abs(np.median(period[200:]) - 20) < 2


def test_klinger_measure(bars):
    v = K.klinger(bars["high"], bars["low"], bars["close"], bars["volume"])
    assert np.isnan(v[:54]).all() and np.isfinite(v[60:]).all()


def test_entropies():
    rng = np.random.default_rng(1)
    noise, ramp = rng.normal(size=200), np.arange(200.0)
    assert K.shannon(np.ones(10)) == 0 and abs(K.shannon(np.arange(10.0)) - math.log2(10)) < 1e-9
    assert K.permutation_entropy(ramp) == 0 < K.permutation_entropy(noise) <= 1
    assert K.approximate_entropy(ramp) < K.approximate_entropy(noise)
    assert K.sample_entropy(np.sin(ramp)) < K.sample_entropy(noise)
    assert abs(K.higuchi(ramp) - 1) < 0.05 and K.higuchi(noise) > 1.8
    assert math.isnan(K.hurst(noise[:10])) and 0.3 < K.hurst(noise) < 0.8


def test_fractional_difference():
    x = np.cumsum(np.random.default_rng(3).normal(size=400))
    assert np.allclose(K.fracdiff(x, 1.0)[1:], np.diff(x)) and np.allclose(K.fracdiff(x, 0.0), x)
    assert np.allclose(K.fracdiff_weights(0.5)[:4], [1, -0.5, -0.125, -0.0625])
    d = K.least_difference(x)
    assert 0 < d <= 1 and K.adf(K.fracdiff(x, d)) < K.ADF_5


def test_selection_algebra():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(500, 3))
    data = np.column_stack([base, base[:, 0] + 0.01 * rng.normal(size=500)])
    corr, cov = np.corrcoef(data.T), np.cov(data.T, ddof=0)
    assert X.greedy(corr, [1, 0.5, 0.4, 0.9], 0.7) == [0, 1, 2]
    assert len(X.vif_filter(corr, 10)) == 3 and X.clusters(corr)[0] == X.clusters(corr)[3]
    w, bad = X.orthogonal_weights(cov)
    got = np.cov((data @ w).T, ddof=0)
    assert np.allclose(got - np.diag(np.diag(got)), 0, atol=1e-9) and not any(bad)
    vectors, share = X.principal(cov)
    assert np.allclose(vectors.T @ vectors, np.eye(4)) and abs(share.sum() - 1) < 1e-12
    found = X.attribution(cov, data.mean(axis=0))
    assert abs(found["beta"][0] - 1) < 0.01 and found["r2"] > 0.99
    assert abs(X.normal_ppf(0.975) - 1.959964) < 1e-6
    low, high = X.block_bootstrap(data[:, 0], 10, 200, 1)
    assert low <= data[:, 0].mean() <= high


def test_splits():
    assert splits.out_of_time(10, 0.3) == ((0, 7), (7, 10))
    assert splits.expanding(10, 4) == [((0, 2), (2, 4)), ((0, 4), (4, 6)), ((0, 6), (6, 8)), ((0, 8), (8, 10))]
    for train, test in splits.purged(200, 4, 5, 0.1):
        assert train[1] + 5 <= test[0]
    assert list(splits.walk_forward(20, 8, 4, 4, 1)) == [((0, 8), (9, 13)), ((4, 12), (13, 17))]
    paths = splits.combinatorial(60, 6, 2, 2, 3)
    assert len(paths) == 15
    for train, test in paths:
        for a, b in test:
            assert all(d <= a - 2 or c >= min(b + 3, 60) for c, d in train)
    assert len(splits.symmetric_halves(6)) == 20 and splits.sliding_windows(10, 4, 1) == [0, 1, 2, 3, 4, 5]
    assert splits.sequence("fibonacci", 3, 40, (14,)) == [3, 5, 8, 13, 14, 21, 34]
