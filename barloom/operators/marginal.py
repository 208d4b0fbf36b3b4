"""What a factor adds to others: semi-partial rank coefficients and combined factors, fitted on train rows and judged on test rows.

A task holds one symbol's rows, as for every kernel over a history.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from barloom.operators.pit import ranks

NAN = float("nan")


@dataclass(frozen=True)
class Settings:
    least_rows: int = 30
    rows_a_regressor: int = 5
    degenerate: float = 1e-10
    draws: int = 1000
    block: int = 5
    seed: int = 20260818
    weights: str = "equal"
    """``equal`` or ``ic_weighted``."""


def normal_scores(x: np.ndarray) -> np.ndarray:
    """Normal quantiles of average ranks over n + 1."""
    r = ranks(x) / (len(x) + 1)
    values, at = np.unique(r, return_inverse=True)
    inverse = NormalDist().inv_cdf
    return np.array([inverse(v) for v in values])[at]


def spearman(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) < 2 or np.ptp(a) == 0 or np.ptp(b) == 0:
        return NAN
    return float(np.corrcoef(ranks(a), ranks(b))[0, 1])


def block_interval(stat, arrays: tuple[np.ndarray, ...], s: Settings) -> tuple[float, float]:
    """95 % interval over draws of blocks of neighbouring rows, widened to hold the statistic itself."""
    n = len(arrays[0])
    if not n:
        return NAN, NAN
    b = min(s.block, n)
    starts = np.random.default_rng(s.seed).integers(0, n - b + 1, (s.draws, -(-n // b)))
    drawn = np.array([stat(*(a[at] for a in arrays)) for at in ((row[:, None] + np.arange(b)).reshape(-1)[:n] for row in starts)])
    drawn, point = drawn[np.isfinite(drawn)], stat(*arrays)
    if not len(drawn):
        return NAN, NAN
    low, high = np.quantile(drawn, [0.025, 0.975])
    return (min(low, point), max(high, point)) if np.isfinite(point) else (float(low), float(high))


def added(x: np.ndarray, basis: np.ndarray, y: np.ndarray, train: np.ndarray, test: np.ndarray, s: Settings) -> dict:
    """Rank coefficient on test rows of what ``x`` has beyond ``basis``, the projection being fitted on train rows."""
    whole = np.isfinite(x) & np.isfinite(basis).all(axis=1) & np.isfinite(y)
    train, test = train & whole, test & whole
    out = {"status": "ok", "marginal_ic": NAN, "gross_ic": NAN, "retained": NAN, "train_ic": NAN, "r2_train": NAN, "low": NAN, "high": NAN, "n_train": int(train.sum()), "n_test": int(test.sum())}
    if min(out["n_train"], out["n_test"]) < max(s.least_rows, s.rows_a_regressor * basis.shape[1], 2):
        return out | {"status": "insufficient_rows"}
    if np.ptp(y[train]) == 0 or np.ptp(y[test]) == 0:
        return out | {"status": "label_degenerate"}
    z = {k: normal_scores(x[rows]) for k, rows in (("train", train), ("test", test))}
    design = {k: np.column_stack([np.ones(rows.sum()), *(normal_scores(basis[rows, j]) for j in range(basis.shape[1]))]) for k, rows in (("train", train), ("test", test))}
    beta, *_ = np.linalg.lstsq(design["train"], z["train"], rcond=None)
    rest = {k: z[k] - design[k] @ beta for k in z}
    if rest["test"].var() <= s.degenerate:
        return out | {"status": "residual_degenerate"}
    total = ((z["train"] - z["train"].mean()) ** 2).sum()
    ic, gross = spearman(rest["test"], y[test]), spearman(x[test], y[test])
    low, high = block_interval(spearman, (rest["test"], y[test]), s)
    return out | {
        "marginal_ic": ic, "gross_ic": gross, "retained": ic / gross if abs(gross) >= 1e-12 else NAN,
        "train_ic": spearman(rest["train"], y[train]) if rest["train"].var() > s.degenerate else NAN,
        "r2_train": 1 - (rest["train"] ** 2).sum() / total if total else 0.0, "low": low, "high": high,
    }


def by_train(values: np.ndarray, y: np.ndarray, rows: np.ndarray) -> list[float]:
    """Rank coefficient of each column over rows."""
    out = []
    for j in range(values.shape[1]):
        ok = rows & np.isfinite(values[:, j]) & np.isfinite(y)
        out.append(spearman(values[ok, j], y[ok]))
    return out


_MARGINAL = "symbol string, view string, feature string, place int, status string, marginal_ic double, gross_ic double, retained double, train_ic double, r2_train double, low double, high double, n_train long, n_test long"


def marginal_ic(df: DataFrame, survivors: list[str], label: str, train: str, test: str, others: tuple[str, ...] = (), settings: Settings | None = None) -> DataFrame:
    """Three views of each symbol: every survivor beside all others (``loo``), in descending order of its train
    coefficient beside those before it (``sequential``), and factors left out beside all survivors (``removed``).

    ``train`` and ``test`` are boolean columns.
    """
    s = settings or Settings()
    if len(set(survivors)) < len(survivors):
        raise ValueError("survivors are repeated")
    names = [*survivors, *[o for o in others if o not in survivors]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        v, y = pdf[names].to_numpy(float), pdf[label].to_numpy(float)
        tr, te = pdf[train].to_numpy(bool), pdf[test].to_numpy(bool)
        k = len(survivors)
        first = by_train(v[:, :k], y, tr)
        order = sorted(range(k), key=lambda j: (-abs(first[j]) if np.isfinite(first[j]) else 0.0, survivors[j]))
        views = [("loo", j, i, [x for x in range(k) if x != j]) for i, j in enumerate(range(k))]
        views += [("sequential", j, i, order[:i]) for i, j in enumerate(order)]
        views += [("removed", j, i, list(range(k))) for i, j in enumerate(range(k, len(names)))]
        rows = [{"symbol": pdf["symbol"].iloc[0], "view": view, "feature": names[j], "place": i} | added(v[:, j], v[:, basis], y, tr, te, s) for view, j, i, basis in views]
        return pd.DataFrame(rows)[[c.split()[0] for c in _MARGINAL.split(", ")]]

    return df.select("symbol", "ts", *names, label, train, test).groupBy("symbol").applyInPandas(run, _MARGINAL).replace(NAN, None)


_COMBINED = "symbol string, status string, composite_ic double, composite_ic_train double, top_single string, top_single_ic double, best_single string, best_single_ic double, delta double, low double, high double, weights map<string,double>, n_train long, n_test long"


def combine(df: DataFrame, survivors: list[str], label: str, train: str, test: str, settings: Settings | None = None) -> DataFrame:
    """Composite of signed, weighted normal scores of each symbol's complete rows; signs and weights are those of train rows.

    Its test coefficient stands beside that of the best single factor on train rows, with an interval of the gap.
    """
    s = settings or Settings()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        v, y = pdf[survivors].to_numpy(float), pdf[label].to_numpy(float)
        whole = np.isfinite(v).all(axis=1) & np.isfinite(y)
        tr, te = pdf[train].to_numpy(bool) & whole, pdf[test].to_numpy(bool) & whole
        out = dict.fromkeys([c.split()[0] for c in _COMBINED.split(", ")]) | {"symbol": pdf["symbol"].iloc[0], "n_train": int(tr.sum()), "n_test": int(te.sum())}
        if min(tr.sum(), te.sum()) < s.least_rows:
            return pd.DataFrame([out | {"status": "insufficient_rows"}])
        first, second = by_train(v, y, tr), by_train(v, y, te)
        kept = [j for j, x in enumerate(first) if np.isfinite(x) and x != 0]
        if not kept:
            return pd.DataFrame([out | {"status": "all_zero_train_ic"}])
        total = sum(abs(first[j]) for j in kept)
        weight = {j: 1 / len(kept) if s.weights == "equal" else abs(first[j]) / total for j in kept}
        made = {k: sum(weight[j] * np.sign(first[j]) * normal_scores(v[rows, j]) for j in kept) for k, rows in (("train", tr), ("test", te))}
        top = max(kept, key=lambda j: (abs(first[j]), -j))
        finite = [j for j, x in enumerate(second) if np.isfinite(x)]
        best = max(finite, key=lambda j: (abs(second[j]), -j)) if finite else None
        ic = spearman(made["test"], y[te])
        low, high = block_interval(lambda c, f, t: spearman(c, t) - spearman(f, t), (made["test"], v[te, top], y[te]), s)
        found = {
            "status": "ok", "composite_ic": ic, "composite_ic_train": spearman(made["train"], y[tr]), "top_single": survivors[top], "top_single_ic": second[top], "delta": ic - second[top], "low": low, "high": high,
            "best_single": None if best is None else survivors[best], "best_single_ic": None if best is None else second[best], "weights": {survivors[j]: float(weight[j] * np.sign(first[j])) for j in kept},
        }
        return pd.DataFrame([out | found])

    return df.select("symbol", "ts", *survivors, label, train, test).groupBy("symbol").applyInPandas(run, _COMBINED)


def bootstrap(df: DataFrame, score: str, outcome: str, draws: int = 200, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """AUC of each symbol with a percentile interval over resampled rows; draws of one class don't count."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values("ts", kind="stable")[[score, outcome]].dropna()
        p, y = d[score].to_numpy(float), d[outcome].to_numpy(int)

        def area(p: np.ndarray, y: np.ndarray) -> float:
            n1 = int(y.sum())
            return float((ranks(p)[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))) if 0 < n1 < len(y) else NAN

        rng = np.random.default_rng(seed)
        drawn = np.array([area(p[at], y[at]) for at in (rng.integers(0, len(y), len(y)) for _ in range(draws))]) if len(y) else np.zeros(0)
        drawn = drawn[np.isfinite(drawn)]
        low, high = np.quantile(drawn, [(1 - confidence) / 2, (1 + confidence) / 2]) if len(drawn) else (NAN, NAN)
        return pd.DataFrame([(pdf["symbol"].iloc[0], len(y), area(p, y) if len(y) else NAN, low, high)], columns=["symbol", "n", "auc", "low", "high"])

    return df.select("symbol", "ts", score, outcome).groupBy("symbol").applyInPandas(run, "symbol string, n long, auc double, low double, high double")
