"""Factor selection on k x k statistics: the data is reduced in Spark, the algebra is on the driver.

Every function takes moments or correlations of k factors (k squared numbers),
never rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators.ic import correlations


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    out, at = np.eye(len(columns)), {c: k for k, c in enumerate(columns)}
    for r in correlations(df, columns).collect():
        out[at[r["a"]], at[r["b"]]] = out[at[r["b"]], at[r["a"]]] = 0.0 if r["r"] is None else r["r"]
    return out


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and covariance (over n) of complete rows, in one aggregation."""
    full = df.dropna(subset=columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = full.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(columns),) * 2)
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    return row["n"], np.array([row[f"m{i}"] or 0.0 for i in range(len(columns))]), cov


def greedy(corr: np.ndarray, scores: list[float], threshold: float = 0.7) -> list[int]:
    """In descending score (ties by place), factors that correlate with none kept beyond the threshold."""
    kept: list[int] = []
    for k in sorted(range(len(scores)), key=lambda i: (-abs(scores[i]), i)):
        if all(abs(corr[k, j]) <= threshold for j in kept):
            kept.append(k)
    return kept


def clusters(corr: np.ndarray, cut: float = 0.5) -> list[int]:
    """Average linkage on 1 - abs correlation, merged while below ``cut``; a label for each factor."""
    groups = [[k] for k in range(len(corr))]
    far = 1 - np.abs(corr)
    while len(groups) > 1:
        best = min(((np.mean([far[i, j] for i in a for j in b]), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y))
        if best[0] > cut:
            break
        _, x, y = best
        groups[x] += groups.pop(y)
    label = [0] * len(corr)
    for g, members in enumerate(sorted(groups, key=min)):
        for k in members:
            label[k] = g
    return label


def vif(corr: np.ndarray) -> np.ndarray:
    return np.diag(np.linalg.pinv(corr))


def vif_filter(corr: np.ndarray, most: float = 10.0) -> list[int]:
    """Drop the factor of the largest inflation until none is beyond the limit."""
    kept = list(range(len(corr)))
    while len(kept) > 1:
        v = vif(corr[np.ix_(kept, kept)])
        k = int(np.argmax(v))
        if v[k] <= most:
            break
        kept.pop(k)
    return kept


def diversification(corr: np.ndarray) -> dict[str, float]:
    off = np.abs(corr[~np.eye(len(corr), dtype=bool)])
    values = np.clip(np.linalg.eigvalsh(corr), 0, None)
    p = values[values > 0] / values.sum()
    return {"mean_abs": float(off.mean()) if len(off) else 0.0, "max_abs": float(off.max()) if len(off) else 0.0, "effective_n": float(np.exp(-(p * np.log(p)).sum()))}


def orthogonal_weights(cov: np.ndarray, eps: float = 1e-10) -> tuple[np.ndarray, list[bool]]:
    """Gram-Schmidt in order, as a matrix W: factors @ W are uncorrelated; and which are degenerate."""
    n = len(cov)
    w, bad = np.zeros((n, n)), []
    for k in range(n):
        v = np.zeros(n)
        v[k] = 1.0
        for j in range(k):
            if not bad[j]:
                u = w[:, j]
                v -= u * (u @ cov[:, k]) / (u @ cov @ u)
        bad.append(v @ cov @ v <= eps * max(cov[k, k], eps))
        w[:, k] = v
    return w, bad


def principal(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loadings (columns, signs fixed by the largest entry) and shares of variance."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    vectors = vectors[:, order]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(cov))])
    values = np.clip(values[order], 0, None)
    return vectors, values / values.sum() if values.sum() else values


def centrality(cov: np.ndarray) -> np.ndarray:
    vectors, share = principal(cov)
    return (vectors**2 * share).sum(axis=1)


def projected(df: DataFrame, columns: list[str], weights: np.ndarray, prefix: str) -> DataFrame:
    """Columns of ``df`` times a weight matrix, as ``<prefix>0..``."""
    new = {}
    for j in range(weights.shape[1]):
        terms = [F.col(c) * float(weights[i, j]) for i, c in enumerate(columns) if weights[i, j]]
        new[f"{prefix}{j}"] = sum(terms[1:], terms[0]) if terms else F.lit(0.0)
    return df.withColumns(new)


def attribution(cov: np.ndarray, means: np.ndarray) -> dict[str, np.ndarray | float]:
    """Least squares of the last variable on the others, from their moments."""
    beta = np.linalg.pinv(cov[:-1, :-1]) @ cov[:-1, -1]
    rest = cov[-1, -1] - beta @ cov[:-1, -1]
    return {"beta": beta, "alpha": float(means[-1] - beta @ means[:-1]), "r2": float(1 - rest / cov[-1, -1]) if cov[-1, -1] else 0.0}


def neutralized(df: DataFrame, factor: str, proxy: str, least: int = 10) -> DataFrame:
    """``factor`` less its full-sample beta on the proxy, per symbol; short samples stay as they are."""
    both = F.col(factor).isNotNull() & F.col(proxy).isNotNull()
    w = Window.partitionBy("symbol")
    beta = F.covar_pop(F.when(both, F.col(factor)), F.when(both, F.col(proxy))).over(w) / F.nullif(F.var_pop(F.when(both, F.col(proxy))).over(w), F.lit(0.0))
    enough = F.count(F.when(both, F.lit(1))).over(w) >= least
    return df.withColumn("neutral", F.when(enough & beta.isNotNull(), F.col(factor) - beta * F.col(proxy)).otherwise(F.col(factor)))


def exposures(df: DataFrame, position: str, factors: list[str], keys: list[str]) -> DataFrame:
    """Portfolio exposure by key: weights scaled to an absolute sum of 1, nulls as 0."""
    p = F.coalesce(F.col(position), F.lit(0.0))
    whole = F.nullif(F.sum(F.abs(p)), F.lit(0.0))
    return df.groupBy(*keys).agg(*[(F.sum(p * F.coalesce(F.col(f), F.lit(0.0))) / whole).alias(f) for f in factors])


def concentration(df: DataFrame, exposure: str, keys: list[str]) -> DataFrame:
    """Herfindahl index and largest share of absolute exposures."""
    share = F.abs(exposure) / F.nullif(F.sum(F.abs(exposure)).over(Window.partitionBy(*keys)), F.lit(0.0))
    return df.withColumn("_s", share).groupBy(*keys).agg(F.sum(F.col("_s") * F.col("_s")).alias("hhi"), F.max("_s").alias("largest"))


# Overfitting checks on period returns


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def normal_ppf(p: float) -> float:
    """Inverse of the normal distribution, by bisection and Newton steps."""
    if not 0 < p < 1:
        raise ValueError("a probability between 0 and 1 is needed")
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if normal_cdf(mid) < p else (low, mid)
    return (low + high) / 2


def normal_scores(ranks: np.ndarray) -> np.ndarray:
    return np.array([normal_ppf(r / (len(ranks) + 1)) for r in ranks])


def expected_max_sharpe(n: int) -> float:
    """Expected maximum of ``n`` standard normals."""
    g = 0.5772156649015329
    return (1 - g) * normal_ppf(1 - 1 / n) + g * normal_ppf(1 - 1 / (n * math.e)) if n > 1 else 0.0


def sharpe_stats(df: DataFrame, r: str, keys: list[str]) -> DataFrame:
    """Sharpe ratio by period (deviation over n - 1), with skewness, kurtosis (normal: 3) and count."""
    return df.where(F.col(r).isNotNull()).groupBy(*keys).agg(
        (F.avg(r) / F.nullif(F.stddev_samp(r), F.lit(0.0))).alias("sharpe"), F.skewness(r).alias("skew"), (F.kurtosis(r) + 3).alias("kurt"), F.count(F.lit(1)).alias("n")
    )


def deflated(sharpe: float, skew: float, kurt: float, n: int, trials: int, spread: float) -> float:
    """Chance that a Sharpe ratio beats the best of ``trials`` unskilled ones of variance ``spread``."""
    best = math.sqrt(spread) * expected_max_sharpe(trials)
    below = 1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2
    return normal_cdf((sharpe - best) * math.sqrt(n - 1) / math.sqrt(below)) if below > 0 else math.nan


def block_moments(df: DataFrame, r: str, candidate: str, blocks: int) -> DataFrame:
    """(candidate, block, n, s, ss): sums of returns over equal blocks of time."""
    d = df.where(F.col(r).isNotNull()).withColumn("block", F.ntile(blocks).over(Window.partitionBy(candidate).orderBy("ts")) - 1)
    return d.groupBy(candidate, "block").agg(F.count(F.lit(1)).alias("n"), F.sum(r).alias("s"), F.sum(F.col(r) * F.col(r)).alias("ss"))


def overfitting(table: DataFrame, candidate: str, blocks: int) -> dict[str, float]:
    """Probability of backtest overfitting: how often the best of one half ranks below the median in the other.

    Works on the block sums (candidates x blocks numbers).
    """
    from barloom.operators.splits import symmetric_halves

    rows = table.collect()
    names = sorted({r[candidate] for r in rows})
    at = {c: k for k, c in enumerate(names)}
    n, s, ss = (np.zeros((len(names), blocks)) for _ in range(3))
    for r in rows:
        k = at[r[candidate]], r["block"]
        n[k], s[k], ss[k] = r["n"], r["s"], r["ss"]

    def ratio(pick: tuple[int, ...]) -> np.ndarray:
        m, a, b = n[:, pick].sum(1), s[:, pick].sum(1), ss[:, pick].sum(1)
        var = (b - a * a / m) / (m - 1)
        return np.where(var > 0, a / m / np.sqrt(np.where(var > 0, var, 1)), -np.inf)

    logits = []
    for inside, outside in symmetric_halves(blocks):
        best = int(np.argmax(ratio(inside)))
        out = ratio(outside)
        rank = (out < out[best]).sum() + 1
        w = rank / (len(names) + 1)
        logits.append(math.log(w / (1 - w)))
    return {"pbo": float(np.mean([x <= 0 for x in logits])), "median_logit": float(np.median(logits)), "splits": len(logits)}


def block_bootstrap(values: np.ndarray, length: int, draws: int, seed: int, statistic=np.mean) -> tuple[float, float]:
    """95 % interval of a statistic over moving blocks, widened to hold the point estimate."""
    rng = np.random.default_rng(seed)
    n = len(values)
    k = -(-n // length)
    starts = rng.integers(0, max(1, n - length + 1), (draws, k))
    found = [statistic(values[(s[:, None] + np.arange(length)).ravel()[:n]]) for s in starts]
    low, high = np.percentile(found, [2.5, 97.5])
    point = statistic(values)
    return float(min(low, point)), float(max(high, point))
