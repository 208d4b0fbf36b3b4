"""Screening of features and search over parameters: stages that name what they drop, grids of strategies, baselines, rules of trees."""

from __future__ import annotations

import itertools
import re
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators import backtest, ic, selection
from barloom.operators.pit import ranks

_c = F.col


def grid(parameters: dict[str, list]) -> list[dict]:
    """Every combination of the parameters' values."""
    return [dict(zip(parameters, values, strict=True)) for values in itertools.product(*parameters.values())]


_TRIALS = "symbol string, trial int, trades long, win_rate double, total_gain double, total_pnl double"


def backtest_grid(bars: DataFrame, strategies: list[dict], base: backtest.Strategy | None = None, probability: str = "p", atr: str = "atr") -> DataFrame:
    """(symbol, trial, trades, win_rate, total_gain, total_pnl): every strategy on every symbol.

    A task reads a symbol's bars once for all strategies, so bars are never multiplied by trials.
    """
    base = base or backtest.Strategy()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        series = [pdf[k].tolist() for k in ("open", "high", "low", "close", atr, probability)]
        rows = []
        for k, parameters in enumerate(strategies):
            done = backtest.simulate(*series, replace(base, **parameters))
            gains = [t[5] for t in done]
            rows.append((pdf["symbol"].iloc[0], k, len(done), float(np.mean([g > 0 for g in gains])) if gains else 0.0, float(sum(gains)), float(sum(t[7] for t in done))))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _TRIALS.split(", ")])

    return bars.select("symbol", "ts", "open", "high", "low", "close", atr, probability).groupBy("symbol").applyInPandas(run, _TRIALS)


def progress(trials: DataFrame, planned: int) -> DataFrame:
    """Complete and failed trials, their share of those planned, and the best so far."""
    return trials.agg(F.count_if(_c("state") == "complete").alias("complete"), F.count_if(_c("state") == "failed").alias("failed"), (F.count(F.lit(1)) / planned).alias("share"), F.max(F.when(_c("state") == "complete", _c("value"))).alias("best"))


def screen(df: DataFrame, features: list[str], label: str, least_coverage: float = 0.8, least_ic: float = 0.0, most_corr: float = 0.9, alpha: float = 0.05, lags: int = 4) -> DataFrame:
    """(feature, coverage, ic, t, p, q, stage): each feature with the stage that drops it (coverage, constant, ic, fdr, redundant) or ``kept``.

    Rank coefficients are means over symbols; their Newey-West t values give the p values.  What is
    gathered is a row a feature.
    """
    stats = df.agg(*[F.avg(_c(f).isNotNull().cast("int")).alias(f"n_{f}") for f in features], *[(F.max(f) > F.min(f)).alias(f"v_{f}") for f in features]).first()
    rows = []
    for f in features:
        per = ic.hac(df, f, label, lags, ["symbol"]).agg(F.avg("mean").alias("ic"), (F.sum("mean") / F.sqrt(F.sum(_c("se") * _c("se")))).alias("t")).first()
        t = per["t"]
        rows.append([f, stats[f"n_{f}"], per["ic"], t, None if t is None else 2 * (1 - selection.normal_cdf(abs(t)))])
    table = df.sparkSession.createDataFrame(rows, "feature string, coverage double, ic double, t double, p double")
    found = {r["feature"]: r for r in ic.benjamini_hochberg(table, "p", alpha).collect()}
    stage = {}
    for f in features:
        r = found[f]
        stage[f] = "coverage" if r["coverage"] < least_coverage else "constant" if not stats[f"v_{f}"] or r["ic"] is None else "ic" if abs(r["ic"]) < least_ic else "kept" if r["rejected"] else "fdr"
    left = [f for f in features if stage[f] == "kept"]
    if len(left) > 1:
        kept = selection.greedy(selection.correlation_matrix(df, left), [abs(found[f]["ic"]) for f in left], most_corr)
        stage |= {f: "redundant" for k, f in enumerate(left) if k not in kept}
    return df.sparkSession.createDataFrame([(f, found[f]["coverage"], found[f]["ic"], found[f]["t"], found[f]["p"], found[f]["q"], stage[f]) for f in features], "feature string, coverage double, ic double, t double, p double, q double, stage string")


def rolling_centrality(ics: DataFrame, columns: list[str], window: int) -> DataFrame:
    """(ts, feature, centrality): of the coefficients in the last ``window`` rows; incomplete windows are left out. A row a time is small."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        v, out = pdf[columns].to_numpy(float), []
        for i in range(window - 1, len(v)):
            part = v[i - window + 1 : i + 1]
            if np.isfinite(part).all():
                out += [(int(pdf["ts"].iloc[i]), c, float(x)) for c, x in zip(columns, selection.centrality(np.cov(part.T, ddof=0)), strict=True)]
        return pd.DataFrame(out, columns=["ts", "feature", "centrality"])

    return ics.select("ts", *columns).groupBy(F.lit(1)).applyInPandas(run, "ts long, feature string, centrality double")


def baseline(long: DataFrame, label: str = "label", draws: int = 200, seed: int = 7, alpha: float = 0.05) -> DataFrame:
    """(feature, n, auc, pr_auc, low, high, p, q, rejected) of a long table of test events (feature, event_id, value, label).

    The band and the p value are those of permuted labels; a test set of one class has none.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_id")
        x, y = pdf["value"].to_numpy(float), pdf[label].to_numpy(int)
        if not np.isfinite(x).all():
            raise ValueError(f"{pdf['feature'].iloc[0]} has values that aren't finite")
        n1, n0 = int(y.sum()), int((1 - y).sum())
        if not n1 or not n0:
            return pd.DataFrame([(pdf["feature"].iloc[0], len(y), None, None, None, None, None)], columns=names)
        r = ranks(x)
        area = lambda z: float((r[z == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))
        rng = np.random.default_rng(seed)
        null = np.array([area(rng.permutation(y)) for _ in range(draws)])
        real = area(y)
        order = np.argsort(-x, kind="stable")
        last = np.flatnonzero(np.append(x[order][1:] != x[order][:-1], True))  # rows of one score count together
        hits = np.cumsum(y[order])[last]
        pr = float((np.diff(np.concatenate([[0], hits])) * hits / (last + 1)).sum() / n1)
        low, high = np.percentile(null, [2.5, 97.5])
        p = (1 + (np.abs(null - 0.5) >= abs(real - 0.5)).sum()) / (draws + 1)
        return pd.DataFrame([(pdf["feature"].iloc[0], len(y), real, pr, low, high, p)], columns=names)

    names = ["feature", "n", "auc", "pr_auc", "low", "high", "p"]
    out = long.select("feature", "event_id", "value", label).groupBy("feature").applyInPandas(run, "feature string, n long, auc double, pr_auc double, low double, high double, p double")
    return ic.benjamini_hochberg(out, "p", alpha)


_SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-0-9.Ee+]+)\)$")


def tree_rules(df: DataFrame, features: list[str], label: str, depth: int = 3, least: int = 20, most: int = 10) -> DataFrame:
    """(rule, support, precision, lift): the paths of a decision tree as conditions, judged on all rows in one aggregation."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    full = df.dropna(subset=[*features, label]).withColumn("_y", _c(label).cast("double"))
    model = DecisionTreeClassifier(featuresCol="_x", labelCol="_y", maxDepth=depth, seed=7).fit(VectorAssembler(inputCols=features, outputCol="_x").transform(full))
    path: list[tuple[int, str]] = []
    rules = []
    for line in model.toDebugString.split("\n"):
        m = _SPLIT.match(line)
        if m:
            path = [p for p in path if p[0] < len(m[1])] + [(len(m[1]), f"`{features[int(m[3])]}` {m[4]} {m[5]}")]
        elif line.strip().startswith("Predict") and path:
            at = len(line) - len(line.lstrip())
            rules.append(" and ".join(r for k, r in path if k < at))
    rules = list(dict.fromkeys(rules))
    if not rules:
        return df.sparkSession.createDataFrame([], "rule string, support long, precision double, lift double")
    row = full.agg(F.avg("_y").alias("base"), *[F.count_if(F.expr(r)).alias(f"n{k}") for k, r in enumerate(rules)], *[F.avg(F.when(F.expr(r), _c("_y"))).alias(f"p{k}") for k, r in enumerate(rules)]).first()
    found = [(r, row[f"n{k}"], row[f"p{k}"], row[f"p{k}"] / row["base"]) for k, r in enumerate(rules) if row[f"n{k}"] >= least and row["base"]]
    return df.sparkSession.createDataFrame(sorted(found, key=lambda r: (-r[2] * r[3], r[0]))[:most], "rule string, support long, precision double, lift double")


def domain_auc(df: DataFrame, features: list[str], part: str) -> float:
    """How well boosted trees tell part 1 from part 0: 0.5 if they are alike."""
    from barloom.operators import models
    from barloom.operators.evaluate import auc

    full = df.dropna(subset=[*features, part])
    fitted, _ = models.boosted(full, features, part)
    scored = models.scored(fitted, full, features, "score").withColumn("_all", F.lit(1))
    return auc(scored, "score", part, ["_all"]).first()["auc"]


def learning_curve(train: DataFrame, test: DataFrame, features: list[str], label: str, shares: tuple[float, ...] = (0.25, 0.5, 1.0)) -> DataFrame:
    """(share, rows, auc): boosted trees fitted on the first share of each symbol's training rows, judged on the test rows."""
    from barloom.operators import models
    from barloom.operators.evaluate import auc

    w = Window.partitionBy("symbol")
    d = train.dropna(subset=[*features, label]).withColumns({"_k": F.row_number().over(w.orderBy("ts")), "_n": F.count(F.lit(1)).over(w)})
    rows = []
    for share in shares:
        part = d.where(_c("_k") <= _c("_n") * share)
        fitted, _ = models.boosted(part, features, label)
        found = auc(models.scored(fitted, test.dropna(subset=[*features, label]), features, "score").withColumn("_all", F.lit(1)), "score", label, ["_all"]).first()
        rows.append((float(share), part.count(), None if found is None else found["auc"]))
    return train.sparkSession.createDataFrame(rows, "share double, rows long, auc double")
