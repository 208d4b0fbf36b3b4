"""Feature extractors, regimes, trials and reports over bars and scored rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions import rolling as R
from barloom.operators import recursive as K

_c = F.col
EPS = 1e-10


def price_features() -> dict[str, Column]:
    o, h, low, c = (_c(k) for k in ("open", "high", "low", "close"))
    return {
        "ret_oc": c / (o + EPS) - 1, "span": (h - low) / (o + EPS), "close_position": (c - low) / (h - low + EPS), "std_ratio_5": R.std("close", 5) / (R.mean("close", 5) + EPS),
        "momentum_3": c / (R.lag("close", 3) + EPS) - 1, "upper_shadow": (h - F.greatest(o, c)) / (o + EPS), "lower_shadow": (F.least(o, c) - low) / (o + EPS), "body": F.abs(c - o) / (o + EPS),
    }


def volume_features() -> dict[str, Column]:
    v = _c("volume")
    return {
        "volume_change": v / (R.lag("volume") + EPS) - 1, "volume_ma_ratio_5": v / (R.mean("volume", 5) + EPS), "taker_value_ratio": _c("taker_buy_volume") / (v + EPS),
        "volume_close_corr_5": R.corr("volume", "close", 5), "volume_abnormal": F.coalesce((v > 2 * R.mean("volume", 20)).cast("int"), F.lit(0)),
    }


def simple_rsi(n: int = 14, c: str = "close") -> list[dict[str, Column]]:
    """RSI of plain means of gains and losses, its zones and its momentum over five rows."""
    d = _c(c) - R.lag(c)
    gain, loss = R.mean("_gain", n), R.mean("_loss", n)
    return [
        {"_gain": F.greatest(d, d * 0), "_loss": F.greatest(-d, d * 0)},
        {"rsi_simple": 100 - 100 / (1 + gain / (loss + EPS))},
        {"overbought": F.coalesce((_c("rsi_simple") > 70).cast("int"), F.lit(0)), "oversold": F.coalesce((_c("rsi_simple") < 30).cast("int"), F.lit(0)), "rsi_momentum": _c("rsi_simple") - R.lag("rsi_simple", 5)},
    ]


def line_signals(short: str, middle: str, long: str) -> dict[str, Column]:
    """States, not events: three lines in order, short over long, middle over long."""
    ok = lambda p: F.coalesce(p, F.lit(False))
    return {"three_lines": ok((_c(short) > _c(middle)) & (_c(middle) > _c(long))), "short_long": ok(_c(short) > _c(long)), "middle_long": ok(_c(middle) > _c(long))}


def ema_trio(bars: DataFrame, spans: tuple[int, int, int] = (5, 20, 60)) -> DataFrame:
    """Means of three spans seeded by the first close, distances, alignment, up-cross and three-bar slope."""
    names = [f"ema_{n}" for n in spans]
    df = K.apply(bars, lambda d: {name: K.ema(d["close"], n, "first") for name, n in zip(names, spans, strict=True)}, names, ["close"]).join(bars.select("symbol", "ts", "close"), ["symbol", "ts"])
    a, b, c = (_c(n) for n in names)
    before = F.lag(a - b).over(R.order())
    return df.withColumns({
        "distance": (_c("close") - a) / (a + EPS), "aligned": F.coalesce(((a > b) & (b > c)).cast("int"), F.lit(0)),
        "crossed_up": F.coalesce(((a > b) & (before <= 0)).cast("int"), F.lit(0)), "slope": (a - R.lag(names[0], 3)) / (R.lag(names[0], 3) + EPS),
    })


def forward_extremes(n: int = 6) -> dict[str, Column]:
    """Returns ahead, and the highest and lowest returns reached within the next ``n`` rows."""
    ahead = R.order().rowsBetween(1, n)
    whole = F.count("close").over(ahead) == n
    return {
        **{f"return_{h}": R.lead("close", h) / F.nullif(_c("close"), F.lit(0.0)) - 1 for h in (1, 2, 4, 6)},
        "max_ahead": F.when(whole, F.max("high").over(ahead) / F.nullif(_c("close"), F.lit(0.0)) - 1), "min_ahead": F.when(whole, F.min("low").over(ahead) / F.nullif(_c("close"), F.lit(0.0)) - 1),
    }


def jump(threshold: float = 0.1) -> Column:
    """Whether the close is up from the last by the threshold."""
    return F.coalesce(_c("close") / F.nullif(R.lag("close"), F.lit(0.0)) - 1 >= threshold, F.lit(False))


def rule_regimes(n: int = 20, least: int = 100) -> list[dict[str, Column]]:
    """Trend (close against its mean) by volatility tercile of the rows so far."""
    change = _c("close") / F.nullif(R.lag("close"), F.lit(0.0)) - 1
    history = R.running()
    third = lambda q: F.when(F.count("_vol").over(history) >= least, F.percentile("_vol", F.lit(q)).over(history))
    return [
        {"_r": change, "_mean": R.mean("close", n)},
        {"_vol": R.std("_r", n)},
        {"_low": third(1 / 3), "_high": third(2 / 3)},
        {"regime": F.when(_c("_low").isNull() | _c("_vol").isNull(), "warm-up").otherwise(F.concat(F.when(_c("close") >= _c("_mean"), "up").otherwise("down"), F.lit("_"), F.when(_c("_vol") <= _c("_low"), "calm").when(_c("_vol") <= _c("_high"), "normal").otherwise("wild")))},
    ]


def kmeans_regimes(bars: DataFrame, k: int = 3, refit: int = 100, least: int = 100, n: int = 20) -> DataFrame:
    """Clusters of (volatility, trend, volume ratio), refitted every ``refit`` rows on the past alone; named by volatility."""
    def kernel(d: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        import pandas as pd

        c, v = pd.Series(d["close"]), pd.Series(d["volume"])
        x = np.column_stack([c.pct_change().rolling(n).std(), (c - c.rolling(n).mean()).abs() / (c.rolling(n).max() - c.rolling(n).min()), v / v.rolling(n).mean()])
        label = np.full(len(x), np.nan)
        ok = np.isfinite(x).all(axis=1)
        for start in range(least, len(x), refit):
            past = x[:start][ok[:start]]
            if len(past) < least // 2:
                continue
            scale = past.std(axis=0) + EPS
            centres = _kmeans((past - past.mean(axis=0)) / scale, k)
            order = np.argsort(np.argsort(centres[:, 0]))
            part = slice(start, min(start + refit, len(x)))
            far = (((x[part] - past.mean(axis=0)) / scale)[:, None] - centres[None]) ** 2
            label[part] = np.where(ok[part], order[np.argmin(np.nan_to_num(far.sum(axis=2), nan=np.inf), axis=1)], np.nan)
        return {"regime": label}

    return K.apply(bars, kernel, ["regime"], ["close", "volume"])


def _kmeans(x: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Lloyd's iterations from quantiles of the first column."""
    order = np.argsort(x[:, 0], kind="stable")
    centres = x[order[[int((j + 0.5) * len(x) / k) for j in range(k)]]].copy()
    for _ in range(rounds):
        own = np.argmin(((x[:, None] - centres[None]) ** 2).sum(axis=2), axis=1)
        new = np.array([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def trend(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Least squares trend of a series on its row number: slope, R squared, t and class."""
    w = Window.partitionBy(*keys).orderBy("ts")
    d = df.where(_c(value).isNotNull()).withColumn("_n", F.row_number().over(w).cast("double"))
    n, sx, sxy, sy = F.count(F.lit(1)), F.var_pop("_n"), F.covar_pop("_n", value), F.var_pop(value)
    out = d.groupBy(*keys).agg(n.alias("n"), (sxy / F.nullif(sx, F.lit(0.0))).alias("slope"), (sxy * sxy / F.nullif(sx * sy, F.lit(0.0))).alias("r2"))
    t = F.signum("slope") * F.sqrt(_c("r2") * (_c("n") - 2) / F.nullif(1 - _c("r2"), F.lit(0.0)))
    return out.withColumn("t", t).withColumn("trend", F.when(F.abs("t") < 1.96, "flat").when(_c("slope") > 0, "up").otherwise("down"))


def weekly(df: DataFrame, value: str, bands: list[tuple[float, str]], top: str) -> DataFrame:
    """Mean by week, rounded half to even, and its band (upper bounds in order)."""
    d = df.groupBy("symbol", (F.floor((_c("ts") - 345600) / 604800) * 604800 + 345600).alias("week")).agg(F.bround(F.avg(value), 0).alias("level"))
    band = None
    for below, name in bands:
        band = F.when(_c("level") < below, name) if band is None else band.when(_c("level") < below, name)
    return d.withColumn("phase", band.otherwise(top))


def rolling_auc(df: DataFrame, score: str, outcome: str, n: int) -> DataFrame:
    """AUC over the ``n`` rows before each row; null for one class or short history."""
    def kernel(d: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = np.full(len(d[score]), np.nan)
        if len(out) <= n:
            return {"auc": out}
        s, y = (np.lib.stride_tricks.sliding_window_view(d[k], n)[:-1] for k in (score, outcome))
        some = max(1, (1 << 22) // (n * n))  # windows at a time: a square of comparisons each
        for k in range(0, len(s), some):
            v, z = s[k : k + some], y[k : k + some]
            known = np.isfinite(v) & np.isfinite(z)
            up, down = known & (z == 1), known & (z == 0)
            wins = (v[:, :, None] > v[:, None, :]) + 0.5 * (v[:, :, None] == v[:, None, :])
            pairs = up.sum(axis=1) * down.sum(axis=1)
            total = (wins * (up[:, :, None] & down[:, None, :])).sum(axis=(1, 2))
            out[n + k : n + k + len(v)] = np.where(pairs > 0, total / np.maximum(pairs, 1), np.nan)
        return {"auc": out}

    return K.apply(df, kernel, ["auc"], [score, outcome])


def zones(df: DataFrame, value: str, below: float) -> DataFrame:
    """Runs of rows with a value below a bound."""
    w = Window.partitionBy("symbol").orderBy("ts")
    low = F.coalesce(_c(value) < below, F.lit(False))
    d = df.withColumn("_low", low).withColumn("_new", (_c("_low") & ~F.coalesce(F.lag("_low").over(w), F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return d.where("_low").groupBy("symbol", "_run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("rows"), F.min(value).alias("lowest")).drop("_run")


def false_positives(df: DataFrame, score: str, outcome: str, most: int = 20) -> DataFrame:
    """The surest wrong calls."""
    return df.where((_c(outcome) == 0) & (_c(score) > 0.5)).orderBy(F.desc(score), "symbol", "ts").limit(most)


def score_curve(df: DataFrame, score: str, change: str, threshold: float) -> DataFrame:
    """Simple and compound curves of holding where the score is above a threshold; symbols are averaged by time first."""
    r = F.when(_c(score) > threshold, _c(change)).otherwise(0.0)
    d = df.where(_c(score).isNotNull() & _c(change).isNotNull()).groupBy("ts").agg(F.avg(r).alias("r"))
    w = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)  # one row for each time
    return d.withColumns({"simple": F.sum("r").over(w), "compound": F.product(1 + _c("r")).over(w) - 1})


def strata(df: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    """Weighted mean, win rate and effective n by every stratum alone and over all: grouping sets in one aggregation."""
    s = F.sum(weight)
    aggs = [F.count(value).alias("n"), (F.sum(_c(value) * _c(weight)) / F.nullif(s, F.lit(0.0))).alias("mean"), (F.sum(F.when(_c(value) > 0, _c(weight)).otherwise(0.0)) / F.nullif(s, F.lit(0.0))).alias("win_rate"), (s * s / F.nullif(F.sum(_c(weight) * _c(weight)), F.lit(0.0))).alias("n_eff")]
    d = df.where(_c(value).isNotNull())
    return d.groupingSets([[], *[[c] for c in by]], *by).agg(*aggs)


def leave_one_out(df: DataFrame, feature: str, label: str) -> DataFrame:
    """For each symbol the sign of the feature learned on the others, and its hit rate on the symbol.

    One pass of sums by symbol; the others' sums are the total less its own.
    """
    d = df.where(_c(feature).isNotNull() & _c(label).isNotNull())
    x, y = _c(feature), _c(label)
    per = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * y).alias("xy"), F.avg((F.signum(x) == F.signum(y)).cast("int")).alias("hit"))
    whole = Window.partitionBy()  # one row a symbol
    rest = {k: F.sum(k).over(whole) - _c(k) for k in ("n", "x", "y", "xy")}
    cov = rest["xy"] / rest["n"] - rest["x"] / rest["n"] * rest["y"] / rest["n"]
    return per.select("symbol", "n", F.signum(cov).alias("sign"), F.when(cov >= 0, _c("hit")).otherwise(1 - _c("hit")).alias("hit_rate"))


def in_out_sample(df: DataFrame, feature: str, label: str, blocks: int = 6) -> DataFrame:
    """Rank coefficient of each block and of the next one, and how much is lost."""
    from barloom.operators.ic import ic

    w = Window.partitionBy("symbol").orderBy("ts")
    d = df.where(_c(feature).isNotNull() & _c(label).isNotNull()).withColumn("block", F.ntile(blocks).over(w))
    per = ic(d, feature, label, ["symbol", "block"])
    after = F.lead("ic").over(Window.partitionBy("symbol").orderBy("block"))
    return per.select("symbol", "block", _c("ic").alias("ic_in"), after.alias("ic_out")).where("ic_out is not null").withColumn("lost", 1 - _c("ic_out") / F.nullif(_c("ic_in"), F.lit(0.0)))


def leakage(df: DataFrame, feature: str, label: str, ahead: int, bound: float = 0.3) -> DataFrame:
    """Correlation of a feature with a label ``ahead`` rows on, flagged beyond a bound."""
    d = df.withColumn("_y", R.lead(label, ahead))
    return d.groupBy("symbol").agg(R.pearson(feature, "_y").alias("r")).withColumn("suspect", F.coalesce(F.abs("r") > bound, F.lit(False)))


def coverage_matrix(df: DataFrame, columns: list[str], symbols: list[str]) -> DataFrame:
    """Null share of each feature (rows) for each symbol (columns); 1 where a symbol has no rows."""
    from barloom.operators.ic import stacked

    long = stacked(df, columns, ["symbol"])
    out = long.groupBy("feature").pivot("symbol", symbols).agg(F.avg(_c("value").isNull().cast("int")))
    return out.select("feature", *[F.coalesce(F.col(f"`{s}`"), F.lit(1.0)).alias(s) for s in symbols])


# Trials (trial, value, state, month): results of a parameter search


def compare_trials(trials: DataFrame, most: int = 10) -> DataFrame:
    """The best trials with rank and distance to the best."""
    w = Window.orderBy(F.desc("value"), "trial")
    best = trials.where("state = 'complete'").orderBy(F.desc("value"), "trial").limit(most)
    return best.withColumn("place", F.row_number().over(w)).withColumn("behind", F.max("value").over(Window.partitionBy()) - _c("value"))


def convergence(trials: DataFrame, key: str = "study", window: float = 0.2, bound: float = 0.01) -> DataFrame:
    """Whether the running best moved by less than a share of itself over the last trials."""
    w = Window.partitionBy(key).orderBy("trial")
    d = trials.where("state = 'complete'").withColumn("_best", F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(key)
    d = d.withColumns({"_k": F.row_number().over(w), "_n": F.count(F.lit(1)).over(whole)})
    last = d.where(_c("_k") > _c("_n") - F.greatest(F.floor(_c("_n") * F.lit(window)), F.lit(5)))
    out = last.groupBy(key).agg(F.max("_best").alias("best"), (F.max("_best") - F.min("_best")).alias("moved"), F.max("_n").alias("trials"))
    return out.withColumn("converged", _c("moved") < F.abs("best") * bound)


def stability(trials: DataFrame, period: str, key: str = "study") -> DataFrame:
    """Variation of means by period: coefficient of variation, best and worst period."""
    per = trials.where("state = 'complete'").groupBy(key, period).agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return per.groupBy(key).agg((F.stddev_pop("m") / F.nullif(F.abs(F.avg("m")), F.lit(0.0))).alias("cv"), F.max_by(period, F.struct("m", period)).alias("best"), F.min_by(period, F.struct("m", period)).alias("worst"))
