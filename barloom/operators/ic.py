"""Information coefficients: rank or linear correlation of a feature with a forward label."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions import rolling as R


def average_rank(c: str, keys: list[str]) -> Column:
    """Average rank among the non-null values of the keys' group."""
    w = Window.partitionBy(*keys)
    return F.when(F.col(c).isNotNull(), F.rank().over(w.orderBy(F.col(c).asc_nulls_last())) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2)


def ic(df: DataFrame, feature: str, label: str, keys: list[str], method: str = "spearman") -> DataFrame:
    """(keys, n, ic) over rows where both are present; null below 2 rows or for constants."""
    both = df.where(F.col(feature).isNotNull() & F.col(label).isNotNull()).select(*keys, F.col(feature).alias("x"), F.col(label).alias("y"))
    if method == "spearman":
        both = both.withColumns({"x": average_rank("x", keys), "y": average_rank("y", keys)})
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), R.pearson("x", "y").alias("ic"))


def kendall(df: DataFrame, feature: str, label: str, keys: list[str]) -> DataFrame:
    """Kendall's tau-b, by a merge sort per group."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        pairs = lambda *v: sum(k * (k - 1) // 2 for k in np.unique(np.stack(v, 1), axis=0, return_counts=True)[1].tolist())
        total, tx, ty, txy = len(x) * (len(x) - 1) // 2, pairs(x), pairs(y), pairs(x, y)
        swaps = _inversions(y.tolist())[1]
        below = ((total - tx) * (total - ty)) ** 0.5
        tau = (total - tx - ty + txy - 2 * swaps) / below if below else None
        return pd.DataFrame([[*pdf[keys].iloc[0], len(x), tau]], columns=[*keys, "n", "ic"])

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    both = df.where(F.col(feature).isNotNull() & F.col(label).isNotNull()).select(*keys, F.col(feature).cast("double").alias("x"), F.col(label).cast("double").alias("y"))
    return both.groupBy(*keys).applyInPandas(one, ", ".join([*(f"{k} {types[k]}" for k in keys), "n long", "ic double"]))


def _inversions(v: list) -> tuple[list, int]:
    if len(v) < 2:
        return v, 0
    a, n = _inversions(v[: len(v) // 2])
    b, m = _inversions(v[len(v) // 2 :])
    out, i, total = [], 0, n + m
    for y in b:
        while i < len(a) and a[i] <= y:
            out.append(a[i])
            i += 1
        total += len(a) - i
        out.append(y)
    return out + a[i:], total


def ic_by_period(df: DataFrame, feature: str, label: str, unit: str = "day", method: str = "spearman") -> DataFrame:
    return ic(df.withColumn("period", F.date_trunc(unit, F.timestamp_seconds("ts"))), feature, label, ["period"], method)


def cross_sectional(df: DataFrame, feature: str, label: str) -> DataFrame:
    """Rank correlation over the symbols of each time."""
    return ic(df, feature, label, ["ts"])


def summary(ics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean, deviation, ratio and hit rate of a series of coefficients."""
    aggs = [F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), (F.avg("ic") / F.nullif(F.stddev_samp("ic"), F.lit(0.0))).alias("icir"), F.avg((F.col("ic") > 0).cast("int")).alias("hit_rate"), F.count("ic").alias("n")]
    return ics.groupBy(*keys).agg(*aggs) if keys else ics.agg(*aggs)


def decay(df: DataFrame, feature: str, horizons: list[int], keys: list[str], price: str = "close") -> DataFrame:
    """The coefficient at each horizon: one pass makes all labels, then one row per horizon and row."""
    labels = {f"_h{h}": R.lead(price, h) / F.nullif(F.col(price), F.lit(0.0)) - 1 for h in horizons}
    long = df.withColumns(labels).select(*keys, feature, F.explode(F.create_map(*[x for h in horizons for x in (F.lit(h), F.col(f"_h{h}"))])).alias("horizon", "label"))
    return ic(long, feature, "label", [*keys, "horizon"])


def autocorrelation(df: DataFrame, c: str, lag: int = 1) -> DataFrame:
    d = df.withColumn("_before", R.lag(c, lag))
    return d.where("_before is not null").groupBy("symbol").agg(R.pearson(c, "_before").alias("autocorr"))


def newey_west(df: DataFrame, z: str, lags: int, keys: list[str], order: str = "ts") -> DataFrame:
    """Mean, Bartlett-weighted standard error and t of a series: S = g0 + 2 sum w_j g_j."""
    w = Window.partitionBy(*keys)
    d = df.where(F.col(z).isNotNull()).withColumn("_e", F.col(z) - F.avg(z).over(w))
    o = w.orderBy(order)
    d = d.withColumns({f"_g{j}": F.col("_e") * F.lag("_e", j).over(o) for j in range(1, lags + 1)})
    g = lambda j: F.sum(f"_g{j}") / F.count(F.lit(1))
    s = F.sum(F.col("_e") * F.col("_e")) / F.count(F.lit(1))
    for j in range(1, lags + 1):
        s = s + 2 * (1 - j / (lags + 1)) * F.coalesce(g(j), F.lit(0.0))
    se = F.sqrt(F.greatest(s, F.lit(0.0)) / F.count(F.lit(1)))
    out = d.groupBy(*keys).agg(F.avg(z).alias("mean"), se.alias("se"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("t", F.col("mean") / F.nullif(F.col("se"), F.lit(0.0)))


def hac(df: DataFrame, feature: str, label: str, lags: int, keys: list[str]) -> DataFrame:
    """Newey-West statistics of the products of standardised ranks, whose mean is the rank coefficient."""
    both = df.where(F.col(feature).isNotNull() & F.col(label).isNotNull())
    both = both.withColumns({"_x": average_rank(feature, keys), "_y": average_rank(label, keys)})
    w = Window.partitionBy(*keys)
    score = lambda c: (F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0))
    return newey_west(both.withColumn("_z", score("_x") * score("_y")), "_z", lags, keys)


def benjamini_hochberg(df: DataFrame, p: str = "p", alpha: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """q values (monotone) and rejections over the rows with a p value; others keep null."""
    keys = keys or []
    ok = df.withColumn("_ok", F.col(p).isNotNull() & ~F.isnan(p))
    w = Window.partitionBy("_ok", *keys)
    k, m = F.row_number().over(w.orderBy(p)), F.count(F.lit(1)).over(w)
    d = ok.withColumn("_raw", F.col(p) * m / k)
    back = w.orderBy(F.desc(p), F.desc("_raw")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.when(F.col("_ok"), F.least(F.min("_raw").over(back), F.lit(1.0)))
    return d.withColumn("q", q).withColumn("rejected", F.coalesce(F.col("q") <= alpha, F.lit(False))).drop("_ok", "_raw")


def quantile_returns(df: DataFrame, bins: str, label: str, keys: list[str]) -> DataFrame:
    return df.where(F.col(bins).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, bins).agg(F.avg(label).alias("mean_label"), F.count(F.lit(1)).alias("n"))


def monotonicity(means: DataFrame, bins: str, keys: list[str]) -> DataFrame:
    """Share of steps up between adjacent bins."""
    step = F.col("mean_label") - F.lag("mean_label").over(Window.partitionBy(*keys).orderBy(bins))
    return means.withColumn("_d", step).where("_d is not null").groupBy(*keys).agg(F.avg((F.col("_d") > 0).cast("int")).alias("monotonicity"))


def long_short(df: DataFrame, bins: str, label: str, q: int, keys: list[str]) -> DataFrame:
    """Means, spread and t of the top against the bottom bin."""
    side = df.where(F.col(label).isNotNull() & F.col(bins).isin(0, q - 1))
    top, low = F.when(F.col(bins) == q - 1, F.col(label)), F.when(F.col(bins) == 0, F.col(label))
    spread = F.avg(top) - F.avg(low)
    se = F.sqrt(F.var_samp(top) / F.count(top) + F.var_samp(low) / F.count(low))
    return side.groupBy(*keys).agg(F.avg(top).alias("long_mean"), F.avg(low).alias("short_mean"), spread.alias("spread"), (spread / F.nullif(se, F.lit(0.0))).alias("t"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns over rows that have both, in one aggregation: (a, b, r, n)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: F.when(F.col(b).isNotNull(), F.col(a))
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), R.pearson(a, b).alias("r"), F.count(both(a, b)).alias("n")) for a, b in pairs]).alias("pairs"))
    return row.select(F.inline("pairs"))


def stacked(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Long form: (keys, feature, value)."""
    return df.select(*keys, F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("feature", "value"))


def conjunction(rules: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, rules)
