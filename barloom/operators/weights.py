"""Sample weights: by age, class, return and overlap of labels, and their combination.

Every weight is floored and divided by its mean within ``keys`` (a symbol), so a
symbol's weights have mean one.  Rows whose input is null have no weight.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAST = 0.01
"""Floor of a weight before it is divided by the mean."""
DAY = 86400.0


def normalized(raw: Column, keys: list[str]) -> Column:
    """``raw`` over its mean; ones where the mean isn't positive."""
    mean = F.avg(raw).over(Window.partitionBy(*keys))
    return F.when(raw.isNotNull(), F.when(mean > 0, raw / mean).otherwise(1.0))


def time_decay(ts: str, half_life_days: float = 180.0, kind: str = "exponential", least: float = LEAST, keys: list[str] | None = None) -> Column:
    """Weight halving every ``half_life_days``, or falling in a line to the oldest row."""
    keys = keys or ["symbol"]
    whole = Window.partitionBy(*keys)
    age = (F.max(ts).over(whole) - F.col(ts)) / DAY
    if kind == "linear":
        oldest = (F.max(ts).over(whole) - F.min(ts).over(whole)) / DAY
        raw = 1 - age / F.when(oldest > 0, oldest).otherwise(1.0)
    else:
        raw = F.pow(F.lit(0.5), age / half_life_days)
    return normalized(F.greatest(raw, F.lit(least)), keys)


def class_balance(df: DataFrame, y: str, into: str, method: str = "balanced", minority: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """Adds ``into``: N / (K n) of each of K classes, its root without K (``sqrt``), or ``minority`` for the rarest class (``custom``).

    The classes are counted in an aggregate and joined back, so rows never meet in one task; a single class gives ones.
    """
    keys = keys or ["symbol"]
    per = df.where(F.col(y).isNotNull()).groupBy(*keys, y).agg(F.count(F.lit(1)).alias("_n"))
    rare = Window.partitionBy(*keys).orderBy("_n", y)
    whole = Window.partitionBy(*keys)
    n, k = F.sum("_n").over(whole), F.count(F.lit(1)).over(whole)
    if method == "sqrt":
        raw = F.sqrt(n / F.col("_n"))
    elif method == "custom" and minority is not None:
        raw = F.when(F.row_number().over(rare) == 1, float(minority)).otherwise(1.0)
    else:
        raw = n / (k * F.col("_n"))
    per = per.withColumn("_w", F.when(k < 2, 1.0).otherwise(raw))
    per = per.withColumn(into, F.col("_w") * n / F.sum(F.col("_w") * F.col("_n")).over(whole)).select(*keys, y, into)
    return df.join(per, [*keys, y], "left")


def by_return(r: str, method: str = "abs", least: float = LEAST, keys: list[str] | None = None) -> Column:
    """Weight by the size of a return, its square, or its size with falls at half; ones if all returns are zero."""
    keys = keys or ["symbol"]
    size = F.abs(F.col(r))
    raw = size * size if method == "squared" else F.when(F.col(r) > 0, size).otherwise(0.5 * size) if method == "positive" else size
    flat = F.max(size).over(Window.partitionBy(*keys)) <= 1e-8
    return F.when(F.col(r).isNotNull(), F.when(flat, 1.0).otherwise(normalized(F.greatest(raw, F.lit(least)), keys)))


def uniqueness(df: DataFrame, spans: DataFrame, n: str, into: str, keys: list[str] | None = None) -> DataFrame:
    """Adds ``into``: one over the number of label ``spans`` (``keys``, start, end; end exclusive) that cover row ``n``, over its mean.

    Starts and ends are running sums along the rows: rows and spans are never paired.
    """
    keys = keys or ["symbol"]
    steps = spans.where("start < end").select(*keys, F.inline(F.array(F.struct(F.col("start").cast("long").alias("_at"), F.lit(1).alias("_d")), F.struct(F.col("end").cast("long").alias("_at"), F.lit(-1).alias("_d")))))
    rows = df.withColumns({"_at": F.col(n).cast("long"), "_d": F.lit(0), "_row": F.lit(True)})
    both = rows.unionByName(steps.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    upto = Window.partitionBy(*keys).orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    covered = both.withColumn("_c", F.sum("_d").over(upto)).where("_row")
    covered = covered.withColumn("_u", 1.0 / F.greatest(F.col("_c"), F.lit(1)))
    return covered.withColumn(into, normalized(F.col("_u"), keys)).drop("_at", "_d", "_row", "_c", "_u")


def combined(weights: list[str], how: str = "multiply", shares: list[float] | None = None, least: float = LEAST, keys: list[str] | None = None) -> Column:
    """Product of weights, or their mean by ``shares``; floored and over its mean."""
    keys = keys or ["symbol"]
    every = [F.col(w) for w in weights]
    if how == "additive":
        shares = shares or [1.0] * len(every)
        raw = reduce(lambda a, b: a + b, [w * (s / sum(shares)) for w, s in zip(every, shares, strict=True)])
    else:
        raw = reduce(lambda a, b: a * b, every)
    return normalized(F.greatest(raw, F.lit(least)), keys)


def summary(df: DataFrame, weight: str, keys: list[str] | None = None) -> DataFrame:
    """Count, effective n and its share, mean, deviation and extremes of a weight."""
    w = F.col(weight)
    effective = F.pow(F.sum(w), 2) / F.greatest(F.sum(w * w), F.lit(1e-12))
    return df.where(w.isNotNull()).groupBy(*(keys or ["symbol"])).agg(
        F.count(F.lit(1)).alias("n_samples"), effective.alias("effective_n"), (effective / F.count(F.lit(1))).alias("efficiency_ratio"),
        F.avg(w).alias("weight_mean"), F.stddev_pop(w).alias("weight_std"), F.min(w).alias("weight_min"), F.max(w).alias("weight_max"),
    )
