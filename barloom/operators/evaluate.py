"""Scores against outcomes: AUC, calibration, expectancy, drift, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators.ic import average_rank


def auc(df: DataFrame, score: str, outcome: str, keys: list[str]) -> DataFrame:
    """Area under the ROC curve by ranks, and rank-biserial correlation; null for one class."""
    both = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).withColumn("_k", average_rank(score, keys))
    p, n = F.sum(F.col(outcome).cast("double")), F.count(F.lit(1)) - F.sum(F.col(outcome).cast("double"))
    area = (F.sum(F.col("_k") * F.col(outcome)) - p * (p + 1) / 2) / F.nullif(p * n, F.lit(0.0))
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), area.alias("auc"), (2 * area - 1).alias("rank_biserial"))


def pr_auc(df: DataFrame, score: str, outcome: str, keys: list[str]) -> DataFrame:
    """Average precision; rows of one score count together."""
    steps = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).groupBy(*keys, score).agg(F.sum(F.col(outcome).cast("double")).alias("_tp"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    d = steps.withColumn("_precision", F.sum("_tp").over(w) / F.sum("_n").over(w))
    return d.groupBy(*keys).agg((F.sum(F.col("_precision") * F.col("_tp")) / F.nullif(F.sum("_tp"), F.lit(0.0))).alias("pr_auc"))


def confusion(df: DataFrame, score: str, outcome: str, threshold: float, keys: list[str]) -> DataFrame:
    hit, y = F.col(score) >= threshold, F.col(outcome) == 1
    out = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).groupBy(*keys).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    precision, recall = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return out.withColumns({"precision": precision, "recall": recall, "f1": 2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))})


def top_lift(df: DataFrame, score: str, outcome: str, share: float, keys: list[str]) -> DataFrame:
    """Outcome rate in the top share of scores over the base rate."""
    w = Window.partitionBy(*keys)
    d = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).withColumn("_k", F.row_number().over(w.orderBy(F.desc(score), "ts"))).withColumn("_n", F.count(F.lit(1)).over(w))
    best = F.when(F.col("_k") <= F.greatest(F.floor(F.col("_n") * F.lit(share)), F.lit(1)), F.col(outcome))
    return d.groupBy(*keys).agg(F.avg(best).alias("top_rate"), F.avg(outcome).alias("base_rate"), (F.avg(best) / F.nullif(F.avg(outcome), F.lit(0.0))).alias("lift"))


def calibration(df: DataFrame, score: str, outcome: str, bins: int = 10) -> DataFrame:
    """Right-closed bins of the score: (bin, n, mean_p, rate)."""
    k = F.greatest(F.least(F.ceil(F.col(score) * bins) - 1, F.lit(bins - 1)), F.lit(0))
    return df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_p"), F.avg(outcome).alias("rate"))


def calibration_error(df: DataFrame, score: str, outcome: str, bins: int = 10) -> DataFrame:
    """Expected calibration error and Brier score."""
    table = calibration(df, score, outcome, bins)
    ece = table.agg((F.sum(F.col("n") * F.abs(F.col("rate") - F.col("mean_p"))) / F.sum("n")).alias("ece"))
    brier = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).agg(F.avg(F.pow(F.col(score) - F.col(outcome), 2)).alias("brier"))
    return ece.join(brier)


def expectancy(df: DataFrame, score: str, change: str, threshold: float, keys: list[str]) -> DataFrame:
    """Trades where the score reaches the threshold: win rate, signed averages, expectancy; zeros without trades."""
    r = F.when(F.col(score) >= threshold, F.col(change))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rate, win, loss = zero(F.avg((r > 0).cast("double"))), zero(F.avg(F.when(r > 0, r))), zero(F.avg(F.when(r <= 0, r)))
    return df.groupBy(*keys).agg(F.count(r).alias("trades"), rate.alias("win_rate"), win.alias("avg_win"), loss.alias("avg_loss"), (rate * win + (1 - rate) * loss).alias("expectancy"))


def density_overlap(df: DataFrame, score: str, outcome: str, bins: int = 50) -> DataFrame:
    """Density of each class by bin and the overlap of the two."""
    d = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).withColumn("bin", F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)))
    side = lambda k: F.count_if(F.col(outcome) == k)
    total = Window.partitionBy()
    per = d.groupBy("bin").agg(side(1).alias("_p"), side(0).alias("_n"))
    share = lambda c: F.col(c) / F.nullif(F.sum(c).over(total), F.lit(0)) * bins
    return per.select("bin", share("_p").alias("positive"), share("_n").alias("negative"))


def psi(df: DataFrame, value: str, part: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Population stability of ``part`` = 1 against 0, over the quantile bins of part 0; values outside are left out."""
    edges = df.where(F.col(part) == 0).agg(F.array_sort(F.array_distinct(F.percentile(value, F.array(*[F.lit(k / bins) for k in range(bins + 1)])))).alias("edges"))
    d = df.where(F.col(value).isNotNull()).join(F.broadcast(edges))  # one row of bins + 1 numbers
    k = F.size(F.filter("edges", lambda e: e < F.col(value)))
    inside = (F.col(value) >= F.element_at("edges", 1)) & (F.col(value) <= F.element_at("edges", -1))
    d = d.where(F.size("edges") >= 3).withColumn("bin", F.when(inside, F.greatest(k, F.lit(1))))
    n0, n1 = F.count_if(F.col(part) == 0), F.count_if(F.col(part) == 1)
    whole = Window.partitionBy()
    shares = d.groupBy("bin").agg(n0.alias("n0"), n1.alias("n1")).withColumns({"e": F.col("n0") / F.sum("n0").over(whole), "a": F.col("n1") / F.sum("n1").over(whole)})
    e, a = F.greatest("e", F.lit(eps)), F.greatest("a", F.lit(eps))
    return shares.where("bin is not null and n0 > 0").agg(F.coalesce(F.sum((a - e) * F.ln(a / e)), F.lit(0.0)).alias("psi"))


def kolmogorov(df: DataFrame, value: str, part: str, pieces: int = 64) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of part 1 against part 0.

    Values are cut into ranges at approximate quantiles; running counts go within a range,
    and from range to range over one row each, so no task sorts all values.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(part) == 0).alias("a"), F.count_if(F.col(part) == 1).alias("b"))
    cuts = per.agg(F.percentile_approx(value, [k / pieces for k in range(1, pieces)], 10 * pieces).alias("c")).first()["c"] or []
    at = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>"), lambda c: c < F.col(value))) if cuts else F.lit(0)
    per = per.withColumn("_r", at)
    past, whole = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = per.groupBy("_r").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))
    sums = sums.select("_r", *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"{c}0") for c in ("_a", "_b")], *[F.sum(c).over(whole).alias(f"{c}n") for c in ("_a", "_b")])
    w = Window.partitionBy("_r").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs((F.col("_a0") + F.sum("a").over(w)) / F.col("_an") - (F.col("_b0") + F.sum("b").over(w)) / F.col("_bn"))
    return per.join(F.broadcast(sums), "_r").withColumn("_g", gap).agg(F.max("_g").alias("ks"), F.sum("a").alias("n0"), F.sum("b").alias("n1"))  # sums: ``pieces`` rows


def coverage(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Coverage, nulls and first valid row (from 0; -1 if none) of each column."""
    d = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("ts")) - 1)
    stats = lambda c: F.struct(F.lit(c).alias("feature"), F.avg(F.col(c).isNotNull().cast("int")).alias("coverage"), F.count_if(F.col(c).isNull()).alias("nulls"), F.coalesce(F.min(F.when(F.col(c).isNotNull(), F.col("_n"))), F.lit(-1)).alias("first_valid"))
    return d.groupBy(*keys).agg(F.array(*[stats(c) for c in columns]).alias("_s")).select(*keys, F.inline("_s"))


def dead_columns(df: DataFrame, columns: list[str], least: int = 2) -> list[str]:
    """Columns with fewer than ``least`` values, or only one; one pass."""
    row = df.agg(*[F.struct(F.count(c).alias("n"), F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]["n"] < least or row[c]["a"] == row[c]["b"]]


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes, skewness, kurtosis and null share of each column."""
    stats = lambda c: F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurt"), F.avg(F.col(c).isNull().cast("int")).alias("null_share"))
    return df.agg(F.array(*[stats(c) for c in columns]).alias("_s")).select(F.inline("_s"))


def weighted_stats(df: DataFrame, value: str, weight: str, keys: list[str]) -> DataFrame:
    """Weighted mean, median, win rate and effective n."""
    d = df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    w = Window.partitionBy(*keys)
    upto = F.sum(weight).over(w.orderBy(value, "ts").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_half", upto >= F.sum(weight).over(w) / 2)
    s = F.sum(weight)
    return d.groupBy(*keys).agg(
        (F.sum(F.col(value) * F.col(weight)) / s).alias("mean"), F.min(F.when(F.col("_half"), F.col(value))).alias("median"),
        (F.sum(F.when(F.col(value) > 0, F.col(weight)).otherwise(0.0)) / s).alias("win_rate"), F.count(F.lit(1)).alias("n"), (s * s / F.sum(F.col(weight) * F.col(weight))).alias("n_eff"),
    )


def cusum(df: DataFrame, value: str, keys: list[str], k: float = 5.0) -> DataFrame:
    """Largest absolute cumulative deviation, its time, and whether it is beyond ``k`` deviations."""
    w = Window.partitionBy(*keys)
    d = df.where(F.col(value).isNotNull()).withColumns({"_e": F.col(value) - F.avg(value).over(w), "_s": F.stddev_pop(value).over(w)})
    d = d.withColumn("_c", F.abs(F.sum("_e").over(w.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))))
    return d.groupBy(*keys).agg(F.max("_c").alias("cusum"), F.max_by("ts", F.struct("_c", -F.col("ts"))).alias("at"), F.coalesce(F.max("_c") > k * F.max("_s"), F.lit(False)).alias("drift"))


def pareto_front(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows that no other row beats in both objectives (larger is better): one sort, no self join."""
    best = df.groupBy(a).agg(F.max(b).alias("_best"))
    ahead = F.max("_best").over(Window.orderBy(F.desc(a)).rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("_ahead", ahead).where("_ahead is null or _best > _ahead").select(a, F.col("_best").alias(b))
    return df.join(front, [a, b])
