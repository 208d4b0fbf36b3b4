"""Price surges and their classes, sides of a feature, phases, capacity, and slices of bars for cases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions import rolling as R
from barloom.operators.evaluate import auc

_c = F.col


def surges(bars: DataFrame, timeframe: str) -> DataFrame:
    """Bars whose close is 10 % (12h) or 15 % above the one before."""
    change = _c("close") / F.nullif(R.lag("close"), F.lit(0.0)) - 1
    return bars.withColumn("price_change", change).where(_c("price_change") >= (0.10 if timeframe == "12h" else 0.15))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed_std(values: Column) -> Column:
    """Deviation (over n - 1) of an array's values within 1.5 interquartile ranges of the quartiles."""
    def at(v: Column, q: float) -> Column:
        place = (F.size(v) - 1) * F.lit(q)
        low = F.floor(place).cast("int")
        a, b = F.get(v, low), F.get(v, F.least(low + 1, F.size(v) - 1))
        return F.when((place == low) | (a == b), a).otherwise(a + (place - low) * (b - a))  # values may be infinite

    def within(v: Column) -> Column:
        bounds = lambda lo, hi: F.array(lo - 1.5 * (hi - lo), hi + 1.5 * (hi - lo))
        return _bound(_bound(F.array(at(v, 0.25), at(v, 0.75)), lambda q: bounds(q[0], q[1])), lambda b: F.filter(v, lambda x: (x >= b[0]) & (x <= b[1])))

    def deviation(kept: Column) -> Column:
        n = F.size(kept)
        mean = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / n
        square = _bound(mean, lambda m: F.aggregate(kept, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
        return F.when(n > 1, F.sqrt(square / (n - 1)))

    return _bound(_bound(F.array_sort(values), within), deviation)


# How many deviations a bar's change may have, from eight bars before a signal to the one before.
MULTIPLES = (2.5, 2.5, 2.5, 2.5, 2.7, 2.9, 3.0, 3.0)
VIOLATIONS = 3


def signal_class(bars: DataFrame, days: int = 10) -> DataFrame:
    """``signal_class`` of each bar: ``trend`` if more than three of the eight bars before moved beyond their bound, else ``initial``.

    Bounds are multiples of the trimmed deviation of the changes in the ``2 * days`` bars before.
    """
    change = F.abs(R.ratio(_c("close") - _c("open"), _c("open")))
    w = R.order()
    d = bars.withColumn("_x", change).withColumns({"_k": F.row_number().over(w) - 1, "_past": F.collect_list("_x").over(w.rowsBetween(-2 * days, -1))})
    d = d.withColumn("base_std", trimmed_std(_c("_past")))
    beyond = [F.coalesce((F.lag("_x", 8 - i).over(w) > m * _c("base_std")).cast("int"), F.lit(0)) for i, m in enumerate(MULTIPLES)]
    d = d.withColumn("_n", sum(beyond[1:], beyond[0]))
    label = F.when(_c("_k") < 8, "few day for calculation").when(_c("_n") > VIOLATIONS, "trend").otherwise("initial")
    return d.withColumn("signal_class", label).drop("_x", "_k", "_past", "_n")


def side_masks(bins: str, q: int, long: list[int] | None = None, short: list[int] | None = None) -> tuple[Column, Column]:
    """Whether a bin (from 0) is one of the long or of the short quantiles (from 1; the top and the bottom one by default); false without a bin."""
    long = [k for k in long or [] if 1 <= k <= q] or [q]
    short = [k for k in short or [] if 1 <= k <= q] or [1]
    return tuple(F.coalesce(_c(bins).isin([k - 1 for k in side]), F.lit(False)) for side in (long, short))


def sides_by_feature(long: DataFrame, bins: str, label: str, q: int, most: int | None = None) -> DataFrame:
    """(feature, n, long_mean, short_mean, spread) of a long table (feature, bin, label), the widest spreads first."""
    up, down = side_masks(bins, q)
    out = long.where(_c(label).isNotNull()).groupBy("feature").agg(F.count(bins).alias("n"), F.avg(F.when(up, _c(label))).alias("long_mean"), F.avg(F.when(down, _c(label))).alias("short_mean"))
    out = out.withColumn("spread", _c("long_mean") - _c("short_mean"))
    return out if most is None else out.orderBy(F.abs("spread").desc_nulls_last(), "feature").limit(most)


def quantile_summary(df: DataFrame, feature: str, change: str, q: int, keys: list[str]) -> DataFrame:
    """Mean return by the quantile bins of the whole sample, labelled Q1.., for description only; repeated edges are one.

    As many bins as distinct values, ``q`` at most; edges by linear interpolation, bins closed on the right.
    """
    values = df.where(_c(feature).isNotNull())
    edges = values.groupBy(*keys).agg(F.least(F.count_distinct(feature), F.lit(q)).cast("int").alias("_q"), *[F.percentile(feature, F.array(*[F.lit(j / k) for j in range(k + 1)])).alias(f"_e{k}") for k in range(2, q + 1)])
    picked = F.lit(None).cast("array<double>")
    for k in range(2, q + 1):
        picked = F.when(_c("_q") == k, F.array_distinct(f"_e{k}")).otherwise(picked)
    d = values.join(edges.select(*keys, picked.alias("_e")).where("_e is not null"), keys)
    at = F.greatest(F.size(F.filter("_e", lambda e: e < _c(feature))), F.lit(1))
    return d.groupBy(*keys, F.concat(F.lit("Q"), at.cast("string")).alias("bin")).agg(F.avg(change).alias("mean_return"), F.count(F.lit(1)).alias("n"))


def capacity(turnover: Column, volume: Column, participation: float = 0.01) -> tuple[Column, Column]:
    """Capital that a factor can take at a share of the daily volume, and its tier by turnover."""
    t = F.greatest(turnover, F.lit(0.0))
    known = volume.isNotNull() & (volume > 0)
    money = F.when(known, F.when(t > 0, volume * participation / t).otherwise(volume * participation))
    return money, F.when(~known, "unknown").when(t > 1.0, "low").when(t > 0.5, "medium").otherwise("high")


def by_phase(df: DataFrame, score: str, outcome: str, phase: str, least: int = 30, share: float = 0.1) -> DataFrame:
    """AUC, outcome rate among the top share of scores, and mean score of each phase; nulls where a phase has too few rows."""
    d = df.where(_c(score).isNotNull() & _c(outcome).isNotNull())
    w = Window.partitionBy(phase)
    d = d.withColumns({"_k": F.row_number().over(w.orderBy(F.desc(score), "symbol", "ts")), "_n": F.count(F.lit(1)).over(w)})
    top = _c("_k") <= F.greatest(F.floor(_c("_n") * F.lit(share)), F.lit(1))
    per = d.groupBy(phase).agg(F.count(F.lit(1)).alias("support"), F.avg(F.when(top, _c(outcome))).alias("precision_top"), F.avg(score).alias("mean_score"))
    per = per.join(auc(d.drop("_k", "_n"), score, outcome, [phase]).select(phase, "auc"), phase, "left")
    enough = _c("support") >= least
    return per.select(phase, "support", *[F.when(enough, _c(c)).alias(c) for c in ("auc", "precision_top", "mean_score")])


def group_stats(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Rows, share and the means of columns by group."""
    per = df.where(_c(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns])
    return per.withColumn("share", _c("n") / F.sum("n").over(Window.partitionBy()))  # one row a group


def case_bars(cases: DataFrame, bars: DataFrame, back: int, ahead: int = 0) -> DataFrame:
    """Bars from ``back`` before to ``ahead`` after each case's (case_id, symbol, t0), with their place: equal joins on row numbers, no range join."""
    numbered = bars.withColumn("_n", R.row_no())
    at0 = cases.join(numbered.select("symbol", _c("ts").alias("t0"), _c("_n").alias("_n0")), ["symbol", "t0"])
    wanted = at0.withColumn("place", F.explode(F.sequence(F.lit(-back), F.lit(ahead)))).withColumn("_n", _c("_n0") + _c("place"))
    return wanted.join(numbered, ["symbol", "_n"]).drop("_n", "_n0")


def indicator_cache(slices: DataFrame, periods: list[int], value: str = "close") -> DataFrame:
    """(case_id, period, mean): the mean of the last ``period`` values up to each case, for every period."""
    past = slices.where("place <= 0")
    long = past.withColumn("period", F.explode(F.array(*[F.lit(p) for p in periods]))).where(-_c("place") < _c("period"))
    return long.groupBy("case_id", "period").agg(F.count(value).alias("_n"), F.avg(value).alias("mean")).select("case_id", "period", F.when(_c("_n") == _c("period"), _c("mean")).alias("mean"))


def strided(points: DataFrame, most: int, keys: list[str], order: str = "ts") -> DataFrame:
    """At most ``most`` rows of each key at an even stride, the first and the last among them."""
    w = Window.partitionBy(*keys)
    d = points.withColumns({"_k": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    # Row k stays if it is floor(i * (n - 1) / (most - 1)) for some i.
    i = F.ceil(_c("_k") * (most - 1) / (_c("_n") - 1))
    hit = F.floor(i * (_c("_n") - 1) / (most - 1)) == _c("_k")
    return d.where((_c("_n") <= most) | hit).drop("_k", "_n")


def points(df: DataFrame, signal: Column, values: list[str]) -> DataFrame:
    """(symbol, ts_ms, values): the rows of a signal with a map of indicator values."""
    pairs = [x for v in values for x in (F.lit(v), _c(v).cast("double"))]
    return df.where(signal).select("symbol", (_c("ts") * 1000).alias("ts_ms"), F.create_map(*pairs).alias("values"))


def universe(df: DataFrame) -> DataFrame:
    """(symbol, rows, digest): identity of each symbol's rows by their times in order."""
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("ts")), lambda t: t.cast("string")), ",").cast("binary"), 256).alias("digest"))


def misaligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """(symbol, ts, only_in) of the keys that only one of a feature and a label table has."""
    keys = ["symbol", "ts"]
    return left.join(right, keys, "left_anti").select(*keys, F.lit("left").alias("only_in")).unionByName(right.join(left, keys, "left_anti").select(*keys, F.lit("right").alias("only_in")))


def rank_change(df: DataFrame, rank: str) -> DataFrame:
    """Mean absolute change of a point-in-time rank from row to row, by symbol."""
    return df.withColumn("_d", F.abs(_c(rank) - R.lag(rank))).groupBy("symbol").agg(F.avg("_d").alias("rank_change_rate"))


def ideal_distances(front: DataFrame, a: str, b: str, knees: int = 3) -> DataFrame:
    """Scaled distance of each Pareto point to the best of both objectives, and the nearest ``knees`` marked; the front is small."""
    whole = Window.partitionBy()
    far = lambda c: (F.max(c).over(whole) - _c(c)) / F.greatest(F.max(c).over(whole) - F.min(c).over(whole), F.lit(1e-6))
    d = front.withColumn("distance", F.sqrt(F.pow(far(a), 2) + F.pow(far(b), 2)))
    return d.withColumn("knee", F.row_number().over(Window.orderBy("distance", a, b)) <= knees)


def consensus(scores: list[str], how: str = "mean", threshold: float = 0.5) -> Column:
    """Mean of several models' scores, or the share of them at or above a threshold."""
    each = [_c(s) if how == "mean" else (_c(s) >= threshold).cast("double") for s in scores]
    return sum(each[1:], each[0]) / len(each)
