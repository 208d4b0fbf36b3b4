"""Case search over bars: parameters, filters, ordering, sampling and negative cases."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions import conditions
from barloom.functions import rolling as R


def case_parameters(bars: DataFrame, method: str = "close_to_close", horizons: tuple[int, ...] = (1, 4)) -> DataFrame:
    """The search parameters of each bar."""
    before = R.lag("close")
    change = (F.col("close") / F.nullif(before, F.lit(0.0)) - 1) if method == "close_to_close" else (F.col("close") / F.nullif(F.col("open"), F.lit(0.0)) - 1)
    span = F.col("high") - F.col("low")
    top, bottom = R.highest("high", 20), R.lowest("low", 20)
    new = {
        "price_change": 100 * change, "closing_strength": (F.col("close") - F.col("low")) / F.nullif(span, F.lit(0.0)),
        "price_position": (F.col("close") - bottom) / F.nullif(top - bottom, F.lit(0.0)), "volume_multiplier": F.col("volume") / F.nullif(R.mean("volume", 20), F.lit(0.0)),
        "_vol": span / F.nullif(F.col("close"), F.lit(0.0)), "_dir": (F.col("close") - F.col("open")) / F.nullif(F.col("open"), F.lit(0.0)),
    }
    new |= {f"future_{h}bar_return": 100 * (R.lead("close", h) / F.nullif(F.col("close"), F.lit(0.0)) - 1) for h in horizons}
    past = R.order().rowsBetween(-3, -1)
    three = F.count("close").over(past) == 3
    return bars.withColumns(new).withColumns({
        "past_3_volatility": F.when(three, F.max("_vol").over(past)), "past_3_direction": F.when(three, F.sum("_dir").over(past)),
        "past_3_volume_cv": F.when(three, F.stddev_samp("volume").over(past) / F.nullif(F.avg("volume").over(past), F.lit(0.0))),
    }).drop("_vol", "_dir")


def market_class() -> Column:
    """Volatility (L, M, H at 3 and 8 %), direction (U, D, S) and volume (A, B, C at .3 and .6) of the three bars before."""
    v, d, c = F.col("past_3_volatility") * 100, F.col("past_3_direction") * 100, F.col("past_3_volume_cv")
    vol = F.when(v < 3, "L").when(v < 8, "M").when(v.isNotNull(), "H")
    way = F.when(d > 1, "U").when(d < -1, "D").when(d.isNotNull(), "S")
    return F.concat(vol, way, F.when(c < 0.3, "A").when(c < 0.6, "B").when(c.isNotNull(), "C"))


@dataclass
class Search:
    """What to look for; ``rules`` and ``more`` are filter triples."""

    rules: list[tuple[str, str, object]]
    more: list[tuple[str, str, object]] = field(default_factory=list)
    symbols: list[str] | None = None
    start: int | None = None
    end: int | None = None
    min_volume: float = 0.0
    new_listing_bars: int = 0
    sample_limit: int | None = None
    method: str = "close_to_close"


def search(bars: DataFrame, spec: Search) -> DataFrame:
    """Cases of all symbols at once, ordered by symbol and time; a sample limit takes rows in a hash order."""
    df = bars if spec.symbols is None else bars.where(F.col("symbol").isin(spec.symbols))
    df = case_parameters(df, spec.method).withColumn("_age", R.row_no())
    keep = conditions.triples(spec.rules + spec.more) & (F.col("volume") >= spec.min_volume) & (F.col("_age") > spec.new_listing_bars)
    if spec.start is not None:
        keep = keep & (F.col("ts") >= spec.start)
    if spec.end is not None:
        keep = keep & (F.col("ts") <= spec.end)
    found = df.where(keep).drop("_age").withColumn("case_id", F.concat_ws("_", "symbol", "ts"))
    return found if spec.sample_limit is None else found.orderBy(F.xxhash64("case_id"), "case_id").limit(spec.sample_limit)


def negatives(candidates: DataFrame, positives: DataFrame, apart: int, ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """Candidates at least ``apart`` seconds from every positive of their symbol; ``ratio`` of them for each positive.

    The nearest positives before and after come from one window over the union,
    not from a range join.
    """
    both = candidates.withColumn("_p", F.lit(None).cast("long")).unionByName(positives.withColumn("_p", F.col("ts")), allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("ts")
    back, ahead = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    near = both.withColumn("_b", F.max("_p").over(back)).withColumn("_a", F.min("_p").over(ahead)).where("_p is null")
    far = (F.coalesce(F.col("ts") - F.col("_b"), F.lit(apart)) >= apart) & (F.coalesce(F.col("_a") - F.col("ts"), F.lit(apart)) >= apart)
    ok = near.where(far).drop("_p", "_b", "_a")
    wanted = positives.groupBy("symbol").agg(F.floor(F.count(F.lit(1)) * F.lit(float(ratio))).alias("_n"))
    order = Window.partitionBy("symbol").orderBy(F.xxhash64("symbol", "ts", F.lit(seed)), "ts")
    return ok.join(wanted, "symbol").withColumn("_k", F.row_number().over(order)).where("_k <= _n").drop("_k", "_n")


def combined(positives: DataFrame, others: DataFrame) -> DataFrame:
    return positives.withColumn("positive_case", F.lit(1)).unionByName(others.withColumn("positive_case", F.lit(0)), allowMissingColumns=True)


def density(cases: DataFrame, signal: str) -> DataFrame:
    """Share of signal bars of each case, and the separation of the classes."""
    per = cases.groupBy("case_id", "positive_case").agg(F.avg(F.col(signal).cast("int")).alias("density"))
    side = lambda k: F.when(F.col("positive_case") == k, F.col("density"))
    pooled = F.sqrt((F.var_samp(side(1)) + F.var_samp(side(0))) / 2)
    gap = F.avg(side(1)) - F.avg(side(0))
    return per.agg(F.avg(side(1)).alias("positive"), F.avg(side(0)).alias("negative"), gap.alias("separation"), (gap / F.nullif(pooled, F.lit(0.0))).alias("cohens_d"))
