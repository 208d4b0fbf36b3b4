"""OHLCV bars: schema, validation, derivation from event tables, storage.

A bar is ``symbol string, ts long (open time, epoch seconds), open, high, low,
close, volume, taker_buy_volume, taker_ratio, quote_volume double, trades long``.
All operators take frames keyed by ``symbol`` and ordered by ``ts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Seconds of each timeframe.
TIMEFRAMES = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "12h": 43200, "1d": 86400, "1w": 604800}
PRICES = ("open", "high", "low", "close")


def seconds(timeframe: str) -> int:
    if timeframe not in TIMEFRAMES:
        raise ValueError(f"unknown timeframe {timeframe!r}")
    return TIMEFRAMES[timeframe]


def periods_per_year(timeframe: str) -> float:
    return 365 * 86400 / seconds(timeframe)


def event_bars(spark: SparkSession, sf_dir: str, timeframe: str = "1h") -> DataFrame:
    """Bars of the ``events`` table: a symbol for each event type, one price for each event."""
    size = seconds(timeframe)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "user_id", "value")
    order = F.struct("ts", "event_id")
    taker = F.count_if(F.col("user_id") % 2 == 0).cast("double")
    return (
        events.groupBy(F.col("event_type").alias("symbol"), (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(size * 1_000_000)) * size).alias("ts"))
        .agg(
            F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"), taker.alias("taker_buy_volume"), (taker / F.count(F.lit(1))).alias("taker_ratio"),
            F.sum("value").alias("quote_volume"), F.count(F.lit(1)).alias("trades"),
        )
    )


def with_synthetic(bars: DataFrame) -> DataFrame:
    """Average, median, typical and weighted prices, and log volumes."""
    o, h, low, c = (F.col(k) for k in PRICES)
    return bars.withColumns(
        {
            "avg_price": (o + h + low + c) / 4, "med_price": (h + low) / 2, "typ_price": (h + low + c) / 3, "wcl_price": (h + low + 2 * c) / 4,
            "log_volume": F.log1p("volume"), "log_quote_volume": F.log1p("quote_volume"),
        }
    )


def bar_faults(bars: DataFrame, of: tuple[str, ...] | None = None) -> DataFrame:
    """Rows that break a bar's rules (all of them, or those named), with an array of the rules broken."""
    c = F.col
    rules = {
        "missing": F.greatest(*[c(k).isNull() for k in (*PRICES, "volume")]),
        "low": (c("low") > c("open")) | (c("low") > c("close")),
        "high": (c("high") < c("open")) | (c("high") < c("close")),
        "price": F.least(*[c(k) for k in PRICES]) <= 0,
        "volume": (c("volume") < 0) | (c("taker_buy_volume") > c("volume")) | (c("taker_buy_volume") < 0),
        "ratio": (c("taker_ratio") < 0) | (c("taker_ratio") > 1),
        "repeated": F.count(F.lit(1)).over(Window.partitionBy("symbol", "ts")) > 1,
    }
    named = F.array_compact(F.array(*[F.when(F.coalesce(p, F.lit(False)), F.lit(k)) for k, p in rules.items() if of is None or k in of]))
    return bars.withColumn("faults", named).where(F.size("faults") > 0)


def from_klines(rows: DataFrame, payload: str = "kline") -> DataFrame:
    """Bars of array-of-strings rows as exchanges send them: open ms, o, h, l, c, v, close ms, quote volume, trades, taker volume."""
    k = lambda i, kind="double": F.get(payload, F.lit(i)).cast(kind)
    taker = F.coalesce(k(9) / F.nullif(k(5), F.lit(0.0)), F.lit(0.5))
    return rows.select(
        "symbol", F.floor(k(0, "long") / 1000).alias("ts"), k(1).alias("open"), k(2).alias("high"), k(3).alias("low"), k(4).alias("close"), k(5).alias("volume"),
        k(9).alias("taker_buy_volume"), taker.alias("taker_ratio"), k(7).alias("quote_volume"), k(8, "long").alias("trades"),
    )


def merge_bars(frames: list[DataFrame], keep: str = "first") -> DataFrame:
    """Union of bar frames; of bars of one symbol and time the first (or last) frame's wins."""
    tagged = [f.withColumn("_source", F.lit(k)) for k, f in enumerate(frames)]
    every = tagged[0]
    for f in tagged[1:]:
        every = every.unionByName(f, allowMissingColumns=True)
    order = F.col("_source").asc() if keep == "first" else F.col("_source").desc()
    best = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(order))
    return every.withColumn("_rank", best).where("_rank = 1").drop("_rank", "_source")


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """Coarser bars of finer ones."""
    size = seconds(timeframe)
    return bars.groupBy("symbol", (F.floor(F.col("ts") / size) * size).alias("ts")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.sum("taker_buy_volume").alias("taker_buy_volume"),
        F.coalesce(F.sum("taker_buy_volume") / F.nullif(F.sum("volume"), F.lit(0.0)), F.lit(0.5)).alias("taker_ratio"),
        F.sum("quote_volume").alias("quote_volume"), F.sum("trades").alias("trades"),
    )


def write_bars(bars: DataFrame, path: str, timeframe: str, mode: str = "overwrite") -> None:
    """Parquet by timeframe and symbol; only the partitions written to are replaced."""
    (
        bars.withColumn("timeframe", F.lit(timeframe)).repartition("symbol").sortWithinPartitions("symbol", "ts")
        .write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("timeframe", "symbol").parquet(path)
    )


def read_bars(spark: SparkSession, path: str, timeframe: str, symbols: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Stored bars with ``start <= ts <= end``; partitions and row groups are pruned."""
    bars = spark.read.parquet(path).where(F.col("timeframe") == timeframe)
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(symbols))
    if start is not None:
        bars = bars.where(F.col("ts") >= start)
    return bars if end is None else bars.where(F.col("ts") <= end)


def around(bars: DataFrame, centres: DataFrame, before: int, after: int) -> DataFrame:
    """For each centre (symbol, centre), the bars from ``before`` before to ``after`` after the bar nearest to it (the earlier of two).

    Centres and bars are sorted together once, which gives each centre the number of the bar
    before it; bars are then found by their numbers, so no bar meets every centre of its symbol.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    numbered = bars.withColumn("bar_no", F.row_number().over(w))
    at = numbered.select("symbol", F.col("ts").cast("double").alias("_t"), F.lit(0).alias("_side"), "bar_no", F.col("ts").alias("_ts"), F.lead("ts").over(w).alias("_after"))
    asked = centres.select("symbol", "centre").distinct().withColumns({"_t": F.col("centre").cast("double"), "_side": F.lit(1)})
    both = asked.unionByName(at, allowMissingColumns=True)
    upto = Window.partitionBy("symbol").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(upto)
    held = both.withColumns({"_no": last("bar_no"), "_before": last("_ts"), "_next": last(F.when(F.col("_side") == 0, F.coalesce("_after", F.lit(1 << 62))))}).where("_side = 1")
    nearer = F.col("_next") - F.col("centre") < F.col("centre") - F.col("_before")
    mid = held.select("symbol", "centre", F.when(F.col("_no").isNull(), 1).when(nearer & (F.col("_next") < (1 << 62)), F.col("_no") + 1).otherwise(F.col("_no")).alias("mid_no"))
    wanted = mid.withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("bar_no", F.col("mid_no") + F.col("offset"))
    return numbered.join(wanted, ["symbol", "bar_no"])


def latest(bars: DataFrame, n: int) -> DataFrame:
    """The last ``n`` bars of each symbol."""
    return bars.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("_k") <= n).drop("_k")


def finite(c: Column | str, cap: float = 1e18) -> Column:
    """Null for NaN, infinities and absurdly large values."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) <= cap), c)
