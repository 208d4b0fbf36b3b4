"""As-of and interval joins, multi-timeframe alignment and the event pipeline.

As-of joins are a union and one window, never a range join: both sides are
sorted once by key and time, so the cost is that of a sort whatever the match
rates, and a key's rows stream through ``last(ignorenulls)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.sources.bars import seconds


def asof(left: DataFrame, right: DataFrame, left_time: str, right_time: str, take: dict[str, str], keys: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Each left row with the last right row of its key at ``right_time <= left_time`` (``<`` if strict).

    ``take`` names the right columns and what they become; of right rows at one
    time the last by those columns counts.
    """
    keys = keys or ["symbol"]
    held = F.struct(*[F.col(c).alias(v) for c, v in take.items()], F.lit(1).alias("_found"))
    # At equal times, right rows go before left ones, or after them if strict.
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(2 if strict else 0).alias("_side"), held.alias("_held"))
    l_ = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"))
    both = l_.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_held").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_last", F.last("_held", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in take.values()])


def align_timeframe(primary: DataFrame, source: DataFrame, primary_tf: str, source_tf: str, columns: list[str], mode: str = "open_time") -> DataFrame:
    """Coarser bars' columns on finer bars: only bars closed by the decision time are seen.

    The decision is at the primary bar's open, or its close if ``mode`` is
    ``close_time``.  New columns are ``<timeframe>_<column>``, and ``<timeframe>_ts``.
    """
    ahead = seconds(primary_tf) if mode == "close_time" else 0
    left = primary.withColumn("_decision", F.col("ts") + ahead)
    right = source.withColumn("_close", F.col("ts") + seconds(source_tf))
    take = {c: f"{source_tf}_{c}" for c in ["ts", *columns]}
    return asof(left, right, "_decision", "_close", take).drop("_decision")


def leaks(aligned: DataFrame, source_ts: str, source_tf: str, primary_tf: str, mode: str = "open_time") -> DataFrame:
    """Rows that see a source bar before its close."""
    ahead = seconds(primary_tf) if mode == "close_time" else 0
    return aligned.where(F.col(source_ts) + seconds(source_tf) > F.col("ts") + ahead)


def in_phase(points: DataFrame, phases: DataFrame, time: str, name: str = "phase") -> DataFrame:
    """The phase (start <= t <= end) of each point; phases don't overlap."""
    found = asof(points.withColumn("_all", F.lit(1)), phases.withColumn("_all", F.lit(1)), time, "start", {"phase": name, "end": "_end"}, ["_all"])
    return found.withColumn(name, F.when(F.col(time) <= F.col("_end"), F.col(name))).drop("_all", "_end")


def phases_within(phases: DataFrame, start: int, end: int) -> DataFrame:
    return phases.where((F.col("start") <= end) & (F.col("end") >= start))


def phases_of(df: DataFrame, time: str, phase: str, step: int) -> DataFrame:
    """Runs of an equal phase, each up to the step before the next begins."""
    w = Window.partitionBy("symbol").orderBy(time)
    turn = (F.col(phase) != F.lag(phase).over(w)) | F.lag(phase).over(w).isNull()
    runs = df.withColumn("_run", F.sum(turn.cast("int")).over(w)).groupBy("symbol", "_run").agg(F.first(phase).alias("phase"), F.min(time).alias("start"), F.max(time).alias("_last"))
    after = F.lead("start").over(Window.partitionBy("symbol").orderBy("start"))
    return runs.select("symbol", "phase", "start", F.coalesce(after - 1, F.col("_last") + step - 1).alias("end"))


def inner_aligned(frames: list[DataFrame], keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Rows of the keys that every frame has; of equal columns the first frame's."""
    def add(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.select(*keys, *[c for c in b.columns if c not in a.columns]), list(keys))

    return reduce(add, frames)


# Events: (event_id, symbol, t0, direction, label)

# Entry semantics, as the bar counted from t0's and the price taken.
ENTRIES = {"trigger_open": (0, "open"), "trigger_close": (0, "close"), "next_open": (1, "open"), "decision_bar_open": (None, "open"), "decision_bar_close": (None, "close")}


def align_events(events: DataFrame, bars: DataFrame, timeframe: str, offset: int = 0, entry: str = "next_open", horizon: int = 4) -> DataFrame:
    """Each event with its decision bar, entry and exit, or one reason why not.

    The decision is at the close of the bar ``offset`` bars before that of t0.
    """
    step = seconds(timeframe)
    back, price = ENTRIES[entry]
    w = Window.partitionBy("symbol").orderBy("ts")
    numbered = bars.withColumn("n", F.row_number().over(w)).select("symbol", "ts", "n", "open", "close")
    at0 = events.join(numbered.select("symbol", F.col("ts").alias("t0"), F.col("n").alias("n0")), ["symbol", "t0"], "left")
    wanted = at0.withColumn("decision_n", F.col("n0") - offset).withColumn("entry_n", F.col("n0") + back if back is not None else F.col("n0") - offset).withColumn("exit_n", F.col("entry_n") + horizon)
    pick = lambda name, *cols: numbered.select("symbol", F.col("n").alias(f"{name}_n"), *[F.col(c).alias(f"{name}_{c}") for c in cols])
    out = wanted
    for name, cols in (("decision", ("ts",)), ("entry", ("ts", price)), ("exit", ("ts", "close"))):
        out = out.join(pick(name, *cols), ["symbol", f"{name}_n"], "left")
    reason = (
        F.when(F.col("n0").isNull(), "no bar at t0").when(F.col("decision_ts").isNull(), "no decision bar").when(F.col("entry_ts").isNull(), "no entry bar")
        .when(F.col("exit_ts").isNull(), "no exit bar").when(F.col(f"entry_{price}") <= 0, "bad entry price")
    )
    ret = F.col("direction") * (F.col("exit_close") / F.nullif(F.col(f"entry_{price}"), F.lit(0.0)) - 1)
    return out.select(
        *events.columns, (F.col("decision_ts") + step).alias("decision_at"), F.col("entry_ts").alias("entry_at"), (F.col("exit_ts") + step).alias("exit_at"),
        F.col(f"entry_{price}").alias("entry_price"), F.col("exit_close").alias("exit_price"), ret.alias("event_return"), reason.alias("reason"),
    )


def features_at(events: DataFrame, features: DataFrame, timeframe: str, columns: list[str]) -> DataFrame:
    """The last features closed by each event's decision, as ``<timeframe>_<column>``."""
    right = features.withColumn("_close", F.col("ts") + seconds(timeframe))
    return asof(events, right, "decision_at", "_close", {c: f"{timeframe}_{c}" for c in columns})


def manifest(events: DataFrame, gap: int = 0, bucket: int = 86400) -> DataFrame:
    """Events (event_id, start, end) with overlap count, uniqueness and cluster.

    The intervals that overlap [start, end) (itself included) are the starts before its
    end less the ends up to its start: two running counts, no self join.  A cluster
    goes on while a start is within the latest end, or ``gap`` of the latest start,
    so far.  Everything runs within ``bucket`` seconds, with one row a bucket between them.
    """
    at = lambda c: F.floor(F.col(c) / bucket)
    empty = F.col("start") == F.col("end")
    mark = lambda t, side, s, f, who: events.select(F.col(t).alias("t"), side.alias("side"), F.lit(s).alias("s"), F.lit(f).alias("f"), (F.col("event_id") if who else F.lit(None)).cast(events.schema["event_id"].dataType).alias("event_id"))
    # At one time: questions for an end, starts, ends, questions for a start; those for an empty interval come before the ends of empty ones.
    both = mark("end", F.lit(-1), 0, 0, True).unionByName(mark("start", F.lit(0), 1, 0, False))
    both = both.unionByName(mark("end", F.when(empty, 3).otherwise(1), 0, 1, False)).unionByName(mark("start", F.when(empty, 2).otherwise(4), 0, 0, True)).withColumn("bucket", at("t"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    totals = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("f").alias("f"))
    base = totals.select("bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("f").over(before), F.lit(0)).alias("f0"))
    w = Window.partitionBy("bucket").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    run = both.withColumn("ns", F.sum("s").over(w)).withColumn("nf", F.sum("f").over(w)).where("event_id is not null").join(base, "bucket")
    many = F.max(F.when(F.col("side") == -1, F.col("ns") + F.col("s0"))) - F.max(F.when(F.col("side") > 0, F.col("nf") + F.col("f0")))
    count = run.groupBy("event_id").agg(F.greatest(many, F.lit(1)).alias("overlaps"))
    reach = F.greatest(F.col("end"), F.col("start") + gap)
    e = events.withColumn("_b", at("start"))
    ends = e.groupBy("_b").agg(F.max(reach).alias("_r"))
    past = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_b").orderBy("start", "end", "event_id")
    e = e.join(ends.select("_b", F.max("_r").over(past).alias("_past")), "_b")
    so_far = F.greatest(F.max(reach).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.col("_past"))
    e = e.withColumn("_new", F.coalesce((F.col("start") > so_far).cast("int"), F.lit(1)))
    opened = e.groupBy("_b").agg(F.sum("_new").alias("_k")).select("_b", F.coalesce(F.sum("_k").over(past), F.lit(0)).alias("_before"))
    clusters = e.join(opened, "_b").withColumn("cluster", F.col("_before") + F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return clusters.select(*events.columns, "cluster").join(count, "event_id").withColumn("uniqueness", 1 / F.col("overlaps"))


def split_events(events: DataFrame, share: float = 0.7, embargo: int = 0, bucket: int = 86400) -> DataFrame:
    """Train or test by each symbol's order in time; rows whose interval crosses the boundary are purged; weights by time bucket."""
    w = Window.partitionBy("symbol")
    k, n = F.row_number().over(w.orderBy("start", "event_id")), F.count(F.lit(1)).over(w)
    cut = F.floor(n * F.lit(share))
    df = events.withColumn("_k", k).withColumn("_cut", cut)
    boundary = F.min(F.when(F.col("_k") > F.col("_cut"), F.col("start"))).over(w)
    part = F.when(F.col("_k") > F.col("_cut"), "test").when(F.col("end") >= boundary - embargo, "purged").otherwise("train")
    df = df.withColumn("split", part).withColumn("bucket", F.floor(F.col("start") / bucket))
    return df.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("symbol", "bucket"))).drop("_k", "_cut")
