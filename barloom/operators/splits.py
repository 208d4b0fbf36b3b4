"""Index splits: they plan over row numbers, never over rows; on the driver, or as a table with the ranges of every symbol."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Range = tuple[int, int]


def out_of_time(n: int, ratio: float) -> tuple[Range, Range]:
    cut = int(n * (1 - ratio))
    return (0, cut), (cut, n)


def expanding(n: int, folds: int) -> list[tuple[Range, Range]]:
    """Growing train ranges, each with the test range after it."""
    size = n // (folds + 1)
    if size < 1:
        raise ValueError(f"too few rows for {folds} folds: {n}")
    return [((0, n - size * (folds - k)), (n - size * (folds - k), n - size * (folds - k - 1))) for k in range(folds)]


def purged(n: int, folds: int, purge: int, embargo: float) -> list[tuple[Range, Range]]:
    """Expanding folds without the last train rows and the first test rows; small ones are left out."""
    out = []
    for (a, b), (c, d) in expanding(n, folds):
        train, test = (a, max(a, b - purge)), (c + int((d - c) * embargo), d)
        if train[1] - train[0] >= 10 and test[1] - test[0] >= 5:
            out.append((train, test))
    return out


def walk_forward(n: int, train: int, test: int, step: int, gap: int = 0) -> Iterator[tuple[Range, Range]]:
    start = 0
    while start + train + gap + test <= n:
        yield (start, start + train), (start + train + gap, start + train + gap + test)
        start += step


def combinatorial(n: int, groups: int, tests: int, purge: int, embargo: int, most: int | None = None, seed: int = 42) -> list[tuple[list[Range], list[Range]]]:
    """Every choice of ``tests`` groups as test; train rows near a test range are purged or embargoed."""
    edges = [round(k * n / groups) for k in range(groups + 1)]
    picks = list(itertools.combinations(range(groups), tests))
    if most is not None and len(picks) > most:
        picks = sorted(random.Random(seed).sample(picks, most))
    out = []
    for pick in picks:
        test = [(edges[k], edges[k + 1]) for k in pick]
        gap = embargo
        while True:
            train = _outside(n, [(a - purge, b + gap) for a, b in test])
            if train or not gap:
                break
            gap //= 2
        out.append((train, test))
    return out


def _outside(n: int, taken: list[Range]) -> list[Range]:
    out, at = [], 0
    for a, b in sorted(taken):
        if a > at:
            out.append((at, min(a, n)))
        at = max(at, b)
    return out + [(at, n)] if at < n else out


def symmetric_halves(blocks: int, most: int | None = None) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Every choice of half of the blocks, with the other half."""
    if blocks % 2:
        raise ValueError("an even number of blocks is needed")
    every = range(blocks)
    out = [(pick, tuple(k for k in every if k not in pick)) for pick in itertools.combinations(every, blocks // 2)]
    return out[:most]


def sliding_windows(n: int, width: int, stride: int) -> list[int]:
    """Starts of windows, the last possible one left out."""
    return list(range(0, max(0, n - width), stride))


def sequence(strategy: str, low: int, high: int, standard: tuple[int, ...] = (), count: int = 8) -> list[int]:
    """Parameter values between bounds: Fibonacci numbers, or equal steps of value or of logarithm, and the standard ones."""
    if strategy == "fibonacci":
        found, a, b = set(), 1, 2
        while a <= high:
            found |= {a} if a >= low else set()
            a, b = b, a + b
    elif strategy == "log":
        found = {round(math.exp(math.log(low) + k * (math.log(high) - math.log(low)) / (count - 1))) for k in range(count)}
    else:
        found = {round(low + k * (high - low) / (count - 1)) for k in range(count)}
    return sorted(found | {s for s in standard if low <= s <= high})


PLAN = "symbol string, fold int, part string, start long, end long, n long"


def plan_table(df: DataFrame, plan: Callable[[int], list[tuple]], allowed: set[str] | None = None) -> DataFrame:
    """(symbol, fold, part, start, end, n): the row ranges that ``plan`` gives for each symbol's number of rows.

    ``plan`` gives (train, test) pairs, each a range or a list of ranges.  Rows are only counted;
    symbols with equal counts share a plan.  A symbol outside ``allowed`` is an error.
    """
    sizes = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    if allowed is not None:
        strange = sizes.where(~F.col("symbol").isin(*allowed)).limit(3).collect()
        if strange:
            raise ValueError(f"symbols that are not allowed: {[r['symbol'] for r in strange]}")
    ranges = []
    for row in sizes.select("n").distinct().collect():  # distinct lengths of histories
        for fold, (train, test) in enumerate(plan(row["n"])):
            for part, found in (("train", train), ("test", test)):
                ranges += [(row["n"], fold, part, a, b) for a, b in ([found] if isinstance(found, tuple) else found)]
    if not ranges:
        raise ValueError("no symbol has rows for a split")
    known = df.sparkSession.createDataFrame(ranges, "n long, fold int, part string, start long, end long")
    return sizes.join(known, "n").select("symbol", "fold", "part", "start", "end", "n")


def parts_of(df: DataFrame, plan: DataFrame, fold: int) -> DataFrame:
    """``df`` with the part of each row in one fold (null between the parts): rows meet their symbol's few ranges."""
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = df.withColumn("_k", F.row_number().over(w) - 1)
    ranges = plan.where(F.col("fold") == fold).groupBy("symbol").agg(F.collect_list(F.struct("part", "start", "end")).alias("_p"))
    hit = F.filter("_p", lambda p: (p["start"] <= F.col("_k")) & (F.col("_k") < p["end"]))
    return rows.join(ranges, "symbol", "left").withColumn("part", F.get(hit, F.lit(0))["part"]).drop("_k", "_p")


def runs(df: DataFrame, number: str, keys: list[str]) -> DataFrame:
    """(keys, start, end): the [start, end) ranges of numbers that follow each other."""
    w = Window.partitionBy(*keys).orderBy(number)
    d = df.select(*keys, number).distinct().withColumn("_g", F.col(number) - F.row_number().over(w))
    return d.groupBy(*keys, "_g").agg(F.min(number).alias("start"), (F.max(number) + 1).alias("end")).drop("_g")


def overlap(train: DataFrame, test: DataFrame, ts: str = "ts") -> DataFrame:
    """(train_last, test_first, apart): whether all training rows lie before all test rows."""
    a, b = train.agg(F.max(ts).alias("train_last")), test.agg(F.min(ts).alias("test_first"))
    return a.join(b).withColumn("apart", F.col("train_last") < F.col("test_first"))
