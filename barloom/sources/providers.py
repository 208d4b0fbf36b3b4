"""Fetching bars: providers by name, pages of time, retries, rate limits, ingest of many symbols, a cache that reads through."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources import bars as B

Fetch = Callable[[SparkSession, str, int, int, str], DataFrame]
"""(session, symbol, start, end, timeframe) to bars of [start, end]."""

PAGE = 1000
"""Rows that one request of a paged source gives."""


def landed(path: str) -> Fetch:
    """A provider over bars that lie in Parquet files; symbol and times reach the scan."""
    def fetch(spark: SparkSession, symbol: str, start: int, end: int, timeframe: str) -> DataFrame:
        rows = spark.read.parquet(path)
        if "timeframe" in rows.columns:
            rows = rows.where(F.col("timeframe") == timeframe)
        return rows.where((F.col("symbol") == symbol) & F.col("ts").between(start, end))

    return fetch


class Providers:
    """Providers by name."""

    def __init__(self) -> None:
        self.known: dict[str, Fetch] = {}

    def register(self, name: str, fetch: Fetch) -> None:
        self.known[name] = fetch

    def fetch(self, name: str, spark: SparkSession, symbol: str, start: int, end: int, timeframe: str) -> DataFrame:
        if name not in self.known:
            raise KeyError(f"unknown source {name!r}; known: {sorted(self.known)}")
        if start > end:
            raise ValueError("the start is after the end")
        B.seconds(timeframe)
        return self.known[name](spark, symbol, start, end, timeframe)


def pages(start: int, end: int, timeframe: str, rows: int = PAGE) -> Iterator[tuple[int, int]]:
    """The [first, last] times of each request: the next begins one bar after the last one's end."""
    step = B.seconds(timeframe)
    while start <= end:
        last = min(end, start + (rows - 1) * step)
        yield start, last
        start = last + step


class RateLimit:
    """Tokens that fill at a rate up to a burst; ``acquire`` waits for them."""

    def __init__(self, rate: float, burst: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = float(burst), clock()

    def acquire(self, n: int = 1) -> float:
        """Seconds waited."""
        if n > self.burst:
            raise ValueError("more tokens than the burst")
        now = self.clock()
        self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        wait = max(0.0, (n - self.tokens) / self.rate)
        if wait:
            self.sleep(wait)
            self.at += wait
            self.tokens += wait * self.rate
        self.tokens -= n
        return wait


class Transient(Exception):
    """An error after which a request may be tried again."""


def with_retries(call: Callable[[], object], tries: int = 3, first: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """The call's result; transient errors are tried again after waits that double, others are not."""
    for k in range(tries):
        try:
            return call()
        except Transient:
            if k + 1 == tries:
                raise
            sleep(first * 2**k)
    raise ValueError("at least one try is needed")


def ingest(providers: Providers, source: str, spark: SparkSession, symbols: list[str], start: int, end: int, timeframe: str, path: str | None = None, stop: Callable[[], bool] = lambda: False) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Bars of many symbols in one frame (and store), and the symbols that failed with why; a failure doesn't end the rest."""
    out, failed = None, []
    for symbol in symbols:
        if stop():
            break
        try:
            rows = providers.fetch(source, spark, symbol, start, end, timeframe)
            out = rows if out is None else out.unionByName(rows)
        except (KeyError, ValueError, Transient) as e:
            failed.append((symbol, str(e)))
    if out is not None and path is not None:
        B.write_bars(out, path, timeframe)
    return out, failed


def missing_ranges(have: tuple[int, int] | None, start: int, end: int, step: int) -> list[tuple[int, int]]:
    """What of [start, end] a cache that holds [first, last] lacks: nothing, all, or the parts before and after it."""
    if have is None or have[1] < start or have[0] > end:
        return [(start, end)]
    out = []
    if start < have[0]:
        out.append((start, have[0] - step))
    if end > have[1]:
        out.append((have[1] + step, end))
    return [r for r in out if r[0] <= r[1]]


def read_through(cached: DataFrame, fetch: Fetch, spark: SparkSession, symbol: str, start: int, end: int, timeframe: str) -> tuple[DataFrame, str]:
    """Bars of [start, end] from the cache and, for what it lacks, from the source; and whether that was a hit, partial or a miss."""
    step = B.seconds(timeframe)
    own = cached.where(F.col("symbol") == symbol)
    row = own.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    lacks = missing_ranges(None if row["a"] is None else (row["a"], row["b"]), start, end, step)
    out = own.where(F.col("ts").between(start, end))
    for a, b in lacks:
        fresh = fetch(spark, symbol, a, b, timeframe)
        out = out.unionByName(fresh.select(*out.columns).join(out.select("symbol", "ts"), ["symbol", "ts"], "left_anti"))
    kind = "hit" if not lacks else "miss" if lacks == [(start, end)] else "partial"
    return out, kind


def last_time(*sources: DataFrame) -> DataFrame:
    """(symbol, ts): the newest time of each symbol over all sources."""
    every = sources[0].select("symbol", "ts")
    for s in sources[1:]:
        every = every.unionByName(s.select("symbol", "ts"))
    return every.groupBy("symbol").agg(F.max("ts").alias("ts"))


def stale(newest: int | None, now: int, most_age: int) -> bool:
    """Whether a cache has to be filled anew."""
    return newest is None or now - newest > most_age
