"""Registries of operators, indicators, strategies and data sources: names to builders of columns or frames.

A builder is a Python function that the caller registers; nothing is imported by name from settings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import rolling as R


class Registry:
    """Names to builders, with what each needs."""

    def __init__(self, kind: str) -> None:
        self.kind, self.entries = kind, {}

    def register(self, name: str, build: Callable, replace: bool = False, **about) -> None:
        if name in self.entries and not replace:
            raise ValueError(f"{self.kind} {name!r} is registered already")
        self.entries[name] = {"build": build} | about

    def build(self, name: str, *args, **parameters):
        if name not in self.entries:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {sorted(self.entries)}")
        return self.entries[name]["build"](*args, **parameters)

    def names(self) -> list[str]:
        return sorted(self.entries)


def operators() -> Registry:
    """The operators on a column (or two) and a window, by the names of a feature's layer."""
    c = R.col
    out = Registry("operator")
    one = {
        "sign": lambda x: F.signum(c(x)), "abs": lambda x: F.abs(c(x)), "log1p": lambda x: F.signum(c(x)) * F.log1p(F.abs(c(x))), "signed_strength": lambda x: F.signum(c(x)) * F.abs(c(x)),
        "lag": lambda x, n=1: R.lag(x, n), "diff": lambda x, n=1: c(x) - R.lag(x, n), "momentum": lambda x, n: c(x) / F.nullif(R.lag(x, n), F.lit(0.0)) - 1, "clip": lambda x, low, high: F.greatest(F.least(c(x), F.lit(high)), F.lit(low)),
    }
    windowed = {"mean": R.mean, "std": R.std, "min": R.lowest, "max": R.highest, "range": lambda x, n: R.highest(x, n) - R.lowest(x, n), "slope": R.slope, "rank": R.rank_pct, "zscore": R.zscore, "skew": R.skew, "kurt": R.kurt, "ts_argmax": R.argmax, "ts_argmin": R.argmin, "decay_linear": R.weighted}
    two = {"ratio": R.safe_ratio, "distance": lambda a, b: R.safe_ratio(c(a) - c(b), b), "cross": lambda a, b: F.when(R.crosses(a, b), F.signum(c(a) - c(b))).otherwise(0.0), "ts_corr": R.corr}
    for arity, group in (("column", one), ("window", windowed), ("pair", two)):
        for name, build in group.items():
            out.register(name, build, takes=arity)
    return out


def counter_metadata(name: str, n: int) -> dict:
    """Rows before a state counter's first value, and what it may look at."""
    after = {"bars_since_cross": n, "bars_since_threshold": n, "cross_count": n, "consecutive_run": n - 1, "window_max_ratio": n - 1}
    if name not in after:
        raise KeyError(f"unknown state counter: {name}")
    return {"operator": name, "max_lookback": n, "warmup": after[name], "null_without_event": name != "cross_count"}


@dataclass(frozen=True)
class Strategy:
    """A strategy makes columns from parameters that keep to their types and ranges."""

    build: Callable[[DataFrame, dict], dict[str, Column]]
    required: dict[str, type] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)

    def faults(self, parameters: dict) -> list[str]:
        out = [f"{k} is missing" for k in self.required if k not in parameters and k not in self.defaults]
        out += [f"{k} is not a {t.__name__}" for k, t in self.required.items() if k in parameters and not isinstance(parameters[k], t)]
        return out + [f"{k} is not within {a} and {b}" for k, (a, b) in self.ranges.items() if k in parameters and not a <= parameters[k] <= b]

    def apply(self, df: DataFrame, parameters: dict) -> DataFrame:
        if wrong := self.faults(parameters):
            raise ValueError("; ".join(wrong))
        return df.withColumns(self.build(df, self.defaults | parameters))


def indicators(df: DataFrame, wanted: list[dict], known: Registry) -> DataFrame:
    """Adds the columns of a list of {name, parameters}, named ``NAME_p1_p2``; one window sort for all."""
    new = {}
    for w in wanted:
        p = w.get("parameters", {})
        new["_".join([w["name"].upper(), *map(str, p.values())])] = known.build(w["name"], **p)
    return df.withColumns(new)


def out_of_range(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(column, n): how many values of a source's columns lie outside their range."""
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(~F.col(c).between(a, b)).alias("n")) for c, (a, b) in ranges.items()])
    return df.agg(parts.alias("_p")).select(F.inline("_p"))


def few_valued(df: DataFrame, columns: list[str], least: int = 3) -> list[str]:
    """Columns with fewer than ``least`` distinct values, for which higher moments mean nothing; one approximate pass."""
    row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] < least]
