"""DuckDB text of the rolling columns, for the oracle of each query."""

from __future__ import annotations

OVER = "(partition by symbol order by ts)"
RUNNING = "(partition by symbol order by ts rows between unbounded preceding and current row)"


def w(n: int) -> str:
    return f"(partition by symbol order by ts rows between {n - 1} preceding and current row)"


def bars(size: int = 3600, name: str = "bars") -> str:
    """A common table of bars of ``size`` seconds over the events."""
    return f"""{name} as (select event_type as symbol, (epoch_us(ts) // {size * 1_000_000}) * {size} as ts,
      arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close,
      cast(count(*) as double) as volume, cast(count(*) filter (where user_id % 2 = 0) as double) as taker_buy_volume,
      cast(count(*) filter (where user_id % 2 = 0) as double) / count(*) as taker_ratio, sum(value) as quote_volume, count(*) as trades
      from events group by 1, 2)"""


def full(c: str, n: int, value: str) -> str:
    return f"case when count({c}) over {w(n)} >= {n} then {value} end"


def lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) over {OVER}"


def lead(c: str, n: int = 1) -> str:
    return f"lead({c}, {n}) over {OVER}"


def agg(f: str, c: str, n: int) -> str:
    return full(c, n, f"{f}({c}) over {w(n)}")


def mean(c: str, n: int) -> str:
    return agg("avg", c, n)


def total(c: str, n: int) -> str:
    return agg("sum", c, n)


def highest(c: str, n: int) -> str:
    return agg("max", c, n)


def lowest(c: str, n: int) -> str:
    return agg("min", c, n)


def std(c: str, n: int, ddof: int = 1) -> str:
    return agg("stddev_samp" if ddof else "stddev_pop", c, n)


def var(c: str, n: int, ddof: int = 1) -> str:
    return agg("var_samp" if ddof else "var_pop", c, n)


def quantile(c: str, n: int, q: float) -> str:
    return full(c, n, f"quantile_cont({c}, {q}) over {w(n)}")


def pair(f: str, a: str, b: str, n: int) -> str:
    return f"case when count(case when {b} is not null then {a} end) over {w(n)} >= {n} then {f}({a}, {b}) over {w(n)} end"


def slope(c: str, n: int) -> str:
    return full(c, n, f"regr_slope({c}, rn) over {w(n)}")


def weighted(c: str, n: int) -> str:
    terms = " + ".join([f"{c} * {n}"] + [f"({lag(c, k)}) * {n - k}" for k in range(1, n)])
    return full(c, n, f"({terms}) / {n * (n + 1) / 2}")


def nested(stages: list[dict[str, str]], source: str = "bars") -> str:
    """Each stage's columns over the stage before it."""
    text = f"(select *, row_number() over {OVER} as rn from {source})"
    for k, stage in enumerate(stages):
        text = f"(select *, {', '.join(f'{v} as {c}' for c, v in stage.items())} from {text} s{k})"
    return text


def query(stages: list[dict[str, str]], outputs: list[str], size: int = 3600, digits: int = 6) -> str:
    """The oracle text of a query over bars with the given outputs, rounded."""
    named = ", ".join(f"round({o}, {digits}) + 0.0 as {o}" for o in outputs)
    return f"with {bars(size)} select symbol, ts, {named} from {nested(stages)} z"
