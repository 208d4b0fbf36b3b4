"""DuckDB text of the entropy and fractal features: lists of a window's values, folded."""

from __future__ import annotations

import math

from barloom.plans import sql as S

O = S.OVER


def _lists(n: int, extra: str = "") -> str:
    return f"with {S.bars()}, w as (select symbol, ts{extra}, case when count(close) over {S.w(n)} = {n} then list(close) over {S.w(n)} end as l from bars)"


SHANNON = _lists(50) + """, e as (select symbol, ts, l, list_min(l) as lo, (list_max(l) - list_min(l)) / 10 as step from w),
 b as (select *, list_transform(l, lambda x: len(list_filter(range(1, 10), lambda k: x >= k * step + lo))) as bins from e),
 c as (select *, list_transform(range(0, 10), lambda k: len(list_filter(bins, lambda a: a = k)) / 50.0) as p from b)
 select symbol, ts, round(case when l is null then null when step = 0 then 0 else -list_sum(list_transform(list_filter(p, lambda x: x > 0), lambda x: x * log2(x))) end, 6) + 0.0 as shannon from c"""


def _pattern() -> str:
    a, b = f"lag(close, 2) over {O}", f"lag(close) over {O}"
    return f"cast({a} <= {b} as int) * 4 + cast({b} <= close as int) * 2 + cast({a} <= close as int)"


_P = "(partition by symbol order by ts rows between 47 preceding and current row)"
PERMUTATION = f"with {S.bars()}, c as (select symbol, ts, {_pattern()} as k from bars), n as (select symbol, ts, count(k) over {_P} as m, " + ", ".join(f"count(*) filter (where k = {k}) over {_P} / 48.0 as p{k}" for k in range(8)) + " from c) select symbol, ts, round(case when m = 48 then -(" + " + ".join(f"case when p{k} > 0 then p{k} * log2(p{k}) else 0 end" for k in range(8)) + f") / {math.log2(6)!r} end, 6) + 0.0 as permutation from n"


def _curve(k: int, n: int) -> str:
    """Length of the curve at step ``k``, the mean over its starts."""
    each = [f"list_sum(list_transform(range({m + k}, {n}, {k}), lambda j: abs(l[j + 1] - l[j + 1 - {k}]))) * {(n - 1) / (((n - 1 - m) // k) * k) / k!r}" for m in range(k) if (n - 1 - m) // k > 0]
    return f"({' + '.join(each)}) / {len(each)}"


def _higuchi(n: int = 50, most: int = 8) -> str:
    x = [math.log(1 / k) for k in range(1, most + 1)]
    mean = sum(x) / most
    below = sum((v - mean) ** 2 for v in x)
    lengths = ", ".join(f"{_curve(k, n)} as c{k}" for k in range(1, most + 1))
    slope = " + ".join(f"ln(c{k}) * {(v - mean) / below!r}" for k, v in enumerate(x, 1))
    return _lists(n) + f", c as (select symbol, ts, l, {lengths} from w) select symbol, ts, round(case when l is not null and least({', '.join(f'c{k}' for k in range(1, most + 1))}) > 0 then {slope} end, 6) + 0.0 as higuchi from c"


HIGUCHI = _higuchi()


def _hurst(n: int = 100) -> str:
    sizes = [s for s in (n // 8, n // 4, n // 2, n) if s >= 4]
    stages = _lists(n)
    for s in sizes:
        parts = f"list_transform(range(0, {n // s}), lambda k: l[k * {s} + 1:(k + 1) * {s}])"
        walk = f"list_transform(range(1, {s + 1}), lambda i: list_sum(p[1:i]) - i * list_avg(p))"
        ratio = f"list_transform({parts}, lambda p: case when list_stddev_pop(p) > 0 then (list_max({walk}) - list_min({walk})) / list_stddev_pop(p) end)"
        stages += f", s{s} as (select symbol, ts, ln(list_avg(list_filter({ratio}, lambda r: r is not null))) as y from w where l is not null)"
    stages += ", y as (" + " union all ".join(f"select symbol, ts, {math.log(s)!r} as x, y from s{s} where y is not null" for s in sizes) + ")"
    return stages + """, f as (select symbol, ts, count(*) as m, regr_slope(y, x) as slope, regr_r2(y, x) as fit from y group by 1, 2)
 select w.symbol, w.ts, round(case when m >= 3 and fit >= 0.1 then slope end, 5) + 0.0 as hurst from w left join f on f.symbol = w.symbol and f.ts = w.ts"""


HURST = _hurst()


def _near(m: int, last: int) -> str:
    """For each stretch of ``m`` values that begins before ``last``, how many such stretches lie within the tolerance."""
    close = " and ".join(f"abs(l[i + {k}] - l[j + {k}]) <= tol" for k in range(m))
    return f"list_transform(range(1, {last + 1}), lambda i: len(list_filter(range(1, {last + 1}), lambda j: {close})))"


def _entropies(n: int = 40) -> str:
    return _lists(n) + f""", t as (select *, 0.2 * list_stddev_pop(l) as tol from w),
 c as (select symbol, ts, l, tol, {_near(2, n - 1)} as a2, {_near(3, n - 2)} as a3, {_near(2, n - 2)} as b2 from t),
 s as (select *, list_sum(list_transform(a3, lambda x: x - 1)) as a, list_sum(list_transform(b2, lambda x: x - 1)) as b from c)
 select symbol, ts, round(case when l is null then null when tol = 0 then 0 else list_avg(list_transform(a2, lambda x: ln(x / {float(n - 1)!r}))) - list_avg(list_transform(a3, lambda x: ln(x / {float(n - 2)!r}))) end, 6) + 0.0 as apen,
 round(case when l is null then null when tol = 0 then 0 when a > 0 and b > 0 then -ln(a / b) end, 6) + 0.0 as sampen from s"""


ENTROPIES = _entropies()
