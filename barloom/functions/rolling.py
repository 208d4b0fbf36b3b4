"""Rolling columns over the last ``n`` rows of a symbol, null unless all ``n`` are present.

Every function takes a column (or its name) and gives a Column over a bounded
frame: no self-join and one sort for all of a plan's columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` as floating point has it: infinite or NaN over zero, where Spark's division fails."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


def log(c: Column) -> Column:
    """Natural logarithm, minus infinity at zero, where Spark's is null."""
    return F.when(c == 0, F.lit(float("-inf"))).otherwise(F.ln(c))


def order() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


def frame(n: int) -> WindowSpec:
    return order().rowsBetween(1 - n, 0)


def running() -> WindowSpec:
    return order().rowsBetween(Window.unboundedPreceding, 0)


def full(c: C, n: int, value: Column, least: int | None = None) -> Column:
    """``value`` where the frame has ``least`` (``n``) non-null rows."""
    return F.when(F.count(col(c)).over(frame(n)) >= (least or n), value)


def lag(c: C, n: int = 1) -> Column:
    return F.lag(col(c), n).over(order())


def lead(c: C, n: int = 1) -> Column:
    return F.lead(col(c), n).over(order())


def row_no() -> Column:
    return F.row_number().over(order())


def mean(c: C, n: int) -> Column:
    return full(c, n, F.avg(col(c)).over(frame(n)))


def total(c: C, n: int) -> Column:
    return full(c, n, F.sum(col(c)).over(frame(n)))


def highest(c: C, n: int) -> Column:
    return full(c, n, F.max(col(c)).over(frame(n)))


def lowest(c: C, n: int) -> Column:
    return full(c, n, F.min(col(c)).over(frame(n)))


def std(c: C, n: int, ddof: int = 1) -> Column:
    return full(c, n, (F.stddev_samp if ddof else F.stddev_pop)(col(c)).over(frame(n)))


def var(c: C, n: int, ddof: int = 1) -> Column:
    return full(c, n, (F.var_samp if ddof else F.var_pop)(col(c)).over(frame(n)))


def quantile(c: C, n: int, q: float, least: int | None = None) -> Column:
    return full(c, n, F.percentile(col(c), F.lit(q)).over(frame(n)), least)


def zscore(c: C, n: int) -> Column:
    s = std(c, n)
    return F.when(s > 0, (col(c) - mean(c, n)) / s)


def pearson(a: C, b: C, over: WindowSpec | None = None) -> Column:
    """Correlation over rows that have both, null for constants (an aggregate, or over a window)."""
    a, b = col(a), col(b)
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    on = (lambda e: e) if over is None else (lambda e: e.over(over))
    spread = on(F.stddev_pop(x)) * on(F.stddev_pop(y))
    return on(F.covar_pop(a, b)) / F.when(spread > 1e-14, spread)


def corr(a: C, b: C, n: int) -> Column:
    both = F.when(col(a).isNotNull() & col(b).isNotNull(), col(a))
    return full(both, n, pearson(a, b, frame(n)))


def covar(a: C, b: C, n: int, ddof: int = 1) -> Column:
    a, b = col(a), col(b)
    both = F.when(a.isNotNull() & b.isNotNull(), a)
    return full(both, n, (F.covar_samp if ddof else F.covar_pop)(a, b).over(frame(n)))


def values(c: C, n: int) -> Column:
    """The frame's values in order, as an array."""
    return F.collect_list(col(c)).over(frame(n))


def slope(c: C, n: int) -> Column:
    """Least squares slope on 0..n-1: a weighted sum of the frame."""
    if n < 2:
        return F.lit(None).cast("double")
    weights = F.array(*[F.lit(12.0 * (i - (n - 1) / 2) / (n * (n * n - 1))) for i in range(n)])
    return full(c, n, F.aggregate(F.zip_with(values(c, n), weights, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x))


def intercept(c: C, n: int) -> Column:
    return mean(c, n) - slope(c, n) * ((n - 1) / 2)


def forecast(c: C, n: int, ahead: int) -> Column:
    """The regression line ``ahead`` rows after the frame's last."""
    return mean(c, n) + slope(c, n) * ((n - 1) / 2 + ahead)


def rank_pct(c: C, n: int) -> Column:
    """Average rank of the current value in the frame, over ``n``."""
    def pick(v: Column) -> Column:
        x = F.element_at(v, -1)
        less, same = F.size(F.filter(v, lambda y: y < x)), F.size(F.filter(v, lambda y: y == x))
        return (less + (same + 1) / 2) / n

    return full(c, n, pick(values(c, n)))


def argmax(c: C, n: int, last: bool = False) -> Column:
    """Place 0..n-1 of the first (last) maximum in the frame."""
    v = values(c, n)
    if last:
        return full(c, n, n - F.array_position(F.reverse(v), F.array_max(v)))
    return full(c, n, F.array_position(v, F.array_max(v)) - 1)


def argmin(c: C, n: int, last: bool = False) -> Column:
    v = values(c, n)
    if last:
        return full(c, n, n - F.array_position(F.reverse(v), F.array_min(v)))
    return full(c, n, F.array_position(v, F.array_min(v)) - 1)


def weighted(c: C, n: int) -> Column:
    """Linearly weighted mean: weights 1..n, the current row the heaviest."""
    terms = [col(c) * n] + [lag(c, k) * (n - k) for k in range(1, n)]
    return full(c, n, sum(terms[1:], terms[0]) / (n * (n + 1) / 2))


def _flat(c: C, n: int) -> Column:
    """Whether the frame is constant but for rounding."""
    m2 = F.var_pop(col(c)).over(frame(n)) * n
    return (m2 <= 0) | (m2 <= 1e-12 * F.sum(col(c) * col(c)).over(frame(n)))


def skew(c: C, n: int) -> Column:
    """Bias-corrected skewness; null for constant frames or impossible values."""
    if n < 3:
        return F.lit(None).cast("double")
    g = F.skewness(col(c)).over(frame(n)) * ((n * (n - 1)) ** 0.5 / (n - 2))
    return full(c, n, F.when(~_flat(c, n) & (F.abs(g) <= n**0.5 * (1 + 1e-9)), g))


def kurt(c: C, n: int) -> Column:
    """Bias-corrected excess kurtosis; null for constant frames or impossible values."""
    if n < 4:
        return F.lit(None).cast("double")
    g = ((n + 1) * F.kurtosis(col(c)).over(frame(n)) + 6) * ((n - 1) / ((n - 2) * (n - 3)))
    return full(c, n, F.when(~_flat(c, n) & (g >= -2 * (n - 1) / (n - 3)) & (g <= n), g))


def mean_abs_dev(c: C, n: int) -> Column:
    v = values(c, n)
    m = F.avg(col(c)).over(frame(n))
    return full(c, n, F.aggregate(F.transform(v, lambda x: F.abs(x - m)), F.lit(0.0), lambda a, x: a + x) / n)


def safe_ratio(a: C, b: C, eps: float = 1e-12, cap: float | None = None) -> Column:
    r = F.when(F.abs(col(b)) > eps, col(a) / col(b))
    return r if cap is None else F.greatest(F.least(r, F.lit(cap)), F.lit(-cap))


def crosses(a: C, b: C) -> Column:
    """Whether ``a - b`` changes sign from the row before; a difference of zero or null on either row is no cross."""
    s = F.signum(col(a) - col(b))
    return F.coalesce(s * F.lag(s).over(order()) < 0, F.lit(False))


def bars_since(event: Column, n: int) -> Column:
    """Rows since ``event`` last held among the last ``n``; null if it did not, and on the first ``n`` rows, as an event needs the row before."""
    at = F.max(F.when(event, row_no())).over(frame(n))
    return F.when(row_no() > n, row_no() - at)


def count_in(event: Column, n: int) -> Column:
    """How often ``event`` holds among the last ``n`` rows; null on the first ``n``."""
    return F.when(row_no() > n, F.sum(event.cast("int")).over(frame(n)))
