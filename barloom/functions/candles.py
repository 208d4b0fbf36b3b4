"""Candlestick patterns as columns: 100 bullish, -100 bearish, 0 none (200 confirmed).

A candle's body, shadows and range are compared with averages of the candles
before it; each pattern is a conjunction over the last few candles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import rolling as R

# For each measure its range, the candles averaged, and the factor.
SETTINGS = {
    "body_long": ("body", 10, 1.0), "body_very_long": ("body", 10, 3.0), "body_short": ("body", 10, 1.0), "body_doji": ("range", 10, 0.1),
    "shadow_long": ("body", 0, 1.0), "shadow_very_long": ("body", 0, 2.0), "shadow_short": ("shadows", 10, 1.0), "shadow_very_short": ("range", 10, 0.1),
    "near": ("range", 5, 0.2), "far": ("range", 5, 0.6), "equal": ("range", 5, 0.05),
}


def _average(name: str) -> str | None:
    """The column that holds the average of a measure, if it has one."""
    kind, n, _ = SETTINGS[name]
    return f"_avg_{kind}_{n}" if n else None


def prepare(bars: DataFrame, used: set[str] | None = None) -> DataFrame:
    """Working columns of one candle (body, range, shadows, colour, four averages), and of those before it.

    ``used`` names the ones of earlier candles that are wanted (all of the last four by default).
    """
    o, h, low, c = (F.col(k) for k in ("open", "high", "low", "close"))
    base = bars.withColumns({"_body": F.abs(c - o), "_range": h - low, "_up": h - F.greatest(o, c), "_down": F.least(o, c) - low, "_color": F.when(c >= o, 1).otherwise(-1)})
    base = base.withColumn("_shadows", F.col("_up") + F.col("_down"))
    new = {}
    for kind, n in sorted({(kind, n) for kind, n, _ in SETTINGS.values() if n}):
        x, before = F.col(f"_{kind}"), R.order().rowsBetween(-n, -1)
        new[f"_avg_{kind}_{n}"] = F.when(F.count(x).over(before) >= n, F.avg(x).over(before))
    ready = base.withColumns(new)
    # Every candle that a pattern looks at, in one window: patterns are then a projection.
    looked = ["open", "high", "low", "close", *[c for c in ready.columns if c.startswith("_")]]
    return ready.withColumns({f"{c}__{k}": R.lag(c, k) for c in looked for k in range(1, 5) if used is None or f"{c}__{k}" in used})


_used: set[str] = set()
"""Columns that the patterns made last look at."""


@dataclass(frozen=True)
class Candle:
    """The candle ``k`` rows ago."""

    k: int

    def _(self, name: str) -> Column:
        column = name if self.k == 0 else f"{name}__{self.k}"
        _used.add(column)
        return F.col(column)

    @property
    def o(self) -> Column:
        return self._("open")

    @property
    def h(self) -> Column:
        return self._("high")

    @property
    def low(self) -> Column:
        return self._("low")

    @property
    def c(self) -> Column:
        return self._("close")

    @property
    def body(self) -> Column:
        return self._("_body")

    @property
    def up(self) -> Column:
        return self._("_up")

    @property
    def down(self) -> Column:
        return self._("_down")

    @property
    def range(self) -> Column:
        return self._("_range")

    @property
    def color(self) -> Column:
        return self._("_color")

    @property
    def top(self) -> Column:
        return F.greatest(self.o, self.c)

    @property
    def bottom(self) -> Column:
        return F.least(self.o, self.c)

    def avg(self, name: str) -> Column:
        kind, n, factor = SETTINGS[name]
        return self._(_average(name) or f"_{kind}") * (factor / (2 if kind == "shadows" else 1))

    @property
    def white(self) -> Column:
        return self.color == 1

    @property
    def black(self) -> Column:
        return self.color == -1

    @property
    def long(self) -> Column:
        return self.body > self.avg("body_long")

    @property
    def short(self) -> Column:
        return self.body <= self.avg("body_short")

    @property
    def small(self) -> Column:
        return self.body < self.avg("body_short")

    @property
    def doji(self) -> Column:
        return self.body <= self.avg("body_doji")

    @property
    def no_up(self) -> Column:
        return self.up < self.avg("shadow_very_short")

    @property
    def no_down(self) -> Column:
        return self.down < self.avg("shadow_very_short")

    def about(self, x: Column, y: Column, name: str = "equal") -> Column:
        return (x >= y - self.avg(name)) & (x <= y + self.avg(name))


def gap_up(a: Candle, b: Candle) -> Column:
    """Body of ``a`` wholly above the body of ``b``."""
    return a.bottom > b.top


def gap_down(a: Candle, b: Candle) -> Column:
    return a.top < b.bottom


def inside(a: Candle, b: Candle) -> Column:
    """Body of ``a`` within the body of ``b``."""
    return (a.top < b.top) & (a.bottom > b.bottom)


def _if(*rules: Column) -> Column:
    out = rules[0]
    for r in rules[1:]:
        out = out & r
    return F.coalesce(out, F.lit(False))


def _two(up: Column, down: Column) -> Column:
    return F.when(up, 100).when(down, -100).otherwise(0)


def _bull(*rules: Column) -> Column:
    return F.when(_if(*rules), 100).otherwise(0)


def _bear(*rules: Column) -> Column:
    return F.when(_if(*rules), -100).otherwise(0)


def _patterns() -> dict[str, Callable[[], Column]]:
    a, b, c, d, e = (Candle(k) for k in range(5))
    high_gap, low_gap = a.low > b.h, a.h < b.low
    star_up = lambda middle: _bull(c.long, c.black, middle, gap_down(b, c), a.body > a.avg("body_short"), a.white, a.c > c.c + 0.3 * c.body)
    star_down = lambda middle: _bear(c.long, c.white, middle, gap_up(b, c), a.body > a.avg("body_short"), a.black, a.c < c.c - 0.3 * c.body)
    either = lambda up, down: F.when(up > 0, up).when(down < 0, down).otherwise(0)
    kick = _if(b.color == -a.color, b.body > b.avg("body_long"), b.no_up, b.no_down, a.body > a.avg("body_long"), a.no_up, a.no_down, F.when(b.black, high_gap).otherwise(low_gap))
    hammer = (a.body < a.avg("body_short"), a.down > a.avg("shadow_long"), a.no_up)
    tiny = [x.body <= c.avg("body_doji") for x in (c, b, a)]  # all three against the first one's average
    three_white = (a.white, b.white, c.white, a.c > b.c, b.c > c.c)
    return {
        "CDL2CROWS": lambda: _bear(c.white, c.long, b.black, gap_up(b, c), a.black, a.o < b.o, a.o > b.c, a.c > c.o, a.c < c.c),
        "CDL3BLACKCROWS": lambda: _bear(d.white, c.black, c.no_down, b.black, b.no_down, a.black, a.no_down, b.o < c.o, b.o > c.c, a.o < b.o, a.o > b.c, d.h > c.c, c.c > b.c, b.c > a.c),
        "CDL3INSIDE": lambda: F.when(_if(c.long, b.short, inside(b, c), c.white, a.black, a.c < c.o), -100).when(_if(c.long, b.short, inside(b, c), c.black, a.white, a.c > c.o), 100).otherwise(0),
        "CDL3LINESTRIKE": lambda: _two(
            _if(d.white, c.white, b.white, a.black, b.c > c.c, c.c > d.c, a.o > b.c, a.c < d.o, c.o >= d.bottom - d.avg("near"), c.o <= d.top + d.avg("near"), b.o >= c.bottom - c.avg("near"), b.o <= c.top + c.avg("near")),
            _if(d.black, c.black, b.black, a.white, b.c < c.c, c.c < d.c, a.o < b.c, a.c > d.o, c.o >= d.bottom - d.avg("near"), c.o <= d.top + d.avg("near"), b.o >= c.bottom - c.avg("near"), b.o <= c.top + c.avg("near")),
        ),
        "CDL3OUTSIDE": lambda: _two(_if(b.white, c.black, b.c > c.o, b.o < c.c, a.c > b.c), _if(b.black, c.white, b.o > c.c, b.c < c.o, a.c < b.c)),
        "CDL3STARSINSOUTH": lambda: _bull(c.black, b.black, a.black, c.long, c.down > c.avg("shadow_long"), b.body < c.body, b.o > c.c, b.o <= c.h, b.low < c.c, b.low >= c.low, b.down > b.avg("shadow_very_short"), a.small, a.no_down, a.no_up, a.low > b.low, a.h < b.h),
        "CDL3WHITESOLDIERS": lambda: _bull(*three_white, c.no_up, b.no_up, a.no_up, b.o > c.o, b.o <= c.c + c.avg("near"), a.o > b.o, a.o <= b.c + b.avg("near"), b.body > c.body - c.avg("far"), a.body > b.body - b.avg("far"), a.body > a.avg("body_short")),
        "CDLABANDONEDBABY": lambda: either(_bull(c.long, b.doji, a.body > a.avg("body_short"), c.black, a.white, a.c > c.c + 0.3 * c.body, b.h < c.low, a.low > b.h), _bear(c.long, b.doji, a.body > a.avg("body_short"), c.white, a.black, a.c < c.c - 0.3 * c.body, b.low > c.h, a.h < b.low)),
        "CDLADVANCEBLOCK": lambda: _bear(
            *three_white, b.o > c.o, b.o <= c.c + c.avg("near"), a.o > b.o, a.o <= b.c + b.avg("near"), c.long, c.up < c.avg("shadow_short"),
            ((b.body < c.body - c.avg("far")) & (a.body < b.body + b.avg("near"))) | (a.body < b.body - b.avg("far"))
            | ((a.body < b.body) & (b.body < c.body) & ((a.up > a.avg("shadow_short")) | (b.up > b.avg("shadow_short")))) | ((a.body < b.body) & (a.up > a.avg("shadow_long"))),
        ),
        "CDLBELTHOLD": lambda: _two(_if(a.long, a.white, a.no_down), _if(a.long, a.black, a.no_up)),
        "CDLBREAKAWAY": lambda: _two(
            _if(e.long, e.black, d.black, b.black, a.white, gap_down(d, e), c.h < d.h, c.low < d.low, b.h < c.h, b.low < c.low, a.c > d.o, a.c < e.c),
            _if(e.long, e.white, d.white, b.white, a.black, gap_up(d, e), c.h > d.h, c.low > d.low, b.h > c.h, b.low > c.low, a.c < d.o, a.c > e.c),
        ),
        "CDLCLOSINGMARUBOZU": lambda: _two(_if(a.long, a.white, a.no_up), _if(a.long, a.black, a.no_down)),
        "CDLCONCEALBABYSWALL": lambda: _bull(d.black, c.black, b.black, a.black, d.no_up, d.no_down, c.no_up, c.no_down, gap_down(b, c), b.up > b.avg("shadow_very_short"), b.h > c.c, a.h > b.h, a.low < b.low),
        "CDLCOUNTERATTACK": lambda: _two(_if(b.color == -a.color, b.long, a.long, b.about(a.c, b.c), a.white), _if(b.color == -a.color, b.long, a.long, b.about(a.c, b.c), a.black)),
        "CDLDARKCLOUDCOVER": lambda: _bear(b.white, b.long, a.black, a.o > b.h, a.c > b.o, a.c < b.c - 0.5 * b.body),
        "CDLDOJI": lambda: _bull(a.doji),
        "CDLDOJISTAR": lambda: _two(_if(b.long, a.doji, b.black, gap_down(a, b)), _if(b.long, a.doji, b.white, gap_up(a, b))),
        "CDLDRAGONFLYDOJI": lambda: _bull(a.doji, a.no_up, a.down > a.avg("shadow_very_short")),
        "CDLENGULFING": lambda: _two(_if(a.white, b.black, a.c >= b.o, a.o <= b.c, (a.c > b.o) | (a.o < b.c)), _if(a.black, b.white, a.o >= b.c, a.c <= b.o, (a.o > b.c) | (a.c < b.o))),
        "CDLEVENINGDOJISTAR": lambda: star_down(b.doji),
        "CDLEVENINGSTAR": lambda: star_down(b.short),
        "CDLGAPSIDESIDEWHITE": lambda: _two(_if(gap_up(b, c), gap_up(a, c), b.white, a.white, b.about(a.body, b.body, "near"), b.about(a.o, b.o)), _if(gap_down(b, c), gap_down(a, c), b.white, a.white, b.about(a.body, b.body, "near"), b.about(a.o, b.o))),
        "CDLGRAVESTONEDOJI": lambda: _bull(a.doji, a.no_down, a.up > a.avg("shadow_very_short")),
        "CDLHAMMER": lambda: _bull(*hammer, a.bottom <= b.low + b.avg("near")),
        "CDLHANGINGMAN": lambda: _bear(*hammer, a.bottom >= b.h - b.avg("near")),
        "CDLHARAMI": lambda: _two(_if(b.long, a.short, inside(a, b), b.black), _if(b.long, a.short, inside(a, b), b.white)),
        "CDLHARAMICROSS": lambda: _two(_if(b.long, a.doji, inside(a, b), b.black), _if(b.long, a.doji, inside(a, b), b.white)),
        "CDLHIGHWAVE": lambda: F.when(_if(a.small, a.up > a.avg("shadow_very_long"), a.down > a.avg("shadow_very_long")), 100 * a.color).otherwise(0),
        "CDLHOMINGPIGEON": lambda: _bull(b.black, a.black, b.long, a.short, a.o < b.o, a.c > b.c),
        "CDLIDENTICAL3CROWS": lambda: _bear(c.black, c.no_down, b.black, b.no_down, a.black, a.no_down, c.c > b.c, b.c > a.c, c.about(b.o, c.c), b.about(a.o, b.c)),
        "CDLINNECK": lambda: _bear(b.black, b.long, a.white, a.o < b.low, a.c <= b.c + b.avg("equal"), a.c >= b.c),
        "CDLINVERTEDHAMMER": lambda: _bull(a.small, a.up > a.avg("shadow_long"), a.no_down, gap_down(a, b)),
        "CDLKICKING": lambda: F.when(kick, 100 * a.color).otherwise(0),
        "CDLKICKINGBYLENGTH": lambda: F.when(kick, 100 * F.when(a.body > b.body, a.color).otherwise(b.color)).otherwise(0),
        "CDLLADDERBOTTOM": lambda: _bull(e.black, d.black, c.black, d.o < e.o, c.o < d.o, d.c < e.c, c.c < d.c, b.black, b.up > b.avg("shadow_very_short"), a.white, a.o > b.o, a.c > b.h),
        "CDLLONGLEGGEDDOJI": lambda: _bull(a.doji, (a.down > a.avg("shadow_long")) | (a.up > a.avg("shadow_long"))),
        "CDLLONGLINE": lambda: F.when(_if(a.long, a.up < a.avg("shadow_short"), a.down < a.avg("shadow_short")), 100 * a.color).otherwise(0),
        "CDLMARUBOZU": lambda: F.when(_if(a.long, a.no_up, a.no_down), 100 * a.color).otherwise(0),
        "CDLMATCHINGLOW": lambda: _bull(b.black, a.black, b.about(a.c, b.c)),
        "CDLMATHOLD": lambda: _bull(e.long, d.small, c.small, b.small, e.white, d.black, a.white, gap_up(d, e), c.bottom < e.c, b.bottom < e.c, c.bottom > e.c - 0.5 * e.body, b.bottom > e.c - 0.5 * e.body, c.top < d.o, b.top < c.top, a.o > b.c, a.c > F.greatest(d.h, c.h, b.h)),
        "CDLMORNINGDOJISTAR": lambda: star_up(b.doji),
        "CDLMORNINGSTAR": lambda: star_up(b.short),
        "CDLONNECK": lambda: _bear(b.black, b.long, a.white, a.o < b.low, b.about(a.c, b.low)),
        "CDLPIERCING": lambda: _bull(b.black, b.long, a.white, a.long, a.o < b.low, a.c < b.o, a.c > b.c + 0.5 * b.body),
        "CDLRICKSHAWMAN": lambda: _bull(a.doji, a.down > a.avg("shadow_long"), a.up > a.avg("shadow_long"), a.bottom <= a.low + a.range / 2 + a.avg("near"), a.top >= a.low + a.range / 2 - a.avg("near")),
        "CDLRISEFALL3METHODS": lambda: F.when(
            _if(
                e.long, d.small, c.small, b.small, a.long, d.color == -e.color, c.color == d.color, b.color == c.color, a.color == e.color, d.bottom < e.h, d.top > e.low, c.bottom < e.h, c.top > e.low, b.bottom < e.h, b.top > e.low,
                c.c * e.color < d.c * e.color, b.c * e.color < c.c * e.color, a.o * e.color > b.c * e.color, a.c * e.color > e.c * e.color,
            ),
            100 * e.color,
        ).otherwise(0),
        "CDLSEPARATINGLINES": lambda: F.when(_if(b.color == -a.color, b.about(a.o, b.o), a.long, (a.white & a.no_down) | (a.black & a.no_up)), 100 * a.color).otherwise(0),
        "CDLSHOOTINGSTAR": lambda: _bear(a.small, a.up > a.avg("shadow_long"), a.no_down, gap_up(a, b)),
        "CDLSHORTLINE": lambda: F.when(_if(a.body < a.avg("body_short"), a.up < a.avg("shadow_short"), a.down < a.avg("shadow_short")), 100 * a.color).otherwise(0),
        "CDLSPINNINGTOP": lambda: F.when(_if(a.body < a.avg("body_short"), a.up > a.body, a.down > a.body), 100 * a.color).otherwise(0),
        "CDLSTALLEDPATTERN": lambda: _bear(*three_white, c.long, b.long, b.no_up, b.o > c.o, b.o <= c.c + c.avg("near"), a.body < a.avg("body_short"), a.o >= b.c - a.body - b.avg("near")),
        "CDLSTICKSANDWICH": lambda: _bull(c.black, b.white, a.black, b.low > c.c, c.about(a.c, c.c)),
        "CDLTAKURI": lambda: _bull(a.doji, a.no_up, a.down > a.avg("shadow_very_long")),
        "CDLTASUKIGAP": lambda: _two(
            _if(gap_up(b, c), b.white, a.black, a.o < b.c, a.o > b.o, a.c < b.o, a.c > c.top, F.abs(b.body - a.body) < b.avg("near")),
            _if(gap_down(b, c), b.black, a.white, a.o < b.o, a.o > b.c, a.c > b.o, a.c < c.bottom, F.abs(b.body - a.body) < b.avg("near")),
        ),
        "CDLTHRUSTING": lambda: _bear(b.black, b.long, a.white, a.o < b.low, a.c > b.c + b.avg("equal"), a.c <= b.c + 0.5 * b.body),
        "CDLTRISTAR": lambda: _two(_if(*tiny, gap_down(b, c), a.bottom > b.bottom), _if(*tiny, gap_up(b, c), a.top < b.top)),
        "CDLUNIQUE3RIVER": lambda: _bull(c.long, c.black, b.black, b.c > c.c, b.o <= c.o, b.low < c.low, a.body < a.avg("body_short"), a.white, a.o > b.low),
        "CDLUPSIDEGAP2CROWS": lambda: _bear(c.white, c.long, b.black, b.short, gap_up(b, c), a.black, a.o > b.o, a.c < b.c, a.c > c.c),
        "CDLXSIDEGAP3METHODS": lambda: F.when(_if(c.color == b.color, b.color == -a.color, a.o < b.top, a.o > b.bottom, a.c < c.top, a.c > c.bottom, (c.white & gap_up(b, c)) | (c.black & gap_down(b, c))), 100 * c.color).otherwise(0),
    }


def _hikkake(modified: bool) -> Column:
    """An inside candle broken one way; 200 on a close beyond the inside candle within three candles.

    The confirmation looks at most three candles back, so a bounded frame is enough.
    """
    a, b, c, d = (Candle(k) for k in range(4))
    held = (b.h < c.h) & (b.low > c.low)
    if modified:
        held = held & (c.h < d.h) & (c.low > d.low)
        up = _if(held, a.h < b.h, a.low < b.low, c.c <= c.low + c.avg("near"))
        down = _if(held, a.h > b.h, a.low > b.low, c.c >= c.h - c.avg("near"))
    else:
        up, down = _if(held, a.h < b.h, a.low < b.low), _if(held, a.h > b.h, a.low > b.low)
    return _two(up, down)


# Candles before the first on which a pattern can be told, where that isn't the ten
# candles of an average and those that the pattern looks back.
LOOKBACK = {
    "CDLENGULFING": 2, "CDLXSIDEGAP3METHODS": 2, "CDL3OUTSIDE": 3, "CDLHIKKAKE": 5, "CDLMATCHINGLOW": 6, "CDLGAPSIDESIDEWHITE": 7, "CDLSTICKSANDWICH": 7, "CDLTASUKIGAP": 7, "CDL3LINESTRIKE": 8, "CDLHIKKAKEMOD": 10,
}
# Patterns of one candle, two, and four or five (the others take three).
ONE = "BELTHOLD CLOSINGMARUBOZU DOJI DRAGONFLYDOJI GRAVESTONEDOJI HIGHWAVE LONGLEGGEDDOJI LONGLINE MARUBOZU RICKSHAWMAN SHORTLINE SPINNINGTOP TAKURI".split()
TWO = "COUNTERATTACK DARKCLOUDCOVER DOJISTAR HAMMER HANGINGMAN HARAMI HARAMICROSS HOMINGPIGEON INNECK INVERTEDHAMMER KICKING KICKINGBYLENGTH ONNECK PIERCING SEPARATINGLINES SHOOTINGSTAR THRUSTING".split()
FOUR, FIVE = "3BLACKCROWS CONCEALBABYSWALL".split(), "BREAKAWAY LADDERBOTTOM MATHOLD RISEFALL3METHODS".split()


def lookback(name: str) -> int:
    """How many candles come before the first on which the pattern can be told."""
    short = name.removeprefix("CDL")
    return LOOKBACK.get(name, 10 + (0 if short in ONE else 1 if short in TWO else 3 if short in FOUR else 4 if short in FIVE else 2))


def _confirmed(name: str) -> Column:
    """200 or -200 on the first close beyond the inside candle of the last pattern, within three candles of it."""
    found, high, low = F.col(f"_{name}"), f"_{name}_h", f"_{name}_l"
    beyond = lambda at, k: F.coalesce(
        ((R.lag(found, k) > 0) & ((R.lag("close", at) if at else F.col("close")) > R.lag(high, k))) | ((R.lag(found, k) < 0) & ((R.lag("close", at) if at else F.col("close")) < R.lag(low, k))), F.lit(False)
    )
    out = F.lit(0)
    for k in (3, 2, 1):
        last = R.lag(found, k) != 0
        for nearer in range(1, k):
            last = last & (R.lag(found, nearer) == 0) & ~beyond(nearer, k)
        out = F.when(F.coalesce(last, F.lit(False)) & beyond(0, k), 2 * R.lag(found, k)).otherwise(out)
    return out


def add_patterns(bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``symbol``, ``ts`` and one column for each pattern (all of them by default)."""
    every = _patterns()
    names = names or [*every, "CDLHIKKAKE", "CDLHIKKAKEMOD"]
    told = lambda n, value: F.when(F.col("_n") > lookback(n), value).otherwise(0).cast("int")
    _used.clear()
    plain = {n: told(n, every[n]()) for n in names if n in every}
    broken = {n: _hikkake(n.endswith("MOD")) for n in ("CDLHIKKAKE", "CDLHIKKAKEMOD") if n in names}
    out = prepare(bars, set(_used)).withColumn("_n", R.row_no()).withColumns(plain)
    for n in ("CDLHIKKAKE", "CDLHIKKAKEMOD"):
        if n in names:
            out = out.withColumns({f"_{n}": broken[n], f"_{n}_h": R.lag("high"), f"_{n}_l": R.lag("low")})
            out = out.withColumn(n, told(n, F.when(F.col(f"_{n}") != 0, F.col(f"_{n}")).otherwise(_confirmed(n))))
    return out.select("symbol", "ts", *names)


def frequency(patterns: DataFrame, names: list[str], windows: tuple[int, ...] = (5, 13, 21)) -> DataFrame:
    """Rolling counts of bullish and bearish patterns, and the mean sign of those that fired."""
    bull = sum((F.when(F.col(n) > 0, 1).otherwise(0) for n in names[1:]), F.when(F.col(names[0]) > 0, 1).otherwise(0))
    bear = sum((F.when(F.col(n) < 0, 1).otherwise(0) for n in names[1:]), F.when(F.col(names[0]) < 0, 1).otherwise(0))
    d = patterns.withColumns({"bull": bull, "bear": bear})
    new = {"consensus": F.when(F.col("bull") + F.col("bear") > 0, (F.col("bull") - F.col("bear")) / (F.col("bull") + F.col("bear"))).otherwise(0.0)}
    for n in windows:
        new |= {f"bull_{n}": R.total("bull", n), f"bear_{n}": R.total("bear", n)}
    return d.withColumns(new).select("symbol", "ts", *new)
