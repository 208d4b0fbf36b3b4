"""Queries of candlestick patterns: simple ones with an oracle, the rest together."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from barloom.functions import candles
from barloom.plans import sql as S
from barloom.plans.registry import query, rounded
from barloom.sources.bars import event_bars

O = S.OVER
_AVG = lambda x, n: f"case when count({x}) over (partition by symbol order by ts rows between {n} preceding and 1 preceding) >= {n} then avg({x}) over (partition by symbol order by ts rows between {n} preceding and 1 preceding) end"
CANDLES = f"""with {S.bars()}, a as (select *, abs(close - open) as body, high - low as span, high - greatest(open, close) as up, least(open, close) - low as down, case when close >= open then 1 else -1 end as color from bars),
 k as (select *, {_AVG('body', 10)} as body10, 0.1 * ({_AVG('span', 10)}) as tenth, {_AVG('up + down', 10)} / 2 as shadow, 0.05 * ({_AVG('span', 5)}) as eq, 0.2 * ({_AVG('span', 5)}) as near from a)"""

# Name to the conditions for +100 and -100, over columns with the candle before as p_.
_SIMPLE = {
    "CDLDOJI": ("body <= tenth", None),
    "CDLDRAGONFLYDOJI": ("body <= tenth and up < tenth and down > tenth", None),
    "CDLGRAVESTONEDOJI": ("body <= tenth and down < tenth and up > tenth", None),
    "CDLBELTHOLD": ("body > body10 and color = 1 and down < tenth", "body > body10 and color = -1 and up < tenth"),
    "CDLCLOSINGMARUBOZU": ("body > body10 and color = 1 and up < tenth", "body > body10 and color = -1 and down < tenth"),
    "CDLMARUBOZU": ("body > body10 and color = 1 and up < tenth and down < tenth", "body > body10 and color = -1 and up < tenth and down < tenth"),
    "CDLSPINNINGTOP": ("body < body10 and up > body and down > body and color = 1", "body < body10 and up > body and down > body and color = -1"),
    "CDLLONGLINE": ("body > body10 and up < shadow and down < shadow and color = 1", "body > body10 and up < shadow and down < shadow and color = -1"),
    "CDLSHORTLINE": ("body < body10 and up < shadow and down < shadow and color = 1", "body < body10 and up < shadow and down < shadow and color = -1"),
    "CDLENGULFING": ("color = 1 and p_color = -1 and close >= p_open and open <= p_close and (close > p_open or open < p_close)", "color = -1 and p_color = 1 and open >= p_close and close <= p_open and (open > p_close or close < p_open)"),
    "CDLHARAMI": (
        "p_body > p_body10 and body <= body10 and greatest(open, close) < greatest(p_open, p_close) and least(open, close) > least(p_open, p_close) and p_color = -1",
        "p_body > p_body10 and body <= body10 and greatest(open, close) < greatest(p_open, p_close) and least(open, close) > least(p_open, p_close) and p_color = 1",
    ),
    "CDLMATCHINGLOW": ("p_color = -1 and color = -1 and close between p_close - p_eq and p_close + p_eq", None),
    "CDLDARKCLOUDCOVER": (None, "p_color = 1 and p_body > p_body10 and color = -1 and open > p_high and close > p_open and close < p_close - 0.5 * p_body"),
    "CDLPIERCING": ("p_color = -1 and p_body > p_body10 and color = 1 and body > body10 and open < p_low and close < p_open and close > p_close + 0.5 * p_body", None),
    "CDLHAMMER": ("body < body10 and down > body and up < tenth and least(open, close) <= p_low + p_near", None),
    "CDLHANGINGMAN": (None, "body < body10 and down > body and up < tenth and least(open, close) >= p_high - p_near"),
}
_BEFORE = ", ".join(f"lag({c}) over {O} as p_{c}" for c in ("open", "high", "low", "close", "body", "color", "body10", "eq", "near"))


def _oracle(name: str, up: str | None, down: str | None) -> str:
    cases = (f" when {up} then 100" if up else "") + (f" when {down} then -100" if down else "")
    return f"{CANDLES}, f as (select *, row_number() over {O} as n, {_BEFORE} from k) select symbol, ts, case when n <= {candles.lookback(name)} then 0{cases} else 0 end as pattern from f"


def _register(name: str) -> None:
    @query(f"candle_{name[3:].lower()}", _oracle(name, *_SIMPLE[name]))
    def run(spark, sf_dir):
        return candles.add_patterns(event_bars(spark, sf_dir), [name]).select("symbol", "ts", F.col(name).alias("pattern"))


for _name in _SIMPLE:
    _register(_name)


# All patterns as conditions over the last five candles.  A name and the candles back: open, high, low, close, body, upper
# and lower shadow (u, s), range, colour; m and w are the larger and smaller end of the body; averages of the candles before:
# a (body), t (a tenth of the range), g (shadows), e, q and f (a twentieth, a fifth and three fifths of the range).
def _white(*ks: int) -> str:
    return " and ".join(f"k{k} = 1" for k in ks)


def _black(*ks: int) -> str:
    return " and ".join(f"k{k} = -1" for k in ks)


def _long(*ks: int) -> str:
    return " and ".join(f"b{k} > a{k}" for k in ks)


def _bare(*ks: int) -> str:
    return " and ".join(f"u{k} < t{k} and s{k} < t{k}" for k in ks)


def _near(x: str, y: str, by: str) -> str:
    return f"{x} between {y} - {by} and {y} + {by}"


_RISING = f"{_white(0, 1, 2)} and c0 > c1 and c1 > c2"
_STEP = "o1 > o2 and o1 <= c2 + q2"
_INSIDE = "m0 < m1 and w0 > w1"
_UP, _DOWN = "w1 > m2", "m1 < w2"
_MORNING = f"{_long(2)} and {_black(2)} and {{}} and {_DOWN} and b0 > a0 and {_white(0)} and c0 > c2 + 0.3 * b2"
_EVENING = f"{_long(2)} and {_white(2)} and {{}} and {_UP} and b0 > a0 and {_black(0)} and c0 < c2 - 0.3 * b2"
_NECK = f"{_black(1)} and {_long(1)} and {_white(0)} and o0 < l1"
_KICK = f"k1 = -k0 and {_long(0, 1)} and {_bare(0, 1)} and ((k1 = -1 and l0 > h1) or (k1 = 1 and h0 < l1))"
_STRIKE = "o2 between w3 - q3 and m3 + q3 and o1 between w2 - q2 and m2 + q2"
_DOJIS = "b2 <= t2 and b1 <= t2 and b0 <= t2"
_METHODS = f"{_long(0, 4)} and b3 < a3 and b2 < a2 and b1 < a1 and k3 = -k4 and k2 = k3 and k1 = k2 and k0 = k4 and " + " and ".join(f"w{k} < h4 and m{k} > l4" for k in (3, 2, 1))
_SIDE = f"{_white(0, 1)} and {_near('b0', 'b1', 'q1')} and {_near('o0', 'o1', 'e1')}"
_PATTERNS = {
    "CDL2CROWS": (None, f"{_white(2)} and {_long(2)} and {_black(0, 1)} and {_UP} and o0 < o1 and o0 > c1 and c0 > o2 and c0 < c2"),
    "CDL3BLACKCROWS": (None, f"{_white(3)} and {_black(0, 1, 2)} and s2 < t2 and s1 < t1 and s0 < t0 and o1 < o2 and o1 > c2 and o0 < o1 and o0 > c1 and h3 > c2 and c2 > c1 and c1 > c0"),
    "CDL3INSIDE": (f"{_long(2)} and b1 <= a1 and m1 < m2 and w1 > w2 and {_black(2)} and {_white(0)} and c0 > o2", f"{_long(2)} and b1 <= a1 and m1 < m2 and w1 > w2 and {_white(2)} and {_black(0)} and c0 < o2"),
    "CDL3LINESTRIKE": (f"{_white(1, 2, 3)} and {_black(0)} and {_STRIKE} and c1 > c2 and c2 > c3 and o0 > c1 and c0 < o3", f"{_black(1, 2, 3)} and {_white(0)} and {_STRIKE} and c1 < c2 and c2 < c3 and o0 < c1 and c0 > o3"),
    "CDL3OUTSIDE": (f"{_white(1)} and {_black(2)} and c1 > o2 and o1 < c2 and c0 > c1", f"{_black(1)} and {_white(2)} and o1 > c2 and c1 < o2 and c0 < c1"),
    "CDL3STARSINSOUTH": (f"{_black(0, 1, 2)} and {_long(2)} and s2 > b2 and b1 < b2 and o1 > c2 and o1 <= h2 and l1 < c2 and l1 >= l2 and s1 > t1 and b0 < a0 and {_bare(0)} and l0 > l1 and h0 < h1", None),
    "CDL3WHITESOLDIERS": (f"{_RISING} and u2 < t2 and u1 < t1 and u0 < t0 and {_STEP} and o0 > o1 and o0 <= c1 + q1 and b1 > b2 - f2 and b0 > b1 - f1 and b0 > a0", None),
    "CDLABANDONEDBABY": (f"{_long(2)} and b1 <= t1 and b0 > a0 and {_black(2)} and {_white(0)} and c0 > c2 + 0.3 * b2 and h1 < l2 and l0 > h1", f"{_long(2)} and b1 <= t1 and b0 > a0 and {_white(2)} and {_black(0)} and c0 < c2 - 0.3 * b2 and l1 > h2 and h0 < l1"),
    "CDLADVANCEBLOCK": (None, f"{_RISING} and {_STEP} and o0 > o1 and o0 <= c1 + q1 and {_long(2)} and u2 < g2 and ((b1 < b2 - f2 and b0 < b1 + q1) or b0 < b1 - f1 or (b0 < b1 and b1 < b2 and (u0 > g0 or u1 > g1)) or (b0 < b1 and u0 > b0))"),
    "CDLBREAKAWAY": (f"{_long(4)} and {_black(1, 3, 4)} and {_white(0)} and m3 < w4 and h2 < h3 and l2 < l3 and h1 < h2 and l1 < l2 and c0 > o3 and c0 < c4", f"{_long(4)} and {_white(1, 3, 4)} and {_black(0)} and w3 > m4 and h2 > h3 and l2 > l3 and h1 > h2 and l1 > l2 and c0 < o3 and c0 > c4"),
    "CDLCONCEALBABYSWALL": (f"{_black(0, 1, 2, 3)} and {_bare(2, 3)} and {_DOWN} and u1 > t1 and h1 > c2 and h0 > h1 and l0 < l1", None),
    "CDLCOUNTERATTACK": (f"k1 = -k0 and {_long(0, 1)} and {_near('c0', 'c1', 'e1')} and {_white(0)}", f"k1 = -k0 and {_long(0, 1)} and {_near('c0', 'c1', 'e1')} and {_black(0)}"),
    "CDLDOJISTAR": (f"{_long(1)} and b0 <= t0 and {_black(1)} and m0 < w1", f"{_long(1)} and b0 <= t0 and {_white(1)} and w0 > m1"),
    "CDLEVENINGDOJISTAR": (None, _EVENING.format("b1 <= t1")),
    "CDLEVENINGSTAR": (None, _EVENING.format("b1 <= a1")),
    "CDLGAPSIDESIDEWHITE": (f"w1 > m2 and w0 > m2 and {_SIDE}", f"m1 < w2 and m0 < w2 and {_SIDE}"),
    "CDLHARAMICROSS": (f"{_long(1)} and b0 <= t0 and {_INSIDE} and {_black(1)}", f"{_long(1)} and b0 <= t0 and {_INSIDE} and {_white(1)}"),
    "CDLHIGHWAVE": ("b0 < a0 and u0 > 2 * b0 and s0 > 2 * b0 and k0 = 1", "b0 < a0 and u0 > 2 * b0 and s0 > 2 * b0 and k0 = -1"),
    "CDLHOMINGPIGEON": (f"{_black(0, 1)} and {_long(1)} and b0 <= a0 and o0 < o1 and c0 > c1", None),
    "CDLIDENTICAL3CROWS": (None, f"{_black(0, 1, 2)} and s2 < t2 and s1 < t1 and s0 < t0 and c2 > c1 and c1 > c0 and {_near('o1', 'c2', 'e2')} and {_near('o0', 'c1', 'e1')}"),
    "CDLINNECK": (None, f"{_NECK} and c0 <= c1 + e1 and c0 >= c1"),
    "CDLINVERTEDHAMMER": ("b0 < a0 and u0 > b0 and s0 < t0 and m0 < w1", None),
    "CDLKICKING": (f"{_KICK} and k0 = 1", f"{_KICK} and k0 = -1"),
    "CDLKICKINGBYLENGTH": (f"{_KICK} and case when b0 > b1 then k0 else k1 end = 1", f"{_KICK} and case when b0 > b1 then k0 else k1 end = -1"),
    "CDLLADDERBOTTOM": (f"{_black(1, 2, 3, 4)} and o4 > o3 and o3 > o2 and c4 > c3 and c3 > c2 and u1 > t1 and {_white(0)} and o0 > o1 and c0 > h1", None),
    "CDLLONGLEGGEDDOJI": ("b0 <= t0 and (s0 > b0 or u0 > b0)", None),
    "CDLMATHOLD": (f"{_long(4)} and b3 < a3 and b2 < a2 and b1 < a1 and {_white(0, 4)} and {_black(3)} and w3 > m4 and w2 < c4 and w1 < c4 and w2 > c4 - 0.5 * b4 and w1 > c4 - 0.5 * b4 and m2 < o3 and m1 < m2 and o0 > c1 and c0 > greatest(h3, h2, h1)", None),
    "CDLMORNINGDOJISTAR": (_MORNING.format("b1 <= t1"), None),
    "CDLMORNINGSTAR": (_MORNING.format("b1 <= a1"), None),
    "CDLONNECK": (None, f"{_NECK} and {_near('c0', 'l1', 'e1')}"),
    "CDLRICKSHAWMAN": ("b0 <= t0 and s0 > b0 and u0 > b0 and w0 <= l0 + r0 / 2 + q0 and m0 >= l0 + r0 / 2 - q0", None),
    "CDLRISEFALL3METHODS": (f"{_METHODS} and k4 = 1 and c2 < c3 and c1 < c2 and o0 > c1 and c0 > c4", f"{_METHODS} and k4 = -1 and c2 > c3 and c1 > c2 and o0 < c1 and c0 < c4"),
    "CDLSEPARATINGLINES": (f"k1 = -k0 and {_near('o0', 'o1', 'e1')} and {_long(0)} and {_white(0)} and s0 < t0", f"k1 = -k0 and {_near('o0', 'o1', 'e1')} and {_long(0)} and {_black(0)} and u0 < t0"),
    "CDLSHOOTINGSTAR": (None, "b0 < a0 and u0 > b0 and s0 < t0 and w0 > m1"),
    "CDLSTALLEDPATTERN": (None, f"{_RISING} and {_long(1, 2)} and u1 < t1 and {_STEP} and b0 < a0 and o0 >= c1 - b0 - q1"),
    "CDLSTICKSANDWICH": (f"{_black(0, 2)} and {_white(1)} and l1 > c2 and {_near('c0', 'c2', 'e2')}", None),
    "CDLTAKURI": ("b0 <= t0 and u0 < t0 and s0 > 2 * b0", None),
    "CDLTASUKIGAP": (f"{_UP} and {_white(1)} and {_black(0)} and o0 < c1 and o0 > o1 and c0 < o1 and c0 > m2 and abs(b1 - b0) < q1", f"{_DOWN} and {_black(1)} and {_white(0)} and o0 < o1 and o0 > c1 and c0 > o1 and c0 < w2 and abs(b1 - b0) < q1"),
    "CDLTHRUSTING": (None, f"{_NECK} and c0 > c1 + e1 and c0 <= c1 + 0.5 * b1"),
    "CDLTRISTAR": (f"{_DOJIS} and {_DOWN} and w0 > w1", f"{_DOJIS} and {_UP} and m0 < m1"),
    "CDLUNIQUE3RIVER": (f"{_long(2)} and {_black(1, 2)} and c1 > c2 and o1 <= o2 and l1 < l2 and b0 < a0 and {_white(0)} and o0 > l1", None),
    "CDLUPSIDEGAP2CROWS": (None, f"{_white(2)} and {_long(2)} and {_black(0, 1)} and b1 <= a1 and {_UP} and o0 > o1 and c0 < c1 and c0 > c2"),
    "CDLXSIDEGAP3METHODS": (f"{_white(1, 2)} and {_black(0)} and o0 < m1 and o0 > w1 and c0 < m2 and c0 > w2 and {_UP}", f"{_black(1, 2)} and {_white(0)} and o0 < m1 and o0 > w1 and c0 < m2 and c0 > w2 and {_DOWN}"),
}
# The simple patterns above, in these names.
_RENAMED = [("p_body10", "a1"), ("body10", "a0"), ("p_open", "o1"), ("p_high", "h1"), ("p_low", "l1"), ("p_close", "c1"), ("p_body", "b1"), ("p_color", "k1"), ("p_eq", "e1"), ("p_near", "q1"), ("open", "o0"), ("close", "c0"), ("body", "b0"), ("color", "k0"), ("tenth", "t0"), ("shadow", "g0"), ("down", "s0"), ("up", "u0")]


def _renamed(rule: str | None) -> str | None:
    for old, new in _RENAMED:
        rule = rule and re.sub(rf"\b{old}\b", new, rule)
    return rule


def _inside_broken(more: str, up: str, down: str) -> str:
    return f"case when h1 < h2 and l1 > l2{more} then case when h0 < h1 and l0 < l1{up} then 100 when h0 > h1 and l0 > l1{down} then -100 else 0 end else 0 end"


def _all_patterns() -> tuple[str, list[str]]:
    every = {k: (_renamed(a), _renamed(b)) for k, (a, b) in _SIMPLE.items()} | _PATTERNS
    plain = {"o": "open", "h": "high", "l": "low", "c": "close", "b": "body", "u": "up", "s": "down", "r": "span", "k": "color", "m": "greatest(open, close)", "w": "least(open, close)", "a": "body10", "t": "tenth", "g": "shadow", "e": "eq", "q": "near", "f": "3 * near"}
    back = ", ".join(f"{v if not k else f'lag({v}, {k}) over {O}'} as {c}{k}" for c, v in plain.items() for k in range(5))
    case = lambda name, up, down: f"case when n <= {candles.lookback(name)} then 0" + (f" when {up} then 100" if up else "") + (f" when {down} then -100" if down else "") + f" else 0 end as {name}"
    # The last inside candle's pattern, its levels, and whether a close has been beyond them since, within three candles.
    last = lambda x: ", ".join(f"lag({x}, {k}) over {O} as {x}_{k}" for k in (1, 2, 3))
    beyond = lambda x, k, c: f"(({x}_{k} = 100 and {c} > high_{k}) or ({x}_{k} = -100 and {c} < low_{k}))"

    def confirmed(x: str) -> str:
        return (
            f"case when {x} <> 0 then {x} when {x}_1 <> 0 then case when {beyond(x, 1, 'c0')} then 2 * {x}_1 else 0 end"
            f" when {x}_2 <> 0 then case when {beyond(x, 2, 'c0')} and not coalesce({beyond(x, 2, 'c1')}, false) then 2 * {x}_2 else 0 end"
            f" when {x}_3 <> 0 then case when {beyond(x, 3, 'c0')} and not coalesce({beyond(x, 3, 'c1')}, false) and not coalesce({beyond(x, 3, 'c2')}, false) then 2 * {x}_3 else 0 end else 0 end"
        )

    names = [*every, "CDLHIKKAKE", "CDLHIKKAKEMOD"]
    text = (
        f"{CANDLES}, f as (select symbol, ts, row_number() over {O} as n, {back} from k),"
        f" i as (select *, {_inside_broken('', '', '')} as hik, {_inside_broken(' and h2 < h3 and l2 > l3', ' and c2 <= l2 + q2', ' and c2 >= h2 - q2')} as hkm from f),"
        f" j as (select *, {last('hik')}, {last('hkm')}, h2 as high_1, h3 as high_2, h4 as high_3, l2 as low_1, l3 as low_2, l4 as low_3 from i),"
        f" p as (select symbol, ts, {', '.join(case(k, *v) for k, v in every.items())}, case when n <= 5 then 0 else {confirmed('hik')} end as CDLHIKKAKE, case when n <= 10 then 0 else {confirmed('hkm')} end as CDLHIKKAKEMOD from j)"
    )
    return text, names


_ALL, _NAMES = _all_patterns()


@query("candle_patterns_all", f"{_ALL} select symbol, ts, name, pattern from (unpivot p on {', '.join(_NAMES)} into name name value pattern) where pattern <> 0")
def _(spark, sf_dir):
    """Every pattern that fires, in long form."""
    df = candles.add_patterns(event_bars(spark, sf_dir))
    names = df.columns[2:]
    return df.select("symbol", "ts", F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("name", "pattern")).where("pattern <> 0")


def _signs(sign: str) -> str:
    return " + ".join(f"cast({n} {sign} 0 as int)" for n in _NAMES)


@query(
    "candle_frequency",
    f"{_ALL}, s as (select symbol, ts, {_signs('>')} as bull, {_signs('<')} as bear from p) select symbol, ts, round(case when bull + bear > 0 then (bull - bear) / cast(bull + bear as double) else 0 end, 6) + 0.0 as consensus, "
    + ", ".join(f"{S.total(x, n)} as {x}_{n}" for n in (5, 13, 21) for x in ("bull", "bear")) + " from s",
)
def _(spark, sf_dir):
    df = candles.add_patterns(event_bars(spark, sf_dir))
    return rounded(candles.frequency(df, df.columns[2:]), "consensus")
