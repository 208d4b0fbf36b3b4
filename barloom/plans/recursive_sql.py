"""DuckDB text of the recursive kernels: each state is a recursive table that takes one bar a step."""

from __future__ import annotations

from barloom.plans import sql as S

O = S.OVER
BARS = f"with recursive {S.bars()}, b as (select *, row_number() over {O} as n, close - lag(close) over {O} as d, greatest(high - low, abs(high - lag(close) over {O}), abs(low - lag(close) over {O})) as tr from bars)"


def ema(name: str, source: str, x: str, n: int, first: int = 1, alpha: str | None = None, seed: str = "sma") -> str:
    """Exponential mean of ``x`` of ``source`` from its row ``first``, as ``v`` of table ``name``."""
    a = alpha or f"(2.0 / {n + 1})"
    if seed == "sma":
        start = f"select symbol, {first + n - 1} as n, avg({x}) as v from {source} where n between {first} and {first + n - 1} group by symbol having count({x}) = {n}"
    else:
        start = f"select symbol, n, {x} as v from {source} where n = {first}"
    return f"{name} as ({start} union all select s.symbol, s.n, e.v + {a} * (s.{x} - e.v) from {name} e join {source} s on s.symbol = e.symbol and s.n = e.n + 1)"


def chain(prefix: str, times: int, n: int, x: str = "close") -> list[str]:
    """Means of means: ``prefix1`` .. ``prefix<times>``."""
    out = [ema(f"{prefix}1", "b", x, n)]
    for k in range(2, times + 1):
        out.append(ema(f"{prefix}{k}", f"{prefix}{k - 1}", "v", n, (k - 1) * (n - 1) + 1))
    return out


def query(tables: list[str], joined: list[str], outputs: dict[str, str], digits: int = 6) -> str:
    named = ", ".join(f"round({e}, {digits}) + 0.0 as {c}" for c, e in outputs.items())
    joins = " ".join(f"left join {t} using (symbol, n)" for t in joined)
    return f"{', '.join([BARS, *tables])} select symbol, b.ts, {named} from b {joins}"


def t3(prefix: str, v: float = 0.7) -> str:
    return f"{-(v**3)!r} * {prefix}6.v + {3 * v**2 + 3 * v**3!r} * {prefix}5.v + {-6 * v**2 - 3 * v - 3 * v**3!r} * {prefix}4.v + {1 + 3 * v + v**3 + 3 * v**2!r} * {prefix}3.v"


DEMA = query([*chain("e", 3, 10), *chain("f", 6, 5)], ["e1", "e2", "e3", "f3", "f4", "f5", "f6"], {"dema": "2 * e1.v - e2.v", "tema": "3 * e1.v - 3 * e2.v + e3.v", "t3": t3("f")})


def kama(n: int) -> list[str]:
    """Table ``ka``: from row n + 1 on."""
    return [
        f"ks as (select symbol, n, close, abs(close - lag(close, {n}) over {O}) as far, sum(abs(d)) over {S.w(n)} as noise from b)",
        f"""ka as (select symbol, n, close as v from ks where n = {n} union all
        select s.symbol, s.n, k.v + power(case when s.noise <> 0 then least(s.far / s.noise, 1) else 1 end * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) * (s.close - k.v) from ka k join ks s on s.symbol = k.symbol and s.n = k.n + 1)""",
    ]


KAMA = query(kama(30), ["ka"], {"kama": "case when n > 30 then ka.v end"})
_LINE = "line as (select f.symbol, f.n, f.v - s.v as v from f join s using (symbol, n))"
MACD = query([ema("f", "b", "close", 12, 15), ema("s", "b", "close", 26), _LINE, ema("g", "line", "v", 9, 26)], ["line", "g"], {"macd": "case when g.v is not null then line.v end", "macd_signal": "g.v", "macd_hist": "line.v - g.v"})
_MEAN9 = "g as (select symbol, n, case when n >= 34 then avg(v) over (partition by symbol order by n rows between 8 preceding and current row) end as v from line)"
MACDEXT = query([ema("f", "b", "close", 12), ema("s", "b", "close", 26), _LINE, _MEAN9], ["line", "g"], {"macd": "case when g.v is not null then line.v end", "macd_signal": "g.v", "macd_hist": "line.v - g.v"})
DIRECTIONAL = query(
    [
        f"m as (select symbol, n, tr, high - lag(high) over {O} as hu, lag(low) over {O} - low as ld from b)",
        "p as (select symbol, n, tr, case when hu > ld and hu > 0 then hu else 0 end as plus, case when ld > hu and ld > 0 then ld else 0 end as minus from m where n > 1)",
        """w as (select symbol, 14 as n, sum(plus) as pd, sum(minus) as md, sum(tr) as t from p where n <= 14 group by symbol having count(*) = 13
        union all select p.symbol, p.n, w.pd - w.pd / 14 + p.plus, w.md - w.md / 14 + p.minus, w.t - w.t / 14 + p.tr from w join p on p.symbol = w.symbol and p.n = w.n + 1)""",
        "i as (select *, case when t > 0 then 100 * pd / t else 0 end as pdi, case when t > 0 then 100 * md / t else 0 end as mdi from w where n > 14)",
        "x as (select *, case when pdi + mdi > 0 then 100 * abs(pdi - mdi) / (pdi + mdi) else 0 end as dx from i)",
        ema("a", "x", "dx", 14, 15, "(1.0 / 14)"),
        "r as (select symbol, n, (v + lag(v, 13) over (partition by symbol order by n)) / 2 as v from a)",
    ],
    ["x", "a", "r"], {"plus_dm": "x.pd", "minus_dm": "x.md", "plus_di": "x.pdi", "minus_di": "x.mdi", "dx": "x.dx", "adx": "a.v", "adxr": "r.v"},
)
_RSI = [
    "c as (select *, greatest(d, 0) as up, greatest(-d, 0) as down from b where n > 1)", ema("u", "c", "up", 14, 2, "(1.0 / 14)"), ema("w", "c", "down", 14, 2, "(1.0 / 14)"),
    "r as (select symbol, n, case when u.v + w.v > 0 then 100 * u.v / (u.v + w.v) else 0 end as v from u join w using (symbol, n))",
]
CMO = query(_RSI, ["r"], {"cmo": "2 * r.v - 100"})
_OF = "(partition by symbol order by n rows between {} preceding and current row)"
STOCHRSI = query(
    [
        *_RSI, f"h as (select *, min(v) over {_OF.format(4)} as lo, max(v) over {_OF.format(4)} as hi, count(v) over {_OF.format(4)} as c from r)",
        "k as (select symbol, n, case when hi > lo then 100 * (v - lo) / (hi - lo) else 0 end as v from h where c = 5)",
        f"m as (select symbol, n, case when count(*) over {_OF.format(2)} = 3 then avg(v) over {_OF.format(2)} end as v from k)",
    ],
    ["k", "m"], {"fast_k": "k.v", "fast_d": "m.v"},
)
_SAR = [
    f"q as (select symbol, n, high, low, case when n = 2 then high else lag(high) over {O} end as ph, case when n = 2 then low else lag(low) over {O} end as pl, lag(high) over {O} as h1, lag(low) over {O} as l1 from b)",
    "z as (select *, not (l1 - low > high - h1 and l1 - low > 0) as up from q where n = 2)",
    """st as (select symbol, cast(1 as bigint) as n, up, case when up then l1 else h1 end as stop, case when up then high else low end as far, cast(0.02 as double) as speed, cast(null as double) as v from z
    union all select symbol, n, up <> flip, case when up <> flip then least(base + speed2 * (far2 - base), pl, low) else greatest(base + speed2 * (far2 - base), ph, high) end, far2, speed2, case when up <> flip then base else -base end from (
     select *, case when flip and up then greatest(far, ph, high) when flip then least(far, pl, low) else stop end as base, case when flip then case when up then low else high end when up then greatest(far, high) else least(far, low) end as far2,
      case when flip then 0.02 when (up and high > far) or (not up and low < far) then least(speed + 0.02, 0.2) else speed end as speed2 from (
      select q.*, st.up, st.stop, st.far, st.speed, case when st.up then q.low <= st.stop else q.high >= st.stop end as flip from st join q on q.symbol = st.symbol and q.n = st.n + 1) x) y)""",
]
SAR = query(_SAR, ["st"], {"sar": "abs(st.v)"})
SAREXT = query(_SAR, ["st"], {"sarext": "st.v"})
TRIX = query([*chain("e", 3, 15), "t as (select symbol, n, 100 * (v / lag(v) over (partition by symbol order by n) - 1) as v from e3)"], ["t"], {"trix": "t.v"})
ADOSC = query(
    [f"a as (select symbol, n, sum(case when high > low then ((close - low) - (high - close)) / (high - low) * volume else 0 end) over {S.RUNNING} as ad from b)", ema("f", "a", "ad", 3, seed="first"), ema("s", "a", "ad", 10, seed="first")],
    ["f", "s"], {"adosc": "case when n >= 10 then f.v - s.v end"}, 5,
)
KELTNER = query(["c as (select * from b where n > 1)", ema("a", "c", "tr", 20, 2, "(1.0 / 20)"), ema("e", "b", "close", 20)], ["a", "e"], {"keltner": "4 * a.v / e.v"})
FORCE = query(["x as (select symbol, n, d * volume as x from b where n > 1)", ema("e", "x", "x", 13, 2, seed="first")], ["e"], {"force": "case when n >= 14 then e.v end"})
KLINGER = query(
    [
        f"p as (select symbol, n, volume, high - low as span, lag(high - low) over {O} as before, case when high + low + close > lag(high + low + close) over {O} then 1 else -1 end as trend from b)",
        "g as (select *, lag(trend) over (partition by symbol order by n) as last from p)",
        """h as (select symbol, n, cast(0 as double) as held from g where n = 1 union all
        select g.symbol, g.n, case when g.n > 2 and g.trend = g.last then h.held + g.span else g.before + g.span end from h join g on g.symbol = h.symbol and g.n = h.n + 1)""",
        "f as (select symbol, n, case when held <> 0 then volume * abs(2 * (span / held - 1)) * trend * 100 else 0 end as x from h join g using (symbol, n) where n > 1)",
        ema("a", "f", "x", 34, 2, seed="first"), ema("z", "f", "x", 55, 2, seed="first"),
    ],
    ["a", "z"], {"klinger": "case when n >= 56 then a.v - z.v end"},
)
KINDS = query(
    [
        *chain("e", 3, 10), *chain("f", 6, 10), *kama(10), f"t5 as (select symbol, n, {S.mean('close', 5)} as m from b)".replace("order by ts", "order by n"),
        f"r as (select symbol, n, {S.mean('close', 10)} as v0, {S.weighted('close', 10)} as v2 from b)", f"t6 as (select symbol, n, {S.mean('m', 6)} as v from t5)".replace("order by ts", "order by n"),
    ],
    ["e1", "e2", "e3", "f3", "f4", "f5", "f6", "ka", "r", "t6"],
    {"ma_0": "r.v0", "ma_1": "e1.v", "ma_2": "r.v2", "ma_3": "2 * e1.v - e2.v", "ma_4": "3 * e1.v - 3 * e2.v + e3.v", "ma_5": "t6.v", "ma_6": "case when n > 10 then ka.v end", "ma_8": t3("f")},
)
_TRIO = [
    *[ema(f"e{n}", "b", "close", n, seed="first") for n in (5, 20, 60)],
    "t as (select b.symbol, b.n, b.ts, b.close, " + ", ".join(f"case when n >= {n} then e{n}.v end as ema_{n}" for n in (5, 20, 60)) + " from b " + " ".join(f"left join e{n} using (symbol, n)" for n in (5, 20, 60)) + ")",
    f"u as (select *, lag(ema_5 - ema_20) over {O} as before, lag(ema_5, 3) over {O} as past, lag(ema_5) over {O} as ema_5_Lag_1, lag(ema_5, 2) over {O} as ema_5_Lag_2 from t)",
]
_EMAS = ", ".join(f"round(ema_{n}, 6) + 0.0 as ema_{n}" for n in (5, 20, 60))
EMA_TRIO = f"{', '.join([BARS, *_TRIO])} select symbol, ts, {_EMAS}, round((close - ema_5) / (ema_5 + 1e-10), 6) + 0.0 as distance, round((ema_5 - past) / (past + 1e-10), 6) + 0.0 as slope, cast(coalesce(ema_5 > ema_20 and ema_20 > ema_60, false) as int) as aligned, cast(coalesce(ema_5 > ema_20 and before <= 0, false) as int) as crossed_up from u"
EMA_LAGS = f"{', '.join([BARS, *_TRIO])} select symbol, ts, round(ema_5_Lag_1, 6) + 0.0 as ema_5_Lag_1, round(ema_5_Lag_2, 6) + 0.0 as ema_5_Lag_2 from u"
