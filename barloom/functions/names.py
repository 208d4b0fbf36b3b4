"""Names of features, columns and parameters: composing, telling apart, choosing; frequencies and epochs."""

from __future__ import annotations

import fnmatch
import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.sources.bars import periods_per_year, seconds

# Parts of names whose columns are stationary by construction, so that no unit root test is needed.
STATIONARY = (
    "_RSI_", "_ADX_", "_ADXR_", "_DX_", "_WILLR_", "_MFI_", "AROON-aroonup", "AROON-aroondown", "_AROONOSC_", "_ULTOSC_", "STOCH-slowk", "STOCH-slowd", "STOCHF-fastk", "STOCHF-fastd", "STOCHRSI-fastk", "STOCHRSI-fastd",
    "_BOP", "_CORREL_", "Correl-CloseVolume", "_CMO_", "LINEARREG-ANGLE", "PLUS-DI", "MINUS-DI", "_NATR_", "_MOM_", "_ROC_", "_ROCP_", "_ROCR_", "_ROCR100_", "_TRIX_", "MACD-Line", "MACD-Signal", "MACD-Hist",
    "MACDEXT-Line", "MACDEXT-Signal", "MACDEXT-Hist", "MACDFIX-Line", "MACDFIX-Signal", "MACDFIX-Hist", "_APO_", "_PPO_", "HT-TRENDMODE", "HT-SINE", "_Cross", "_BinarySignal_", "_Sign_", "_TsRank_", "_TsArgMax_", "_TsArgMin_", "_TsCorr_",
)


def skips_unit_root(column: str, enabled: bool = True, more: tuple[str, ...] = (), never: tuple[str, ...] = ()) -> bool:
    if not enabled or any(p and p in column for p in never):
        return False
    return any(p and p in column for p in (*STATIONARY, *more))


def blacklisted(patterns: list[str], columns: list[str]) -> set[str]:
    """Columns that hold one of the patterns; ``CDL_PATTERN_ALL`` stands for every candlestick pattern's name."""
    from barloom.functions.candles import _patterns

    every = [*_patterns(), "CDLHIKKAKE", "CDLHIKKAKEMOD"]
    wanted = [w for p in patterns if p for w in (every if p == "CDL_PATTERN_ALL" else [p])]
    return {c for c in columns if any(w in c for w in wanted)}


def without(df: DataFrame, columns: set[str]) -> DataFrame:
    """``df`` without the named columns; those it lacks don't matter."""
    return df.drop(*[c for c in df.columns if c in columns])


def selected(columns: list[str], include: list[str] | None = None, exclude: list[str] | None = None, pattern: str | None = None) -> list[str]:
    """Columns by glob patterns to include and exclude, and a regular expression."""
    hit = lambda c, globs: any(fnmatch.fnmatchcase(c, g) for g in globs)
    return [c for c in columns if (not include or hit(c, include)) and not (exclude and hit(c, exclude)) and (pattern is None or re.search(pattern, c))]


def required(frames: dict[str, DataFrame], columns: list[str]) -> None:
    """An error if a frame lacks one of the columns: an intersection would hide it."""
    missing = {k: lost for k, df in frames.items() if (lost := [c for c in columns if c not in df.columns])}
    if missing:
        raise ValueError(f"columns missing: {missing}")


def shared(column_sets: list[list[str]]) -> list[str]:
    """Columns that all have; none at all is an error."""
    common = sorted(set.intersection(*map(set, column_sets))) if column_sets else []
    if column_sets and not common:
        raise ValueError("no column is in all frames")
    return common


def feature_name(source: str, category: str, indicator: str, parameters: dict[str, object] | None = None) -> str:
    """``source_category_INDICATOR_parameters``; underscores of the source become hyphens."""
    return "_".join([source.replace("_", "-"), category, indicator, *map(_segment, (parameters or {}).values())])


def _segment(v: object) -> str:
    return f"{v:g}".replace(".", "p") if isinstance(v, float) else str(v)


# What tells a feature's category, in order: a prefix (with ^) or a part of its name.
CATEGORIES = (
    ("^ms_", "microstructure"), ("^ent_", "entropy"), ("^tr_", "tail_risk"), ("^(close|volume)_trend_|_trend_", "trend"), ("_momentum_", "momentum"), ("_volatility_", "volatility"), ("_volume_", "volume"),
    ("_cycle_", "cycle"), ("_pattern_", "pattern"), ("_(statistics|stats|stat)_", "statistics"), ("^meta_", "meta"),
)
# What tells a feature's layer, the outermost first.
LAYERS = (
    (r"(_rank|_gaussian|_zscore_\d+)$", "layer6_5"), (r"^meta_", "layer6"), (r"^cs_", "layer5"), (r"_Lag_", "layer4"), (r"_(Mean|Std|Min|Max|Range|Slope|Rank|ZScore|Skew|Kurt)_W\d+$", "layer3"),
    (r"_(Cross|Ratio|Distance|SignedStrength|Sign|Log1p|Abs|Clip)$|_Momentum_L\d+$|_(TsArgmax|TsArgmin|TsRank|DecayLinear)_W\d+$|_TsCorr_.+_W\d+$|_BinarySignal", "layer2"),
)
# The categories of each level.
LEVELS = {"L1_basic": ("trend", "momentum", "volatility", "volume"), "L2_intermediate": ("statistics", "cycle", "pattern", "tail_risk"), "L3_advanced": ("microstructure", "entropy")}


def _first(name: Column, rules: tuple, other: str) -> Column:
    out = F.lit(other)
    for rule, label in reversed(rules):
        out = F.when(name.rlike(rule), label).otherwise(out)
    return out


def category(name: Column) -> Column:
    return _first(name, CATEGORIES, "other")


def layer(name: Column) -> Column:
    return _first(name, LAYERS, "layer1")


def level(kind: Column) -> Column:
    """The level of a category; the first one for others."""
    out = F.lit("L1_basic")
    for label, members in LEVELS.items():
        out = F.when(kind.isin(*members), label).otherwise(out)
    return out


def stable_json(payload: object) -> str:
    """JSON in one form: keys sorted, no blanks, numbers of other libraries as plain ones, and no values that JSON lacks."""
    return json.dumps(plain(payload), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def plain(x: object) -> object:
    """Nested containers of Python's own types; what isn't finite is None."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [plain(v) for v in x]
    if hasattr(x, "tolist"):
        return plain(x.tolist())
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    return x if isinstance(x, (str, int, bool)) or x is None else str(x)


def merged(*layers: dict | None) -> dict:
    """Nested settings, later layers over earlier ones."""
    out: dict = {}
    for new in layers:
        for k, v in (new or {}).items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def available_years(bars: int, timeframe: str) -> float:
    return bars / periods_per_year(timeframe)


def epoch_seconds(value: Column, largest: Column) -> Column:
    """Seconds of an epoch whose unit the largest absolute value tells: nano-, micro- or milliseconds, or seconds."""
    unit = F.when(largest >= F.lit(10**18), F.lit(10**9)).when(largest >= F.lit(10**15), F.lit(10**6)).when(largest >= F.lit(10**12), F.lit(1000)).otherwise(F.lit(1))
    return F.floor(value / unit)


def time_column(columns: list[str]) -> str:
    """The column of time by its name."""
    for name in ("timestamp", "ts", "datetime", "date", "time", "open_time"):
        for c in columns:
            if c.lower() == name:
                return c
    raise ValueError(f"no column of time among {columns}")


# Warm-up: rows that an indicator needs before its values have settled.
# How many periods each kind takes.
SETTLING = {"SMA": 1, "WMA": 1, "STDDEV": 1, "EMA": 4, "DEMA": 8, "TEMA": 12, "RSI": 10, "ATR": 10, "ADX": 12, "KAMA": 5}


def warmup(indicator: str, period: int) -> int:
    return SETTLING.get(indicator.upper(), 4) * period


def most_warmup(settings: list[tuple[str, int, str]], timeframe: str) -> int:
    """Bars of ``timeframe`` that the slowest of (indicator, period, its timeframe) needs."""
    return max((-(-warmup(i, p) * seconds(tf) // seconds(timeframe)) for i, p, tf in settings), default=0)


def ingest_start(start: int, settings: list[tuple[str, int, str]], timeframe: str) -> int:
    """Where reading has to begin so that values have settled at ``start``; with a tenth to spare."""
    return start - math.ceil(1.1 * most_warmup(settings, timeframe)) * seconds(timeframe)


def trimmed(df: DataFrame, start: int | None, end: int | None = None) -> DataFrame:
    """Rows of the output window; the filter reaches the files."""
    if start is not None:
        df = df.where(F.col("ts") >= start)
    return df if end is None else df.where(F.col("ts") <= end)


# The default parameters of indicators that take several.
DEFAULTS = {
    "macd": {"fastperiod": 12, "slowperiod": 26, "signalperiod": 9}, "macdext": {"fastperiod": 12, "slowperiod": 26, "signalperiod": 9}, "stoch": {"fastk_period": 5, "slowk_period": 3, "slowk_matype": 0, "slowd_period": 3, "slowd_matype": 0},
    "stochf": {"fastk_period": 5, "fastd_period": 3, "fastd_matype": 0}, "stochrsi": {"timeperiod": 14, "fastk_period": 5, "fastd_period": 3, "fastd_matype": 0},
}


def combinations(kind: str, custom: list | None = None) -> list[dict]:
    """Parameter sets of an indicator: custom ones (by name, or in order), or else its default one; lists of another length are left out."""
    default = DEFAULTS.get(kind.lower())
    if not custom:
        return [dict(default)] if default else []
    out = [dict(c) if isinstance(c, dict) else dict(zip(default, c, strict=True)) for c in custom if isinstance(c, dict) or (default and len(c) == len(default))]
    return out
