"""Safe boolean expressions over named columns, and filter triples.

Text is parsed to a tree of allowed nodes, brought to a canonical form with a
digest, checked for roles and for being always true or false, and compiled to a
Column.  It is never handed to an evaluator.
"""

from __future__ import annotations

import ast
import fnmatch
import hashlib
import itertools
import json
import operator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import rolling as R

# The comparison operators, and each one's mirror image.
COMPARE = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!="}
MIRROR = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}
_PYTHON = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}


class ConditionError(ValueError):
    pass


@dataclass(frozen=True)
class Condition:
    tree: tuple
    columns: frozenset[str]
    lags: int
    digest: str
    role: str = "feature"
    text: str = field(default="", compare=False)


def parse(text: str, roles: dict[str, str], role: str = "feature") -> Condition:
    """A condition over columns of ``roles`` (name to role); columns of other roles are refused."""
    try:
        node = ast.parse(text, mode="eval").body
    except SyntaxError as e:
        raise ConditionError(f"not an expression: {text!r}") from e
    columns: set[str] = set()
    lags = [0]

    def walk(n: ast.AST) -> tuple:
        if isinstance(n, ast.BoolOp):
            parts = [walk(v) for v in n.values]
            kind = "and" if isinstance(n.op, ast.And) else "or"
            flat = list(itertools.chain.from_iterable(p[1] if p[0] == kind else (p,) for p in parts))
            return kind, tuple(sorted(set(flat), key=repr))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            return "not", walk(n.operand)
        if isinstance(n, ast.Compare):
            sides = [value(v) for v in (n.left, *n.comparators)]
            parts = []
            for a, op, b in zip(sides, n.ops, sides[1:], strict=False):
                if type(op) not in COMPARE:
                    raise ConditionError(f"operator {type(op).__name__} is not allowed")
                sign = COMPARE[type(op)]
                parts.append((MIRROR[sign], b, a) if a[0] == "number" and b[0] != "number" else (sign, a, b))
            return parts[0] if len(parts) == 1 else ("and", tuple(sorted(set(parts), key=repr)))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in ("isnull", "notnull") and len(n.args) == 1 and not n.keywords:
            return n.func.id, value(n.args[0])
        if isinstance(n, ast.Constant) and isinstance(n.value, bool):
            return "bool", n.value
        raise ConditionError(f"{type(n).__name__} is not allowed as a condition")

    def value(n: ast.AST) -> tuple:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool):
            return "number", float(n.value)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            inner = value(n.operand)
            if inner[0] == "number":
                return "number", -inner[1]
        if isinstance(n, ast.Name):
            if n.id not in roles:
                raise ConditionError(f"unknown column {n.id!r}")
            if roles[n.id] != role:
                raise ConditionError(f"column {n.id!r} is of role {roles[n.id]!r}, not {role!r}")
            columns.add(n.id)
            return "column", n.id
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and not n.keywords:
            if n.func.id == "abs" and len(n.args) == 1:
                return "abs", value(n.args[0])
            if n.func.id == "lag" and len(n.args) == 2 and isinstance(n.args[1], ast.Constant) and isinstance(n.args[1].value, int) and n.args[1].value > 0:
                lags[0] = max(lags[0], n.args[1].value)
                return "lag", value(n.args[0]), n.args[1].value
        raise ConditionError(f"{type(n).__name__} is not allowed as a value")

    tree = walk(node)
    known = fold(tree)
    if known is not None:
        raise ConditionError(f"the condition is always {str(known).lower()}")
    digest = hashlib.sha256(json.dumps(tree).encode()).hexdigest()
    return Condition(tree, frozenset(columns), lags[0], digest, role, text)


def fold(t: tuple) -> bool | None:
    """Whether the tree is always true or false, by constants and by ``x or not x``."""
    kind = t[0]
    if kind == "bool":
        return t[1]
    if kind == "not":
        inner = fold(t[1])
        return None if inner is None else not inner
    if kind in ("and", "or"):
        stop = kind == "or"
        found = [fold(p) for p in t[1]]
        if stop in found or any(("not", p) in t[1] for p in t[1]):
            return stop
        return (not stop) if all(f is (not stop) for f in found) else None
    if kind in COMPARE.values() and t[1][0] == t[2][0] == "number":
        return _PYTHON[kind](t[1][1], t[2][1])
    return None


def column(condition: Condition) -> Column:
    """The condition as a Column: comparisons with null are false, also under ``not``."""
    def walk(t: tuple) -> Column:
        kind = t[0]
        if kind == "bool":
            return F.lit(t[1])
        if kind == "not":
            return ~walk(t[1])
        if kind in ("and", "or"):
            return reduce(lambda a, b: a & b if kind == "and" else a | b, [walk(p) for p in t[1]])
        if kind in ("isnull", "notnull"):
            return value(t[1]).isNull() if kind == "isnull" else value(t[1]).isNotNull()
        return F.coalesce(_PYTHON[kind](value(t[1]), value(t[2])), F.lit(False))

    def value(t: tuple) -> Column:
        kind = t[0]
        if kind == "number":
            return F.lit(t[1])
        if kind == "column":
            return F.col(f"`{t[1]}`")
        return F.abs(value(t[1])) if kind == "abs" else R.lag(value(t[1]), t[2])

    return walk(condition.tree)


def check_columns(df: DataFrame, condition: Condition) -> None:
    missing = condition.columns - set(df.columns)
    if missing:
        raise ConditionError(f"missing columns: {sorted(missing)}")


def mask(df: DataFrame, condition: Condition, name: str = "mask") -> DataFrame:
    check_columns(df, condition)
    return df.withColumn(name, column(condition))


def where(df: DataFrame, condition: Condition) -> DataFrame:
    """Filter; a condition with lags is computed on all rows first."""
    return mask(df, condition, "_mask").where("_mask").drop("_mask")


def without_outcomes(columns: list[str], roles: dict[str, str]) -> None:
    bad = [c for c in columns if roles.get(c) == "outcome"]
    if bad:
        raise ConditionError(f"outcome columns among features: {bad}")


def triples(rules: list[tuple[str, str, object]]) -> Column:
    """A conjunction of (column, operator, value): comparisons, ``between`` (ordered pair), ``in``."""
    def one(name: str, op: str, v: object) -> Column:
        c = F.col(f"`{name}`")
        if op == "between":
            low, high = v
            if low > high:
                raise ConditionError(f"between needs an ordered pair, not {v}")
            return c.between(low, high)
        if op == "in":
            return c.isin(list(v))
        op = {"=": "=="}.get(op, op)
        if op not in _PYTHON:
            raise ConditionError(f"unknown operator {op!r}")
        return _PYTHON[op](c, F.lit(v))

    return F.coalesce(reduce(lambda a, b: a & b, [one(*r) for r in rules]), F.lit(False)) if rules else F.lit(False)


def pattern_rule(name: str, op: str, threshold: float) -> Column:
    """A rule whose equality has a tolerance."""
    c = F.col(f"`{name}`")
    if op in ("==", "!="):
        same = F.abs(c - threshold) < 1e-6
        return F.coalesce(same if op == "==" else ~same, F.lit(False))
    return triples([(name, op, threshold)])


def pair_allowed(symbol: str, suffix: str = "USDT", excluded: tuple[str, ...] = ()) -> Column:
    """Symbols that end with a suffix and match no excluded glob."""
    c = F.col(symbol)
    bad = [c.rlike(f"^{fnmatch.translate(g).removeprefix('(?s:').removesuffix(')')}$".replace(r")\Z", "")) for g in excluded]
    return reduce(lambda a, b: a & ~b, bad, c.endswith(suffix))


def sample_tier(n: str, tiers: tuple[tuple[int, str], ...] = ((30, "insufficient"), (100, "low"), (300, "medium"))) -> Column:
    out = None
    for below, name in tiers:
        out = F.when(F.col(n) < below, name) if out is None else out.when(F.col(n) < below, name)
    return out.otherwise("high")
