"""Reports over features, cases and trials: alerts, hotspots, statistics, recommendations, Markdown."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators.ic import correlations

_c = F.col
MOST_ALERTS = 100
"""Alerts that a report lists (a report's length, as in the reference)."""
HOT_COLUMNS = 200
"""Columns of largest variance whose correlations a report looks at (a report's length)."""


def quality_alerts(df: DataFrame, columns: list[str], order: str = "ts") -> DataFrame:
    """(severity, feature, message): nulls beyond a tenth, constants, and rows before the first value of a table in order."""
    first = {c: F.min(F.when(_c(c).isNotNull(), F.struct(_c(order)))) for c in columns}
    stats = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)], *[F.min(c).alias(f"a_{i}") for i, c in enumerate(columns)], *[F.max(c).alias(f"b_{i}") for i, c in enumerate(columns)], *[first[c].alias(f"f_{i}") for i, c in enumerate(columns)]).first()
    n = stats["n"]
    gaps = [c for i, c in enumerate(columns) if 0 < n - stats[f"n_{i}"]]
    before = df.agg(F.lit(0).alias("_"), *[F.count_if((_c(order) < stats[f"f_{columns.index(c)}"][0]) if stats[f"f_{columns.index(c)}"] else F.lit(True)).alias(c) for c in gaps]).first() if gaps else {}
    rows = [("warning", c, f"NaN ratio {1 - stats[f'n_{i}'] / n:.2%} exceeds 10% threshold") for i, c in enumerate(columns) if n and 1 - stats[f"n_{i}"] / n > 0.1]
    rows += [("warning", c, "Constant feature detected") for i, c in enumerate(columns) if stats[f"a_{i}"] == stats[f"b_{i}"]]
    rows += [("info", c, f"Warmup detected: first {before[c]} rows are NaN") for c in gaps if before[c]]
    return df.sparkSession.createDataFrame(rows[:MOST_ALERTS], "severity string, feature string, message string")


def hotspots(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """The pairs (a, b, r) of largest absolute correlation among the columns of largest variance."""
    if len(columns) > HOT_COLUMNS:
        row = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
        columns = sorted(columns, key=lambda c: (-(row[c] or 0.0), c))[:HOT_COLUMNS]
    return correlations(df, columns).where("r is not null").orderBy(F.abs("r").desc(), "a", "b").limit(most).select("a", "b", "r")


def case_statistics(cases: DataFrame) -> DataFrame:
    """Cases, positive and negative ones, distinct symbols and timeframes."""
    return cases.agg(F.count(F.lit(1)).alias("cases"), F.count_if("positive_case").alias("positive"), F.count_if(~_c("positive_case")).alias("negative"), F.count_distinct("symbol").alias("symbols"), F.count_distinct("timeframe").alias("timeframes"))


def case_faults(positive: DataFrame, negative: DataFrame, known: DataFrame, least: int = 10) -> DataFrame:
    """(fault, n): too few cases of a class, ids in both, ids unknown to the store."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fault"), "n")
    few = lambda df, name: count(df, name).where(_c("n") < least)
    every = positive.select("case_id").unionByName(negative.select("case_id"))
    return reduce(DataFrame.unionByName, [
        few(positive, "few positive cases"), few(negative, "few negative cases"), count(positive.select("case_id").intersect(negative.select("case_id")), "in both").where("n > 0"),
        count(every.join(known, "case_id", "left_anti").distinct(), "unknown").where("n > 0"),
    ])


def tag_statistics(patterns: DataFrame) -> DataFrame:
    """(kind, name, n): patterns by status and by tag."""
    status = patterns.groupBy(_c("status").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("status").alias("kind"), "name", "n")
    tags = patterns.select(F.explode("tags").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.lit("tag").alias("kind"), "name", "n")
    return status.unionByName(tags)


def query_patterns(patterns: DataFrame, status: str | None = None, tags: list[str] | None = None, case_id: str | None = None, least: float | None = None) -> DataFrame:
    rules: list[Column] = [F.lit(True)]
    if status is not None:
        rules.append(_c("status") == status)
    if tags:
        rules.append(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if case_id is not None:
        rules.append(_c("case_id") == case_id)
    if least is not None:
        rules.append(_c("performance") >= least)
    return patterns.where(reduce(lambda a, b: a & b, rules))


def simplify_rules(rules: list[dict]) -> list[dict]:
    """Rules (features, confidence, lift) by confidence times lift; a rule of one feature goes if a better one uses it."""
    used: set[str] = set()
    out = []
    for r in sorted(rules, key=lambda r: -r["confidence"] * r["lift"]):
        if len(r["features"]) == 1 and r["features"][0] in used:
            continue
        out.append(r)
        used |= set(r["features"])
    return out


def recommend(trials: DataFrame, least_cases: int | None = None, most_std: float | None = None, least_value: float | None = None, most: int = 5) -> DataFrame:
    """The best complete trials within bounds on cases, deviation over folds and value; the best of all if none is."""
    done = trials.where("state = 'complete'")
    fit = F.lit(True)
    if least_cases is not None:
        fit = fit & (F.coalesce("n_cases", F.lit(0)) >= least_cases)
    if most_std is not None:
        fit = fit & (F.coalesce("cv_std", F.lit(float("inf"))) <= most_std)
    if least_value is not None:
        fit = fit & (_c("value") >= least_value)
    flagged = done.withColumn("within", fit)
    best = flagged.orderBy(F.desc("within"), F.desc("value"), "trial").limit(most)  # a report's length
    some = F.max("within").over(Window.partitionBy())
    return best.withColumns({"_some": some, "_k": F.row_number().over(Window.orderBy(F.desc("within"), F.desc("value"), "trial"))}).where(_c("within") | (~_c("_some") & (_c("_k") == 1))).drop("_some", "_k")


def heatmap(trials: DataFrame, x: str, y: str, most: int = 1000) -> DataFrame:
    """Points (x, y, value, trial) of the first complete trials, with the range of values; fewer than five are an error."""
    points = trials.where("state = 'complete'").orderBy("trial").limit(most).select(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"), "value", "trial")
    whole = Window.partitionBy()
    points = points.withColumns({"lowest": F.min("value").over(whole), "highest": F.max("value").over(whole)})
    if points.count() < 5:
        raise ValueError("a heat map needs five complete trials")
    return points


def separation_by_month(signals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(month, positive, negative, separation, n): signal density of positive and negative cases by the month of the case, and their gap."""
    pos = F.col("positive_case")
    return signals.groupBy(*(keys or []), "month").agg(F.avg(F.when(pos, _c("density"))).alias("positive"), F.avg(F.when(~pos, _c("density"))).alias("negative"), F.count(F.lit(1)).alias("n")).withColumn("separation", _c("positive") - _c("negative"))


def importance(trials: DataFrame, parameters: list[str], bins: int = 5) -> DataFrame:
    """(parameter, share): the variance of the value between bins of a parameter over its variance."""
    done = trials.where("state = 'complete'")
    total = done.agg(F.var_pop("value").alias("v"), F.avg("value").alias("m")).first()
    out = []
    for p in parameters:
        edges = done.agg(F.percentile(p, F.array(*[F.lit(k / bins) for k in range(1, bins)])).alias("e")).first()["e"] or []
        at = sum(((_c(p) > e).cast("int") for e in edges), F.lit(0))
        between = done.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m")).agg((F.sum(_c("n") * F.pow(_c("m") - total["m"], 2)) / F.sum("n")).alias("s")).first()["s"]
        out.append((p, between / total["v"] if total["v"] else 0.0))
    return done.sparkSession.createDataFrame(out, "parameter string, share double")


def trial_faults(row: dict) -> list[str]:
    """What is out of range in a trial's result."""
    out = []
    for name, (low, high) in {"separation": (-1, 1), "positive_ratio": (0, 1), "negative_ratio": (0, 1), "p_value": (0, 1)}.items():
        v = row.get(name)
        if v is not None and (not math.isfinite(v) or not low <= v <= high):
            out.append(f"{name} is {v}, not within {low} and {high}")
    return out


def families(df: DataFrame, feature: str = "feature") -> DataFrame:
    """Adds the family of a feature's name (without a last number) and that number."""
    return df.withColumns({"family": F.regexp_replace(feature, r"^(.+?)_(\d+)$", "$1"), "parameter": F.regexp_extract(feature, r"^.+?_(\d+)$", 1).try_cast("int")})


def sensitivity(ics: DataFrame, least: int = 3) -> DataFrame:
    """(family, n, ic_std, best): how a coefficient (feature, ic) varies over a family's parameters; small families are left out."""
    d = families(ics).where("ic is not null")
    out = d.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("ic").alias("ic_std"), F.max_by("parameter", F.struct("ic", -_c("parameter"))).alias("best"))
    risk = F.when(_c("ic_std") < 0.02, "low").when(_c("ic_std") < 0.05, "medium").otherwise("high")
    return out.where(_c("n") >= least).withColumn("risk", risk)


def group_coverage(df: DataFrame, groups: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """(keys, group, coverage): mean share of values over a group's features."""
    share = lambda cs: sum((F.avg(_c(c).isNotNull().cast("int")) for c in cs[1:]), F.avg(_c(cs[0]).isNotNull().cast("int"))) / len(cs)
    parts = F.array(*[F.struct(F.lit(g).alias("group"), share(cs).alias("coverage")) for g, cs in groups.items()])
    return df.groupBy(*keys).agg(parts.alias("_g")).select(*keys, F.inline("_g"))


def markdown(title: str, sections: dict[str, list[dict]], budget: int = 4000) -> str:
    """Tables under headings, cut at whole rows to about ``budget`` tokens (four characters each)."""
    lines, room = [f"# {title}"], 4 * budget
    for name, rows in sections.items():
        lines.append(f"\n## {name}")
        if rows:
            head = list(rows[0])
            lines += ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
            for k, r in enumerate(rows):
                line = "| " + " | ".join(f"{r[h]:.6g}" if isinstance(r[h], float) else str(r[h]) for h in head) + " |"
                if sum(map(len, lines)) + len(line) > room:
                    lines.append(f"({len(rows) - k} more)")
                    break
                lines.append(line)
    return "\n".join(lines) + "\n"


# Length of a backtest against the number of trials


def least_years(trials: int, target: float) -> float:
    """Upper bound of the years below which the best of so many trials is expected to reach a Sharpe ratio by chance: 2 ln N / SR^2."""
    if trials < 1 or not target > 0:
        raise ValueError("a trial or more and a positive target are needed")
    return 2 * math.log(trials) / target**2


def most_trials(years: float, target: float) -> int:
    """Trials that so many years bear: floor(exp(T SR^2 / 2))."""
    x = years * target**2 / 2
    if not years > 0 or not target > 0 or x > 700:
        raise ValueError("positive years and target of a finite budget are needed")
    return math.floor(math.exp(x))


def eligibility(years: float, trials: int | None, target: float) -> dict:
    """Whether the years suffice for the trials made; unknown (None) if their number is."""
    need = None if trials is None else least_years(trials, target)
    return {
        "eligible": None if need is None else need <= years, "required_years_upper_bound": need, "available_years": float(years), "trials_budget": most_trials(years, target),
        "trials_used": trials, "target_sharpe": float(target), "n_source": "ledger_unavailable" if trials is None else "ledger", "status": "unavailable" if trials is None else "ok",
    }


def validation_section(eligible: dict, dsr: dict | None, pbo: dict | None, provenance: dict) -> dict:
    """The five parts of a validation report, and whether it is shown as doubtful: unless all are sound."""
    part = lambda x: {"status": "not_computed", "reason": "n_unknown"} if x is None else x
    sound = eligible["eligible"] is True and all(part(x).get("status") == "ok" for x in (dsr, pbo)) and part(pbo).get("universe_scope") != "ledger_only"
    return {"eligibility": eligible, "min_btl": {k: eligible[k] for k in ("status", "required_years_upper_bound", "available_years", "trials_budget", "trials_used", "target_sharpe")}, "dsr": part(dsr), "pbo": part(pbo), "provenance": provenance, "display_downgrade": not sound}
