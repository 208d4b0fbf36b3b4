"""Queries of preprocessing, splits, tests and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import rolling as R
from barloom.operators import models
from barloom.operators import preprocess as P
from barloom.plans import sql as S
from barloom.plans.registry import query, rounded
from barloom.plans.research_queries import SCORED, avg_rank, scored
from barloom.sources.bars import event_bars

O = S.OVER


@query("standardize_cross_section", SCORED + f", z as (select symbol, ts, (mom3 - avg(mom3) over (partition by ts)) / nullif(stddev_samp(mom3) over (partition by ts), 0) as z, case when mom3 is not null then ({avg_rank('mom3', 'ts')}) / count(mom3) over (partition by ts) end as r from scored) select symbol, ts, round(z, 5) + 0.0 as z, round(r, 6) + 0.0 as r from z")
def _(spark, sf_dir):
    return rounded(rounded(scored(spark, sf_dir).select("symbol", "ts", P.cross_zscore("mom3").alias("z"), P.cross_rank("mom3").alias("r")), "z", digits=5), "r")


@query("winsorize_train_fit", SCORED + ", f as (select symbol, quantile_cont(case when n <= 300 then close end, 0.01) as lo, quantile_cont(case when n <= 300 then close end, 0.99) as hi from scored group by symbol) select s.symbol, s.ts, round(greatest(least(close, hi), lo), 6) + 0.0 as close_clip from scored s join f on s.symbol = f.symbol")
def _(spark, sf_dir):
    return rounded(P.fitted_clip(scored(spark, sf_dir), "close", F.col("n") <= 300).select("symbol", "ts", "close_clip"), "close_clip")


@query("winsorize_mad_zscore", SCORED + """, m as (select symbol, quantile_cont(close, 0.5) filter (where n <= 300) as m, avg(close) filter (where n <= 300) as a, stddev_samp(close) filter (where n <= 300) as s from scored group by symbol),
 d as (select s.symbol, any_value(m.m) as m, any_value(m.a) as a, any_value(m.s) as s, quantile_cont(abs(close - m.m), 0.5) filter (where n <= 300) as d from scored s join m on s.symbol = m.symbol group by s.symbol)
 select s.symbol, s.ts, round(greatest(least(close, m + 4.4478 * d), m - 4.4478 * d), 5) + 0.0 as mad, round(greatest(least(close, a + 3 * d.s), a - 3 * d.s), 5) + 0.0 as z from scored s join d on s.symbol = d.symbol""")
def _(spark, sf_dir):
    d = scored(spark, sf_dir)
    a = P.fitted_clip(d, "close", F.col("n") <= 300, "mad").select("symbol", "ts", F.col("close_clip").alias("mad"))
    b = P.fitted_clip(d, "close", F.col("n") <= 300, "zscore").select("symbol", "ts", F.col("close_clip").alias("z"))
    return rounded(a.join(b, ["symbol", "ts"]), "mad", "z", digits=5)


@query("gaussian_rank", f"""with {S.bars()}, l as (select symbol, ts, close, case when count(close) over {S.w(20)} = 20 then list(close) over {S.w(20)} end as l from bars),
 p as (select symbol, ts, (len(list_filter(l, lambda u: u < close)) + (len(list_filter(l, lambda u: u = close)) + 1) / 2.0) / 21 as p from l), t as (select *, sqrt(-2 * ln(least(p, 1 - p))) as t from p),
 z as (select symbol, ts, p, t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t) as z from t) select symbol, ts, round(case when p < 0.5 then -z else z end, 6) + 0.0 as g from z""")
def _(spark, sf_dir):
    return rounded(event_bars(spark, sf_dir).select("symbol", "ts", P.gaussian_rank("close", 20).alias("g")), "g")


_T1, _T2 = 1705000000, 1705400000


@query("time_split", f"with {S.bars()}, k as (select symbol, ts, row_number() over {O} as k, count(case when ts <= {_T1} then 1 end) over (partition by symbol) as n from bars) select symbol, ts, case when ts <= {_T1} then case when k > n - floor(n * 0.2) then 'validation' else 'train' end when ts >= {_T2} then 'test' end as part from k")
def _(spark, sf_dir):
    return P.split_by_time(event_bars(spark, sf_dir), _T1, _T2).select("symbol", "ts", "part")


@query("sequence_windows", f"with {S.bars()}, k as (select symbol, ts, row_number() over {O} - 1 as k, count(*) over (partition by symbol) as n, sum(close) over (partition by symbol order by ts rows between current row and 9 following) as s from bars) select symbol, ts, round(s, 2) + 0.0 as total from k where k < n - 10 and k % 3 = 0")
def _(spark, sf_dir):
    d = P.sequences(event_bars(spark, sf_dir), ["close", "volume"], 10, 3)
    total = F.aggregate("window", F.lit(0.0), lambda a, v: a + F.round(F.get(v, F.lit(0)).cast("double"), 2))
    return rounded(d.select("symbol", "ts", total.alias("total")), "total", digits=2)


@query("bar_eligibility", f"""with {S.bars()}, k as (select *, row_number() over {O} as k, count(*) over (partition by symbol) as n, min(ts) over f as a, max(ts) over f as b, min(least(open, close)) over f as lo from bars window f as (partition by symbol order by ts rows between 3 preceding and 4 following)),
 r as (select symbol, case when k <= 3 then 'warm-up' when k > n - 4 then 'tail' when b - a <> 7 * 3600 then 'gap' when lo <= 0 then 'price' end as reason from k) select symbol, reason, count(*) as n from r group by 1, 2""")
def _(spark, sf_dir):
    return P.eligibility(event_bars(spark, sf_dir), 4, 3, 3600).groupBy("symbol", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("factor_returns", SCORED + f", p as (select *, sign(mom3) as p from scored) select symbol, ts, round(p * fwd4, 6) + 0.0 as factor_return, round(sum(p * fwd4) over {S.RUNNING}, 4) + 0.0 as cumulative, round(coalesce(abs(p - lag(p) over {O}), 0), 6) + 0.0 as turnover from p")
def _(spark, sf_dir):
    d = P.factor_returns(scored(spark, sf_dir).withColumn("p", F.signum("mom3")), "p", "fwd4").select("symbol", "ts", "factor_return", "cumulative", "turnover")
    return rounded(rounded(d, "factor_return", "turnover"), "cumulative", digits=4)


@query("series_tests")
def _(spark, sf_dir):
    return rounded(P.series_tests(event_bars(spark, sf_dir), "close"), "adf_t", "ljung_box", "effective_share")


@query("permutation_band")
def _(spark, sf_dir):
    return rounded(P.permutation_band(scored(spark, sf_dir), "mom3", "fwd4"), "coefficient", "low", "high", "p")


@query("cluster_bootstrap")
def _(spark, sf_dir):
    return rounded(P.cluster_bootstrap(scored(spark, sf_dir).withColumn("day", F.floor(F.col("ts") / 86400)), "fwd4", "volume", "day"), "mean", "low", "high")


@query("model_boosted_trees")
def _(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("r1", F.col("close") / F.nullif(R.lag("close"), F.lit(0.0)) - 1)
    features = ["mom3", "volume", "taker_ratio", "r1"]
    model, ranked = models.boosted(d, features, "up")
    return spark.createDataFrame([(f, round(v, 6)) for f, v in ranked], "name string, importance double")


@query("model_calibrated")
def _(spark, sf_dir):
    d = scored(spark, sf_dir)
    out = models.calibrated(d.where("n <= 400"), d.where("n > 400"), "taker_ratio", "up").select("symbol", "ts", "calibrated")
    return rounded(out, "calibrated")
