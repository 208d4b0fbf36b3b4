"""Queries of factor selection, neutralisation and overfitting checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import rolling as R
from barloom.operators import selection as X
from barloom.plans import sql as S
from barloom.plans.registry import query, rounded
from barloom.plans.research_queries import SCORED, scored

FACTORS = ["mom3", "volume", "taker_ratio", "sma20"]
O = S.OVER


@query("factor_neutralized", SCORED + """, b as (select symbol, covar_pop(mom3, sma20) / nullif(var_pop(case when mom3 is not null then sma20 end), 0) as beta, count(case when sma20 is not null then mom3 end) as n from scored group by symbol)
 select s.symbol, s.ts, round(case when b.n >= 10 and beta is not null then mom3 - beta * sma20 else mom3 end, 5) + 0.0 as neutral from scored s join b on s.symbol = b.symbol""")
def _(spark, sf_dir):
    return rounded(X.neutralized(scored(spark, sf_dir), "mom3", "sma20").select("symbol", "ts", "neutral"), "neutral", digits=5)


@query("portfolio_exposure", SCORED + " select ts, round(sum(coalesce(mom3, 0) * volume) / nullif(sum(abs(coalesce(mom3, 0))), 0), 6) + 0.0 as volume, round(sum(coalesce(mom3, 0) * taker_ratio) / nullif(sum(abs(coalesce(mom3, 0))), 0), 6) + 0.0 as taker_ratio from scored group by ts")
def _(spark, sf_dir):
    return rounded(X.exposures(scored(spark, sf_dir), "mom3", ["volume", "taker_ratio"], ["ts"]), "volume", "taker_ratio")


@query("exposure_concentration", SCORED + ", s as (select ts, abs(mom3) / nullif(sum(abs(mom3)) over (partition by ts), 0) as s from scored) select ts, round(sum(s * s), 6) + 0.0 as hhi, round(max(s), 6) + 0.0 as largest from s group by ts")
def _(spark, sf_dir):
    return rounded(X.concentration(scored(spark, sf_dir), "mom3", ["ts"]), "hhi", "largest")


@query("sharpe_statistics", SCORED + f", r as (select symbol, close / nullif(lag(close) over {O}, 0) - 1 as r from scored) select symbol, round(avg(r) / stddev_samp(r), 6) + 0.0 as sharpe, round(kurtosis_pop(r) + 3, 4) + 0.0 as kurt, count(*) as n from r where r is not null group by symbol")
def _(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("r", F.col("close") / F.nullif(R.lag("close"), F.lit(0.0)) - 1)
    return rounded(rounded(X.sharpe_stats(d, "r", ["symbol"]).drop("skew"), "sharpe"), "kurt", digits=4)


@query("selection_greedy_and_vif")
def _(spark, sf_dir):
    """Which factors stay by correlation, by cluster and by variance inflation."""
    corr = X.correlation_matrix(scored(spark, sf_dir), FACTORS)
    scores = [abs(x) for x in corr[0]]
    kept, low, label, v = X.greedy(corr, scores, 0.5), X.vif_filter(corr), X.clusters(corr), X.vif(corr)
    return spark.createDataFrame([(c, k in kept, k in low, label[k], round(float(v[k]), 6)) for k, c in enumerate(FACTORS)], "name string, greedy boolean, low_vif boolean, cluster int, vif double")


_F = "f as (select symbol, ts, mom3, volume, taker_ratio, sma20 from scored where mom3 is not null and volume is not null and taker_ratio is not null and sma20 is not null)"


def _step(k: int, factor: str, source: str) -> str:
    """Factor ``k`` less its regressions on the ones made before."""
    less = "".join(f" - (select covar_pop(o{j}, {factor}) / var_pop(o{j}) from {source}) * o{j}" for j in range(k))
    return f"g{k} as (select *, {factor}{less} as o{k} from {source})"


@query("factor_orthogonal", SCORED + ", " + ", ".join([_F, *(_step(k, c, f"g{k - 1}" if k else "f") for k, c in enumerate(FACTORS))]) + " select symbol, ts, " + ", ".join(f"round(o{k}, 4) + 0.0 as orth{k}" for k in range(4)) + " from g3")
def _(spark, sf_dir):
    d = scored(spark, sf_dir).dropna(subset=FACTORS)
    _, _, cov = X.moments(d, FACTORS)
    w, _ = X.orthogonal_weights(cov)
    out = X.projected(d, FACTORS, w, "orth").select("symbol", "ts", *[f"orth{k}" for k in range(4)])
    return rounded(out, *[f"orth{k}" for k in range(4)], digits=4)


@query("factor_principal_components")
def _(spark, sf_dir):
    _, _, cov = X.moments(scored(spark, sf_dir), FACTORS)
    vectors, share = X.principal(cov)
    central = X.centrality(cov)
    return spark.createDataFrame([(c, *[round(float(x), 5) for x in vectors[k]], round(float(share[k]), 6), round(float(central[k]), 6)) for k, c in enumerate(FACTORS)], "name string, p0 double, p1 double, p2 double, p3 double, share double, centrality double")


@query("factor_attribution")
def _(spark, sf_dir):
    names = [*FACTORS, "fwd4"]
    n, means, cov = X.moments(scored(spark, sf_dir), names)
    found = X.attribution(cov, means)
    return spark.createDataFrame([(c, round(float(b), 6), round(found["alpha"], 6), round(found["r2"], 6), n) for c, b in zip(FACTORS, found["beta"], strict=True)], "name string, beta double, alpha double, r2 double, n long")


@query("overfitting_probability")
def _(spark, sf_dir):
    """Strategies by symbol and sign of momentum threshold as candidates, over 8 blocks."""
    d = scored(spark, sf_dir).where("mom3 is not null and fwd4 is not null")
    d = d.select("ts", F.col("fwd4"), F.explode(F.array(*[F.struct(F.lit(f"t{k}").alias("candidate"), F.when(F.col("mom3") > k / 4, F.col("fwd4")).otherwise(0.0).alias("r")) for k in range(8)])).alias("x")).select("ts", "x.*")
    found = X.overfitting(X.block_moments(d, "r", "candidate", 8), "candidate", 8)
    return spark.createDataFrame([(round(found["pbo"], 6), round(found["median_logit"], 6), found["splits"])], "pbo double, median_logit double, splits long")


@query("deflated_sharpe")
def _(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("r", F.col("close") / F.nullif(R.lag("close"), F.lit(0.0)) - 1)
    rows = X.sharpe_stats(d, "r", ["symbol"]).collect()
    spread = sum(r["sharpe"] ** 2 for r in rows) / len(rows)
    return spark.createDataFrame([(r["symbol"], round(X.deflated(r["sharpe"], r["skew"], r["kurt"], r["n"], 10, spread), 6)) for r in rows], "symbol string, dsr double")
