"""Queries of generated events, signals, sides, reports, names, split plans and providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import names as N
from barloom.functions import rolling as R
from barloom.operators import align, events, ic, marginal, pit, preprocess, registry, reports, signals, splits, study
from barloom.plans import sql as S
from barloom.plans.more_queries import TRIALS, trials
from barloom.plans.registry import query, rounded
from barloom.plans.research_queries import CASES, PIT_BINS, SCORED, TRADES, events_of, ic_sql, rn, scored, traded
from barloom.sources import bars as B
from barloom.sources import providers
from barloom.sources.bars import event_bars

O = S.OVER

# Events from a condition: two rules, one horizon each

_RULES = [events.LabelRule("up4", 4, 0.0), events.LabelRule("double2", 2, 1.0)]


def _generated(rule: str, h: int, threshold: float) -> str:
    return f"""select symbol || ':1h:' || cast(ts * 1000 as varchar) || ':{rule}' as event_id, symbol, ts as t0, '{rule}' as label_id, {h} as horizon, cast(lead(close, {h}) over {O} / close - 1 >= {threshold} as int) as label, lead(close, {h}) over {O} / close - 1 as label_value,
  mom3, n, count(*) over (partition by symbol) as total, lead(ts, {h}) over {O} - ts = {h} * 3600 as whole, min(least(open, close)) over (partition by symbol order by ts rows between current row and {h} following) as low from scored"""


GENERATED = SCORED + f""", g as ({_generated('up4', 4, 0.0)} union all {_generated('double2', 2, 1.0)}), e as (select event_id, symbol, t0, label_id, horizon, label, label_value from g where mom3 > 1 and n <= total - horizon and whole and low > 0)"""


def generated(spark: SparkSession, sf_dir: str, primary: bool = False) -> DataFrame:
    d = scored(spark, sf_dir)
    return events.generate(d, F.col("mom3") > 1, _RULES, "1h", primary=primary)


@query("events_generated", GENERATED + f" select event_id, symbol, t0, label_id, label, {rn('label_value')} from e")
def _(spark, sf_dir):
    return rounded(generated(spark, sf_dir).select("event_id", "symbol", "t0", "label_id", "label", "label_value"), "label_value")


@query("events_generated_primary", GENERATED + """, w as (select *, max(t0 + (horizon + 1) * 3600) over (partition by symbol, label_id order by t0, event_id rows between unbounded preceding and 1 preceding) as reach from e) select event_id, symbol, t0, label_id, label from w where reach is null or t0 > reach""")
def _(spark, sf_dir):
    return generated(spark, sf_dir, True).select("event_id", "symbol", "t0", "label_id", "label")


@query("event_counterexamples", GENERATED + """, k as (select e.*, case when e.t0 % 5 = 0 then 'b_range' end as kind, b.open, b.close, (b.close - b.open) / b.open as r0, e.label_value as rw from e join bars b on b.symbol = e.symbol and b.ts = e.t0 where label = 0),
 h as (select *, cast(r0 >= 0.05 and rw <= 0 as int) as a, cast(abs(r0) <= 0.01 as int) as b, cast(r0 <= -0.05 as int) as c from k),
 s as (select *, case when a + b + c <> 1 then 'unclassifiable' when a = 1 then 'a_trigger_no_follow' when b = 1 then 'b_range' else 'c_drop' end as said from h)
 select event_id, coalesce(kind, said) as kind_effective, case when kind is null then 'platform_auto' else 'user' end as kind_source, case when kind is not null and kind <> said then said end as suggested_kind from s""")
def _(spark, sf_dir):
    e = generated(spark, sf_dir).withColumn("kind", F.when(F.col("t0") % 5 == 0, "b_range"))
    return events.counterexamples(e, event_bars(spark, sf_dir))


@query("event_return_series", SCORED + f""", ev as (select symbol || '_' || cast(ts as varchar) as event_id, symbol, n, case when mom3 > 0 then 1 else -1 end as d from scored where abs(mom3) > 2),
 j as (select e.event_id, e.d, a.ts as entry_at, a.open as p, b.ts + 3600 as exit_at, b.close as c from ev e join scored a on a.symbol = e.symbol and a.n = e.n + 1 join scored b on b.symbol = e.symbol and b.n = e.n + 5)
 select event_id, entry_at, exit_at, round(d * (c / p - 1), 6) + 0.0 as hold_return from j where d = 1""")
def _(spark, sf_dir):
    aligned = align.align_events(events_of(spark, sf_dir), event_bars(spark, sf_dir), "1h")
    wanted = aligned.where("reason is null and direction = 1").select("event_id")
    return rounded(events.return_series(wanted, aligned), "hold_return")


@query("event_ic_inputs", GENERATED + f" select symbol, t0 as feature_ts, event_id, {rn('label_value')} from e where label_id = 'up4' and t0 % 7 <> 0")
def _(spark, sf_dir):
    e = generated(spark, sf_dir).where("label_id = 'up4'")
    fed = events.ic_inputs(e, e.select("event_id", (F.col("t0") % 7 != 0).alias("in_primary")), e.select("event_id", F.col("t0").alias("feature_ts")))
    return rounded(fed, "label_value")


IMPORTED = """with i as (select event_id as row, case when event_id % 97 = 0 then 'again' when event_id % 89 = 0 then '' else cast(event_id as varchar) end as event_id, event_type as symbol, '1h' as timeframe,
  case when event_id % 83 = 0 then epoch_us(ts) else epoch_us(ts) // 1000 end as t0, case when event_id % 79 = 0 then 'up' else 'long' end as direction, cast(user_id % 2 as int) as label, cast(user_id as double) as odd from events)"""


def imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, us = F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp"))
    fixed = {"entry_price_semantic": "next_open", "scenario": "C", "control_kind": "condition", "source_file_digest": "0" * 64}
    return e.select(
        k.alias("row"), F.when(k % 97 == 0, "again").when(k % 89 == 0, "").otherwise(k.cast("string")).alias("event_id"), F.col("event_type").alias("symbol"), F.lit("1h").alias("timeframe"),
        F.when(k % 83 == 0, us).otherwise(F.floor(us / 1000)).alias("t0"), F.when(k % 79 == 0, "up").otherwise("long").alias("direction"), (F.col("user_id") % 2).cast("int").alias("label"), F.col("user_id").cast("double").alias("odd"),
        F.create_map(F.lit("rule_id"), F.lit("r"), F.lit("canonical_digest"), F.when(k % 71 == 0, "").otherwise("d")).alias("label_definition"), *[F.lit(v).alias(c) for c, v in fixed.items()],
    )


@query("event_import_failures", IMPORTED + """ select row, event_id, 'odd' as field, 'unknown_field' as reason from i where odd is not null union all select row, event_id, 'event_id', 'type_error' from i where event_id = ''
 union all select row, event_id, 't0', 'invalid_timestamp_unit' from i where t0 < 1000000000000 or t0 >= 1000000000000000 union all select row, event_id, 'direction', 'enum_violation' from i where direction = 'up'
 union all select row, event_id, 'label_definition.canonical_digest', 'missing_required_field' from i where row % 71 = 0 union all select null, event_id, 'event_id', 'duplicate_event_id' from i group by event_id having count(*) > 1""")
def _(spark, sf_dir):
    return events.import_failures(imported(spark, sf_dir))


# Signals and sides


@query("signal_surges", f"with {S.bars()}, c as (select symbol, ts, close / nullif(lag(close) over {O}, 0) - 1 as price_change, close, volume from bars) select symbol, ts, {rn('price_change')}, close, volume from c where price_change >= 0.10")
def _(spark, sf_dir):
    return rounded(signals.surges(event_bars(spark, sf_dir), "12h").select("symbol", "ts", "price_change", "close", "volume"), "price_change")


@query("signal_class", f"""with {S.bars()}, x as (select symbol, ts, row_number() over {O} - 1 as k, abs((close - open) / open) as x from bars),
 q as (select *, list(x) over p as l, quantile_cont(x, 0.25) over p as a, quantile_cont(x, 0.75) over p as b from x window p as (partition by symbol order by ts rows between 20 preceding and 1 preceding)),
 s as (select *, list_filter(l, lambda v: v >= a - 1.5 * (b - a) and v <= b + 1.5 * (b - a)) as f from q), t as (select *, case when len(f) > 1 then list_stddev_samp(f) end as base from s),
 v as (select *, {' + '.join(f"coalesce(cast(lag(x, {8 - i}) over {O} > {m} * base as int), 0)" for i, m in enumerate(signals.MULTIPLES))} as n from t)
 select symbol, ts, round(base, 6) + 0.0 as base_std, case when k < 8 then 'few day for calculation' when n > 3 then 'trend' else 'initial' end as signal_class from v""")
def _(spark, sf_dir):
    return rounded(signals.signal_class(event_bars(spark, sf_dir)).select("symbol", "ts", "base_std", "signal_class"), "base_std")


@query("side_masks", PIT_BINS + " select symbol, ts, c >= 100 and coalesce(bin in (3, 4), false) as long, c >= 100 and coalesce(bin = 0, false) as short from p")
def _(spark, sf_dir):
    d = pit.expanding(scored(spark, sf_dir), "mom3")
    up, down = signals.side_masks("pit_bin", 5, [4, 5], [1, 9])
    return d.select("symbol", "ts", up.alias("long"), down.alias("short"))


_BINNED = SCORED + ", " + ", ".join(f"b_{c} as (select '{c}' as feature, ntile(5) over (partition by symbol order by {c}, ts) - 1 as bin, fwd4 from scored where {c} is not null and fwd4 is not null)" for c in ("mom3", "sma20", "volume")) + ", l as (" + " union all ".join(f"select * from b_{c}" for c in ("mom3", "sma20", "volume")) + ")"


@query("sides_by_feature", _BINNED + f""", s as (select feature, count(*) as n, avg(fwd4) filter (where bin = 4) as long_mean, avg(fwd4) filter (where bin = 0) as short_mean from l group by 1) select feature, n, {rn('long_mean')}, {rn('short_mean')}, round(long_mean - short_mean, 6) + 0.0 as spread from s order by abs(long_mean - short_mean) desc limit 2""")
def _(spark, sf_dir):
    from pyspark.sql.window import Window

    d = ic.stacked(scored(spark, sf_dir), ["mom3", "sma20", "volume"], ["symbol", "ts", "fwd4"]).where("value is not null and fwd4 is not null")
    d = d.withColumn("bin", F.ntile(5).over(Window.partitionBy("symbol", "feature").orderBy("value", "ts")) - 1)
    return rounded(signals.sides_by_feature(d, "bin", "fwd4", 5, 2), "long_mean", "short_mean", "spread")


@query("quantile_summary", SCORED + f""", f as (select * from scored where mom3 is not null), e as (select symbol, list_distinct(quantile_cont(mom3, [0, 0.2, 0.4, 0.6, 0.8, 1])) as e from f group by symbol)
 select f.symbol, 'Q' || cast(greatest(len(list_filter(e, lambda x: x < mom3)), 1) as varchar) as bin, round(avg(fwd4), 6) + 0.0 as mean_return, count(*) as n from f join e on f.symbol = e.symbol group by 1, 2""")
def _(spark, sf_dir):
    return rounded(signals.quantile_summary(scored(spark, sf_dir), "mom3", "fwd4", 5, ["symbol"]), "mean_return")


@query("factor_capacity", SCORED + f""", p as (select *, abs(sign(mom3) - lag(sign(mom3)) over {O}) as t from scored), s as (select symbol, avg(t) as turnover, avg(quote_volume) as volume from p group by symbol)
 select symbol, round(case when turnover > 0 then volume * 0.01 / turnover else volume * 0.01 end, 5) + 0.0 as capacity, case when turnover > 1 then 'low' when turnover > 0.5 then 'medium' else 'high' end as tier from s""")
def _(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("p", F.signum("mom3")).withColumn("t", F.abs(F.col("p") - R.lag("p")))
    per = d.groupBy("symbol").agg(F.avg("t").alias("turnover"), F.avg("quote_volume").alias("volume"))
    money, tier = signals.capacity(F.col("turnover"), F.col("volume"))
    return rounded(per.select("symbol", money.alias("capacity"), tier.alias("tier")), "capacity", digits=5)


@query("scores_by_phase", SCORED + """, q as (select *, case when close > 50 then 'high' when close > 20 then 'mid' else 'low' end as phase from scored where up is not null and taker_ratio is not null),
 r as (select *, rank() over (partition by phase order by taker_ratio) + (count(*) over (partition by phase, taker_ratio) - 1) / 2.0 as k, row_number() over (partition by phase order by taker_ratio desc, symbol, ts) as d, count(*) over (partition by phase) as m from q)
 select phase, count(*) as support, round((sum(k * up) - sum(up) * (sum(up) + 1) / 2.0) / nullif(sum(up) * (count(*) - sum(up)), 0), 6) + 0.0 as auc, round(avg(up) filter (where d <= greatest(floor(m * 0.1), 1)), 6) + 0.0 as precision_top, round(avg(taker_ratio), 6) + 0.0 as mean_score from r group by phase""")
def _(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("phase", F.when(F.col("close") > 50, "high").when(F.col("close") > 20, "mid").otherwise("low"))
    return rounded(signals.by_phase(d, "taker_ratio", "up", "phase"), "auc", "precision_top", "mean_score")


@query("regime_group_stats", SCORED + ", q as (select *, case when close > 50 then 'high' when close > 20 then 'mid' else 'low' end as regime from scored), s as (select regime, count(*) as n, avg(volume) as mean_volume, avg(fwd4) as mean_fwd4 from q group by 1) select regime, n, round(mean_volume, 6) + 0.0 as mean_volume, round(mean_fwd4, 6) + 0.0 as mean_fwd4, round(n / sum(n) over (), 6) + 0.0 as share from s")
def _(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("regime", F.when(F.col("close") > 50, "high").when(F.col("close") > 20, "mid").otherwise("low"))
    return rounded(signals.group_stats(d, "regime", ["volume", "fwd4"]), "mean_volume", "mean_fwd4", "share")


_CASE_IDS = f"with {S.bars()}, n as (select *, row_number() over {O} as n from bars), c as (select symbol || '_' || cast(ts as varchar) as case_id, symbol, n as n0 from n where n % 50 = 0)"


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = event_bars(spark, sf_dir).withColumn("n", R.row_no()).where("n % 50 = 0")
    return d.select(F.concat_ws("_", "symbol", "ts").alias("case_id"), "symbol", F.col("ts").alias("t0"))


@query("case_bar_slices", _CASE_IDS + " select c.case_id, n.n - n0 as place, n.ts, n.close from c join n on n.symbol = c.symbol and n.n between n0 - 20 and n0 + 4")
def _(spark, sf_dir):
    return signals.case_bars(_cases(spark, sf_dir), event_bars(spark, sf_dir), 20, 4).select("case_id", F.col("place").cast("long").alias("place"), "ts", "close")


@query("case_indicator_cache", _CASE_IDS + " select c.case_id, p as period, round(case when count(*) = p then avg(n.close) end, 6) + 0.0 as mean from c, (select unnest([5, 10, 20]) as p) q join n on n.symbol = c.symbol and n.n between n0 - p + 1 and n0 group by 1, 2")
def _(spark, sf_dir):
    slices = signals.case_bars(_cases(spark, sf_dir), event_bars(spark, sf_dir), 19)
    return rounded(signals.indicator_cache(slices, [5, 10, 20]), "mean")


@query("signal_points_sampled", f"""with {S.bars()}, p as (select symbol, ts, close, row_number() over {O} - 1 as k, count(*) over (partition by symbol) as n from bars where close > open),
 i as (select symbol, unnest(list_transform(range(0, 50), lambda i: cast(floor(i * (max(n) - 1) / 49.0) as bigint))) as k from p group by symbol) select distinct p.symbol, ts * 1000 as ts_ms, close from p left join i on i.symbol = p.symbol and i.k = p.k where n <= 50 or i.k is not null""")
def _(spark, sf_dir):
    d = signals.points(event_bars(spark, sf_dir), F.col("close") > F.col("open"), ["close"])
    return signals.strided(d, 50, ["symbol"], "ts_ms").select("symbol", "ts_ms", F.col("values")["close"].alias("close"))


@query("universe_digest", f"with {S.bars()} select symbol, count(*) as rows, sha256(string_agg(cast(ts as varchar), ',' order by ts)) as digest from bars group by symbol")
def _(spark, sf_dir):
    return signals.universe(event_bars(spark, sf_dir))


@query("label_misalignment", f"with {S.bars()}, n as (select *, row_number() over {O} as n from bars) select symbol, ts, case when n % 10 = 0 then 'left' else 'right' end as only_in from n where (n % 10 = 0) <> (n % 15 = 0)")
def _(spark, sf_dir):
    d = event_bars(spark, sf_dir).withColumn("n", R.row_no())
    return signals.misaligned(d.where("n % 15 <> 0"), d.where("n % 10 <> 0"))


@query("rank_change_rate", SCORED + f""", l as (select symbol, ts, mom3, list(mom3) filter (where mom3 is not null) over {S.RUNNING} as l from scored),
 r as (select symbol, ts, case when mom3 is not null and len(l) >= 100 then (len(list_filter(l, lambda x: x < mom3)) + len(list_filter(l, lambda x: x <= mom3)) + 1) / 2.0 end as r from l)
 select symbol, round(avg(d), 5) + 0.0 as rank_change_rate from (select symbol, abs(r - lag(r) over {O}) as d from r) q group by symbol""")
def _(spark, sf_dir):
    return rounded(signals.rank_change(pit.expanding(scored(spark, sf_dir), "mom3"), "pit_rank"), "rank_change_rate", digits=5)


@query("pareto_knees", """with t as (select p_partkey, p_retailprice as a, cast(p_size as double) as b from part), f as (select * from t where not exists (select 1 from t u where u.a >= t.a and u.b >= t.b and (u.a > t.a or u.b > t.b))),
 d as (select *, sqrt(power((max(a) over () - a) / greatest(max(a) over () - min(a) over (), 1e-6), 2) + power((max(b) over () - b) / greatest(max(b) over () - min(b) over (), 1e-6), 2)) as distance from f)
 select p_partkey, round(distance, 6) + 0.0 as distance, row_number() over (order by distance, a, b) <= 3 as knee from d""")
def _(spark, sf_dir):
    from barloom.operators import evaluate

    t = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_retailprice").alias("a"), F.col("p_size").cast("double").alias("b"))
    return rounded(signals.ideal_distances(evaluate.pareto_front(t, "a", "b"), "a", "b").select("p_partkey", "distance", "knee"), "distance")


@query("consensus_predictions", f"with {S.bars()} select symbol, ts, round((taker_ratio + close / (close + 10)) / 2, 6) + 0.0 as mean, (cast(taker_ratio >= 0.5 as int) + cast(close / (close + 10) >= 0.5 as int)) / 2.0 as vote from bars")
def _(spark, sf_dir):
    d = event_bars(spark, sf_dir).withColumn("other", F.col("close") / (F.col("close") + 10))
    return rounded(d.select("symbol", "ts", signals.consensus(["taker_ratio", "other"]).alias("mean"), signals.consensus(["taker_ratio", "other"], "vote").alias("vote")), "mean")


# Reports


@query("quality_alerts")
def _(spark, sf_dir):
    d = scored(spark, sf_dir).where("symbol = 'view'").withColumn("same", F.lit(1.0))
    return reports.quality_alerts(d, ["mom3", "sma20", "fwd4", "same", "close"])


@query("correlation_hotspots", SCORED + ", p as (" + " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from scored" for a, b in (("close", "high"), ("close", "volume"), ("close", "mom3"), ("high", "volume"), ("high", "mom3"), ("volume", "mom3"))) + ") select a, b, round(r, 6) + 0.0 as r from p order by abs(r) desc, a, b limit 3")
def _(spark, sf_dir):
    return rounded(reports.hotspots(scored(spark, sf_dir), ["close", "high", "volume", "mom3"], 3), "r")


@query("case_statistics", CASES + " select count(*) as cases, count_if(price_change > 500) as positive, count_if(not price_change > 500) as negative, count(distinct symbol) as symbols, 1 as timeframes from cases where price_change is not null")
def _(spark, sf_dir):
    from barloom.operators import search

    d = search.case_parameters(event_bars(spark, sf_dir)).where("price_change is not null")
    return reports.case_statistics(d.select("symbol", F.lit("1h").alias("timeframe"), (F.col("price_change") > 500).alias("positive_case")))


@query("trials_recommend", TRIALS + ", f as (select *, month >= 6 as within from t where state = 'complete') select trial, value, within from f order by within desc, value desc, trial limit 5")
def _(spark, sf_dir):
    t = trials(spark, sf_dir).withColumns({"n_cases": F.col("month"), "cv_std": F.lit(0.01)})
    return reports.recommend(t, least_cases=6, most_std=0.05).select("trial", "value", "within")


@query("trials_heatmap", TRIALS + ", p as (select trial, cast(month as double) as x, cast(trial % 7 as double) as y, value from t where state = 'complete' order by trial limit 1000) select x, y, value, trial, min(value) over () as lowest, max(value) over () as highest from p")
def _(spark, sf_dir):
    return reports.heatmap(trials(spark, sf_dir).withColumn("y", F.col("trial") % 7), "month", "y")


@query("trials_importance")
def _(spark, sf_dir):
    t = trials(spark, sf_dir).withColumn("seven", F.col("trial") % 7)
    return rounded(reports.importance(t, ["month", "seven"]), "share")


@query("separation_by_month", "with c as (select month(o_orderdate) as month, o_orderstatus = 'F' as positive_case, o_totalprice / 100000 as density from orders), s as (select month, avg(density) filter (where positive_case) as positive, avg(density) filter (where not positive_case) as negative, count(*) as n from c group by 1) select month, round(positive, 6) + 0.0 as positive, round(negative, 6) + 0.0 as negative, n, round(positive - negative, 6) + 0.0 as separation from s")
def _(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.month("o_orderdate").cast("long").alias("month"), (F.col("o_orderstatus") == "F").alias("positive_case"), (F.col("o_totalprice") / 100000).alias("density"))
    return rounded(reports.separation_by_month(o), "positive", "negative", "separation")


_FAMILY = [("mom", k) for k in (2, 3, 5)] + [("vol", k) for k in (4, 8, 16)]


@query("parameter_sensitivity", SCORED + ", v as (select *, " + ", ".join(f"close / nullif(lag(close, {k}) over {O}, 0) - 1 as mom_{k}, {S.mean('volume', k)} as vol_{k}" for k in (2, 3, 5, 4, 8, 16)) + " from scored), i as (" + " union all ".join(f"select '{a}' as family, {k} as p, corr({a}_{k}, fwd4) as ic from v" for a, k in _FAMILY) + ") select family, count(*) as n, round(stddev_pop(ic), 6) + 0.0 as ic_std, arg_max(p, ic) as best, case when stddev_pop(ic) < 0.02 then 'low' when stddev_pop(ic) < 0.05 then 'medium' else 'high' end as risk from i group by family")
def _(spark, sf_dir):
    d = scored(spark, sf_dir).withColumns({f"{a}_{k}": (F.col("close") / F.nullif(R.lag("close", k), F.lit(0.0)) - 1 if a == "mom" else R.mean("volume", k)) for a, k in _FAMILY})
    long = ic.stacked(d, [f"{a}_{k}" for a, k in _FAMILY], ["fwd4"])
    ics = long.groupBy("feature").agg(R.pearson("value", "fwd4").alias("ic"))
    return rounded(reports.sensitivity(ics), "ic_std")


@query("group_coverage", SCORED + " select symbol, unnest(['momentum', 'level']) as \"group\", round(unnest([(avg(cast(mom3 is not null as int)) + avg(cast(fwd4 is not null as int))) / 2, avg(cast(sma20 is not null as int))]), 6) + 0.0 as coverage from scored group by symbol")
def _(spark, sf_dir):
    return rounded(reports.group_coverage(scored(spark, sf_dir), {"momentum": ["mom3", "fwd4"], "level": ["sma20"]}, ["symbol"]), "coverage")


@query("backtest_eligibility", """with n as (select event_type as symbol, count(distinct user_id) as trials, count(*) / 100.0 as years from events group by 1)
 select symbol, trials, round(2 * ln(trials) / 1.44, 6) + 0.0 as required, cast(floor(exp(least(years, 20) * 0.72)) as bigint) as budget, 2 * ln(trials) / 1.44 <= least(years, 20) as eligible from n""")
def _(spark, sf_dir):
    per = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("symbol")).agg(F.count_distinct("user_id").alias("trials"), (F.count(F.lit(1)) / 100.0).alias("years"))
    rows = []
    for r in per.collect():  # one row a symbol
        e = reports.eligibility(min(r["years"], 20), r["trials"], 1.2)
        rows.append((r["symbol"], r["trials"], e["required_years_upper_bound"], e["trials_budget"], e["eligible"]))
    return rounded(spark.createDataFrame(rows, "symbol string, trials long, required double, budget long, eligible boolean"), "required")


# Names, epochs, registries


@query("feature_names", """with f as (select p_partkey, case p_partkey % 9 when 0 then 'close_1h_momentum_RSI_14' when 1 then 'ms_vpin_30' when 2 then 'close_trend_EMA_20_Mean_W5' when 3 then 'close_1h_volatility_ATR_14_Lag_2' when 4 then 'meta_consensus' when 5 then 'cs_beta_20' when 6 then 'close_1h_stats_Z_zscore_20' when 7 then 'ent_shannon_Cross' else 'x_rank' end as name from part)
 select p_partkey, case p_partkey % 9 when 0 then 'momentum' when 1 then 'microstructure' when 2 then 'trend' when 3 then 'volatility' when 4 then 'meta' when 5 then 'other' when 6 then 'statistics' when 7 then 'entropy' else 'other' end as category,
 case p_partkey % 9 when 2 then 'layer3' when 3 then 'layer4' when 4 then 'layer6' when 5 then 'layer5' when 6 then 'layer6_5' when 7 then 'layer2' when 8 then 'layer6_5' else 'layer1' end as layer, case p_partkey % 9 when 6 then 'L2_intermediate' when 1 then 'L3_advanced' when 7 then 'L3_advanced' else 'L1_basic' end as level from f""")
def _(spark, sf_dir):
    every = ["close_1h_momentum_RSI_14", "ms_vpin_30", "close_trend_EMA_20_Mean_W5", "close_1h_volatility_ATR_14_Lag_2", "meta_consensus", "cs_beta_20", "close_1h_stats_Z_zscore_20", "ent_shannon_Cross", "x_rank"]
    d = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.get(F.array(*map(F.lit, every)), (F.col("p_partkey") % 9).cast("int")).alias("name"))
    return d.select("p_partkey", N.category(F.col("name")).alias("category"), N.layer(F.col("name")).alias("layer"), N.level(N.category(F.col("name"))).alias("level"))


@query("epoch_seconds", "with e as (select event_id, epoch_us(ts) as us from events) select event_id, us // 1000000 as t_us, us // 1000000 as t_ms, us // 1000000 as t_ns, us // 1000000 as t_s from e")
def _(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    e = e.withColumns({"ms": F.floor(F.col("us") / 1000), "ns": F.col("us") * 1000, "s": F.floor(F.col("us") / 1_000_000)})
    top = e.agg(*[F.max(F.abs(c)).alias(f"_{c}") for c in ("us", "ms", "ns", "s")])
    d = e.join(F.broadcast(top))  # one row
    return d.select("event_id", *[N.epoch_seconds(F.col(c), F.col(f"_{c}")).alias(f"t_{c}") for c in ("us", "ms", "ns", "s")])


@query("registry_operators", f"with {S.bars()}, v as (select symbol, ts, sign(close - open) as sign, {S.mean('close', 5)} as mean, close / nullif(lag(close, 3) over {O}, 0) - 1 as momentum, case when abs(open) > 1e-12 then (close - open) / open end as distance from bars) select symbol, ts, sign, {rn('mean')}, {rn('momentum')}, {rn('distance')} from v")
def _(spark, sf_dir):
    known = registry.operators()
    d = event_bars(spark, sf_dir).withColumn("body", F.col("close") - F.col("open"))
    d = d.select("symbol", "ts", known.build("sign", "body").alias("sign"), known.build("mean", "close", 5).alias("mean"), known.build("momentum", "close", n=3).alias("momentum"), known.build("distance", "close", "open").alias("distance"))
    return rounded(d, "mean", "momentum", "distance")


@query("source_ranges", f"with {S.bars()} select 'taker_ratio' as \"column\", count_if(not taker_ratio between 0.2 and 0.8) as n from bars union all select 'close', count_if(not close between 1 and 60) from bars")
def _(spark, sf_dir):
    return registry.out_of_range(event_bars(spark, sf_dir), {"taker_ratio": (0.2, 0.8), "close": (1, 60)})


# Split plans

_HALVES = "with " + S.bars() + ", n as (select symbol, count(*) as n from bars group by 1)"


@query("split_plan_walk_forward", _HALVES + """, f as (select symbol, n, unnest(range(0, greatest(0, (n - 130) // 25 + 1))) as fold from n where n >= 130)
 select symbol, cast(fold as int) as fold, 'train' as part, fold * 25 as start, fold * 25 + 100 as "end", n from f union all select symbol, cast(fold as int), 'test', fold * 25 + 105, fold * 25 + 130, n from f""")
def _(spark, sf_dir):
    return splits.plan_table(event_bars(spark, sf_dir), lambda n: list(splits.walk_forward(n, 100, 25, 25, 5)))


@query("split_plan_combinatorial")
def _(spark, sf_dir):
    return splits.plan_table(event_bars(spark, sf_dir), lambda n: splits.combinatorial(n, 5, 2, 3, n // 100))


@query("split_runs", f"with {S.bars()}, k as (select symbol, row_number() over {O} as n, close > open as up from bars), g as (select symbol, n, n - row_number() over (partition by symbol order by n) as g from k where up) select symbol, min(n) as start, max(n) + 1 as \"end\" from g group by symbol, g")
def _(spark, sf_dir):
    d = event_bars(spark, sf_dir).withColumn("n", R.row_no().cast("long")).where("close > open")
    return splits.runs(d, "n", ["symbol"])


@query("split_overlap", f"with {S.bars()} select max(ts) filter (where ts < 1705000000) as train_last, min(ts) filter (where ts >= 1705000000) as test_first, max(ts) filter (where ts < 1705000000) < min(ts) filter (where ts >= 1705000000) as apart from bars")
def _(spark, sf_dir):
    b = event_bars(spark, sf_dir)
    return splits.overlap(b.where("ts < 1705000000"), b.where("ts >= 1705000000"))


@query("preprocess_chain", SCORED + """, t as (select *, n <= 100 as train, last_value(mom3 ignore nulls) over (partition by symbol order by ts rows between unbounded preceding and current row) as x from scored),
 b as (select symbol, quantile_cont(x, 0.01) filter (where train) as lo, quantile_cont(x, 0.99) filter (where train) as hi from t group by symbol),
 c as (select t.symbol, ts, train, case when x is not null then greatest(least(x, hi), lo) end as x from t join b on t.symbol = b.symbol), m as (select symbol, avg(x) filter (where train) as m, stddev_samp(x) filter (where train) as s from c group by symbol)
 select c.symbol, ts, round(case when x is not null and s > 0 then (x - m) / s end, 5) + 0.0 as x from c join m on c.symbol = m.symbol""")
def _(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("x", F.col("mom3"))
    return rounded(preprocess.chain(d, ["x"], F.col("n") <= 100).select("symbol", "ts", "x"), "x", digits=5)


# Sources


@query("read_through_cache", f"with {S.bars()} select symbol, ts, close from bars where symbol = 'view' and ts between 1704300000 and 1705300000")
def _(spark, sf_dir):
    b = event_bars(spark, sf_dir)
    fetch = lambda s, symbol, start, end, timeframe: b.where((F.col("symbol") == symbol) & F.col("ts").between(start, end))
    return providers.read_through(b.where("ts between 1704600000 and 1704900000"), fetch, spark, "view", 1704300000, 1705300000, "1h")[0].select("symbol", "ts", "close")


@query("newest_times", f"with {S.bars()} select symbol, max(ts) as ts from bars group by symbol")
def _(spark, sf_dir):
    b = event_bars(spark, sf_dir)
    return providers.last_time(b.where("ts % 7200 = 0"), b.where("ts % 7200 <> 0"))


@query("page_ranges", "with p as (select range as k from range(0, 8)) select 1704067200 + k * 1000 * 3600 as first, least(1704067200 + 7 * 1000 * 3600 + 3600 * 99, 1704067200 + (k + 1) * 1000 * 3600 - 3600) as last from p")
def _(spark, sf_dir):
    return spark.createDataFrame(list(providers.pages(1704067200, 1704067200 + 7 * 1000 * 3600 + 3600 * 99, "1h")), "first long, last long")


# What a factor adds


@query("marginal_ic")
def _(spark, sf_dir):
    d = scored(spark, sf_dir).withColumns({"train": F.col("n") <= 100, "test": F.col("n") > 104, "range": F.col("high") - F.col("low")})
    out = marginal.marginal_ic(d, ["mom3", "sma20", "range"], "fwd4", "train", "test", ("volume",), marginal.Settings(draws=100))
    return rounded(out, "marginal_ic", "gross_ic", "retained", "train_ic", "r2_train", "low", "high", digits=5)


@query("combined_factors")
def _(spark, sf_dir):
    d = scored(spark, sf_dir).withColumns({"train": F.col("n") <= 100, "test": F.col("n") > 104, "range": F.col("high") - F.col("low")})
    out = marginal.combine(d, ["mom3", "sma20", "range"], "fwd4", "train", "test", marginal.Settings(draws=100, weights="ic_weighted"))
    return rounded(out.select("symbol", "status", "composite_ic", "composite_ic_train", "top_single", "top_single_ic", "delta"), "composite_ic", "composite_ic_train", "top_single_ic", "delta", digits=5)


@query("bootstrap_auc")
def _(spark, sf_dir):
    return rounded(marginal.bootstrap(scored(spark, sf_dir), "taker_ratio", "up"), "auc", "low", "high")


@query("bars_latest_pages", f"with {S.bars()} select symbol, ts, close from bars where close > 5 order by symbol, ts limit 100 offset 50")
def _(spark, sf_dir):
    from barloom.sources import io

    return io.page(event_bars(spark, sf_dir), F.col("close") > 5, ["symbol", "ts", "close"], ["symbol", "ts"], 50, 100)


# Screening and search


@query("ic_grouped", SCORED + ", h as (select *, (ts // 3600) % 24 as hour from scored) " + ic_sql("mom3", "fwd4", "hour", "h"))
def _(spark, sf_dir):
    return rounded(ic.ic(scored(spark, sf_dir).withColumn("hour", F.floor(F.col("ts") / 3600) % 24), "mom3", "fwd4", ["hour"]), "ic")


@query("trials_progress", TRIALS + " select count_if(state = 'complete') as complete, count_if(state = 'failed') as failed, round(count(*) / 20000.0, 6) + 0.0 as share, max(value) filter (where state = 'complete') as best from t")
def _(spark, sf_dir):
    return rounded(study.progress(trials(spark, sf_dir), 20000), "share")


@query("feature_baseline", SCORED + ", " + ", ".join(f"l_{c} as (select '{c}' as feature, {c} as value, up as label from scored where {c} is not null and up is not null and n > 100)" for c in ("mom3", "volume", "taker_ratio")) + ", l as (" + " union all ".join(f"select * from l_{c}" for c in ("mom3", "volume", "taker_ratio")) + """),
 r as (select *, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0 as k from l), g as (select feature, value, sum(label) as tp, count(*) as m from l group by 1, 2),
 s as (select *, sum(tp) over (partition by feature order by value desc rows between unbounded preceding and current row) / sum(m) over (partition by feature order by value desc rows between unbounded preceding and current row) as precision from g), p as (select feature, sum(tp * precision) / sum(tp) as pr_auc from s group by 1)
 select r.feature, count(*) as n, round((sum(k * label) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 6) + 0.0 as auc, round(max(p.pr_auc), 6) + 0.0 as pr_auc from r join p on p.feature = r.feature group by 1""")
def _(spark, sf_dir):
    d = scored(spark, sf_dir).where("up is not null and n > 100").withColumn("event_id", F.concat_ws("_", "symbol", "ts"))
    long = ic.stacked(d, ["mom3", "volume", "taker_ratio"], ["event_id", "up"]).where("value is not null").withColumnRenamed("up", "label")
    return rounded(study.baseline(long).select("feature", "n", "auc", "pr_auc"), "auc", "pr_auc")


@query("feature_screen")
def _(spark, sf_dir):
    d = scored(spark, sf_dir).withColumns({"copy": F.col("mom3") * 2, "flat": F.lit(1.0), "gaps": F.when(F.col("n") % 3 == 0, F.col("volume"))})
    return rounded(study.screen(d, ["mom3", "copy", "flat", "gaps", "volume", "taker_ratio"], "fwd4", alpha=0.5), "coverage", "ic", "t", "p", "q", digits=5)


@query("backtest_grid", TRADES + ", g as (select symbol, count(*) as trades, avg(cast(gain > 0 as int)) as win_rate, sum(gain) as total_gain, sum(pnl) as total_pnl from t group by 1), every_symbol as (select distinct symbol from bars) select v.symbol, 0 as trial, coalesce(trades, 0) as trades, round(coalesce(win_rate, 0), 6) + 0.0 as win_rate, round(coalesce(total_gain, 0), 5) + 0.0 as total_gain, round(coalesce(total_pnl, 0), 5) + 0.0 as total_pnl from every_symbol v left join g on g.symbol = v.symbol")
def _(spark, sf_dir):
    b = traded(spark, sf_dir)[0]
    out = study.backtest_grid(b, study.grid({"entry": [0.6, 0.8], "cooldown": [0]})).where("trial = 0")
    return rounded(rounded(out, "win_rate"), "total_gain", "total_pnl", digits=5)


@query("tree_rules")
def _(spark, sf_dir):
    return rounded(study.tree_rules(scored(spark, sf_dir), ["mom3", "volume", "taker_ratio"], "up"), "precision", "lift")
