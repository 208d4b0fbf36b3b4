"""Events from conditions: generation and labels, checks of imported ones, counterexamples, return series, IC inputs."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from barloom.functions import rolling as R
from barloom.operators import align
from barloom.operators.preprocess import eligibility
from barloom.sources.bars import seconds


@dataclass(frozen=True)
class LabelRule:
    """Label 1 if the return from t0's close over ``horizon`` bars, in the event's direction, reaches ``threshold``."""

    label_id: str
    horizon: int
    threshold: float


def digest(payload: object) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()


def evaluation_frame(bars: DataFrame, horizons: list[int]) -> DataFrame:
    """Adds ``trigger_return`` (within the bar) and ``future_return_<h>`` (close to close), without direction."""
    future = {f"future_return_{h}": R.lead("close", h) / F.nullif(F.col("close"), F.lit(0.0)) - 1 for h in sorted(set(horizons))}
    return bars.withColumns({"trigger_return": F.col("close") / F.nullif(F.col("open"), F.lit(0.0)) - 1, **future})


def generate(bars: DataFrame, condition: Column, rules: list[LabelRule], timeframe: str, direction: int = 1, offset: int = 0, primary: bool = True) -> DataFrame:
    """Events where ``condition`` holds, one for each rule: (event_id, symbol, t0, direction, label_id, horizon, label, label_value, start, end).

    Bars whose window is short, broken or without price make none.  With ``primary``, of
    events of one rule and symbol whose windows hang together the first stays.
    """
    if not rules or len({r.label_id for r in rules}) < len(rules):
        raise ValueError("label rules need distinct names")
    step = seconds(timeframe)
    frame = evaluation_frame(bars, [r.horizon for r in rules]).withColumn("_hit", F.coalesce(condition, F.lit(False)))
    out = []
    for r in rules:
        fit = eligibility(bars, r.horizon, offset, step).where("reason is null").select("symbol", "ts")
        value = direction * F.col(f"future_return_{r.horizon}")
        made = frame.where("_hit").join(fit, ["symbol", "ts"]).select(
            F.concat_ws(":", "symbol", F.lit(timeframe), F.col("ts") * 1000, F.lit(r.label_id)).alias("event_id"), "symbol", F.col("ts").alias("t0"), F.lit(direction).alias("direction"),
            F.lit(r.label_id).alias("label_id"), F.lit(r.horizon).alias("horizon"), (value >= r.threshold).cast("int").alias("label"), value.alias("label_value"),
            F.col("ts").alias("start"), (F.col("ts") + (r.horizon + 1) * step).alias("end"),
        )
        out.append(made)
    events = reduce(DataFrame.unionByName, out)
    if not primary:
        return events
    w = Window.partitionBy("symbol", "label_id").orderBy("start", "event_id")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("_reach", reach).where("_reach is null or start > _reach").drop("_reach")


def provenance(rules: list[LabelRule], direction: int, source: str) -> dict:
    """What made the events, with digests that tell two makings apart."""
    named = [asdict(r) | {"digest": digest(asdict(r) | {"direction": direction})} for r in rules]
    return {"rules": named, "direction": direction, "source": source, "digest": digest([named, direction, source])}


# Kinds of counterexamples.
NO_FOLLOW, RANGE, DROP, UNCLEAR = "a_trigger_no_follow", "b_range", "c_drop", "unclassifiable"


def counterexample(first: Column, window: Column, trigger: float, follow: float, within: float, drop: float) -> Column:
    """The one kind whose rule holds, by the signed return of t0's bar and of the window; none or several are unclear."""
    rules = [(NO_FOLLOW, (first >= trigger) & (window <= follow)), (RANGE, F.abs(first) <= within), (DROP, first <= -drop)]
    hits = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]), lambda x: x.isNotNull())
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0))).otherwise(UNCLEAR)


def counterexamples(events: DataFrame, bars: DataFrame, trigger: float = 0.05, follow: float = 0.0, within: float = 0.01, drop: float = 0.05) -> DataFrame:
    """Kind of each event (symbol, t0, direction, horizon, label, kind) of label 0; a ``kind`` given by the user stays, and what the rules say is beside it."""
    horizons = sorted(r["horizon"] for r in events.select("horizon").distinct().collect())  # a handful of rules
    frame = bars.select("symbol", F.col("ts").alias("t0"), "open", "close", *[R.lead("close", h).alias(f"_{h}") for h in horizons])
    found = events.where("label = 0").join(frame, ["symbol", "t0"], "left")
    last = reduce(lambda a, h: F.when(F.col("horizon") == h, F.col(f"_{h}")).otherwise(a), horizons, F.lit(None).cast("double"))
    first, window = F.col("direction") * (F.col("close") - F.col("open")) / F.col("open"), F.col("direction") * (last - F.col("close")) / F.col("close")
    known = (F.col("open") > 0) & (F.col("close") > 0) & last.isNotNull()
    said = F.when(known, counterexample(first, window, trigger, follow, within, drop))
    return found.select(
        "event_id", F.coalesce("kind", said, F.lit(UNCLEAR)).alias("kind_effective"), F.when(F.col("kind").isNotNull(), "user").otherwise("platform_auto").alias("kind_source"),
        F.when(F.col("kind").isNotNull() & (said != F.col("kind")), said).alias("suggested_kind"),
    )


def return_series(signals: DataFrame, aligned: DataFrame) -> DataFrame:
    """(event_id, entry_at, exit_at, hold_return) of the signalled events (event_id) in order of entry; an event without alignment is an error."""
    wanted = signals.select("event_id").distinct()
    lost = wanted.join(aligned.where("reason is null"), "event_id", "left_anti").limit(3).collect()
    if lost:
        raise ValueError(f"signals without an aligned event: {[r['event_id'] for r in lost]}")
    return aligned.join(wanted, "event_id", "left_semi").select("event_id", "entry_at", "exit_at", F.col("event_return").alias("hold_return"))


def ic_inputs(events: DataFrame, manifest: DataFrame, receipts: DataFrame) -> DataFrame:
    """(feature_ts, event_id, label_value) of the primary events; two events on one feature row of a symbol are an error.

    ``manifest`` has (event_id, in_primary), ``receipts`` (event_id, feature_ts).
    """
    fed = events.join(manifest.where("in_primary").select("event_id"), "event_id").join(receipts.select("event_id", "feature_ts"), "event_id")
    twice = fed.groupBy("symbol", "feature_ts").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two events on the feature row {twice[0]['feature_ts']} of {twice[0]['symbol']}")
    return fed.select("symbol", "feature_ts", "event_id", "label_value")


# Imported events. Fields, their types, and the words allowed.
REQUIRED = {"event_id": "string", "symbol": "string", "timeframe": "string", "t0": "long", "direction": "string", "entry_price_semantic": "string", "scenario": "string", "label": "int", "label_definition": "map", "control_kind": "string", "source_file_digest": "string"}
WORDS = {"direction": ("long", "short"), "entry_price_semantic": tuple(align.ENTRIES), "scenario": ("A", "B", "C", "two_stage"), "label": (0, 1)}
OPTIONAL = ("decision_offset_bars", "label_value", "counterexample_kind", "kind_source", "meta", "event_origin", "source_model", "data_snapshot_digest")
MS_LEAST = 1_000_000_000_000


class ImportErrors(ValueError):
    """Every failure of an import: (row, event_id, field, reason)."""

    def __init__(self, failures: list[tuple]) -> None:
        super().__init__(f"{len(failures)} failures: {failures[:5]}")
        self.failures = failures


def import_failures(events: DataFrame, source_digest: str | None = None) -> DataFrame:
    """(row, event_id, field, reason) of every broken rule of an import table; empty if it may be taken.

    Milliseconds are told from other units by their size.  Rules of single rows are one
    projection; those of the whole batch (repeated ids, one direction, both labels) are aggregates.
    """
    rules: list[tuple[str, str, Column]] = []
    have = set(events.columns)
    for name in REQUIRED:
        rules.append((name, "missing_required_field", F.col(name).isNull() if name in have else F.lit(True)))
    for name in sorted(have - set(REQUIRED) - set(OPTIONAL) - {"row"}):
        rules.append((name, "unknown_field", F.col(name).isNotNull()))
    for name in ("event_id", "symbol", "timeframe"):
        if name in have:
            rules.append((name, "type_error", F.col(name) == ""))
    if "t0" in have:
        rules.append(("t0", "invalid_timestamp_unit", (F.col("t0") < MS_LEAST) | (F.col("t0") >= MS_LEAST * 1000)))
    for name, words in WORDS.items():
        if name in have:
            rules.append((name, "enum_violation", ~F.col(name).isin(*words)))
    if "decision_offset_bars" in have:
        rules.append(("decision_offset_bars", "type_error", F.col("decision_offset_bars") < 0))
    if "source_file_digest" in have:
        hexed = F.lower("source_file_digest").rlike("^[0-9a-f]{64}$")
        rules.append(("source_file_digest", "type_error", ~hexed))
        if source_digest is not None:
            rules.append(("source_file_digest", "digest_mismatch", hexed & (F.lower("source_file_digest") != source_digest.lower())))
    if isinstance(dict((f.name, f.dataType) for f in events.schema).get("label_definition"), (T.MapType, T.StructType)):
        for key in ("rule_id", "canonical_digest"):
            rules.append((f"label_definition.{key}", "missing_required_field", F.coalesce(F.col("label_definition")[key], F.lit("")) == ""))
    broken = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(name).alias("field"), F.lit(why).alias("reason"))) for name, why, rule in rules]), lambda x: x.isNotNull())
    row = F.col("row").cast("long") if "row" in have else F.lit(None).cast("long")
    who = F.col("event_id") if "event_id" in have else F.lit(None).cast("string")
    out = events.select(row.alias("row"), who.alias("event_id"), F.inline(broken))
    whole = lambda field, why: [F.lit(None).cast("long").alias("row"), F.lit(None).cast("string").alias("event_id"), F.lit(field).alias("field"), F.lit(why).alias("reason")]
    out = out.unionByName(events.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(*whole(None, "empty_import")).withColumn("field", F.col("field").cast("string")))
    if "event_id" in have:
        twice = events.where("event_id is not null").groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.unionByName(twice.select(F.lit(None).cast("long").alias("row"), "event_id", F.lit("event_id").alias("field"), F.lit("duplicate_event_id").alias("reason")))
    if "direction" in have:
        out = out.unionByName(events.where(F.col("direction").isin(*WORDS["direction"])).agg(F.count_distinct("direction").alias("n")).where("n > 1").select(*whole("direction", "direction_mixed_in_batch")))
    if "label" in have:
        out = out.unionByName(events.where(F.col("label").isin(0, 1)).agg(F.count_distinct("label").alias("n")).where("n = 1").select(*whole("label", "missing_control_group")))
    return out


def checked_import(events: DataFrame, source: bytes | None = None) -> DataFrame:
    """``events`` with the default decision offset, or :class:`ImportErrors` with the first thousand failures."""
    found = import_failures(events, hashlib.sha256(source).hexdigest() if source is not None else None)
    failures = [tuple(r) for r in found.limit(1000).collect()]
    if failures:
        raise ImportErrors(failures)
    offset = F.coalesce("decision_offset_bars", F.lit(0)) if "decision_offset_bars" in events.columns else F.lit(0)
    return events.withColumn("decision_offset_bars", offset)
