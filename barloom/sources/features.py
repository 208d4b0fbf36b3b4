"""A store of features: runs of column groups with a manifest, read by column, by group or for many symbols.

A run of a symbol, timeframe and settings' hash is a folder with a Parquet table for each
group and ``manifest`` as JSON, written last, so a run without one isn't there.  Strict
consumers take complete runs only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.names import required, stable_json

KEYS = ["symbol", "ts"]


class NotConsumable(RuntimeError):
    """A run that a strict consumer must not read."""


def run_dir(base: str, symbol: str, timeframe: str, config_hash: str) -> str:
    for part in (symbol, timeframe, config_hash):
        if not part or "/" in part or part in (".", ".."):
            raise ValueError(f"not a name of a folder: {part!r}")
    return f"{base.rstrip('/')}/{symbol}/{timeframe}/{config_hash}"


def write_run(df: DataFrame, base: str, symbol: str, timeframe: str, config_hash: str, groups: dict[str, list[str]], status: str = "complete", kind: str = "raw") -> dict:
    """Write the groups of one symbol's features, then the manifest."""
    root = run_dir(base, symbol, timeframe, config_hash)
    rows = df.where(F.col("symbol") == symbol)
    for group, columns in groups.items():
        rows.select(*KEYS, *columns).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{kind}/{group}")
    manifest = {"run_status": status, "rows": rows.count(), "artifacts": {kind: {"groups": {g: {"path": f"{kind}/{g}", "columns": c} for g, c in groups.items()}}}}
    spark = df.sparkSession
    spark.createDataFrame([(stable_json(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifest")
    return manifest


def status_of(manifest: dict | None) -> str:
    return str((manifest or {}).get("run_status") or (manifest or {}).get("quality_status") or "unknown")


def consumable(status: str, allow_partial: bool = False) -> bool:
    return status == "complete" or allow_partial and status == "partial"


def load_manifest(spark: SparkSession, base: str, symbol: str, timeframe: str, config_hash: str, strict: bool = False, allow_partial: bool = False) -> dict:
    """A run's manifest, without reading its data; a strict consumer gets complete runs (or partial ones if allowed)."""
    manifest = json.loads("".join(r["value"] for r in spark.read.text(f"{run_dir(base, symbol, timeframe, config_hash)}/manifest").collect()))
    if strict and not consumable(status_of(manifest), allow_partial):
        raise NotConsumable(f"the run of {symbol} {timeframe} is {status_of(manifest)}")
    return manifest


def list_features(manifest: dict, kind: str = "raw") -> list[str]:
    return [c for g in manifest["artifacts"][kind]["groups"].values() for c in g["columns"]]


def groups(spark: SparkSession, base: str, symbol: str, timeframe: str, config_hash: str, kind: str = "raw", **gate) -> Iterator[tuple[str, DataFrame]]:
    """Each group's name and lazy table; files are read when one is used."""
    manifest = load_manifest(spark, base, symbol, timeframe, config_hash, **gate)
    root = run_dir(base, symbol, timeframe, config_hash)
    for name, group in manifest["artifacts"][kind]["groups"].items():
        yield name, spark.read.parquet(f"{root}/{group['path']}")


def load_columns(spark: SparkSession, base: str, symbol: str, timeframe: str, config_hash: str, columns: list[str], kind: str = "raw", **gate) -> DataFrame:
    """The wanted columns beside symbol and time: only their groups and columns are scanned."""
    manifest = load_manifest(spark, base, symbol, timeframe, config_hash, **gate)
    root, left, out = run_dir(base, symbol, timeframe, config_hash), list(columns), None
    for group in manifest["artifacts"][kind]["groups"].values():
        here = [c for c in left if c in group["columns"]]
        if here:
            part = spark.read.parquet(f"{root}/{group['path']}").select(*KEYS, *here)
            out = part if out is None else out.join(part, KEYS, "full")
            left = [c for c in left if c not in here]
    if left or out is None:
        raise KeyError(f"features not in the run: {left}")
    return out.select(*KEYS, *columns)


def checked_rows(df: DataFrame, manifest: dict) -> DataFrame:
    """The table, if it has as many rows as its manifest says."""
    n = df.count()
    if n != manifest["rows"]:
        raise ValueError(f"{n} rows, and the manifest says {manifest['rows']}")
    return df


def load_many(spark: SparkSession, base: str, runs: dict[str, str], timeframe: str, columns: list[str] | None = None, for_training: bool = False, allow_partial: bool = False) -> DataFrame:
    """Features of many symbols (symbol to settings' hash) in one table; a symbol without a run, or without a column, is an error."""
    parts = {}
    for symbol, config_hash in runs.items():
        manifest = load_manifest(spark, base, symbol, timeframe, config_hash, strict=for_training, allow_partial=allow_partial)
        names = columns or list_features(manifest)
        parts[symbol] = load_columns(spark, base, symbol, timeframe, config_hash, names)
    if not parts:
        raise ValueError("no symbols")
    required(parts, columns or [])
    out = None
    for part in parts.values():
        out = part if out is None else out.unionByName(part, allowMissingColumns=not columns)
    return out
