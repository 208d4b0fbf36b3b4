"""Where query modules put their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans import sql
from barloom.sources.bars import event_bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under ``name``."""

    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines' last bits agree."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def bar_query(name: str, stages: list[dict[str, Column]], sql_stages: list[dict[str, str]] | None, outputs: list[str], digits: int = 6) -> None:
    """A query of staged columns over hourly event bars: symbol, ts and the outputs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = event_bars(spark, sf_dir)
        for stage in stages():
            df = df.withColumns(stage)
        return rounded(df.select("symbol", "ts", *[F.col(o).cast("double").alias(o) for o in outputs]), *outputs, digits=digits)

    query(name, sql.query(sql_stages, outputs, digits=digits) if sql_stages else None)(run)
