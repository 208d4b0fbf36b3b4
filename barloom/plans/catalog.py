"""Registered queries of the reference's operators, and their DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.plans.registry import ORACLE, QUERIES

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("indicators", "research", "candles", "selection", "more", "prep", "extra")

for _name in MODULES:
    importlib.import_module(f"barloom.plans.{_name}_queries")

__all__ = ["ORACLE", "QUERIES"]
