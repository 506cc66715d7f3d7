"""The queries for the reference's operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("bibliometrics", "facets", "matching", "networks", "retrieval", "feeds", "fields", "library", "pages", "exchange")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out |= import_module(f"citeloom.plans.{name}").QUERIES
    return out


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= import_module(f"citeloom.plans.{name}").SQL
    return out
