"""Registered queries over the given tables, with SQL twins to check them by."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ["sources", "stores", "scalars", "chunking", "embedding", "searching", "classification", "contexts", "training"]


def check(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its twin."""

    def add(query: Callable[[SparkSession, str], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def load_all() -> None:
    """Import every module that registers queries."""
    for module in MODULES:
        import_module(f"checks.{module}")
