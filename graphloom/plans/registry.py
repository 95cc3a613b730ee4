"""Registered queries of the core operators and the DuckDB SQL that each must equal."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
#: Modules that register queries on import.
MODULES: list[str] = ["relational", "metrics", "structure", "text", "collections", "synthetic", "more", "datasets", "further"]


def register(name: str, sql: str | None = None):
    """Decorator: add a query, and its oracle SQL where SQL can express it."""

    def add(query: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = query
        if sql is not None:
            _oracles[name] = sql
        return query

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"graphloom.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
