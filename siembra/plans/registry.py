"""One registry of queries: name -> (function of (spark, sf_dir), SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

#: Modules of this package that register queries when imported.
MODULES = ("gold", "marts", "panels", "planning", "commercial", "silver", "backtests", "identity", "catalogue")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the DuckDB SQL that gives the same rows."""

    def put(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = function
        if sql is not None:
            _ORACLES[name] = sql
        return function

    return put


def _load() -> None:
    for module in MODULES:
        import_module(f"siembra.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
