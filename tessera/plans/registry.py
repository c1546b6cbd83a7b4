"""Registry of named queries and their DuckDB oracles.

Each plan module registers a builder with ``query``; the builder takes
``(spark, sf_dir)`` and its oracle is plain SQL over the same tables.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

#: Modules that register queries when imported.
MODULES = ("search", "facts", "counts", "life", "more", "talk", "words", "corpus")

_queries: dict[str, Builder] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register the decorated builder under ``name``, with its oracle if SQL can express it."""

    def add(builder: Builder) -> Builder:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = builder
        if sql is not None:
            _oracles[name] = sql
        return builder

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"tessera.plans.{module}")


def queries() -> dict[str, Builder]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
