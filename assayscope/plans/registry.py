"""Registered queries and their SQL. A plan module calls add() for each of its queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
MODULES = ("ingest", "ranking", "sampling", "epistasis", "calibration", "acquisition", "statistics", "decision", "structure")


def add(sql: str | None = None, name: str | None = None):
    """Register the decorated (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def mark(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return mark


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"assayscope.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
