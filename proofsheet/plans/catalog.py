"""All queries over the driver's tables, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with its SQL if there is one."""

    def register(f):
        key = name or f.__name__
        assert key not in QUERIES, key
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return register


def _load() -> None:
    from proofsheet.plans import bursts, deliver, facets, frames, library, logs, models, people, quality, rubric, scoring, sidecars, signals, similar, sound, telemetry, text, timeline  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return SQL
