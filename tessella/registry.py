"""Named queries over the given tables, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.sources.views import VIEWS_SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a function of ``Views``, under its own name or another. ``sql`` may use the views and begin with ``WITH``."""

    def registered(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name or f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            text = sql.strip()
            ORACLE_SQL[name or f.__name__] = f"WITH RECURSIVE {VIEWS_SQL}" + (f", {text[5:]}" if text.startswith("WITH ") else f" {text}")
        return f

    return registered
