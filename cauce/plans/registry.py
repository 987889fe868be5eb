"""Registry of named queries: a Spark builder and, where SQL can express it,
the DuckDB oracle statement producing the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cauce.plans.oracle import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``sql`` is the oracle statement; ``views`` lists the derived views
    (``cauce.plans.oracle.VIEWS``) it needs as CTEs.
    """
    def deco(fn: QueryFn) -> QueryFn:
        old = QUERIES.get(name)
        if old is not None and (old.__module__, old.__qualname__) != (fn.__module__, fn.__qualname__):
            raise ValueError(f"duplicate query {name}")  # a module reload re-registers silently
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        return fn
    return deco
