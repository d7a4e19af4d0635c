"""Registry of queries (name -> callable(spark, sf_dir) -> DataFrame) and their DuckDB oracles.

Every registered query reads the driver's tables through the binding, so its work grows with
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.plans.oracle import with_binding
from dwell.sources import binding

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, raw_sql: str | None = None):
    """Register ``fn`` under ``name``; ``sql`` is wrapped with the binding CTEs."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_binding(sql)
        elif raw_sql is not None:
            ORACLES[name] = raw_sql
        return fn
    return deco


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return binding.views(spark, sf_dir)


def r6(c: str | Column) -> Column:
    """Round floating results to 6 dp (the oracle does the same)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def load_all() -> None:
    """Import every catalog module so that the decorators run."""
    from dwell.plans.catalog import (aggregates, features, joins, models, ordering, predicates,  # noqa: F401
                                     quality, scalars, sets, sources, splits, windows)
