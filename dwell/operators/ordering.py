"""Sorts, limits and top-k (T01–T06). A limit is kept only where it is the feature (top-k report)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwell.operators.ranking import dense_index

# Report status order.
STATUS_ORDER = ("FAIL", "WARN", "PASS")


def top_k(df: DataFrame, column: str, k: int, tie_order: Sequence[str | Column]) -> DataFrame:
    """K largest by ``column``; ties in input order (``tie_order``). Planned as
    TakeOrderedAndProject: each task keeps its local top k, the driver merges k × tasks rows."""
    return df.orderBy(F.col(column).desc(), *tie_order).limit(k)


def status_rank(c: str | Column) -> Column:
    """Ordered category FAIL < WARN < PASS (unknown last)."""
    c = F.col(c) if isinstance(c, str) else c
    expr = F.when(c == STATUS_ORDER[0], 0)
    for i, s in enumerate(STATUS_ORDER[1:], 1):
        expr = expr.when(c == s, i)
    return expr.otherwise(len(STATUS_ORDER))


def top_abs(df: DataFrame, column: str, k: int, tie: Sequence[str] = ()) -> DataFrame:
    """K rows with the largest |value| (nulls dropped)."""
    return df.filter(F.col(column).isNotNull()).orderBy(F.abs(column).desc(), *tie).limit(k)


def top_abs_resorted(df: DataFrame, column: str, k: int, tie: Sequence[str] = ()) -> DataFrame:
    """Top k by magnitude, then re-sorted by the signed value."""
    return top_abs(df, column, k, tie).orderBy(column, *tie)


def head_tail_middle(df: DataFrame, order: Sequence[str], head: int = 5, tail: int = 6) -> DataFrame:
    """First ``head`` rows, last ``tail`` rows and the row at position n // 2 of the ordered
    set, with their positions (from the distributed dense index of T01)."""
    indexed = dense_index(df, order, "position")
    n = indexed.select(F.count(F.lit(1))).scalar()
    pos = F.col("position")
    chosen = indexed.filter((pos < head) | (pos >= n - tail) | (pos == F.floor(n / 2)))
    return chosen.withColumn("part", F.when(pos < head, "head").when(pos >= n - tail, "tail").otherwise("middle"))
