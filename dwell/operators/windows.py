"""Window operators W01–W04 (partitioned windows only; no global single-partition window)."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_flag(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "is_duplicate") -> DataFrame:
    """Every occurrence after the first of ``keys`` (first by ``order``) is flagged; null keys
    are equal to each other, as in pandas ``duplicated``.

    The first occurrence per key is a partial (map-side) ``min`` aggregate joined back null-safely,
    so a key holding a large share of the rows is never sorted inside one window partition (AQE's
    skew-join handling splits it on the large side)."""
    first = F.struct(*[F.col(c) for c in order])
    firsts = df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(F.min(first).alias("__first"))
    cond = reduce(and_, [df[k].eqNullSafe(firsts[f"__k_{k}"]) for k in keys])
    joined = df.join(firsts, cond, "left")
    # rows tied with the first occurrence on (key, order): all but one are duplicates; the window
    # only spans such ties
    tie = Window.partitionBy(*keys, *order).orderBy(*df.columns)
    is_first_value = first == F.col("__first")
    flagged = joined.withColumn(name, ~is_first_value | (F.row_number().over(tie) > 1))
    return flagged.drop("__first", *[f"__k_{k}" for k in keys])


def duplicate_count(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Number of excess rows (rows after the first) — group-by with map-side partial counts."""
    cols = list(keys) if keys else df.columns
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
            .agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long").alias("duplicates")))


def calendar_checks(calendar: DataFrame, week: str = "week", date: str = "date") -> DataFrame:
    """W02 over a distinct (week, date) calendar: weeks repeated with different dates, and gaps
    between successive weeks' dates that are not exactly 7 days. The calendar is small (one row
    per week) but the lag is still computed on the de-duplicated calendar only."""
    distinct = calendar.select(week, date).distinct()
    per_week = distinct.groupBy(week).agg(F.count(F.lit(1)).alias("n"), F.min(date).alias(date))
    w = Window.orderBy(week)
    lagged = per_week.withColumn("__prev", F.lag(date).over(w))
    return lagged.agg(
        F.count(F.lit(1)).cast("long").alias("weeks"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("repeated_weeks"),
        F.count_if(F.col("__prev").isNotNull() & (F.datediff(date, "__prev") != 7)).cast("long").alias("bad_gaps"),
    )


def arg_min(df: DataFrame, group: Sequence[str], metric: str, ties: Sequence[str]) -> DataFrame:
    """The row with the smallest ``metric`` per group, ties broken by ``ties`` in order —
    ``min_by`` over a struct key, an aggregate with partial (map-side) evaluation. Rows without a
    metric are skipped (N17)."""
    key = F.struct(F.col(metric).alias("m"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(ties)])
    other = [c for c in df.columns if c not in group]
    agg = df.filter(F.col(metric).isNotNull()).groupBy(*group).agg(F.min_by(F.struct(*other), key).alias("__best"))
    return agg.select(*group, "__best.*")
