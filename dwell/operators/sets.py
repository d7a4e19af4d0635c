"""Set operations U01–U04."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_splits(labelled: DataFrame, label: str, names: Sequence[str]) -> DataFrame:
    """Bag union of named splits of one labelled DataFrame (features and target stay
    aligned because they are one row). Equivalent to ``unionByName`` of the filtered parts but
    scans once."""
    return labelled.filter(F.col(label).isin(list(names)))


def wide_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "model",
                 value: str = "value") -> DataFrame:
    """Per-model columns -> (model, value) rows (``unpivot``; narrow, no shuffle)."""
    return df.unpivot(list(ids), list(values), name, value)


def never_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` absent from ``right`` (left anti join on distinct keys)."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def distinct_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct projection (partial distinct map-side, then shuffle)."""
    return df.select(*columns).distinct()


def invalid_examples(df: DataFrame, column: str, invalid, k: int = 5) -> DataFrame:
    """Up to ``k`` distinct invalid values for an error message (sorted, deterministic).
    The distinct set is aggregated before the limit, so only k values reach the driver."""
    return df.filter(invalid).select(F.col(column).cast("string").alias(column)).distinct().orderBy(column).limit(k)
