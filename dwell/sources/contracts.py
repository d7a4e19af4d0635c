"""Table and builder contracts (P01, Q01): metadata-only checks plus one ``limit(1)`` probe."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

# Required columns per table.
REQUIRED_COLUMNS: dict[str, tuple[str, ...]] = {
    "projects": ("project_id", "project_name", "university"),
    "units": ("unit_id", "project_id", "floor", "size_sqm"),
    "listings": ("listing_id", "unit_id", "project_id", "date_listed", "first_asking_rent", "leased",
                 "weeks_on_market"),
    "leases": ("lease_id", "unit_id", "project_id", "date_start", "rent", "is_renewal"),
    "weekly_market": ("week", "date", "project_id", "occupancy", "n_searchers"),
}


def missing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Required columns absent from ``df``, in the required order."""
    present = set(df.columns)
    return [c for c in columns if c not in present]


def require_columns(df: DataFrame, columns: Sequence[str], table: str) -> None:
    missing = missing_columns(df, columns)
    if missing:
        raise KeyError(f"{table} is missing required columns: {missing}")


def table_errors(tables: Mapping[str, DataFrame], required: Mapping[str, Sequence[str]] = REQUIRED_COLUMNS,
                 probe_empty: bool = True) -> list[tuple[str, str]]:
    """Q01: (table, error) pairs — missing table, missing columns (sorted), empty table."""
    errors: list[tuple[str, str]] = []
    for name, cols in required.items():
        if name not in tables:
            errors.append((name, "missing table"))
            continue
        df = tables[name]
        missing = sorted(missing_columns(df, cols))
        if missing:
            errors.append((name, "missing columns: " + ", ".join(missing)))
        if probe_empty and not df.limit(1).take(1):
            errors.append((name, "empty table"))
    return errors


def errors_frame(spark: SparkSession, errors: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(errors, "table string, error string")
