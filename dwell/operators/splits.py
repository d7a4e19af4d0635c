"""Time splits and observation maturity.

Three cut-off semantics exist and are kept apart (N14):

* ``chronological_split``: whole cut-off day included (``ts < cutoff + 1 day``);
* ``matured_split``: midnight inclusive (``ts <= cutoff``), so 23:59 on the cut-off day moves on;
* ``rolling_folds``: fold windows ``(train_end, validation_end]`` at midnight.

All three only add columns (narrow transformations): no shuffle, no join.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwell.functions.scalars import parse_timestamp

SPLITS_3 = ("train", "validation", "test")
SPLITS_4 = ("train", "validation", "test", "post_test")


def _day(value: str) -> Column:
    return F.to_timestamp(F.lit(value[:10]))


def _timestamp(df: DataFrame, column: str) -> Column:
    """The column as a timestamp; text that does not parse is null."""
    if dict(df.dtypes)[column] in ("date", "timestamp"):
        return F.col(column).cast("timestamp")
    return parse_timestamp(column)


def _check_column(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise KeyError(f"Date column was not found: {column}")


def _check_order(*cutoffs: str) -> None:
    days = [c[:10] for c in cutoffs]
    if any(a >= b for a, b in zip(days, days[1:])):
        raise ValueError("cut-offs must be strictly increasing: " + " < ".join(cutoffs))


def unparseable_dates(df: DataFrame, column: str) -> int:
    """Count of non-null-input rows whose date does not parse (plus null inputs) — one aggregate."""
    return df.select(F.count_if(_timestamp(df, column).isNull()).alias("n")).first()["n"]


def chronological_label(ts: Column, train_end: str, validation_end: str) -> Column:
    """K01 label: whole cut-off days included."""
    train_cut = F.date_add(_day(train_end), 1).cast("timestamp")
    valid_cut = F.date_add(_day(validation_end), 1).cast("timestamp")
    return F.when(ts < train_cut, "train").when(ts < valid_cut, "validation").when(ts.isNotNull(), "test")


def chronological_split(df: DataFrame, date_column: str, train_end: str, validation_end: str,
                        validate: bool = True, label: str = "split") -> DataFrame:
    """Adds ``label``; callers filter it (one labelled DataFrame instead of three copies)."""
    _check_column(df, date_column)
    _check_order(train_end, validation_end)
    if validate:
        bad = unparseable_dates(df, date_column)
        if bad:
            raise ValueError(f"{date_column} contains {bad} unparseable values")
    return df.withColumn(label, chronological_label(_timestamp(df, date_column), train_end, validation_end))


def matured_label(ts: Column, train_end: str, validation_end: str, test_end: str) -> Column:
    """K02 label: midnight-inclusive cut-offs, rows after test_end are post_test."""
    return (F.when(ts <= _day(train_end), "train")
            .when(ts <= _day(validation_end), "validation")
            .when(ts <= _day(test_end), "test")
            .when(ts.isNotNull(), "post_test"))


def matured_split(df: DataFrame, date_column: str, train_end: str, validation_end: str, test_end: str,
                  validate: bool = True, label: str = "data_split") -> DataFrame:
    _check_column(df, date_column)
    _check_order(train_end, validation_end, test_end)
    if validate:
        bad = unparseable_dates(df, date_column)
        if bad:
            raise ValueError(f"{date_column} contains unparseable dates")
    return df.withColumn(label, matured_label(_timestamp(df, date_column), train_end, validation_end, test_end))


def matured_range(date_col: str, split: str, train_end: str, validation_end: str, test_end: str) -> Column:
    """K02 as a date-range predicate on a DATE column (same rows as ``matured_label == split``),
    in a form that reaches the parquet scan and prunes row groups of date-sorted data."""
    d = F.col(date_col)
    c1, c2, c3 = (F.lit(x[:10]).cast("date") for x in (train_end, validation_end, test_end))
    return {"train": d <= c1, "validation": (d > c1) & (d <= c2), "test": (d > c2) & (d <= c3),
            "post_test": d > c3}[split]


def chronological_range(date_col: str, split: str, train_end: str, validation_end: str) -> Column:
    """K01 as a date-range predicate on a DATE column (whole cut-off days included)."""
    d = F.col(date_col)
    c1, c2 = (F.lit(x[:10]).cast("date") for x in (train_end, validation_end))
    return {"train": d <= c1, "validation": (d > c1) & (d <= c2), "test": d > c2}[split]


def fold_windows(windows: Sequence[tuple[str, str, str]]) -> Column:
    """The (fold, train_end, validation_end) list as a literal array of structs."""
    return F.array(*[
        F.struct(F.lit(name).alias("fold"), _day(tr).alias("train_end"), _day(va).alias("validation_end"))
        for name, tr, va in windows
    ])


def rolling_folds(df: DataFrame, date_column: str, windows: Sequence[tuple[str, str, str]],
                  fold: str = "fold", role: str = "role", validate: bool = True) -> DataFrame:
    """Long (fold, role, row) form. A row is in fold k's train when ts <= train_end and in its
    validation when train_end < ts <= validation_end. Expressed as a per-row ``explode`` over the
    literal window list: no join, no shuffle, output is at most |windows| × input. Dates that do not
    parse and empty fold sides are errors (``check_folds``)."""
    _check_column(df, date_column)
    if validate:
        check_folds(df, date_column, windows)
    ts = _timestamp(df, date_column)
    memberships = F.transform(
        fold_windows(windows),
        lambda w: F.struct(
            w["fold"].alias(fold),
            F.when(ts <= w["train_end"], "train")
            .when((ts > w["train_end"]) & (ts <= w["validation_end"]), "validation").alias(role),
        ),
    )
    kept = F.filter(memberships, lambda m: m[role].isNotNull())
    return df.select("*", F.inline(kept))


def check_folds(df: DataFrame, date_column: str, windows: Sequence[tuple[str, str, str]]) -> None:
    """K03 gate, one aggregate: no unparseable date, rows on both sides of every fold."""
    ts = _timestamp(df, date_column)
    sides = [((name, role), F.count_if(rows)) for name, train_end, validation_end in windows for role, rows in (
        ("train", ts <= _day(train_end)), ("validation", (ts > _day(train_end)) & (ts <= _day(validation_end))))]
    bad, *counts = df.agg(F.count_if(ts.isNull()), *[n for _, n in sides]).first()
    if bad:
        raise ValueError(f"{date_column} contains {bad} unparseable values")
    empty = [f"{name} ({role})" for ((name, role), _), n in zip(sides, counts) if not n]
    if empty:
        raise ValueError("empty folds: " + ", ".join(empty))


@dataclass(frozen=True)
class SlicedFolds:
    """K03 as additive slices: rows with a ``slice`` number that grows with time; fold i trains on the
    slices up to ends[i][0] and is validated on the later ones up to ends[i][1]."""
    rows: DataFrame
    names: tuple[str, ...]
    ends: tuple[tuple[int, int], ...]


def sliced_folds(df: DataFrame, date_column: str, windows: Sequence[tuple[str, str, str]]) -> SlicedFolds:
    """K03 as ``SlicedFolds``: the slice is the number of cut-offs before the row; nothing is exploded."""
    _check_column(df, date_column)
    check_folds(df, date_column, windows)
    ts = _timestamp(df, date_column)
    cuts = sorted({end[:10] for _, *ends in windows for end in ends})
    number = sum((F.when(ts > _day(c), 1).otherwise(0) for c in cuts), F.lit(0))
    ends = tuple((cuts.index(train_end[:10]), cuts.index(validation_end[:10])) for _, train_end, validation_end in windows)
    return SlicedFolds(df.withColumn("slice", number), tuple(name for name, _, _ in windows), ends)


def fold_summary(long_folds: DataFrame, windows: Sequence[tuple[str, str, str]],
                 fold: str = "fold", role: str = "role") -> DataFrame:
    """Name, cut-offs, train rows, validation rows (one aggregate; windows joined as literals)."""
    counts = long_folds.groupBy(fold).agg(
        F.count_if(F.col(role) == "train").cast("long").alias("train_rows"),
        F.count_if(F.col(role) == "validation").cast("long").alias("validation_rows"),
    )
    spark = long_folds.sparkSession
    names = spark.createDataFrame([(n, t, v, i) for i, (n, t, v) in enumerate(windows)],
                                  f"{fold} string, train_end string, validation_end string, ordinal int")
    return (F.broadcast(names).join(counts, fold, "left")
            .select(fold, "train_end", "validation_end",
                    F.coalesce("train_rows", F.lit(0)).alias("train_rows"),
                    F.coalesce("validation_rows", F.lit(0)).alias("validation_rows"), "ordinal"))


def require_nonempty(df: DataFrame, what: str) -> DataFrame:
    """A named split/fold side must have at least one row (``limit(1)`` probe)."""
    if df.limit(1).count() == 0:
        raise ValueError(f"{what} is empty")
    return df


def observation_end(market: DataFrame, date_column: str = "date") -> Column:
    """K06 aggregate expression: max(market date) + 7 days."""
    return F.date_add(F.max(F.to_date(date_column)), 7)


def follow_up_weeks(obs_end: Column, test_end: str) -> Column:
    """floor(days(observation_end - test_end) / 7)."""
    return F.floor(F.datediff(obs_end, F.lit(test_end[:10]).cast("date")) / 7).cast("long")


def check_follow_up(market: DataFrame, test_end: str, min_weeks: int = 52, date_column: str = "date") -> int:
    """K06 gate: raise when the test window cannot be followed for ``min_weeks``."""
    row = market.select(
        F.count_if(parse_timestamp(date_column).isNull()).alias("bad"),
        follow_up_weeks(observation_end(market, date_column), test_end).alias("weeks"),
    ).first()
    if row["bad"]:
        raise ValueError("weekly_market.date contains unparseable dates")
    if row["weeks"] is None or row["weeks"] < min_weeks:
        raise ValueError(f"test window has too little follow-up: need {min_weeks} weeks, have {row['weeks']}")
    return int(row["weeks"])
