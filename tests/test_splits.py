"""Cut-off semantics (N14), folds and the follow-up gate."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dwell.operators import splits


def test_chronological_split_includes_whole_cutoff_day(spark):
    df = spark.createDataFrame([("2025-12-31 23:59:59",), ("2026-01-01 00:00:00",), ("2026-03-31 23:59:59",),
                                ("2026-04-01 00:00:00",)], "event_time string")
    out = splits.chronological_split(df, "event_time", "2025-12-31", "2026-03-31")
    assert [r["split"] for r in out.collect()] == ["train", "validation", "validation", "test"]


def test_chronological_split_errors(spark):
    df = spark.createDataFrame([("2025-01-01",), ("not a date",)], "d string")
    with pytest.raises(ValueError):
        splits.chronological_split(df, "d", "2025-12-31", "2026-03-31")
    with pytest.raises(KeyError):
        splits.chronological_split(df, "missing", "2025-12-31", "2026-03-31")
    with pytest.raises(ValueError):
        splits.chronological_split(df, "d", "2026-03-31", "2025-12-31", validate=False)


def test_matured_split_is_midnight_inclusive(spark):
    df = spark.createDataFrame([("2024-12-31",), ("2025-03-31",), ("2025-06-30",), ("2025-07-01",),
                                ("2024-12-31 23:59:00",)], "d string")
    out = splits.matured_split(df, "d", "2024-12-31", "2025-03-31", "2025-06-30")
    assert [r["data_split"] for r in out.collect()] == ["train", "validation", "test", "post_test", "validation"]
    with pytest.raises(ValueError):
        splits.matured_split(df, "d", "2025-03-31", "2024-12-31", "2025-06-30")


def test_rolling_folds_counts(spark):
    days = [(dt.date(2025, 1, 1) + dt.timedelta(days=i)).isoformat() for i in range(60)]
    df = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date_start string, i int")
    long = splits.rolling_folds(df, "date_start", [("f1", "2025-01-30", "2025-02-10")])
    counts = {r["role"]: r["count"] for r in long.groupBy("role").count().collect()}
    assert counts == {"train": 30, "validation": 11}
    summary = splits.fold_summary(long, [("f1", "2025-01-30", "2025-02-10")]).first()
    assert (summary["train_rows"], summary["validation_rows"]) == (30, 11)


def test_follow_up_gate(spark):
    ok = spark.createDataFrame([("2026-06-23",)], "date string")
    assert splits.check_follow_up(ok, "2025-06-30", 52) >= 52
    late = spark.createDataFrame([("2025-12-23",)], "date string")
    with pytest.raises(ValueError):
        splits.check_follow_up(late, "2025-06-30", 52)


def test_require_nonempty(spark):
    with pytest.raises(ValueError):
        splits.require_nonempty(spark.range(0), "validation")
    assert splits.require_nonempty(spark.range(1), "train").count() == 1


def test_folds_reject_bad_dates_and_empty_sides(spark):
    window = [("f1", "2025-01-30", "2025-02-10")]
    for dates, what in ((["2025-01-01", "2025-02-01", "soon"], "unparseable"), (["2025-01-01", "2025-03-01"], "validation"),
                        (["2025-02-01"], "train")):
        df = spark.createDataFrame([(d,) for d in dates], "date_start string")
        for make in (splits.rolling_folds, splits.sliced_folds):
            with pytest.raises(ValueError, match=what):
                make(df, "date_start", window)


def test_date_bound_reaches_the_scan(spark, tmp_path, capsys):
    from pyspark.sql import functions as F

    from dwell.functions.scalars import parse_date
    path = str(tmp_path / "leases")
    spark.sql("SELECT DATE '2025-01-01' AS date_start, 1 AS x").write.parquet(path)
    df = spark.read.parquet(path).select(parse_date("date_start", "date").alias("date_start"), "x")
    df = df.withColumn("year", F.year("date_start")).filter(splits.chronological_range("date_start", "train", "2025-01-30", "2025-02-10"))
    df.explain("formatted")
    assert "LessThanOrEqual(date_start,2025-01-30)" in capsys.readouterr().out and df.count() == 1
