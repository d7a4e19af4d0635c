"""Null rules (N1–N3, N10–N13) and scalar functions X01–X15 on dirty rows."""

import math

from pyspark.sql import functions as F

from dwell.functions import nulls, scalars as X


def test_negated_rules_count_null_as_failure(spark):
    df = spark.createDataFrame([(1.0,), (9.0,), (None,)], "x double")
    row = df.agg(F.count_if(nulls.fails_between("x", 0, 5)).alias("between"),
                 F.count_if(nulls.fails_isin("x", [1.0])).alias("isin"),
                 F.count_if(nulls.fails(F.col("x") <= 0)).alias("direct")).first()
    assert (row["between"], row["isin"], row["direct"]) == (2, 2, 0)


def test_differs_and_null_safe_equality(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, None), (None, 1)], "a int, b int")
    got = [tuple(r) for r in df.select(nulls.differs("a", "b"), nulls.differs_null_safe("a", "b")).collect()]
    assert got == [(False, False), (True, True), (True, False), (True, True)]


def test_not_close_uses_relative_and_absolute_tolerance(spark):
    df = spark.createDataFrame([(1.0, 1.0 + 1e-9), (1.0, 1.1), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(nulls.not_close("a", "b")).collect()] == [False, True, True]


SPELLINGS = ["true", " TRUE ", "1", "0", "false", "yes", "no", "maybe", "1.0", None]


def test_strict_boolean_spellings(spark):
    df = spark.createDataFrame([(s,) for s in SPELLINGS], "v string")
    parsed, invalid = X.strict_boolean("v", "string")
    got = [(r[0], r[1]) for r in df.select(parsed, invalid).collect()]
    assert got == [(True, False), (True, False), (True, False), (False, False), (False, False),
                   (None, True), (None, True), (None, True), (None, True), (None, True)]


def test_strict_boolean_integers_and_floats(spark):
    ints = spark.createDataFrame([(0,), (1,), (2,)], "v int")
    p, bad = X.strict_boolean("v", "int")
    assert [tuple(r) for r in ints.select(p, bad).collect()] == [(False, False), (True, False), (None, True)]
    floats = spark.createDataFrame([(1.0,)], "v double")
    p, bad = X.strict_boolean("v", "double")
    assert floats.select(bad).first()[0] is True


def test_lenient_boolean_and_flag(spark):
    df = spark.createDataFrame([(s,) for s in SPELLINGS], "v string")
    got = [(r[0], r[1]) for r in df.select(X.lenient_boolean("v"), X.lenient_flag("v")).collect()]
    assert got == [(True, True), (True, True), (True, True), (False, False), (False, False), (True, True),
                   (False, False), (None, False), (None, False), (None, False)]


def test_date_and_number_parsing_coerce(spark):
    df = spark.createDataFrame([("2025-01-31",), ("2025-13-01",), ("01/02/2025",), (None,)], "d string")
    got = [r[0] for r in df.select(X.parse_date("d")).collect()]
    assert str(got[0]) == "2025-01-31" and got[1:] == [None, None, None]
    nums = spark.createDataFrame([("12.5",), ("n/a",)], "v string")
    assert [r[0] for r in nums.select(X.parse_number("v")).collect()] == [12.5, None]


def test_iso_pattern_text_hygiene_and_suffix(spark):
    df = spark.createDataFrame([("2025-01-02", " studio", "City", "L1-B"), ("02/01/2025", "studio", "city", "L2"),
                                (None, None, None, None)], "d string, r string, v string, id string")
    got = [tuple(r) for r in df.select(X.is_iso_date_text("d"), X.untrimmed("r"), X.not_lowercase("v"),
                                       X.is_alternative_id("id"), X.base_id("id")).collect()]
    assert got == [(True, True, True, True, "L1"), (False, False, False, False, ""), (None, None, None, False, None)]


def test_safe_ratio_variants(spark):
    df = spark.createDataFrame([(10, 5), (10, 0), (10, -2), (10, None)], "a int, b int")
    got = [tuple(r) for r in df.select(X.safe_ratio("a", "b"), X.positive_ratio("a", "b")).collect()]
    assert got == [(2.0, 2.0), (None, None), (-5.0, None), (None, None)]


def test_clip_and_half_even_rounding(spark):
    df = spark.createDataFrame([(-1.5,), (0.5,), (1.5,), (2.5,), (None,)], "x double")
    got = [tuple(r) for r in df.select(X.clip_zero("x"), X.round_half_even("x")).collect()]
    assert got == [(0.0, -2.0), (0.5, 0.0), (1.5, 2.0), (2.5, 2.0), (None, None)]


def test_calendar_and_names(spark):
    df = spark.createDataFrame([("2025-07-19", 3)], "d string, w int")
    r = df.select(X.month_start("d"), X.week_to_date("w", "2023-01-03"), X.log1p(F.lit(0.0)),
                  X.clean_encoded_name(F.lit("category__room_type_studio"))).first()
    assert str(r[0]) == "2025-07-01" and str(r[1]) == "2023-01-24" and r[2] == 0.0 and r[3] == "room_type_studio"
    assert X.slug("Random Forest") == "random_forest"


def test_resolve_alias(spark):
    df = spark.createDataFrame([(None, 0.8), (0.7, 0.9)], "market_occupancy double, occupancy double")
    assert [r[0] for r in df.select(X.resolve_alias(df.columns, "market_occupancy", "occupancy")).collect()] == [0.8, 0.7]
    assert df.select(X.resolve_alias(df.columns, "absent")).first()[0] is None
    assert not math.isnan(0.0)


def test_require_strict_boolean_lists_bad_values(spark):
    import pytest
    ok = spark.createDataFrame([("true",), ("0",)], "v string")
    assert [r[0] for r in X.require_strict_boolean(ok, "v").collect()] == [True, False]
    bad = spark.createDataFrame([(s,) for s in ["yes", "2", "maybe", "1.0", "x", "y", "true"]], "v string")
    with pytest.raises(ValueError) as err:
        X.require_strict_boolean(bad, "v")
    assert "'1.0'" in str(err.value) and str(err.value).count("'") == 10   # five values quoted
    nulls = spark.createDataFrame([(None,)], "v string")
    with pytest.raises(ValueError):
        X.require_strict_boolean(nulls, "v")


def test_raw_listing_queries_read_the_raw_twin(spark, monkeypatch):
    """X03, X05, X06 see the rows before clean-up."""
    from dwell.plans.catalog import scalars as Q
    rows = [(w, f, "studio", "city", 30.0, True, "2020-01-02", 9.0) for w, f in ((1, 3), (2, 5), (3, 7))]
    listings = spark.createDataFrame(rows, "week_listed int, floor int, room_type string, view string, size_sqm double, furnished boolean, "
                                           "date_listed string, asking_rent double").withColumn("date_listed", F.to_date("date_listed")).withColumn(
                                               "listing_id", F.concat(F.lit("L"), F.col("floor")))
    monkeypatch.setattr(Q, "tables", lambda spark, sf: {"listings": listings})
    got = {q: {r["listing_id"]: tuple(r)[1:] for r in getattr(Q, q)(spark, "").collect()} for q in ("x03", "x05", "x06")}
    assert [got["x03"][i][1] for i in ("L3", "L5", "L7")] == [False, False, True]
    assert [got["x05"][i][0] for i in ("L3", "L5", "L7")] == [True, True, False]
    assert [got["x06"][i] for i in ("L3", "L5", "L7")] == [(True, False), (False, True), (False, False)]
