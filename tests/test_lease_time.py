"""The time-to-lease builder (F02) on the reference's fixture rows (FIXTURES.md §2.2)."""

import pytest
from pyspark.sql import functions as F

from dwell.plans import features as feat

CONST = dict(project_name="Project A", university="University A", distance_to_campus_m=300, facility_count=20,
             floor=5, size_sqm=25.0, room_type="studio", view="city", furnished=True, season_listed="normal",
             first_asking_rent=10000.0)
ROWS = [  # listing_id, unit_id, project_id, week_listed, date_listed, weeks_on_market, leased, week_leased
    ("L-TRAIN", "U-1", 1, 2, "2024-12-31", 4, "true", 6),
    ("L-VALID", "U-2", 1, 3, "2025-03-31", 2, "True", 5),
    ("L-TEST", "U-3", 1, 4, "2025-04-01", 1, "1", 5),
    ("L-DUP-B", "U-4", 1, 4, "2025-04-01", 1, "true", 5),
    ("L-OPEN", "U-5", 1, 4, "2025-04-01", 0, "false", None),
    ("L-NO-HISTORY", "U-6", 2, 1, "2025-01-07", 3, "true", 4),
]
DDL = ("listing_id string, unit_id string, project_id int, week_listed int, date_listed string, weeks_on_market int, "
       "leased string, week_leased int, project_name string, university string, distance_to_campus_m int, "
       "facility_count int, floor int, size_sqm double, room_type string, view string, furnished boolean, "
       "season_listed string, first_asking_rent double")


def tables(spark, market_date="2026-06-23"):
    listings = spark.createDataFrame([(*r, *CONST.values()) for r in ROWS], DDL)
    market = [(w, market_date, 1, 20 + w, 10, 0.70 + w / 100, 9000.0 + 100 * w) for w in range(1, 5)]
    market.append((1, market_date, 2, 10, 5, 0.5, 8000.0))
    wm = spark.createDataFrame(market, "week int, date string, project_id int, n_searchers int, n_listings_open int, "
                                       "occupancy double, median_asking_rent double")
    return {"listings": listings, "weekly_market": wm}


def build(spark, **kw):
    return feat.lease_time_dataset(tables(spark, **kw), "2024-12-31", "2025-03-31", "2025-06-30")


def test_rows_and_splits(spark):
    out = {r["listing_id"]: r for r in build(spark).collect()}
    assert set(out) == {"L-TRAIN", "L-VALID", "L-TEST", "L-NO-HISTORY"}
    assert {k: r["data_split"] for k, r in out.items()} == {
        "L-TRAIN": "train", "L-VALID": "validation", "L-TEST": "test", "L-NO-HISTORY": "validation"}
    assert list(build(spark).columns) == [*feat.TTL_IDS, *feat.TTL_FEATURES, feat.TTL_TARGET]


def test_previous_week_market_values(spark):
    r = build(spark).filter(F.col("listing_id") == "L-TRAIN").first()
    assert r["market_occupancy"] == pytest.approx(0.71)
    assert r["market_median_asking_rent"] == pytest.approx(9100.0)
    assert r["market_demand_pressure"] == pytest.approx(2.1)
    assert r["rent_to_market_ratio"] == pytest.approx(10000 / 9100)
    assert r["missing_market_history"] is False
    assert (r["listing_year"], r["listing_month"]) == (2024, 12)


def test_missing_history(spark):
    r = build(spark).filter(F.col("listing_id") == "L-NO-HISTORY").first()
    assert r["missing_market_history"] is True and r["market_occupancy"] is None


def test_follow_up_gate_fails_on_short_observation(spark):
    with pytest.raises(ValueError):
        build(spark, market_date="2025-12-23")


def test_leakage_guard_and_contracts(spark):
    data = build(spark)
    guard = {r["column"]: r for r in feat.leakage_guard(data).collect()}
    assert not any(r["forbidden"] and r["candidate"] for r in guard.values())
    t = tables(spark)
    with pytest.raises(KeyError):
        feat.lease_time_dataset({"listings": t["listings"].drop("week_leased"), "weekly_market": t["weekly_market"]})


def test_target_invariants_detect_mismatch(spark):
    bad = tables(spark)["listings"].withColumn("weeks_on_market", F.lit(9))
    with pytest.raises(ValueError):
        feat.check_target_invariants(feat.completed_primary(bad))


def test_duplicate_market_key_is_rejected(spark):
    t = tables(spark)
    t["weekly_market"] = t["weekly_market"].unionByName(t["weekly_market"].limit(1))
    with pytest.raises(ValueError):
        feat.lease_time_dataset(t, "2024-12-31", "2025-03-31", "2025-06-30")


def test_inference_input_matches_training_expressions(spark):
    rooms = spark.createDataFrame([("2026-07-07", 0.8, 10000.0, 30, 20, 12000.0)],
                                  "date_listed string, occupancy double, median_asking_rent double, n_searchers int, "
                                  "n_listings_open int, first_asking_rent double")
    r = feat.ttl_inference_input(rooms).first()
    assert (r["listing_year"], r["listing_month"]) == (2026, 7)
    assert r["market_demand_pressure"] == pytest.approx(1.5) and r["rent_to_market_ratio"] == pytest.approx(1.2)
    assert r["market_occupancy"] == pytest.approx(0.8) and r["missing_market_history"] is False
    zero = rooms.withColumn("n_listings_open", F.lit(0))
    z = feat.ttl_inference_input(zero).first()
    assert z["market_demand_pressure"] is None and z["missing_market_history"] is True
