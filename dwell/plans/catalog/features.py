"""Feature-pipeline queries F01–F07."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwell.plans import features as feat
from dwell.plans.catalog.common import _p, _w, ttl
from dwell.plans.registry import query, r6, tables
from dwell.sources import binding

_FLOATS = {"size_sqm", "first_asking_rent", "market_occupancy", "market_demand_pressure", "market_median_asking_rent",
           "rent_to_market_ratio", "rent", "weeks_on_market"}


def _round_floats(df):
    return df.select(*[r6(c).alias(c) if c in _FLOATS else F.col(c) for c in df.columns])


@query("f01", sql=_p("SELECT date_start, " + ", ".join(
    f"round({c}, 6) AS {c}" if c in _FLOATS else c for c in feat.PRICE_FEATURES) + ", round(rent, 6) AS rent FROM price"))
def f01(spark, sf):
    return _round_floats(feat.price_dataset(tables(spark, sf)))


@query("f02", sql=_w("SELECT " + ", ".join(
    f"round({c}, 6) AS {c}" if c in _FLOATS else c for c in (*feat.TTL_IDS, *feat.TTL_FEATURES, feat.TTL_TARGET)) + " FROM ttl"))
def f02(spark, sf):
    return _round_floats(ttl(spark, sf))


@query("f03", sql="""
SELECT CAST(count(DISTINCT listing_id) AS BIGINT) AS distinct_ids, CAST(count(*) AS BIGINT) AS rows,
  CAST(count(*) FILTER (WHERE date_listed IS NULL) AS BIGINT) AS bad_date,
  CAST(count(*) FILTER (WHERE weeks_on_market IS NULL) AS BIGINT) AS bad_target,
  CAST(count(*) FILTER (WHERE weeks_on_market < 0) AS BIGINT) AS negative_target,
  CAST(count(*) FILTER (WHERE coalesce(week_leased - week_listed <> weeks_on_market, true)) AS BIGINT) AS target_mismatch,
  CAST(count(*) - count(DISTINCT listing_id) AS BIGINT) AS duplicate_ids
FROM listings WHERE NOT coalesce(ends_with(listing_id, '-B'), false) AND coalesce(leased, false)""")
def f03(spark, sf):
    return feat.target_invariants(feat.completed_primary(tables(spark, sf)["listings"]))


@query("f04", sql=_w("""
SELECT listing_id, round(market_occupancy, 6) AS market_occupancy, round(market_demand_pressure, 6) AS market_demand_pressure,
  round(market_median_asking_rent, 6) AS market_median_asking_rent, round(rent_to_market_ratio, 6) AS rent_to_market_ratio,
  missing_market_history FROM ttl"""))
def f04(spark, sf):
    return _round_floats(ttl(spark, sf).select("listing_id", "market_occupancy", "market_demand_pressure",
                                               "market_median_asking_rent", "rent_to_market_ratio", "missing_market_history"))


_F05_NAMES = list(dict.fromkeys([*feat.TTL_FEATURES, *feat.LEAKAGE_COLUMNS, feat.TTL_TARGET, "outcome_known_date"]))


@query("f05", sql=_w("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {str(c in (*feat.LEAKAGE_COLUMNS, feat.TTL_TARGET, 'outcome_known_date')).lower()} AS forbidden, "
    f"{str(c in (*feat.TTL_IDS, *feat.TTL_FEATURES, feat.TTL_TARGET)).lower()} AS present, "
    f"{str(c in feat.TTL_FEATURES).lower()} AS candidate, "
    + (f"CAST(count({c}) AS DOUBLE)" if c in (*feat.TTL_IDS, *feat.TTL_FEATURES, feat.TTL_TARGET) else "max(CAST(NULL AS DOUBLE))")
    + " AS non_null FROM ttl" for c in _F05_NAMES) + ")"))
def f05(spark, sf):
    data = ttl(spark, sf)
    guard = feat.leakage_guard(data)
    present = [c for c in _F05_NAMES if c in data.columns]
    counts = data.agg(*[F.count(c).cast("double").alias(c) for c in present]).unpivot([], present, "column", "non_null")
    return guard.join(counts, "column", "left").select("column", "forbidden", "present", "candidate", "non_null")


def rooms(spark, sf):
    """Rooms to score: post_test primary listings carrying the previous week's market under the
    raw market names (occupancy, median_asking_rent, n_searchers, n_listings_open)."""
    t = tables(spark, sf)
    listings = feat.completed_primary(t["listings"])
    market = t["weekly_market"].select("project_id", (F.col("week") + 1).alias("week_listed"), "occupancy",
                                       "median_asking_rent", "n_searchers", "n_listings_open")
    return (listings.filter(F.col("date_listed") > F.lit(binding.TTL_TEST_END).cast("date"))
            .select("listing_id", "project_id", "week_listed", "date_listed", "first_asking_rent", "floor", "size_sqm",
                    "room_type", "view", "furnished", "project_name", "university", "distance_to_campus_m",
                    "facility_count", "season_listed")
            .join(market, ["project_id", "week_listed"], "left"))


ROOMS_SQL = f"""
rooms AS (SELECT l.*, m.occupancy, m.median_asking_rent, m.n_searchers, m.n_listings_open FROM listings l
  LEFT JOIN weekly_market m ON m.project_id = l.project_id AND m.week + 1 = l.week_listed
  WHERE NOT coalesce(ends_with(l.listing_id, '-B'), false) AND coalesce(l.leased, false) AND l.date_listed > DATE '{binding.TTL_TEST_END}')
"""


@query("f06", sql=ROOMS_SQL.strip() + """
SELECT listing_id, CAST(year(date_listed) AS INTEGER) AS listing_year, CAST(month(date_listed) AS INTEGER) AS listing_month, round(occupancy, 6) AS market_occupancy,
  round(CAST(n_searchers AS DOUBLE) / nullif(n_listings_open, 0), 6) AS market_demand_pressure,
  round(median_asking_rent, 6) AS market_median_asking_rent, round(first_asking_rent / nullif(median_asking_rent, 0), 6) AS rent_to_market_ratio,
  (occupancy IS NULL OR CAST(n_searchers AS DOUBLE) / nullif(n_listings_open, 0) IS NULL OR median_asking_rent IS NULL) AS missing_market_history,
  date_listed IS NOT NULL AS date_is_valid FROM rooms""")
def f06(spark, sf):
    out = feat.ttl_inference_input(rooms(spark, sf))
    return _round_floats(out.select("listing_id", "listing_year", "listing_month", "market_occupancy", "market_demand_pressure",
                                    "market_median_asking_rent", "rent_to_market_ratio", "missing_market_history",
                                    "date_is_valid"))


@query("f07", sql=f"""
SELECT lease_id, CAST(year(date_start) AS INTEGER) AS start_year, CAST(month(date_start) AS INTEGER) AS start_month, true AS date_is_valid
FROM leases WHERE date_start > DATE '{binding.PRICE_VALIDATION_END}'""")
def f07(spark, sf):
    le = tables(spark, sf)["leases"]
    test_rooms = le.filter(F.col("date_start") > F.lit(binding.PRICE_VALIDATION_END).cast("date")) \
        .withColumn("date_start", F.col("date_start").cast("string"))
    return feat.price_inference_input(test_rooms).select("lease_id", "start_year", "start_month", "date_is_valid")
