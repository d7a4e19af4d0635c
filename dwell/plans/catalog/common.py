"""Shared datasets and oracle CTEs for the registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwell.plans import features as feat
from dwell.plans.registry import tables

TTL_CTE = """
ttl AS (
  SELECT l.listing_id, l.unit_id, l.project_id, l.date_listed,
    CASE WHEN l.date_listed <= DATE '1998-12-31' THEN 'train' WHEN l.date_listed <= DATE '1999-03-31' THEN 'validation'
         WHEN l.date_listed <= DATE '1999-06-30' THEN 'test' ELSE 'post_test' END AS data_split,
    l.floor, l.size_sqm, l.room_type, l.view, l.furnished, l.first_asking_rent, l.project_name, l.university,
    l.distance_to_campus_m, l.facility_count, l.season_listed,
    CAST(year(l.date_listed) AS INTEGER) AS listing_year, CAST(month(l.date_listed) AS INTEGER) AS listing_month,
    m.occupancy AS market_occupancy,
    CAST(m.n_searchers AS DOUBLE) / nullif(m.n_listings_open, 0) AS market_demand_pressure,
    m.median_asking_rent AS market_median_asking_rent,
    l.first_asking_rent / nullif(m.median_asking_rent, 0) AS rent_to_market_ratio,
    (m.occupancy IS NULL OR CAST(m.n_searchers AS DOUBLE) / nullif(m.n_listings_open, 0) IS NULL
      OR m.median_asking_rent IS NULL) AS missing_market_history,
    CAST(l.weeks_on_market AS DOUBLE) AS weeks_on_market, m.week AS market_history_week
  FROM listings l LEFT JOIN weekly_market m ON m.project_id = l.project_id AND m.week + 1 = l.week_listed
  WHERE NOT coalesce(ends_with(l.listing_id, '-B'), false) AND coalesce(l.leased, false))
"""


def ttl(spark, sf_dir, **kw):
    return feat.lease_time_dataset(tables(spark, sf_dir), **kw)


EDA = "eda AS (SELECT * FROM ttl WHERE data_split = 'train')"
PRICE_CTE = """
price AS (
  SELECT le.date_start, u.floor, u.size_sqm, u.room_type, u.view, u.furnished, le.lease_months, le.is_renewal,
    p.project_name, p.university, p.distance_to_campus_m, p.facility_count,
    CAST(year(le.date_start) AS INTEGER) AS start_year, CAST(month(le.date_start) AS INTEGER) AS start_month, le.rent,
    CASE WHEN le.date_start < DATE '2000-01-01' THEN 'train' WHEN le.date_start < DATE '2000-04-01' THEN 'validation'
         ELSE 'test' END AS split
  FROM leases le LEFT JOIN units u ON u.unit_id = le.unit_id LEFT JOIN projects p ON p.project_id = le.project_id),
price_train AS (SELECT * FROM price WHERE split = 'train')
"""
SPEARMAN_COLUMNS = ("weeks_on_market", "first_asking_rent", "rent_to_market_ratio", "size_sqm", "floor",
                    "distance_to_campus_m", "facility_count", "market_occupancy", "market_demand_pressure",
                    "market_median_asking_rent")
PEARSON_COLUMNS = ("rent", "floor", "size_sqm", "lease_months", "distance_to_campus_m", "facility_count")


def eda(spark, sf_dir):
    """Matured train split of F02, selected by a date predicate that reaches the scan."""
    from dwell.operators import splits
    from dwell.sources import binding
    return ttl(spark, sf_dir).filter(splits.matured_range("date_listed", "train", binding.TTL_TRAIN_END,
                                                          binding.TTL_VALIDATION_END, binding.TTL_TEST_END))


def price_split(spark, sf_dir):
    from dwell.operators import splits
    from dwell.sources import binding
    return splits.chronological_split(feat.price_dataset(tables(spark, sf_dir)), feat.PRICE_DATE,
                                      binding.PRICE_TRAIN_END, binding.PRICE_VALIDATION_END, validate=False)


def price_train(spark, sf_dir):
    """Chronological train split of F01, selected by a date predicate that reaches the scan."""
    from dwell.operators import splits
    from dwell.sources import binding
    return price_split(spark, sf_dir).filter(splits.chronological_range(
        "date_start", "train", binding.PRICE_TRAIN_END, binding.PRICE_VALIDATION_END))


def _join(parts, body: str) -> str:
    """CTE list + body; a body that starts with further CTEs (``name AS (...) SELECT``) is joined
    with a comma."""
    body = body.strip()
    sep = "\n" if body.upper().startswith("SELECT") else ",\n"
    return ",\n".join(p.strip() for p in parts) + sep + body


def _w(body: str, *ctes: str) -> str:
    return _join([TTL_CTE, *ctes], body)


def _p(body: str, *ctes: str) -> str:
    return _join([PRICE_CTE, *ctes], body)


def analysis(spark, sf_dir):
    """Primary listings (leased or not) with their matured split label."""
    from dwell.functions.scalars import is_alternative_id, lenient_flag
    from dwell.operators import splits
    from dwell.sources import binding
    lst = tables(spark, sf_dir)["listings"]
    return (lst.filter(~is_alternative_id("listing_id"))
            .withColumn("leased", lenient_flag("leased", dict(lst.dtypes)["leased"]))
            .withColumn("data_split", splits.matured_label(F.col("date_listed").cast("timestamp"),
                                                           binding.TTL_TRAIN_END, binding.TTL_VALIDATION_END,
                                                           binding.TTL_TEST_END)))


ANALYSIS_CTE = """
analysis AS (
  SELECT *, CASE WHEN date_listed <= DATE '1998-12-31' THEN 'train' WHEN date_listed <= DATE '1999-03-31' THEN 'validation'
         WHEN date_listed <= DATE '1999-06-30' THEN 'test' ELSE 'post_test' END AS data_split
  FROM listings WHERE NOT coalesce(ends_with(listing_id, '-B'), false))
"""

PRICE_SPLIT_SQL = PRICE_CTE


def _a(body: str, *ctes: str) -> str:
    return _join([ANALYSIS_CTE, *ctes], body)


def _wp(body: str, *ctes: str) -> str:
    """TTL + price CTEs together."""
    return _join([TTL_CTE, PRICE_CTE, *ctes], body)
