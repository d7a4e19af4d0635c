"""Scalar-function queries X01–X15 over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwell.functions import scalars as X
from dwell.plans.catalog.common import _w, ttl
from dwell.plans.catalog.quality import RAW_LISTINGS_SQL
from dwell.plans.registry import query, r6, tables
from dwell.sources import binding

# Deterministic text spellings of the leased flag, chosen by week_listed % 8 (exercise every
# accepted and rejected spelling on real rows).
SPELL_SQL = """
spelled AS (SELECT listing_id, CASE week_listed % 8
    WHEN 0 THEN CASE WHEN leased THEN 'true' ELSE 'false' END
    WHEN 1 THEN CASE WHEN leased THEN ' TRUE ' ELSE ' FALSE ' END
    WHEN 2 THEN CASE WHEN leased THEN '1' ELSE '0' END
    WHEN 3 THEN CASE WHEN leased THEN 'yes' ELSE 'no' END
    WHEN 4 THEN CASE WHEN leased THEN 'True' ELSE 'False' END
    WHEN 5 THEN NULL
    WHEN 6 THEN CASE WHEN leased THEN '1.0' ELSE '0.0' END
    ELSE 'maybe' END AS value FROM listings)
"""


def spelled(spark, sf):
    lst = tables(spark, sf)["listings"]
    k = F.col("week_listed") % 8
    lz = F.col("leased")

    def tf(a, b):
        return F.when(lz, a).otherwise(b)
    value = (F.when(k == 0, tf("true", "false")).when(k == 1, tf(" TRUE ", " FALSE ")).when(k == 2, tf("1", "0"))
             .when(k == 3, tf("yes", "no")).when(k == 4, tf("True", "False")).when(k == 5, F.lit(None))
             .when(k == 6, tf("1.0", "0.0")).otherwise("maybe"))
    return lst.select("listing_id", value.cast("string").alias("value"))


@query("x01", sql=SPELL_SQL.strip() + """
SELECT listing_id, value, CASE WHEN lower(trim(value)) IN ('true', '1') THEN true WHEN lower(trim(value)) IN ('false', '0') THEN false END AS parsed,
  coalesce(lower(trim(value)) NOT IN ('true', '1', 'false', '0'), true) AS is_invalid FROM spelled""")
def x01(spark, sf):
    parsed, invalid = X.strict_boolean("value", "string")
    return spelled(spark, sf).select("listing_id", "value", parsed.alias("parsed"), invalid.alias("is_invalid"))


@query("x02", sql=SPELL_SQL.strip() + """
SELECT listing_id, CASE WHEN lower(trim(value)) IN ('true', '1', 'yes') THEN true WHEN lower(trim(value)) IN ('false', '0', 'no') THEN false END AS parsed,
  coalesce(lower(trim(value)) IN ('true', '1', 'yes'), false) AS flag FROM spelled""")
def x02(spark, sf):
    return spelled(spark, sf).select("listing_id", X.lenient_boolean("value").alias("parsed"),
                                     X.lenient_flag("value").alias("flag"))


def raw(spark, sf):
    return binding.dirty_listings(tables(spark, sf)["listings"])


@query("x03", sql=RAW_LISTINGS_SQL.strip() + """
SELECT listing_id, TRY_CAST(date_listed AS DATE) AS parsed, TRY_CAST(date_listed AS DATE) IS NULL AS is_invalid FROM raw_listings""")
def x03(spark, sf):
    d = X.parse_date("date_listed")
    return raw(spark, sf).select("listing_id", d.alias("parsed"), d.isNull().alias("is_invalid"))


@query("x04", sql="""
SELECT listing_id, round(TRY_CAST(CASE WHEN week_listed % 5 = 0 THEN 'n/a' ELSE CAST(CAST(floor(asking_rent) AS BIGINT) AS VARCHAR) END AS DOUBLE), 6) AS parsed
FROM listings""")
def x04(spark, sf):
    lst = tables(spark, sf)["listings"]
    text = F.when(F.col("week_listed") % 5 == 0, "n/a").otherwise(F.floor("asking_rent").cast("long").cast("string"))
    return lst.select("listing_id", r6(X.parse_number(text)).alias("parsed"))


@query("x05", sql=RAW_LISTINGS_SQL.strip() + """
SELECT listing_id, regexp_full_match(date_listed, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS is_iso FROM raw_listings""")
def x05(spark, sf):
    return raw(spark, sf).select("listing_id", X.is_iso_date_text("date_listed").alias("is_iso"))


@query("x06", sql=RAW_LISTINGS_SQL.strip() + """
SELECT listing_id, room_type <> trim(room_type) AS untrimmed, view <> lower(view) AS not_lower FROM raw_listings""")
def x06(spark, sf):
    return raw(spark, sf).select("listing_id", X.untrimmed("room_type").alias("untrimmed"),
                                 X.not_lowercase("view").alias("not_lower"))


@query("x07", sql="""
SELECT listing_id, coalesce(ends_with(listing_id, '-B'), false) AS is_alternative,
  substr(listing_id, 1, length(listing_id) - 2) AS base_id FROM listings""")
def x07(spark, sf):
    return tables(spark, sf)["listings"].select("listing_id", X.is_alternative_id("listing_id").alias("is_alternative"),
                                                X.base_id("listing_id").alias("base_id"))


@query("x08", sql="""
SELECT listing_id, CAST(year(date_listed) AS INTEGER) AS year, CAST(month(date_listed) AS INTEGER) AS month,
  CAST(date_trunc('month', date_listed) AS DATE) AS month_start FROM listings""")
def x08(spark, sf):
    return tables(spark, sf)["listings"].select("listing_id", F.year("date_listed").alias("year"),
                                                F.month("date_listed").alias("month"),
                                                X.month_start("date_listed").alias("month_start"))


@query("x09", sql=f"SELECT listing_id, DATE '{binding.WEEK_ZERO}' + CAST(week_listed * 7 AS INTEGER) AS week_date FROM listings")
def x09(spark, sf):
    return tables(spark, sf)["listings"].select("listing_id", X.week_to_date("week_listed", binding.WEEK_ZERO).alias("week_date"))


@query("x10", sql="""
SELECT project_id, week, round(CAST(n_searchers AS DOUBLE) / nullif(n_listings_open - 1, 0), 6) AS safe,
  round(CAST(n_searchers AS DOUBLE) / CASE WHEN n_listings_open - 2 > 0 THEN n_listings_open - 2 END, 6) AS positive,
  round(CAST(n_searchers AS DOUBLE) / nullif(n_listings_open - 2, 0), 6) AS safe_shifted FROM weekly_market""")
def x10(spark, sf):
    m = tables(spark, sf)["weekly_market"]
    return m.select("project_id", "week", r6(X.safe_ratio("n_searchers", F.col("n_listings_open") - 1)).alias("safe"),
                    r6(X.positive_ratio("n_searchers", F.col("n_listings_open") - 2)).alias("positive"),
                    r6(X.safe_ratio("n_searchers", F.col("n_listings_open") - 2)).alias("safe_shifted"))


@query("x11", sql=_w("SELECT listing_id, round(ln(1 + weeks_on_market), 6) AS log1p_weeks FROM ttl"))
def x11(spark, sf):
    return ttl(spark, sf).select("listing_id", r6(X.log1p("weeks_on_market")).alias("log1p_weeks"))


@query("x12", sql=_w("""
SELECT listing_id, round(greatest((weeks_on_market - 10) / 4.0, 0.0), 6) AS clipped,
  CAST(round_even(greatest((weeks_on_market - 10) / 4.0, 0.0), 0) AS DOUBLE) AS weeks,
  CAST(round_even(greatest((weeks_on_market - 10) / 4.0, 0.0) * 7, 0) AS DOUBLE) AS days FROM ttl"""))
def x12(spark, sf):
    c = X.clip_zero((F.col("weeks_on_market") - 10) / 4.0)
    return ttl(spark, sf).select("listing_id", r6(c).alias("clipped"), X.round_half_even(c).cast("double").alias("weeks"),
                                 X.round_half_even(c * 7).cast("double").alias("days"))


@query("x13", sql="""
names AS (SELECT DISTINCT 'category__room_type_' || room_type AS name FROM units UNION SELECT DISTINCT 'category__view_' || view FROM units
          UNION SELECT 'number__size_sqm' FROM units)
SELECT name, regexp_replace(name, '^(category__|number__)', '') AS cleaned,
  replace(lower(regexp_replace(name, '^(category__|number__)', '')), ' ', '_') AS slug FROM names""")
def x13(spark, sf):
    u = tables(spark, sf)["units"]
    names = (u.select(F.concat(F.lit("category__room_type_"), "room_type").alias("name"))
             .union(u.select(F.concat(F.lit("category__view_"), "view").alias("name")))
             .union(u.select(F.lit("number__size_sqm").alias("name"))).distinct())
    cleaned = X.clean_encoded_name("name")
    return names.select("name", cleaned.alias("cleaned"), F.regexp_replace(F.lower(cleaned), " ", "_").alias("slug"))


@query("x14", sql="""
SELECT m.project_id, m.week, coalesce(abs(m.occupancy - CAST(m.n_units_leased AS DOUBLE) / p.total_units)
  <= 1e-8 + 1e-5 * abs(CAST(m.n_units_leased AS DOUBLE) / p.total_units), false) AS close
FROM weekly_market m LEFT JOIN projects p ON p.project_id = m.project_id""")
def x14(spark, sf):
    t = tables(spark, sf)
    from dwell.functions.nulls import not_close
    m = t["weekly_market"].join(t["projects"].select("project_id", "total_units"), "project_id", "left")
    return m.select("project_id", "week", (~not_close("occupancy", F.col("n_units_leased") / F.col("total_units"))).alias("close"))


@query("x15", sql=_w("""
SELECT t.listing_id, round(coalesce(t.market_occupancy, m.occupancy), 6) AS occupancy_resolved
FROM ttl t LEFT JOIN listings l ON l.listing_id = t.listing_id
LEFT JOIN weekly_market m ON m.project_id = l.project_id AND m.week = l.week_listed"""))
def x15(spark, sf):
    t = tables(spark, sf)
    current = t["weekly_market"].select("project_id", F.col("week").alias("week_listed"), "occupancy")
    base = ttl(spark, sf).select("listing_id", "market_occupancy").join(
        t["listings"].select("listing_id", "project_id", "week_listed"), "listing_id", "left") \
        .join(current, ["project_id", "week_listed"], "left")
    return base.select("listing_id", r6(X.resolve_alias(base.columns, "market_occupancy", "occupancy")).alias("occupancy_resolved"))
