"""Projection / predicate queries P01–P06 (P05 lives with the quality report)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwell.functions.nulls import all_null, all_present, any_null
from dwell.plans import features as feat
from dwell.plans.catalog.common import PRICE_CTE, _p, _w, ttl
from dwell.plans.registry import query, r6, tables
from dwell.sources.contracts import missing_columns


@query("p01", sql="""
SELECT t AS "table", CAST(n AS BIGINT) AS rows, CAST(r AS BIGINT) AS required, '' AS missing FROM (
  SELECT 'listings' AS t, (SELECT count(*) FROM listings) AS n, 19 AS r UNION ALL
  SELECT 'weekly_market', (SELECT count(*) FROM weekly_market), 7)""")
def p01(spark, sf):
    """Builder contracts of F02: required listing and market columns (missing ones listed in order)."""
    t = tables(spark, sf)
    parts = []
    for name, cols in (("listings", feat.TTL_LISTING_COLUMNS), ("weekly_market", feat.TTL_MARKET_COLUMNS)):
        df = t[name]
        parts.append(df.agg(F.count(F.lit(1)).cast("long").alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(len(cols)).cast("long").alias("required"),
            F.lit(", ".join(missing_columns(df, cols))).alias("missing")))
    return parts[0].unionByName(parts[1])


@query("p01_missing", sql="""
SELECT 'listings' AS "table", CAST(count(*) AS BIGINT) AS rows, 'unit_id, first_asking_rent' AS missing FROM listings UNION ALL
SELECT 'weekly_market', CAST(count(*) AS BIGINT), 'week, occupancy' FROM weekly_market""")
def p01_missing(spark, sf):
    """P01 on tables that lack columns: the missing ones in the required order, not in that of dropping."""
    t = tables(spark, sf)
    broken = {"listings": (feat.TTL_LISTING_COLUMNS, t["listings"].drop("first_asking_rent", "unit_id")),
              "weekly_market": (feat.TTL_MARKET_COLUMNS, t["weekly_market"].drop("occupancy", "week"))}
    parts = [df.agg(F.count(F.lit(1)).cast("long").alias("rows")).select(
        F.lit(name).alias("table"), "rows", F.lit(", ".join(missing_columns(df, cols))).alias("missing")) for name, (cols, df) in broken.items()]
    return parts[0].unionByName(parts[1])


@query("p02", sql="""
SELECT listing_id, CAST(weeks_on_market AS DOUBLE) AS weeks_on_market FROM listings
WHERE NOT coalesce(ends_with(listing_id, '-B'), false) AND coalesce(leased, false)""")
def p02(spark, sf):
    return feat.completed_primary(tables(spark, sf)["listings"]) \
        .select("listing_id", F.col("weeks_on_market").cast("double"))


def _rental_text_sql(c, kind):
    if kind == "boolean":
        return f"coalesce(CASE WHEN {c} THEN 'True' WHEN NOT {c} THEN 'False' END, 'nan') AS {c}"
    return f"coalesce(CAST({c} AS VARCHAR), 'nan') AS {c}"


@query("p03", sql=_p("SELECT " + ", ".join(
    _rental_text_sql(c, "boolean" if c in ("furnished", "is_renewal") else "text") if c in feat.PRICE_CATEGORICAL
    else (f"round({c}, 6) AS {c}" if c == "size_sqm" else c) for c in feat.PRICE_FEATURES) + " FROM price"))
def p03(spark, sf):
    df = feat.price_model_input(feat.price_dataset(tables(spark, sf)))
    return df.withColumn("size_sqm", r6("size_sqm"))


def _ttl_text_sql(c, kind):
    if kind == "boolean":
        return f"CASE WHEN {c} THEN 'True' WHEN NOT {c} THEN 'False' END AS {c}"
    return f"CAST({c} AS VARCHAR) AS {c}"


_FLOATS = {"size_sqm", "first_asking_rent", "market_occupancy", "market_demand_pressure", "market_median_asking_rent",
           "rent_to_market_ratio"}


@query("p04", sql=_w("SELECT listing_id, " + ", ".join(
    _ttl_text_sql(c, "boolean" if c in ("furnished", "missing_market_history") else "text") if c in feat.TTL_CATEGORICAL
    else (f"round({c}, 6) AS {c}" if c in _FLOATS else c) for c in feat.TTL_FEATURES)
    + ", CAST(weeks_on_market AS DOUBLE) AS weeks_on_market FROM ttl"))
def p04(spark, sf):
    df = feat.ttl_features_and_target(ttl(spark, sf), keep=("listing_id",))
    return df.select(*[r6(c).alias(c) if c in _FLOATS else F.col(c) for c in df.columns])


@query("p06", sql=_w("""
SELECT CAST(count(*) FILTER (WHERE market_occupancy IS NULL OR market_demand_pressure IS NULL OR market_median_asking_rent IS NULL) AS BIGINT) AS any_null,
  CAST(count(*) FILTER (WHERE market_occupancy IS NULL AND market_demand_pressure IS NULL AND market_median_asking_rent IS NULL) AS BIGINT) AS all_null,
  CAST(count(*) FILTER (WHERE market_occupancy IS NOT NULL AND market_demand_pressure IS NOT NULL AND market_median_asking_rent IS NOT NULL) AS BIGINT) AS all_present
FROM ttl"""))
def p06(spark, sf):
    cols = feat.TTL_MARKET_FEATURES
    return ttl(spark, sf).agg(F.count_if(any_null(cols)).cast("long").alias("any_null"),
                              F.count_if(all_null(cols)).cast("long").alias("all_null"),
                              F.count_if(all_present(cols)).cast("long").alias("all_present"))
