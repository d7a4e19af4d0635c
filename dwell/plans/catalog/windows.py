"""Window queries W01–W04."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwell.functions.nulls import differs
from dwell.operators import windows
from dwell.operators.ranking import average_ranks
from dwell.plans.catalog.common import EDA, _w, eda, ttl
from dwell.plans.registry import query, r6, tables


@query("w01", sql="""
SELECT listing_id, row_number() OVER (PARTITION BY unit_id, date_listed ORDER BY listing_id) > 1 AS is_duplicate
FROM listings""")
def w01(spark, sf):
    lst = tables(spark, sf)["listings"]
    return windows.duplicate_flag(lst, ["unit_id", "date_listed"], ["listing_id"]).select("listing_id", "is_duplicate")


@query("w02", sql="""
cal AS (SELECT DISTINCT week, date FROM weekly_market),
pw AS (SELECT week, count(*) AS n, min(date) AS date FROM cal GROUP BY week),
lg AS (SELECT week, date, n, lag(date) OVER (ORDER BY week) AS prev FROM pw),
checks AS (SELECT CAST(count(*) AS BIGINT) AS weeks, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS repeated_weeks,
  CAST(count(*) FILTER (WHERE prev IS NOT NULL AND date_diff('day', prev, date) <> 7) AS BIGINT) AS bad_gaps FROM lg),
mism AS (SELECT CAST(count(*) FILTER (WHERE coalesce(l.date_listed <> pw.date, true)) AS BIGINT) AS listing_date_mismatch
  FROM listings l LEFT JOIN pw ON pw.week = l.week_listed)
SELECT * FROM checks, mism""")
def w02(spark, sf):
    t = tables(spark, sf)
    checks = windows.calendar_checks(t["weekly_market"])
    cal = t["weekly_market"].groupBy("week").agg(F.min("date").alias("cal_date"))
    mism = (t["listings"].join(cal, F.col("week") == F.col("week_listed"), "left")
            .agg(F.count_if(differs("date_listed", "cal_date")).cast("long").alias("listing_date_mismatch")))
    return checks.select("*", mism.select("listing_date_mismatch").scalar().alias("listing_date_mismatch"))


@query("w03", sql=_w("""
SELECT DISTINCT data_split, weeks_on_market AS value, CAST(count(*) OVER (PARTITION BY data_split, weeks_on_market) AS BIGINT) AS n,
  round(rank() OVER (PARTITION BY data_split ORDER BY weeks_on_market)
        + (count(*) OVER (PARTITION BY data_split, weeks_on_market) - 1) / 2.0, 6) AS avg_rank
FROM ttl"""))
def w03(spark, sf):
    r = average_ranks(ttl(spark, sf).select("data_split", F.col("weeks_on_market").alias("value")), ["data_split"], "value")
    return r.select("data_split", "value", F.col("n").cast("long"), r6("avg_rank").alias("avg_rank"))


@query("w04", sql=_w("""
SELECT project_id, listing_id, weeks_on_market, date_listed FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY weeks_on_market, date_listed, listing_id) AS rn FROM ttl)
WHERE rn = 1"""))
def w04(spark, sf):
    base = ttl(spark, sf).select("project_id", "listing_id", "weeks_on_market", "date_listed")
    return windows.arg_min(base, ["project_id"], "weeks_on_market", ["date_listed", "listing_id"])
