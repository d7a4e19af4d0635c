"""Sort / top-k queries T01–T06 (T03 lives with the quality report)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwell.operators import ordering, stats
from dwell.operators.ranking import dense_index
from dwell.plans.catalog.aggregates import _spearman_sql
from dwell.plans.catalog.common import EDA, SPEARMAN_COLUMNS, _p, _w, eda, price_train, ttl
from dwell.plans.registry import query, r6


@query("t01", sql=_w("SELECT CAST(row_number() OVER (ORDER BY date_listed, listing_id) - 1 AS BIGINT) AS row_index, listing_id FROM ttl"))
def t01(spark, sf):
    return dense_index(ttl(spark, sf).select("date_listed", "listing_id"), ["date_listed", "listing_id"]) \
        .select("row_index", "listing_id")


@query("t02", sql=_w("""
SELECT listing_id, project_name, date_listed, round(first_asking_rent, 6) AS first_asking_rent, weeks_on_market
FROM eda ORDER BY weeks_on_market DESC, date_listed, listing_id LIMIT 10""", EDA))
def t02(spark, sf):
    top = ordering.top_k(eda(spark, sf), "weeks_on_market", 10, ["date_listed", "listing_id"])
    return top.select("listing_id", "project_name", "date_listed", r6("first_asking_rent").alias("first_asking_rent"),
                      "weeks_on_market")


@query("t04", sql=_w("""
SELECT col, corr FROM (""" + _spearman_sql(SPEARMAN_COLUMNS) + """) s
WHERE row = 'weeks_on_market' AND col <> 'weeks_on_market' AND corr IS NOT NULL
ORDER BY abs(corr) DESC, col LIMIT 5""", EDA))
def t04(spark, sf):
    pairs = [("weeks_on_market", c) for c in SPEARMAN_COLUMNS if c != "weeks_on_market"]
    rel = stats.spearman_pairs(eda(spark, sf), SPEARMAN_COLUMNS, pairs).select("col", r6("corr").alias("corr"))
    return ordering.top_abs(rel, "corr", 5, ["col"])


@query("t05", sql=_w("""
idx AS (SELECT listing_id, CAST(row_number() OVER (ORDER BY date_listed, listing_id) - 1 AS BIGINT) AS position,
        count(*) OVER () AS n FROM ttl)
SELECT listing_id, position, CASE WHEN position < 5 THEN 'head' WHEN position >= n - 6 THEN 'tail' ELSE 'middle' END AS part
FROM idx WHERE position < 5 OR position >= n - 6 OR position = n // 2"""))
def t05(spark, sf):
    return ordering.head_tail_middle(ttl(spark, sf).select("date_listed", "listing_id"), ["date_listed", "listing_id"]) \
        .select("listing_id", "position", "part")


@query("t06", sql=_p("""
dev AS (SELECT project_name, avg(rent) - (SELECT avg(rent) FROM price_train) AS deviation FROM price_train
        WHERE project_name IS NOT NULL GROUP BY project_name)
SELECT project_name, round(deviation, 6) AS deviation FROM (
  SELECT * FROM dev ORDER BY abs(deviation) DESC, project_name LIMIT 15)"""))
def t06(spark, sf):
    p = price_train(spark, sf)
    overall = p.select(F.avg("rent")).scalar()
    dev = p.filter(F.col("project_name").isNotNull()).groupBy("project_name") \
        .agg((F.avg("rent") - overall).alias("deviation"))
    return ordering.top_abs_resorted(dev, "deviation", 15, ["project_name"]) \
        .select("project_name", r6("deviation").alias("deviation"))
