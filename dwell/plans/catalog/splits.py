"""Time-split queries K01–K07."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwell.operators import splits
from dwell.plans import features as feat
from dwell.plans.catalog.common import PRICE_CTE, _p, _w, price_split, price_train, ttl
from dwell.plans.registry import query, tables
from dwell.sources import binding

FOLDS_SQL = "folds AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', DATE '{a}', DATE '{b}', {i})" for i, (n, a, b) in enumerate(binding.PRICE_FOLDS)) + \
    ") f(fold, train_end, validation_end, ordinal))"
LONG_FOLDS_SQL = """
long_folds AS (
  SELECT f.fold, CASE WHEN p.date_start <= f.train_end THEN 'train' ELSE 'validation' END AS role, p.*
  FROM price_train p JOIN folds f ON p.date_start <= f.validation_end)
"""


@query("k01", sql=_p("""
SELECT split, CAST(count(*) AS BIGINT) AS rows, min(date_start) AS first_date, max(date_start) AS last_date FROM price GROUP BY split"""))
def k01(spark, sf):
    labelled = splits.chronological_split(feat.price_dataset(tables(spark, sf)), feat.PRICE_DATE, binding.PRICE_TRAIN_END, binding.PRICE_VALIDATION_END)
    return labelled.groupBy("split").agg(
        F.count(F.lit(1)).cast("long").alias("rows"), F.min("date_start").alias("first_date"),
        F.max("date_start").alias("last_date"))


@query("k02", sql=_w("""
SELECT data_split, CAST(count(*) AS BIGINT) AS rows, min(date_listed) AS first_date, max(date_listed) AS last_date FROM ttl GROUP BY data_split"""))
def k02(spark, sf):
    return ttl(spark, sf).groupBy("data_split").agg(
        F.count(F.lit(1)).cast("long").alias("rows"), F.min("date_listed").alias("first_date"),
        F.max("date_listed").alias("last_date"))


def long_folds(spark, sf):
    return splits.rolling_folds(price_train(spark, sf), feat.PRICE_DATE, binding.PRICE_FOLDS)


@query("k03", sql=_p("""
SELECT fold, role, CAST(count(*) AS BIGINT) AS rows, min(date_start) AS first_date, max(date_start) AS last_date,
  round(sum(rent), 4) AS rent_sum FROM long_folds GROUP BY fold, role""", FOLDS_SQL, LONG_FOLDS_SQL))
def k03(spark, sf):
    return long_folds(spark, sf).groupBy("fold", "role").agg(
        F.count(F.lit(1)).cast("long").alias("rows"), F.min("date_start").alias("first_date"),
        F.max("date_start").alias("last_date"), F.round(F.sum("rent"), 4).alias("rent_sum"))


K04_SQL = _p("""
SELECT f.fold, CAST(f.train_end AS VARCHAR) AS train_end, CAST(f.validation_end AS VARCHAR) AS validation_end,
  CAST(count(*) FILTER (WHERE l.role = 'train') AS BIGINT) AS train_rows,
  CAST(count(*) FILTER (WHERE l.role = 'validation') AS BIGINT) AS validation_rows
FROM folds f LEFT JOIN long_folds l ON l.fold = f.fold GROUP BY f.fold, f.train_end, f.validation_end""", FOLDS_SQL, LONG_FOLDS_SQL)


@query("k04", sql=K04_SQL)
def k04(spark, sf):
    return splits.fold_summary(long_folds(spark, sf), binding.PRICE_FOLDS).drop("ordinal")


@query("k05", sql=_w("""
SELECT d.dataset, d.split, CAST(coalesce(c.n, 0) AS BIGINT) AS rows, coalesce(c.n, 0) > 0 AS non_empty FROM
(VALUES ('price', 'train'), ('price', 'validation'), ('price', 'test'), ('time_to_lease', 'train'), ('time_to_lease', 'validation'),
        ('time_to_lease', 'test')) d(dataset, split)
LEFT JOIN (SELECT 'price' AS dataset, split, count(*) AS n FROM price GROUP BY split UNION ALL
           SELECT 'time_to_lease', data_split, count(*) FROM ttl GROUP BY data_split) c ON c.dataset = d.dataset AND c.split = d.split""",
                    PRICE_CTE))
def k05(spark, sf):
    wanted = [("price", s) for s in ("train", "validation", "test")] + [("time_to_lease", s) for s in ("train", "validation", "test")]
    counts = (price_split(spark, sf).groupBy(F.lit("price").alias("dataset"), "split").count()
              .unionByName(ttl(spark, sf).groupBy(F.lit("time_to_lease").alias("dataset"),
                                                  F.col("data_split").alias("split")).count()))
    names = spark.createDataFrame(wanted, "dataset string, split string")
    return (F.broadcast(names).join(counts, ["dataset", "split"], "left")
            .select("dataset", "split", F.coalesce("count", F.lit(0)).cast("long").alias("rows"),
                    (F.coalesce("count", F.lit(0)) > 0).alias("non_empty")))


@query("k06", sql=f"""
SELECT CAST(max(date) + 7 AS DATE) AS observation_end,
  CAST(floor(date_diff('day', DATE '{binding.TTL_TEST_END}', CAST(max(date) + 7 AS DATE)) / 7) AS BIGINT) AS follow_up_weeks
FROM weekly_market""")
def k06(spark, sf):
    m = tables(spark, sf)["weekly_market"]
    obs = splits.observation_end(m)
    return m.agg(obs.alias("observation_end")).select(
        "observation_end", splits.follow_up_weeks(F.col("observation_end"), binding.TTL_TEST_END).alias("follow_up_weeks"))


@query("k07", sql="""
SELECT l.listing_id, CAST(c.d + 7 AS DATE) AS outcome_known_date FROM listings l
LEFT JOIN (SELECT week, min(date) AS d FROM weekly_market GROUP BY week) c ON c.week = l.week_leased
WHERE NOT coalesce(ends_with(l.listing_id, '-B'), false) AND coalesce(l.leased, false)""")
def k07(spark, sf):
    t = tables(spark, sf)
    calendar = t["weekly_market"].groupBy("week").agg(F.min("date").alias("week_date"))
    done = feat.completed_primary(t["listings"]).select("listing_id", "week_leased")
    j = done.join(calendar, F.col("week") == F.col("week_leased"), "left")
    return j.select("listing_id", F.date_add("week_date", 7).alias("outcome_known_date"))
