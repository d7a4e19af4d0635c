"""Set-operation queries U01–U04."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwell.operators import sets
from dwell.plans.catalog.common import _p, price_split, ttl
from dwell.plans.registry import query, r6, tables


from dwell.plans.catalog.common import _w  # noqa: E402


@query("u01", sql=_w("SELECT listing_id, data_split, weeks_on_market FROM ttl WHERE data_split IN ('train', 'validation')"))
def u01(spark, sf):
    return sets.union_splits(ttl(spark, sf), "data_split", ["train", "validation"]) \
        .select("listing_id", "data_split", "weeks_on_market")


MEAN_MODELS_SQL = """
fit_all AS (SELECT avg(rent) AS m FROM price_train),
fit_room AS (SELECT room_type, avg(rent) AS m FROM price_train GROUP BY room_type),
test AS (SELECT t.*, (SELECT m FROM fit_all) AS global_mean, r.m AS room_type_mean
         FROM price t LEFT JOIN fit_room r ON r.room_type IS NOT DISTINCT FROM t.room_type WHERE t.split = 'test')
"""


def mean_models(spark, sf):
    """Two closed-form reference predictors fitted on the price train split: the global mean and
    the room-type mean (= OLS on an intercept / on one categorical)."""
    p = price_split(spark, sf)
    train = p.filter(F.col("split") == "train")
    overall = train.select(F.avg("rent")).scalar()
    by_room = train.groupBy("room_type").agg(F.avg("rent").alias("room_type_mean"))
    test = p.filter(F.col("split") == "test")
    return test.join(by_room, test["room_type"].eqNullSafe(by_room["room_type"]), "left") \
        .drop(by_room["room_type"]).withColumn("global_mean", overall)


@query("u02", sql=_p("""
SELECT model, round(rent - prediction, 6) AS residual FROM (
  SELECT rent, 'global_mean' AS model, global_mean AS prediction FROM test UNION ALL
  SELECT rent, 'room_type_mean' AS model, room_type_mean AS prediction FROM test)""", MEAN_MODELS_SQL))
def u02(spark, sf):
    wide = mean_models(spark, sf)
    long = sets.wide_to_long(wide, ["rent"], ["global_mean", "room_type_mean"], "model", "prediction")
    return long.select("model", r6(F.col("rent") - F.col("prediction")).alias("residual"))


@query("u03", sql="SELECT DISTINCT project_id FROM projects WHERE project_id NOT IN (SELECT project_id FROM listings WHERE project_id IS NOT NULL)")
def u03(spark, sf):
    t = tables(spark, sf)
    return sets.never_in(t["projects"], t["listings"], "project_id")


@query("u04", sql="SELECT DISTINCT week_listed, date_listed FROM listings")
def u04(spark, sf):
    return sets.distinct_rows(tables(spark, sf)["listings"], ["week_listed", "date_listed"])
