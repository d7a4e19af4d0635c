"""Model queries M01–M27, S07 and A18.

Oracles use closed forms (SURVEY §7.3): OLS on one categorical predicts the group mean, OLS on one
numeric is ``regr_slope`` / ``regr_intercept``, one-hot rows are indicator counts. Tree ensembles,
selection and tuning have full sizes and rows-only checks. Their twins run the same code where a closed
form exists: trees that tell all groups of one categorical apart predict group means (``_closed``), n of
them at a rate predict ``mean + (1 - (1 - rate)^n) * (group mean - mean)`` (``_rate``), the first round of
selection is the best of one-feature fits (``_first``), a stump takes the largest drop of squared error
(``_stump``). Tuning queries run ``BOOSTING_GRID``, all twelve sets.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from dwell.functions.scalars import clean_encoded_name
from dwell.ml import encode, forward
from dwell.ml import metrics as M
from dwell.ml import models as ML
from dwell.ml import runs
from dwell.operators import splits
from dwell.plans import features as feat
from dwell.plans.catalog.common import EDA, _p, _w, _wp, eda, price_split, ttl
from dwell.plans.catalog.features import ROOMS_SQL, rooms
from dwell.plans.catalog.sets import MEAN_MODELS_SQL, mean_models
from dwell.plans.registry import query, r6, tables
from dwell.sources import binding, io

NOISE = 9            # decimals the queries keep before half-even rounding: solver noise, as in the oracles


def price_xy(spark, sf):
    """P03/P04 rental input with split label and date kept."""
    return feat.price_features_and_target(price_split(spark, sf), keep=("split", "date_start"))


def price_part(spark, sf, *names):
    """The named splits, as date ranges that reach the scan."""
    ranges = [splits.chronological_range(feat.PRICE_DATE, n, binding.PRICE_TRAIN_END, binding.PRICE_VALIDATION_END) for n in names]
    return price_xy(spark, sf).filter(reduce(or_, ranges))


def ttl_xy(spark, sf):
    return feat.ttl_features_and_target(ttl(spark, sf), keep=("listing_id", "data_split", "date_listed"))


def ttl_train(spark, sf):
    return ttl_xy(spark, sf).filter(splits.matured_range(feat.TTL_DATE, "train", binding.TTL_TRAIN_END,
                                                         binding.TTL_VALIDATION_END, binding.TTL_TEST_END))


def price_folds(spark, sf, n=len(binding.PRICE_FOLDS)):
    """Folds of the price train split, as slices of one table."""
    return splits.sliced_folds(price_part(spark, sf, "train"), feat.PRICE_DATE, binding.PRICE_FOLDS[:n])


def _rows(spark, records, ddl):
    return spark.createDataFrame(records, ddl)


# ------------------------------------------------------------------------------ M01 / M02
@query("m01", sql=_w(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median FROM eda" for c in feat.TTL_NUMERIC), EDA))
def m01(spark, sf):
    med = encode.exact_medians(ttl_train(spark, sf), feat.TTL_NUMERIC)
    return _rows(spark, [(k, None if v is None else round(float(v), 6)) for k, v in med.items()],
                 "feature string, median double")


def _ttl_text(c):
    if c in ("furnished", "missing_market_history"):
        return f"CASE WHEN {c} THEN 'True' WHEN NOT {c} THEN 'False' END"
    return f"CAST({c} AS VARCHAR)"


@query("m02", sql=_w(" UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS feature, {_ttl_text(c)} AS mode FROM eda WHERE {c} IS NOT NULL GROUP BY 2 "
    f"ORDER BY count(*) DESC, 2 LIMIT 1)" for c in feat.TTL_CATEGORICAL), EDA))
def m02(spark, sf):
    mod = encode.modes(ttl_train(spark, sf), feat.TTL_CATEGORICAL)
    return _rows(spark, list(mod.items()), "feature string, mode string")


# ------------------------------------------------------------------------------ M03–M06
def _rental_text(c):
    if c in ("furnished", "is_renewal"):
        return f"coalesce(CASE WHEN {c} THEN 'True' WHEN NOT {c} THEN 'False' END, 'nan')"
    return f"coalesce(CAST({c} AS VARCHAR), 'nan')"


PRICE_CAT_COUNTS = "cat_counts AS (" + " UNION ALL ".join(
    f"SELECT {i} AS ord, '{c}' AS feature, {_rental_text(c)} AS value, count(*) AS n FROM price_train GROUP BY 3"
    for i, c in enumerate(feat.PRICE_CATEGORICAL)) + ")"
PRICE_CAT_RANKED = ("cat_ranked AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value) AS r, "
                    "count(*) OVER (PARTITION BY feature) AS k FROM cat_counts)")
PRICE_TRAIN_CTE = "price_train AS (SELECT * FROM price WHERE split = 'train')"


def _indicator_counts(spark, sf, drop_first):
    train = price_part(spark, sf, "train")
    enc = encode.fit_preprocessor(train, feat.PRICE_CATEGORICAL, feat.PRICE_NUMERIC, drop_first)
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer
    # one vector-sum aggregate (JVM side, map-side partial sums) over the encoded rows
    total = enc.transform(train).select(Summarizer.sum(F.col(enc.features_col)).alias("s"))
    sums = total.select(F.posexplode(vector_to_array("s")).alias("pos", "ones"))
    names = _rows(spark, [(i, n) for i, n in enumerate(enc.names) if n.startswith("category__")], "pos int, name string")
    return names.join(sums, "pos").select("name", F.col("ones").cast("long").alias("ones"))


@query("m03", sql=_p("SELECT 'category__' || feature || '_' || value AS name, CAST(n AS BIGINT) AS ones FROM cat_ranked WHERE r > 1",
                     PRICE_CAT_COUNTS, PRICE_CAT_RANKED))
def m03(spark, sf):
    return _indicator_counts(spark, sf, True)


@query("m04", sql=_p("SELECT 'category__' || feature || '_' || value AS name, CAST(n AS BIGINT) AS ones FROM cat_ranked",
                     PRICE_CAT_COUNTS, PRICE_CAT_RANKED))
def m04(spark, sf):
    return _indicator_counts(spark, sf, False)


NUMERIC_NAMES = "nums AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{c}')" for i, c in enumerate(feat.PRICE_NUMERIC)) + ") v(ord, feature))"


@query("m05", sql=_p("""
cats AS (SELECT CAST(row_number() OVER (ORDER BY ord, value) - 1 AS BIGINT) AS position,
                'category__' || feature || '_' || value AS name FROM cat_ranked WHERE r > 1)
SELECT position, name FROM cats UNION ALL
SELECT CAST((SELECT count(*) FROM cats) + ord AS BIGINT), 'number__' || feature FROM nums""",
                     PRICE_CAT_COUNTS, PRICE_CAT_RANKED, NUMERIC_NAMES))
def m05(spark, sf):
    enc = encode.fit_preprocessor(price_part(spark, sf, "train"), feat.PRICE_CATEGORICAL, feat.PRICE_NUMERIC, True)
    return _rows(spark, list(enumerate(enc.names)), "position bigint, name string")


@query("m06", sql=_p("""
sizes AS (SELECT ord, feature, max(k) - 1 AS size FROM cat_ranked GROUP BY ord, feature HAVING max(k) > 1),
cats AS (SELECT feature, CAST(coalesce(sum(size) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first,
         CAST(size AS BIGINT) AS size FROM sizes)
SELECT feature, first, size FROM cats UNION ALL
SELECT feature, CAST((SELECT sum(size) FROM sizes) + ord AS BIGINT), CAST(1 AS BIGINT) FROM nums""",
                     PRICE_CAT_COUNTS, PRICE_CAT_RANKED, NUMERIC_NAMES))
def m06(spark, sf):
    enc = encode.fit_preprocessor(price_part(spark, sf, "train"), feat.PRICE_CATEGORICAL, feat.PRICE_NUMERIC, True)
    return _rows(spark, encode.layout(enc), "feature string, first bigint, size bigint")


# ------------------------------------------------------------------------------ M07 OLS
GROUP_MEAN_SQL = "SELECT {c} AS {c}, round(avg(rent), 2) AS prediction FROM price_train GROUP BY {c}"


@query("m07", sql=_p(GROUP_MEAN_SQL.format(c="room_type")))
def m07(spark, sf):
    train = price_part(spark, sf, "train")
    model = ML.fit_linear(train, ["room_type"], [], "rent")
    groups = train.select("room_type").distinct()
    return model.predict(groups, keep=["room_type"]).select("room_type", F.round("prediction", 2).alias("prediction"))


# ------------------------------------------------------------------------------ M08 / M09 trees (rows-only)
@query("m08")
def m08(spark, sf):
    data = ttl_xy(spark, sf)
    model = ML.fit_forest(data.filter(F.col("data_split") == "train"), feat.TTL_CATEGORICAL, feat.TTL_NUMERIC,
                          feat.TTL_TARGET, order=["listing_id"])
    long = runs.scored_long(model, data.filter(F.col("data_split") == "validation"), "forest", "validation", feat.TTL_TARGET)
    return M.ttl_metrics(long)


@query("m09")
def m09(spark, sf):
    model = ML.fit_boosting(price_part(spark, sf, "train"), feat.PRICE_CATEGORICAL, feat.PRICE_NUMERIC, "rent")
    long = runs.scored_long(model, price_part(spark, sf, "validation"), "boosting", "validation", "rent")
    return M.regression_metrics(long, ["model", "split"])


# ------------------------------------------------------------------------------ M10 / M11 selection (rows-only)
HISTORY_DDL = ("step bigint, added_feature string, mean_rolling_mae double, std_rolling_mae double, "
               "mae_improvement double")


def _history_frame(spark, history, n_folds):
    ddl = HISTORY_DDL + "".join(f", fold_{i}_mae double" for i in range(1, n_folds + 1))
    cols = ["step", "added_feature", "mean_rolling_mae", "std_rolling_mae", "mae_improvement",
            *[f"fold_{i}_mae" for i in range(1, n_folds + 1)]]
    return spark.createDataFrame([tuple(h[c] for c in cols) for h in history], ddl)


@query("m10")
def m10(spark, sf):
    folds = price_folds(spark, sf)
    _, history = forward.forward_select(folds, feat.PRICE_CATEGORICAL, feat.PRICE_NUMERIC, "rent", candidates=feat.PRICE_FEATURES)
    return _history_frame(spark, history, len(folds.names))


@query("m11")
def m11(spark, sf):
    _, history = forward.forward_select(price_folds(spark, sf, 1), feat.PRICE_CATEGORICAL, feat.PRICE_NUMERIC, "rent",
                                        candidates=feat.PRICE_FEATURES)
    return _history_frame(spark, history, 1)


# ------------------------------------------------------------------------------ M12 / M13 tuning (rows-only)
def _tuning_frame(spark, rows):
    cols = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(float(r.get(c)) if r.get(c) is not None else None for c in cols) for r in rows],
                                 ", ".join(f"{c} double" for c in cols))


@query("m12")
def m12(spark, sf):
    row, = runs.tuning_table(price_folds(spark, sf), feat.PRICE_CATEGORICAL, feat.PRICE_NUMERIC, "rent", grid=[ML.BOOSTING_DEFAULTS])
    return _tuning_frame(spark, [row])


@query("m13")
def m13(spark, sf):
    best, rows = runs.tune_boosting(price_folds(spark, sf), feat.PRICE_CATEGORICAL, feat.PRICE_NUMERIC, "rent", grid=runs.BOOSTING_GRID)
    return _tuning_frame(spark, rows).withColumn("chosen", F.col("set_number") == float(best["set_number"]))


# ------------------------------------------------------------------------------ closed forms of M08–M13
ONE_TREE = {"n_estimators": 1, "learning_rate": 1.0, "max_depth": 4, "min_samples_leaf": 1, "subsample": 1.0, "random_state": 42}
ONE_FOREST_TREE = {"n_estimators": 1, "max_depth": 4, "min_samples_leaf": 1, "max_features": 1.0, "random_state": 42, "bootstrap": False}
FOLD_MEANS_SQL = ("folds AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, DATE '{tr}', DATE '{va}')" for i, (_, tr, va) in enumerate(binding.PRICE_FOLDS, 1)) + """) v(i, train_end, validation_end)),
fold_fit AS (SELECT i, room_type, avg(rent) AS m FROM price_train JOIN folds ON date_start <= train_end GROUP BY i, room_type),
fold_mae AS (SELECT f.i, avg(CASE WHEN p.date_start <= f.train_end THEN abs(p.rent - m.m) END) AS train_mae,
                    avg(CASE WHEN p.date_start > f.train_end THEN abs(p.rent - m.m) END) AS mae
             FROM price_train p JOIN folds f ON p.date_start <= f.validation_end
             JOIN fold_fit m ON m.i = f.i AND m.room_type = p.room_type GROUP BY f.i)""")


@query("m08_closed", sql=_w("""
fit AS (SELECT season_listed, avg(weeks_on_market) AS m FROM ttl WHERE data_split = 'train' GROUP BY season_listed)
SELECT t.season_listed, CAST(count(*) AS BIGINT) AS rows, round(avg(f.m), 6) AS prediction
FROM ttl t JOIN fit f ON f.season_listed = t.season_listed WHERE t.data_split = 'validation' GROUP BY t.season_listed"""))
def m08_closed(spark, sf):
    """M08 with one unbootstrapped tree on one categorical: group means."""
    data = ttl_xy(spark, sf)
    model = ML.fit_forest(ttl_train(spark, sf), ["season_listed"], [], feat.TTL_TARGET, ONE_FOREST_TREE, order=["listing_id"])
    scored = model.predict(data.filter(F.col("data_split") == "validation"), keep=["season_listed"])
    return scored.groupBy("season_listed").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("prediction"), 6).alias("prediction"))


@query("m09_closed", sql=_p("""
SELECT v.room_type, CAST(count(*) AS BIGINT) AS rows, round(avg(f.m), 4) AS prediction FROM price v
JOIN (SELECT room_type, avg(rent) AS m FROM price_train GROUP BY room_type) f ON f.room_type = v.room_type
WHERE v.split = 'validation' GROUP BY v.room_type"""))
def m09_closed(spark, sf):
    """M09 with one tree at rate 1 on one categorical: group means."""
    model = ML.fit_boosting(price_part(spark, sf, "train"), ["room_type"], [], "rent", ONE_TREE)
    scored = model.predict(price_part(spark, sf, "validation"), keep=["room_type"])
    return scored.groupBy("room_type").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("prediction"), 4).alias("prediction"))


SELECTED_SQL = "SELECT CAST(1 AS BIGINT) AS step, 'room_type' AS added_feature, round(avg(mae), 4) AS mean_rolling_mae, round(stddev_pop(mae), 4) AS std_rolling_mae FROM fold_mae"


def _selected(spark, history):
    return _rows(spark, [(h["step"], h["added_feature"], round(h["mean_rolling_mae"], 4), round(h["std_rolling_mae"], 4)) for h in history],
                 "step bigint, added_feature string, mean_rolling_mae double, std_rolling_mae double")


@query("m10_closed", sql=_p(SELECTED_SQL, FOLD_MEANS_SQL))
def m10_closed(spark, sf):
    """M10 with one categorical candidate: errors of the folds' group means."""
    return _selected(spark, forward.forward_select(price_folds(spark, sf), ["room_type"], [], "rent")[1])


@query("m11_closed", sql=_p(SELECTED_SQL + " WHERE i = 1", FOLD_MEANS_SQL))
def m11_closed(spark, sf):
    return _selected(spark, forward.forward_select(price_folds(spark, sf, 1), ["room_type"], [], "rent")[1])


def _tuned_sql(sets):
    return " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS set_number, round(avg(train_mae), 4) AS mean_train_mae, round(avg(mae), 4) "
                              "AS mean_validation_mae, round(stddev_pop(mae), 4) AS std_validation_mae FROM fold_mae" for i in range(1, sets + 1))


def _tuned(spark, sf, grid):
    rows = runs.tuning_table(price_folds(spark, sf), ["room_type"], [], "rent", grid=grid)
    cols = ("mean_train_mae", "mean_validation_mae", "std_validation_mae")
    return _rows(spark, [(r["set_number"], *[round(r[c], 4) for c in cols]) for r in rows],
                 "set_number bigint, " + ", ".join(f"{c} double" for c in cols))


@query("m12_closed", sql=_p(_tuned_sql(1), FOLD_MEANS_SQL))
def m12_closed(spark, sf):
    """M12 with one tree on one categorical: errors of the folds' group means."""
    return _tuned(spark, sf, [ONE_TREE])


@query("m13_closed", sql=_p(_tuned_sql(2), FOLD_MEANS_SQL))
def m13_closed(spark, sf):
    return _tuned(spark, sf, [ONE_TREE, {**ONE_TREE, "max_depth": 3}])


# ------------------------------------------------------------------------------ M09, M12, M13 at their own rates
#: depth 4 and one row a leaf tell all groups of one categorical apart; trees and rates are those of the models
def _separating(params):
    return {**params, "max_depth": 4, "min_samples_leaf": 1, "subsample": 1.0}


def _shrunk(n, rate, group="g.m", mean="a.m"):
    return f"({mean} + (1 - power(1 - {rate}, {n})) * ({group} - {mean}))"


@query("m09_rate", sql=_p(f"""
a AS (SELECT avg(rent) AS m FROM price_train), g AS (SELECT room_type, avg(rent) AS m FROM price_train GROUP BY room_type)
SELECT v.room_type, CAST(count(*) AS BIGINT) AS rows,
  round(avg({_shrunk(ML.BOOSTING_DEFAULTS["n_estimators"], ML.BOOSTING_DEFAULTS["learning_rate"])}), 4) AS prediction,
  round(avg({_shrunk(3, 0.1)}), 4) AS after_3_trees
FROM price v JOIN g ON g.room_type = v.room_type CROSS JOIN a WHERE v.split = 'validation' GROUP BY v.room_type"""))
def m09_rate(spark, sf):
    """M09 with its 250 trees at rate 0.05, and with 3 trees at 0.1."""
    train, valid = price_part(spark, sf, "train"), price_part(spark, sf, "validation")
    full, three = (ML.fit_boosting(train, ["room_type"], [], "rent", _separating(p)) for p in (
        ML.BOOSTING_DEFAULTS, {**ML.BOOSTING_DEFAULTS, "n_estimators": 3, "learning_rate": 0.1}))
    scored = three.predict(full.predict(valid, keep=["room_type"]).withColumnRenamed("prediction", "long"), keep=["room_type", "long"])
    return scored.groupBy("room_type").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("long"), 4).alias("prediction"),
                                           F.round(F.avg("prediction"), 4).alias("after_3_trees"))


def _rate_sql(grid):
    """Errors of shrunk group means of every set on every fold, then the table of sets."""
    sets = ", ".join(f"({i}, {p['n_estimators']}, {p['learning_rate']})" for i, p in enumerate(grid, 1))
    return f"""folds AS (SELECT * FROM (VALUES {", ".join(f"({i}, DATE '{tr}', DATE '{va}')" for i, (_, tr, va) in enumerate(binding.PRICE_FOLDS, 1))}) v(i, train_end, validation_end)),
sets AS (SELECT * FROM (VALUES {sets}) v(set_number, n, rate)),
a AS (SELECT i, avg(rent) AS m FROM price_train JOIN folds ON date_start <= train_end GROUP BY i),
g AS (SELECT i, room_type, avg(rent) AS m FROM price_train JOIN folds ON date_start <= train_end GROUP BY i, room_type),
errors AS (SELECT s.set_number, f.i, p.date_start <= f.train_end AS fitted, p.rent, p.rent - {_shrunk("s.n", "s.rate")} AS e
           FROM price_train p JOIN folds f ON p.date_start <= f.validation_end JOIN a ON a.i = f.i
           JOIN g ON g.i = f.i AND g.room_type = p.room_type CROSS JOIN sets s),
each AS (SELECT set_number, i, avg(abs(e)) FILTER (fitted) AS train_mae, avg(abs(e)) FILTER (NOT fitted) AS mae,
                sqrt(avg(e * e) FILTER (NOT fitted)) AS rmse,
                1 - (sum(e * e) FILTER (NOT fitted)) / ((var_pop(rent) FILTER (NOT fitted)) * (count(*) FILTER (NOT fitted))) AS r2
         FROM errors GROUP BY set_number, i),
tuned AS (SELECT CAST(set_number AS BIGINT) AS set_number, avg(train_mae) AS train_mae, avg(mae) AS mae, stddev_pop(mae) AS std, avg(rmse) AS rmse, avg(r2) AS r2
          FROM each GROUP BY set_number),
best AS (SELECT set_number FROM tuned ORDER BY mae, std, set_number LIMIT 1)"""


RATE_COLUMNS_SQL = """SELECT set_number, round(train_mae, 4) AS mean_train_mae, round(mae, 4) AS mean_validation_mae, round(std, 4) AS std_validation_mae,
  round(rmse, 4) AS mean_validation_rmse, round(r2, 6) AS mean_validation_r2"""


def _rate_rows(spark, rows, *more):
    digits = {"mean_train_mae": 4, "mean_validation_mae": 4, "std_validation_mae": 4, "mean_validation_rmse": 4, "mean_validation_r2": 6}
    ddl = "set_number bigint, " + ", ".join(f"{c} double" for c in digits) + "".join(f", {m}" for m in more)
    return [(r["set_number"], *[round(r[c], d) for c, d in digits.items()]) for r in rows], ddl


@query("m12_rate", sql=_p(RATE_COLUMNS_SQL + " FROM tuned", _rate_sql([ML.BOOSTING_DEFAULTS])))
def m12_rate(spark, sf):
    """M12 with 250 trees at rate 0.05 on one categorical."""
    rows = runs.tuning_table(price_folds(spark, sf), ["room_type"], [], "rent", [_separating(ML.BOOSTING_DEFAULTS)])
    return _rows(spark, *_rate_rows(spark, rows))


@query("m13_rate", sql=_p(RATE_COLUMNS_SQL + ", set_number = (SELECT set_number FROM best) AS chosen FROM tuned", _rate_sql(runs.BOOSTING_GRID)))
def m13_rate(spark, sf):
    """M13 with the trees and rates of all twelve sets on one categorical, and the set that is chosen."""
    best, rows = runs.tune_boosting(price_folds(spark, sf), ["room_type"], [], "rent", [_separating(p) for p in runs.BOOSTING_GRID])
    records, ddl = _rate_rows(spark, rows, "chosen boolean")
    return _rows(spark, [(*r, r[0] == best["set_number"]) for r in records], ddl)


# ------------------------------------------------------------------------------ M10, M11: the first round
def _first_sql(n_folds):
    """The best one-feature fit: group means (an unseen category counts as the first one) or a line."""
    folds = ", ".join(f"({i}, DATE '{tr}', DATE '{va}')" for i, (_, tr, va) in enumerate(binding.PRICE_FOLDS[:n_folds], 1))
    fits = [f"""SELECT {feat.PRICE_FEATURES.index(c)} AS ord, '{c}' AS feature, f.i, avg(abs(p.rent - coalesce(g.m, first.m))) AS mae
        FROM price_train p JOIN folds f ON p.date_start > f.train_end AND p.date_start <= f.validation_end
        LEFT JOIN (SELECT i, {_rental_text(c)} AS v, avg(rent) AS m FROM price_train JOIN folds ON date_start <= train_end GROUP BY 1, 2) g
          ON g.i = f.i AND g.v = {_rental_text(c).replace(c, "p." + c) if c not in ("furnished", "is_renewal") else _rental_text(c)}
        JOIN (SELECT i, arg_min(m, v) AS m FROM (SELECT i, {_rental_text(c)} AS v, avg(rent) AS m FROM price_train JOIN folds ON date_start <= train_end
              GROUP BY 1, 2) GROUP BY i) first ON first.i = f.i GROUP BY f.i""" for c in feat.PRICE_CATEGORICAL]
    fits += [f"""SELECT {feat.PRICE_FEATURES.index(c)}, '{c}', f.i, avg(abs(p.rent - (l.b + l.s * p.{c})))
        FROM price_train p JOIN folds f ON p.date_start > f.train_end AND p.date_start <= f.validation_end
        JOIN (SELECT i, regr_slope(rent, {c}) AS s, regr_intercept(rent, {c}) AS b FROM price_train JOIN folds ON date_start <= train_end GROUP BY i) l
          ON l.i = f.i GROUP BY f.i""" for c in feat.PRICE_NUMERIC]
    return f"folds AS (SELECT * FROM (VALUES {folds}) v(i, train_end, validation_end)), fits AS ({' UNION ALL '.join(fits)})"


FIRST_SQL = """SELECT CAST(1 AS BIGINT) AS step, feature AS added_feature, round(avg(mae), 4) AS mean_rolling_mae, round(stddev_pop(mae), 4) AS std_rolling_mae
FROM fits GROUP BY ord, feature ORDER BY round(avg(mae), 6), ord LIMIT 1"""


@query("m10_first", sql=_p(FIRST_SQL, _first_sql(len(binding.PRICE_FOLDS))))
def m10_first(spark, sf):
    """M10 over all 13 candidates, stopped after its first round by the improvement it asks for."""
    return _selected(spark, forward.forward_select(price_folds(spark, sf), feat.PRICE_CATEGORICAL, feat.PRICE_NUMERIC, "rent",
                                                   candidates=feat.PRICE_FEATURES, minimum_improvement=float("inf"))[1])


@query("m11_first", sql=_p(FIRST_SQL, _first_sql(1)))
def m11_first(spark, sf):
    return _selected(spark, forward.forward_select(price_folds(spark, sf, 1), feat.PRICE_CATEGORICAL, feat.PRICE_NUMERIC, "rent",
                                                   candidates=feat.PRICE_FEATURES, minimum_improvement=float("inf"))[1])


# ------------------------------------------------------------------------------ M19, M20: stumps
def _stump_sql(source, target, texts):
    """The category that one split takes: the largest drop of squared error of one against the rest."""
    sides = " UNION ALL ".join(f"SELECT '{c}' AS feature, {text} AS v, count(*) AS n, avg({target}) AS m FROM {source} GROUP BY 2" for c, text in texts)
    return f"""whole AS (SELECT count(*) AS n, avg({target}) AS m FROM {source}), sides AS ({sides}),
drops AS (SELECT s.feature, s.v, s.n * (w.n - s.n) / w.n * power(s.m - (w.m * w.n - s.m * s.n) / (w.n - s.n), 2) AS gain
          FROM sides s CROSS JOIN whole w WHERE s.n < w.n),
best AS (SELECT * FROM drops ORDER BY gain DESC LIMIT 1)"""


@query("m20_stump", sql=_p("SELECT 'category__' || feature || '_' || v AS name, 1.0 AS importance FROM best",
                           _stump_sql("price_train", "rent", [(c, _rental_text(c)) for c in feat.PRICE_CATEGORICAL])))
def m20_stump(spark, sf):
    """M20 of one tree with one split: all importance lies on the encoded column with the largest drop."""
    model = ML.fit_boosting(price_part(spark, sf, "train"), feat.PRICE_CATEGORICAL, [], "rent", {**ONE_TREE, "max_depth": 1})
    return _rows(spark, [(n, v) for n, v in ML.encoded_importance(model) if v > 0], "name string, importance double")


@query("m19_stump", sql=_w("SELECT feature, 1.0 AS importance FROM best", EDA,
                           _stump_sql("eda", "weeks_on_market", [(c, _ttl_text(c)) for c in feat.TTL_CATEGORICAL])))
def m19_stump(spark, sf):
    """M19 of one unbootstrapped tree with one split: all importance lies on the split's feature."""
    model = ML.fit_forest(ttl_train(spark, sf), feat.TTL_CATEGORICAL, [], feat.TTL_TARGET, {**ONE_FOREST_TREE, "max_depth": 1}, order=["listing_id"])
    return _rows(spark, [(n, v) for n, v in ML.grouped_importance(model) if v > 0], "feature string, importance double")


# ------------------------------------------------------------------------------ M22, M23 on one categorical
CLOSED_GRID = tuple({"n_estimators": n, "learning_rate": rate, "max_depth": 4, "min_samples_leaf": 1, "subsample": 1.0, "random_state": 42}
                    for n, rate in ((20, 0.1), (60, 0.05), (350, 0.02)))


def closed_price_run(spark, sf):
    """M23 on room_type alone: the stepwise model predicts group means, boosting shrunk ones."""
    return runs.price_run(price_xy(spark, sf), binding.PRICE_FOLDS, grid=CLOSED_GRID, categorical=["room_type"], numeric=[])


def _price_run_sql():
    metric = """CAST(count(*) AS BIGINT) AS rows, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, 1 - sum(e * e) / (var_pop(rent) * count(*)) AS r2"""
    return f"""{_rate_sql(CLOSED_GRID)},
chosen AS (SELECT s.* FROM sets s JOIN best b ON b.set_number = s.set_number),
fit_rows AS (SELECT 'validation' AS split, rent, room_type FROM price WHERE split = 'train'
             UNION ALL SELECT 'test', rent, room_type FROM price WHERE split IN ('train', 'validation')),
fit_all AS (SELECT split, avg(rent) AS m FROM fit_rows GROUP BY split),
fit_group AS (SELECT split, room_type, avg(rent) AS m FROM fit_rows GROUP BY split, room_type),
run_errors AS (SELECT p.split, p.rent, p.rent - g.m AS linear, p.rent - {_shrunk("s.n", "s.rate")} AS boosted
               FROM price p JOIN fit_all a ON a.split = p.split JOIN fit_group g ON g.split = p.split AND g.room_type = p.room_type CROSS JOIN chosen s),
run_metrics AS (SELECT '{runs.STEPWISE}' AS model, split, {metric} FROM (SELECT *, linear AS e FROM run_errors) GROUP BY split
                UNION ALL SELECT '{runs.BOOSTING}', split, {metric} FROM (SELECT *, boosted AS e FROM run_errors) GROUP BY split),
run_winner AS (SELECT model AS winner FROM run_metrics WHERE split = 'validation' ORDER BY mae, model = '{runs.BOOSTING}' LIMIT 1)"""


PRICE_RUN_SQL = _price_run_sql()


@query("m23_closed", sql=_p("SELECT model, split, rows, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 6) AS r2, winner FROM run_metrics "
                            "CROSS JOIN run_winner", PRICE_RUN_SQL))
def m23_closed(spark, sf):
    out = closed_price_run(spark, sf)
    out["data"].unpersist()
    return out["metrics"].select("model", "split", "rows", *[F.round(c, d).alias(c) for c, d in (("mae", 4), ("rmse", 4), ("r2", 6))],
                                 F.lit(out["winner"]).alias("winner"))


LONE_LEAF = {"n_estimators": 1, "max_depth": 0, "min_samples_leaf": 1, "max_features": 1.0, "random_state": 42, "bootstrap": False}


def closed_ttl_run(spark, sf):
    """M22 on season_listed alone: the linear model predicts group means, a forest of one leaf the mean."""
    return runs.ttl_run(ttl(spark, sf), LONE_LEAF, categorical=["season_listed"], numeric=[])


def _ttl_run_sql():
    metric = """CAST(count(*) AS BIGINT) AS rows, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2,
  100 * avg(CASE WHEN abs(e) <= 1 THEN 1.0 ELSE 0.0 END) AS within_1_pct, 100 * avg(CASE WHEN abs(e) <= 2 THEN 1.0 ELSE 0.0 END) AS within_2_pct"""
    return f"""fit_rows AS (SELECT 'validation' AS split, weeks_on_market AS y, season_listed FROM ttl WHERE data_split = 'train'
             UNION ALL SELECT 'test', weeks_on_market, season_listed FROM ttl WHERE data_split IN ('train', 'validation')),
fit_all AS (SELECT split, avg(y) AS m FROM fit_rows GROUP BY split),
fit_group AS (SELECT split, season_listed, avg(y) AS m FROM fit_rows GROUP BY split, season_listed),
run_errors AS (SELECT t.data_split AS split, t.weeks_on_market AS y, t.weeks_on_market - greatest(g.m, 0) AS linear, t.weeks_on_market - greatest(a.m, 0) AS mean
               FROM ttl t JOIN fit_all a ON a.split = t.data_split JOIN fit_group g ON g.split = t.data_split AND g.season_listed = t.season_listed),
run_metrics AS (SELECT '{runs.LINEAR}' AS model, split, {metric} FROM (SELECT *, linear AS e FROM run_errors) GROUP BY split
                UNION ALL SELECT '{runs.FOREST}', split, {metric} FROM (SELECT *, mean AS e FROM run_errors) GROUP BY split),
run_winner AS (SELECT model AS winner FROM run_metrics WHERE split = 'validation' ORDER BY mae, model = '{runs.FOREST}' LIMIT 1)"""


TTL_RUN_SQL = _ttl_run_sql()


@query("m22_closed", sql=_w("SELECT model, split, rows, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 6) AS r2, round(within_1_pct, 4) AS within_1_pct, "
                            "round(within_2_pct, 4) AS within_2_pct, winner FROM run_metrics CROSS JOIN run_winner", TTL_RUN_SQL))
def m22_closed(spark, sf):
    out = closed_ttl_run(spark, sf)
    rows = out["metrics"].select("model", "split", "rows", *[F.round(c, d).alias(c) for c, d in (
        ("mae", 4), ("rmse", 4), ("r2", 6), ("within_1_pct", 4), ("within_2_pct", 4))], F.lit(out["winner"]).alias("winner"))
    done = spark.createDataFrame(rows.collect(), rows.schema)      # models x splits
    out["data"].unpersist()
    return done


# ------------------------------------------------------------------------------ M14–M17 metrics
def _metric_sql(pred_col, model, source, split=None):
    return (f"SELECT '{model}' AS model, {'' if split is None else repr(split) + ' AS split, '}"
            f"CAST(count(*) AS BIGINT) AS rows, round(avg(abs(rent - {pred_col})), 6) AS mae, "
            f"round(sqrt(avg((rent - {pred_col}) * (rent - {pred_col}))), 6) AS rmse, "
            f"round(1 - sum((rent - {pred_col}) * (rent - {pred_col})) / (var_pop(rent) * count(rent)), 6) AS r2 FROM {source}")


def _round_metrics(df):
    return df.select(*[r6(c).alias(c) if c in ("mae", "rmse", "r2", "within_1_pct", "within_2_pct") else F.col(c)
                       for c in df.columns])


@query("m14", sql=_p(" UNION ALL ".join([_metric_sql("global_mean", "global_mean", "test"),
                                          _metric_sql("room_type_mean", "room_type_mean", "test")]), MEAN_MODELS_SQL))
def m14(spark, sf):
    wide = mean_models(spark, sf)
    long = wide.unpivot(["rent"], ["global_mean", "room_type_mean"], "model", "prediction")
    return _round_metrics(M.regression_metrics(long, ["model"], actual="rent"))


TTL_MEANS_SQL = """
ttl_fit AS (SELECT room_type, avg(weeks_on_market) AS m FROM ttl WHERE data_split = 'train' GROUP BY room_type),
ttl_all AS (SELECT avg(weeks_on_market) AS m FROM ttl WHERE data_split = 'train'),
ttl_scored AS (SELECT t.listing_id, t.data_split, t.weeks_on_market AS actual, f.m - 6 AS room_type_mean,
               (SELECT m FROM ttl_all) - 6 AS global_mean
               FROM ttl t LEFT JOIN ttl_fit f ON f.room_type IS NOT DISTINCT FROM t.room_type)
"""


def ttl_mean_models(spark, sf):
    """Two closed-form TTL predictors (train means, shifted down by 6 weeks so that clipping at 0
    matters): the global mean and the room-type mean."""
    data = ttl(spark, sf)
    train = data.filter(F.col("data_split") == "train")
    overall = train.select(F.avg("weeks_on_market")).scalar()
    by_room = train.groupBy("room_type").agg(F.avg("weeks_on_market").alias("m"))
    j = data.join(by_room, data["room_type"].eqNullSafe(by_room["room_type"]), "left")
    return j.select("listing_id", "data_split", F.col("weeks_on_market").alias("actual"),
                    (F.col("m") - 6).alias("room_type_mean"), (overall - 6).alias("global_mean"))


def _ttl_metric_sql(model, split):
    p = f"greatest({model}, 0.0)"
    e = f"(actual - {p})"
    return (f"SELECT '{model}' AS model, '{split}' AS split, CAST(count(*) AS BIGINT) AS rows, round(avg(abs{e}), 6) AS mae, "
            f"round(sqrt(avg({e} * {e})), 6) AS rmse, round(1 - sum({e} * {e}) / (var_pop(actual) * count(actual)), 6) AS r2, "
            f"round(avg(CASE WHEN abs{e} <= 1 THEN 1.0 ELSE 0.0 END) * 100, 6) AS within_1_pct, "
            f"round(avg(CASE WHEN abs{e} <= 2 THEN 1.0 ELSE 0.0 END) * 100, 6) AS within_2_pct "
            f"FROM ttl_scored WHERE data_split = '{split}'")


@query("m15", sql=_w(_ttl_metric_sql("room_type_mean", "validation"), TTL_MEANS_SQL))
def m15(spark, sf):
    s = ttl_mean_models(spark, sf).filter(F.col("data_split") == "validation")
    long = s.select(F.lit("room_type_mean").alias("model"), F.lit("validation").alias("split"), "actual",
                    F.col("room_type_mean").alias("prediction"))
    return _round_metrics(M.ttl_metrics(long))


def _price_long(spark, sf, splits_=("validation", "test")):
    p = price_split(spark, sf)
    train = p.filter(F.col("split") == "train")
    overall = train.select(F.avg("rent")).scalar()
    by_room = train.groupBy("room_type").agg(F.avg("rent").alias("room_type_mean"))
    scored = p.filter(F.col("split").isin(*splits_)).join(
        by_room, p["room_type"].eqNullSafe(by_room["room_type"]), "left").drop(by_room["room_type"]) \
        .withColumn("global_mean", overall)
    return scored.unpivot(["split", "rent"], ["global_mean", "room_type_mean"], "model", "prediction")


PRICE_MEANS_SQL = """
fit_all2 AS (SELECT avg(rent) AS m FROM price WHERE split = 'train'),
fit_room2 AS (SELECT room_type, avg(rent) AS m FROM price WHERE split = 'train' GROUP BY room_type),
scored AS (SELECT t.split, t.rent, (SELECT m FROM fit_all2) AS global_mean, r.m AS room_type_mean
           FROM price t LEFT JOIN fit_room2 r ON r.room_type IS NOT DISTINCT FROM t.room_type WHERE t.split IN ('validation', 'test'))
"""
M16_SQL = " UNION ALL ".join(
    _metric_sql(m, m, f"scored WHERE split = '{s}'", s) for m in ("global_mean", "room_type_mean") for s in ("validation", "test"))


@query("m16", sql=_p(M16_SQL, PRICE_MEANS_SQL))
def m16(spark, sf):
    return _round_metrics(M.regression_metrics(_price_long(spark, sf), ["model", "split"], actual="rent"))


@query("a18", sql=_p("""
SELECT model, max(CASE WHEN split = 'validation' THEN mae END) AS validation, max(CASE WHEN split = 'test' THEN mae END) AS test
FROM (""" + M16_SQL + ") GROUP BY model", PRICE_MEANS_SQL))
def a18(spark, sf):
    metrics = _round_metrics(M.regression_metrics(_price_long(spark, sf), ["model", "split"], actual="rent"))
    return metrics.groupBy("model").pivot("split", ["validation", "test"]).agg(F.first("mae"))


@query("m17", sql=_w("""
SELECT listing_id, actual, round(greatest(global_mean, 0.0), 6) AS predicted_global_mean,
  round(abs(actual - greatest(global_mean, 0.0)), 6) AS abs_error_global_mean,
  round(greatest(room_type_mean, 0.0), 6) AS predicted_room_type_mean,
  round(abs(actual - greatest(room_type_mean, 0.0)), 6) AS abs_error_room_type_mean
FROM ttl_scored WHERE data_split = 'test'""", TTL_MEANS_SQL))
def m17(spark, sf):
    s = ttl_mean_models(spark, sf).filter(F.col("data_split") == "test")
    t = M.prediction_table(s, ["listing_id"], "actual", ["global_mean", "room_type_mean"])
    return t.select(*[r6(c).alias(c) if c.startswith(("predicted", "abs_error")) else F.col(c) for c in t.columns])


# ------------------------------------------------------------------------------ M18–M21 model tables
@query("m18", sql=_p("""
SELECT CAST(0 AS BIGINT) AS rank, 'intercept' AS term, round(regr_intercept(rent, size_sqm), 4) AS coefficient FROM price_train
UNION ALL SELECT CAST(1 AS BIGINT), 'size_sqm', round(regr_slope(rent, size_sqm), 4) FROM price_train"""))
def m18(spark, sf):
    model = ML.fit_linear(price_part(spark, sf, "train"), [], ["size_sqm"], "rent")
    rows = [(i, name, round(v, 4)) for i, (name, v) in enumerate(ML.coefficient_table(model))]
    return _rows(spark, rows, "rank bigint, term string, coefficient double") \
        .withColumn("term", clean_encoded_name("term"))


@query("m19", sql=_w("SELECT CAST(count(*) AS BIGINT) AS n_features, CAST(1.0 AS DOUBLE) AS total FROM (SELECT DISTINCT feature FROM (VALUES "
                     + ", ".join(f"('{c}')" for c in (*feat.TTL_CATEGORICAL, *feat.TTL_NUMERIC)) + ") v(feature)) "
                     "WHERE (SELECT count(*) FROM eda) > 0", EDA))
def m19(spark, sf):
    model = ML.fit_forest(ttl_train(spark, sf), feat.TTL_CATEGORICAL, feat.TTL_NUMERIC, feat.TTL_TARGET,
                          order=["listing_id"])
    imp = ML.grouped_importance(model)
    return _rows(spark, [(len(imp), round(sum(v for _, v in imp), 6))], "n_features bigint, total double")


@query("m20", sql=_p("SELECT CAST((SELECT count(*) FROM cat_counts) + " + str(len(feat.PRICE_NUMERIC))
                     + " AS BIGINT) AS n_columns, CAST(1.0 AS DOUBLE) AS total", PRICE_CAT_COUNTS))
def m20(spark, sf):
    model = ML.fit_boosting(price_part(spark, sf, "train"), feat.PRICE_CATEGORICAL, feat.PRICE_NUMERIC, "rent")
    imp = ML.encoded_importance(model)
    return _rows(spark, [(len(imp), round(sum(v for _, v in imp), 6))], "n_columns bigint, total double")


@query("m21")
def m21(spark, sf):
    """Top-15 forest importances and top-15 OLS coefficients, prefixes stripped, re-sorted."""
    data = ttl_train(spark, sf)
    forest = ML.fit_forest(data, feat.TTL_CATEGORICAL, feat.TTL_NUMERIC, feat.TTL_TARGET, order=["listing_id"])
    linear = ML.fit_linear(data, feat.TTL_CATEGORICAL, feat.TTL_NUMERIC, feat.TTL_TARGET)
    rows = [("importance", n, v) for n, v in ML.encoded_importance(forest)[:15]]
    coefs = sorted(ML.coefficient_table(linear)[1:], key=lambda kv: -abs(kv[1]))[:15]
    rows += [("coefficient", n, v) for n, v in sorted(coefs, key=lambda kv: kv[1])]
    return _rows(spark, rows, "kind string, name string, value double").withColumn("name", clean_encoded_name("name"))


# ------------------------------------------------------------------------------ M22 / M23 runs (rows-only)
@query("m22")
def m22(spark, sf):
    out = runs.ttl_run(ttl(spark, sf))
    metrics = _round_metrics(out["metrics"]).withColumn("winner", F.lit(out["winner"]))
    rows = metrics.collect()           # model-sized (models x splits)
    out["data"].unpersist()
    return spark.createDataFrame(rows, metrics.schema)


@query("m23")
def m23(spark, sf):
    out = runs.price_run(price_xy(spark, sf), binding.PRICE_FOLDS, grid=runs.BOOSTING_GRID)
    metrics = _round_metrics(out["metrics"]).withColumn("winner", F.lit(out["winner"]))
    rows = metrics.collect()           # model-sized (models x splits)
    out["data"].unpersist()
    return spark.createDataFrame(rows, metrics.schema)


# ------------------------------------------------------------------------------ M24–M27 scoring
@query("m24", sql=_p("""
fit_view AS (SELECT view, avg(rent) AS m FROM price_train GROUP BY view),
fit_room AS (SELECT room_type, avg(rent) AS m FROM price_train GROUP BY room_type)
SELECT 'room_type' AS model, round(t.rent - r.m, 2) AS residual FROM price t JOIN fit_room r ON r.room_type = t.room_type WHERE t.split = 'test'
UNION ALL
SELECT 'view', round(t.rent - v.m, 2) FROM price t JOIN fit_view v ON v.view = t.view WHERE t.split = 'test'"""))
def m24(spark, sf):
    train, test = price_part(spark, sf, "train"), price_part(spark, sf, "test")
    a = ML.fit_linear(train, ["room_type"], [], "rent").predict(test, keep=["rent"]).withColumnRenamed("prediction", "room_type")
    b = ML.fit_linear(train, ["view"], [], "rent").predict(test, keep=["rent"]).withColumnRenamed("prediction", "view")
    long = a.select("rent", F.col("room_type").alias("p"), F.lit("room_type").alias("model")).unionByName(
        b.select("rent", F.col("view").alias("p"), F.lit("view").alias("model")))
    return long.select("model", F.round(F.col("rent") - F.col("p"), 2).alias("residual"))


@query("m25", sql=_w(ROOMS_SQL.strip() + """,
fit AS (SELECT season_listed, avg(weeks_on_market) AS m FROM ttl WHERE data_split = 'train' GROUP BY season_listed)
SELECT r.listing_id, round(greatest(f.m, 0.0), 4) AS predicted_weeks,
  CAST(greatest(round_even(round(greatest(f.m, 0.0), 9), 0), 0) AS DOUBLE) AS estimated_weeks,
  CAST(greatest(round_even(round(greatest(f.m, 0.0) * 7, 9), 0), 0) AS DOUBLE) AS estimated_days
FROM rooms r LEFT JOIN fit f ON f.season_listed = r.season_listed"""))
def m25(spark, sf):
    model = ML.fit_linear(ttl_train(spark, sf), ["season_listed"], [], feat.TTL_TARGET)
    out = runs.score_time_to_lease(model, rooms(spark, sf), keep=("listing_id",))
    return out.select("listing_id", F.round("predicted_weeks", 4).alias("predicted_weeks"),
                      runs.whole_units(F.round("predicted_weeks", NOISE)).alias("estimated_weeks"),
                      runs.whole_units(F.round(F.col("predicted_weeks") * 7, NOISE)).alias("estimated_days"))


RECOMMEND_SQL = """
fit AS (SELECT view, avg(rent) AS m FROM price_train GROUP BY view),
rec AS (SELECT l.lease_id, l.rent AS actual, f.m AS predicted_rent,
               CAST(greatest(round_even(round(f.m, 9), 0), 0) AS DOUBLE) AS recommended_rent
        FROM leases l JOIN units u ON u.unit_id = l.unit_id LEFT JOIN fit f ON f.view = u.view
        WHERE l.date_start > DATE '2000-03-31')
"""


def recommendations(spark, sf):
    t = tables(spark, sf)
    model = ML.fit_linear(price_part(spark, sf, "train"), ["view"], [], "rent")
    room_rows = (t["leases"].filter(F.col("date_start") > F.lit(binding.PRICE_VALIDATION_END).cast("date"))
                 .join(t["units"].select("unit_id", "floor", "size_sqm", "room_type", "view", "furnished"), "unit_id")
                 .join(t["projects"].select("project_id", "project_name", "university", "distance_to_campus_m", "facility_count"), "project_id", "left")
                 .withColumn("date_start", F.col("date_start").cast("string"))
                 .withColumnRenamed("rent", "actual"))
    out = runs.recommend_price(model, room_rows, keep=("lease_id", "actual"))
    return out.withColumn("recommended_rent", runs.whole_units(F.round("predicted_rent", NOISE)))


@query("m26", sql=_p(RECOMMEND_SQL.strip() + "\nSELECT lease_id, round(predicted_rent, 2) AS predicted_rent, recommended_rent FROM rec"))
def m26(spark, sf):
    return recommendations(spark, sf).select("lease_id", F.round("predicted_rent", 2).alias("predicted_rent"),
                                             "recommended_rent")


@query("m27", sql=_p(RECOMMEND_SQL.strip() + """
SELECT lease_id, round(actual, 2) AS actual, recommended_rent, round(abs(actual - recommended_rent), 2) AS abs_error FROM rec"""))
def m27(spark, sf):
    r = recommendations(spark, sf)
    return r.select("lease_id", F.round("actual", 2).alias("actual"), "recommended_rent",
                    F.round(F.abs(F.col("actual") - F.col("recommended_rent")), 2).alias("abs_error"))


# ------------------------------------------------------------------------------ S07 persistence
@query("s07", sql=_p("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0.0 AS DOUBLE) AS max_abs_diff FROM price WHERE split = 'validation'"))
def s07(spark, sf):
    from pyspark.ml import PipelineModel
    train, valid = price_part(spark, sf, "train"), price_part(spark, sf, "validation")
    model = ML.fit_linear(train, ["room_type", "view"], ["size_sqm", "floor"], "rent")
    path = io.scratch_path(spark, "model")
    model.pipeline.write().overwrite().save(path)
    reloaded = PipelineModel.load(path)
    # score the same rows with both models in one plan and compare
    first = model.pipeline.transform(valid).select(F.col("prediction").alias("__first"), *valid.columns)
    both = reloaded.transform(first).select("__first", "prediction")
    return both.agg(F.count(F.lit(1)).cast("long").alias("rows"),
                    F.coalesce(F.max(F.abs(F.col("__first") - F.col("prediction"))), F.lit(0.0)).alias("max_abs_diff"))
