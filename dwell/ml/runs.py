"""Training runs, tuning and batch scoring.

The modelling tables are labelled once (split / fold columns) and cached; every fit is a Spark ML
job, and every metric table is one aggregate over long (model, split, actual, prediction) rows.
The driver only orders metric rows and picks winners (W04 tie rules).
"""

from __future__ import annotations

from typing import Mapping, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwell.functions.scalars import clip_zero, round_half_even
from dwell.ml import boosting
from dwell.ml import metrics as M
from dwell.ml.forward import forward_select
from dwell.ml.models import BOOSTING_DEFAULTS, FOREST_DEFAULTS, FittedModel, boosted_pipeline, fit_forest, fit_linear
from dwell.operators.splits import SlicedFolds, fold_summary, rolling_folds, sliced_folds
from dwell.plans import features as feat

LINEAR = "Multiple Linear Regression"
FOREST = "Random Forest"
STEPWISE = "Stepwise Linear Regression"
BOOSTING = "Gradient Boosting"

# The tuning grid (12 parameter sets, in order):
# (n_estimators, learning_rate, max_depth, min_samples_leaf, subsample)
BOOSTING_GRID_VALUES = (
    (350, 0.03, 3, 15, 0.9),
    (250, 0.03, 3, 15, 0.9),
    (450, 0.03, 3, 15, 0.9),
    (350, 0.02, 3, 15, 0.9),
    (450, 0.02, 3, 15, 0.9),
    (250, 0.05, 2, 10, 1.0),
    (350, 0.05, 2, 10, 0.9),
    (250, 0.03, 2, 15, 0.9),
    (350, 0.03, 2, 25, 0.9),
    (350, 0.03, 4, 15, 0.9),
    (350, 0.03, 3, 25, 0.8),
    (450, 0.02, 4, 25, 0.8),
)
BOOSTING_GRID = tuple({"n_estimators": n, "learning_rate": lr, "max_depth": d, "min_samples_leaf": leaf,
                       "subsample": sub, "random_state": 42} for n, lr, d, leaf, sub in BOOSTING_GRID_VALUES)


def scored_long(model: FittedModel, df: DataFrame, name: str, split: str, target: str,
                keep: Sequence[str] = ()) -> DataFrame:
    return model.transform(df).select(*keep, F.lit(name).alias("model"), F.lit(split).alias("split"),
                                      F.col(target).cast("double").alias("actual"), "prediction")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ---------------------------------------------------------------- M22 time-to-lease run
def ttl_run(modeling: DataFrame, forest_params: Mapping | None = None, order: Sequence[str] = ("listing_id",),
            categorical: Sequence[str] = feat.TTL_CATEGORICAL, numeric: Sequence[str] = feat.TTL_NUMERIC) -> dict:
    """M22 over a K02-labelled F02 dataset. Returns metric rows (DataFrame), winner, models,
    prediction table, split rows and the excluded post_test count."""
    data = feat.ttl_features_and_target(modeling, keep=("listing_id", "unit_id", "project_id", "date_listed",
                                                        "data_split")).cache()
    cats, nums, y = list(categorical), list(numeric), feat.TTL_TARGET
    part = {s: data.filter(F.col("data_split") == s) for s in ("train", "validation", "test")}
    counts = {r["data_split"]: r["count"] for r in data.groupBy("data_split").count().collect()}
    for s in ("train", "validation", "test"):
        if not counts.get(s):
            raise ValueError(f"split {s} is empty")
    fitters = {LINEAR: lambda d: fit_linear(d, cats, nums, y),
               FOREST: lambda d: fit_forest(d, cats, nums, y, forest_params, order)}
    val_models = {n: f(part["train"]) for n, f in fitters.items()}
    val_long = union_all([scored_long(m, part["validation"], n, "validation", y) for n, m in val_models.items()])
    val_metrics = M.ttl_metrics(val_long).collect()
    winner = min(val_metrics, key=lambda r: (r["mae"], 0 if r["model"] == LINEAR else 1))["model"]
    train_val = data.filter(F.col("data_split").isin("train", "validation"))
    final = {n: f(train_val) for n, f in fitters.items()}
    ids = ["listing_id", "unit_id", "project_id", "date_listed"]
    wide = part["test"]
    for n, name in ((LINEAR, "linear"), (FOREST, "forest")):       # one row stays one row: no join, no pivot
        wide = final[n].transform(wide).select(*part["test"].columns, *[c for c in ("linear",) if c in wide.columns],
                                               F.col("prediction").alias(name))
    wide = wide.withColumn("actual", F.col(y).cast("double"))
    test_long = wide.select("actual", F.inline(F.array(*[
        F.struct(F.lit(n).alias("model"), F.lit("test").alias("split"), F.col(c).alias("prediction")) for n, c in ((LINEAR, "linear"), (FOREST, "forest"))])))
    metrics = M.ttl_metrics(val_long.unionByName(test_long))
    table = M.prediction_table(wide, ids, "actual", ["linear", "forest"])
    matured = data.filter(F.col("data_split").isin("train", "validation", "test"))
    deployment = fitters[winner](matured)
    return {"winner": winner, "metrics": metrics, "prediction_table": table, "deployment_model": deployment,
            "models": final, "split_rows": counts,
            "deployment_training_rows": counts["train"] + counts["validation"] + counts["test"],
            "excluded_post_test_rows": counts.get("post_test", 0), "data": data, "features": [*cats, *nums],
            "forest_params": {**FOREST_DEFAULTS, **(forest_params or {})}}


# ---------------------------------------------------------------- M12 / M13 tuning
def tuning_table(folds: SlicedFolds, categorical, numeric, target, grid: Sequence[Mapping] = BOOSTING_GRID) -> list[dict]:
    """One row per parameter set. All models grow together; sets that differ only in their number of
    trees are stages of one ensemble."""
    families: dict[tuple, list[int]] = {}
    for number, p in enumerate(grid):
        families.setdefault(tuple(sorted((k, v) for k, v in p.items() if k != "n_estimators")), []).append(number)
    specs, sets = [], []
    for numbers in families.values():
        stages = tuple(sorted({int(grid[i]["n_estimators"]) for i in numbers}))
        for fold, (a, b) in enumerate(folds.ends):
            specs.append(boosting.Spec(a, b, {**BOOSTING_DEFAULTS, **grid[numbers[0]], "n_estimators": stages[-1]}, stages))
            sets.append((fold, numbers))
    _, errors = boosting.fit(folds.rows, categorical, numeric, target, specs, keep=False)
    found: dict[tuple[int, int, str], dict] = {}
    for e in errors:
        fold, numbers = sets[e["spec"]]
        found |= {(i, fold, e["role"]): e for i in numbers if int(grid[i]["n_estimators"]) == e["step"]}
    return [_summary(i, [{role: found[i, f, role] for role in boosting.ROLES} for f in range(len(folds.names))]) | dict(p)
            for i, p in enumerate(grid)]


def _summary(number: int, folds: Sequence[Mapping]) -> dict:
    """A parameter set's errors over its folds."""
    train, valid = (np.array([[f[role][m] for m in ("mae", "rmse", "r2")] for f in folds]) for role in boosting.ROLES)
    out = {"set_number": number + 1, "mean_train_mae": train[:, 0].mean(), "mean_validation_mae": valid[:, 0].mean(),
           "std_validation_mae": valid[:, 0].std(), "mean_validation_rmse": valid[:, 1].mean(), "mean_validation_r2": valid[:, 2].mean(),
           "mae_gap": valid[:, 0].mean() - train[:, 0].mean(), **{f"fold_{i}_mae": v for i, v in enumerate(valid[:, 0], 1)}}
    return {k: v if k == "set_number" else float(v) for k, v in out.items()}


def tune_boosting(folds: SlicedFolds, categorical, numeric, target, grid: Sequence[Mapping] = BOOSTING_GRID) -> tuple[dict, list[dict]]:
    """Every set on every fold; the lowest mean MAE wins, then the lowest deviation, then set order."""
    rows = tuning_table(folds, categorical, numeric, target, grid)
    return min(rows, key=lambda r: (r["mean_validation_mae"], r["std_validation_mae"], r["set_number"])), rows


# ---------------------------------------------------------------- M23 rental price run
def price_run(labelled: DataFrame, windows, grid: Sequence[Mapping] = BOOSTING_GRID, minimum_improvement: float = 1.0,
              categorical: Sequence[str] = feat.PRICE_CATEGORICAL, numeric: Sequence[str] = feat.PRICE_NUMERIC) -> dict:
    """M23 over the P04 rental input carrying a K01 ``split`` label: folds inside train (K03) ->
    forward selection (M10) and boosting tuning (M13) -> fit both on train, pick by validation
    MAE -> refit both on train+validation -> test once. The deployed winner is not refit on test."""
    cats, nums, y = list(categorical), list(numeric), feat.PRICE_TARGET
    candidates = [c for c in feat.PRICE_FEATURES if c in (*cats, *nums)]
    labelled = labelled.persist(StorageLevel.MEMORY_AND_DISK)     # every fit below reads it
    train = labelled.filter(F.col("split") == "train")
    valid = labelled.filter(F.col("split") == "validation")
    test = labelled.filter(F.col("split") == "test")
    train_val = labelled.filter(F.col("split").isin("train", "validation"))
    folds = sliced_folds(train, feat.PRICE_DATE, windows)
    summary = sorted(fold_summary(rolling_folds(train, feat.PRICE_DATE, windows, validate=False), windows).collect(), key=lambda r: r["ordinal"])
    selected, history = forward_select(folds, cats, nums, y, candidates=candidates, minimum_improvement=minimum_improvement)
    best, tuning = tune_boosting(folds, cats, nums, y, grid)
    params = dict(grid[int(best["set_number"]) - 1])
    sel_c = [c for c in selected if c in cats]
    sel_n = [c for c in selected if c in nums]
    # the chosen set on train and on train + validation, grown together
    sides = train_val.withColumn("slice", F.when(F.col("split") == "train", 0).otherwise(1))
    whole = {**BOOSTING_DEFAULTS, **params}
    ensembles, _ = boosting.fit(sides, cats, nums, y, [boosting.Spec(0, 0, whole), boosting.Spec(1, 1, whole)])
    on_train, final = ({STEPWISE: fit_linear(rows, sel_c, sel_n, y), BOOSTING: boosted_pipeline(rows, cats, nums, ensemble)}
                       for rows, ensemble in zip((train, train_val), ensembles))
    val_long = union_all([scored_long(m, valid, n, "validation", y) for n, m in on_train.items()])
    test_long = union_all([scored_long(m, test, n, "test", y) for n, m in final.items()])
    metrics = M.regression_metrics(union_all([val_long, test_long]), ["model", "split"])
    rows = metrics.collect()                                       # models x splits
    maes = {r["model"]: r["mae"] for r in rows if r["split"] == "validation"}
    winner = min((STEPWISE, BOOSTING), key=lambda n: maes[n])      # ties: stepwise
    metrics = labelled.sparkSession.createDataFrame(rows, metrics.schema)
    return {"winner": winner, "metrics": metrics, "selected": selected, "history": history, "tuning": tuning,
            "best_params": params, "folds": summary, "models": final, "deployed": final[winner], "data": labelled,
            "features": candidates}


# ---------------------------------------------------------------- M25 / M26 batch scoring
def whole_units(value: Column) -> Column:
    """max(0, half-even round)."""
    return F.greatest(round_half_even(value), F.lit(0.0))


def score_time_to_lease(model: FittedModel, rooms: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """F06 -> model -> predicted_weeks = max(0, p); estimated weeks / days half-even rounded."""
    prepared = feat.ttl_model_input(feat.require_valid_dates(feat.ttl_inference_input(rooms), feat.TTL_DATE), keep=tuple(keep))
    p = clip_zero("prediction")
    return model.transform(prepared).select(
        *keep, p.alias("predicted_weeks"),
        whole_units(p).alias("estimated_weeks"), whole_units(p * 7).alias("estimated_days"))


def recommend_price(model: FittedModel, rooms: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """F07 -> P03 -> model -> predicted_rent, recommended_rent = max(0, half-even round)."""
    prepared = rooms if {"start_year", "start_month"} <= set(rooms.columns) else feat.require_valid_dates(
        feat.price_inference_input(rooms), feat.PRICE_DATE)
    prepared = feat.price_features_and_target(prepared.withColumn(feat.PRICE_TARGET, F.lit(None).cast("double"))
                                              if feat.PRICE_TARGET not in prepared.columns else prepared, keep=tuple(keep))
    return model.transform(prepared).select(
        *keep, F.col("prediction").alias("predicted_rent"),
        whole_units(F.col("prediction")).alias("recommended_rent"))
