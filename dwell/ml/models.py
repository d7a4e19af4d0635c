"""Regression models (M07–M09) as persistable PipelineModels ending in a ``prediction`` column.

* OLS: ``LinearRegression(solver="normal", regParam=0)`` — the distributed normal equations
  (one XᵀX aggregate) on a maximal linearly independent subset of the encoded columns, found
  from one Gram pass, so rank-deficient encodings never reach the quasi-Newton fallback.
* Random forest: 150 trees, depth 12, min leaf 5, 80 % of features per split, seed 42; grown by
  ``dwell.ml.forest`` on the booster's bins, with bootstrap weights by a hash of (tree, row).
* Gradient boosting (squared loss): 250 trees, rate .05, depth 2, min leaf 10, subsample 1.0,
  seed 42; grown by ``dwell.ml.boosting``, because Spark's booster takes its first tree whole and fits
  the others to doubled residuals. The trees are handed to Spark ML's ensemble model for scoring.
"""

from __future__ import annotations

from typing import Mapping, Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.ml import boosting, forest
from dwell.ml.encode import Encoded, fit_preprocessor

# Default hyper-parameters.
FOREST_DEFAULTS = {"n_estimators": 150, "max_depth": 12, "min_samples_leaf": 5, "max_features": 0.8,
                   "random_state": 42}
BOOSTING_DEFAULTS = {"n_estimators": 250, "learning_rate": 0.05, "max_depth": 2, "min_samples_leaf": 10,
                     "subsample": 1.0, "random_state": 42}
LABEL = "__label"


class FittedModel:
    """A fitted pipeline (preprocessing + regressor) plus its encoded layout."""

    def __init__(self, kind: str, pipeline: PipelineModel, encoded: Encoded, regressor):
        self.kind, self.pipeline, self.encoded, self.regressor = kind, pipeline, encoded, regressor
        self.importances: np.ndarray | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(df)

    def predict(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return self.pipeline.transform(df).select(*keep, "prediction")


def _prepare(train: DataFrame, categorical, numeric, target, drop_first) -> tuple[Encoded, DataFrame]:
    feats = [*categorical, *numeric]
    if not feats:
        raise ValueError("empty feature list")
    enc = fit_preprocessor(train, categorical, numeric, drop_first)
    data = enc.transform(train.withColumn(LABEL, F.col(target).cast("double")))
    return enc, data


def independent_columns(gram: np.ndarray, tol: float = 1e-9) -> list[int]:
    """Columns of X (in order) that are not linear combinations of earlier ones plus the
    intercept, from the augmented Gram [X y 1]ᵀ[X y 1] (pivoted elimination on the centred
    cross-product matrix; p is the encoded width, so this runs on the driver)."""
    p = gram.shape[0] - 2
    n = gram[p + 1, p + 1]
    mean = gram[:p, p + 1] / n
    sxx = gram[:p, :p] - n * np.outer(mean, mean)
    keep: list[int] = []
    for j in range(p):
        d = sxx[j, j]
        if keep:
            k = np.array(keep)
            coef = np.linalg.solve(sxx[np.ix_(k, k)], sxx[k, j])
            d = d - sxx[j, k] @ coef
        if d > tol * max(sxx[j, j], 1e-300) and d > 1e-12:
            keep.append(j)
    return keep


def fit_linear(train: DataFrame, categorical: Sequence[str], numeric: Sequence[str], target: str) -> FittedModel:
    """OLS with intercept on drop-first one-hot + median-imputed numerics.

    Encodings are often collinear (a project fixes its university, distance and facility count).
    One distributed Gram pass finds a maximal independent set of encoded columns; a
    ``VectorSlicer`` keeps them, so the Cholesky normal-equation solver always applies and the
    fitted values equal the minimum-norm least-squares fit. Dropped columns get coefficient 0."""
    from pyspark import StorageLevel
    from pyspark.ml.feature import VectorSlicer
    from pyspark.ml.functions import vector_to_array

    from dwell.ml.forward import fold_grams

    train = train.select(*categorical, *numeric, *([] if target in (*categorical, *numeric) else [target])).persist(StorageLevel.MEMORY_AND_DISK)
    try:                                       # three passes, and what they read is often a join
        enc, data = _prepare(train, categorical, numeric, target, drop_first=True)
        width = len(enc.names)
        rows = data.select(F.lit("all").alias("fold"), vector_to_array(enc.features_col).alias("x"),
                           F.col(LABEL).alias("y"))
        keep = independent_columns(fold_grams(rows, {"all": width})["all"])
        stages = list(enc.model.stages)
        features = enc.features_col
        if len(keep) < width:
            slicer = VectorSlicer(inputCol=enc.features_col, outputCol="__independent", indices=keep)
            stages.append(slicer)
            features = "__independent"
            data = slicer.transform(data)
        lr = LinearRegression(featuresCol=features, labelCol=LABEL, predictionCol="prediction",
                              solver="normal", regParam=0.0, elasticNetParam=0.0, standardization=False,
                              fitIntercept=True)
        model = lr.fit(data.select(features, LABEL))
    finally:
        train.unpersist()
    fitted = FittedModel("linear", PipelineModel(stages=[*stages, model]), enc, model)
    full = np.zeros(width)
    full[keep] = model.coefficients.toArray()
    fitted.coefficients = full
    return fitted


def fit_forest(train: DataFrame, categorical: Sequence[str], numeric: Sequence[str], target: str,
               params: Mapping | None = None, order: Sequence[str] = ()) -> FittedModel:
    """Random forest on full one-hot (unseen -> zeros) + numerics. ``order``: columns that tell
    rows apart, for the bootstrap (default: all values of a row)."""
    p = {**FOREST_DEFAULTS, **(params or {})}
    if not [*categorical, *numeric]:
        raise ValueError("empty feature list")
    enc = fit_preprocessor(train, categorical, numeric, drop_first=False)
    plan, nodes = forest.fit(train, categorical, numeric, target, p, _positions(enc, categorical, numeric), order)
    model = forest.spark_model(plan, nodes, len(enc.names), enc.features_col, "prediction")
    fitted = FittedModel("forest", PipelineModel(stages=[*enc.model.stages, model]), enc, model)
    fitted.importances = np.zeros(len(enc.names))
    for position, share in forest.importances(plan, nodes).items():
        fitted.importances[position] = share
    return fitted


def _positions(enc: Encoded, categorical: Sequence[str], numeric: Sequence[str]) -> dict[tuple[str, str | None], int]:
    """Vector index of each (column, label); label None: a numeric column."""
    positions: dict[tuple[str, str | None], int] = {(c, None): enc.groups[c][0] for c in numeric}
    for c in categorical:
        positions |= {(c, enc.names[i][len(f"category__{c}_"):]): i for i in enc.groups.get(c, [])}
    return positions


def fit_boosting(train: DataFrame, categorical: Sequence[str], numeric: Sequence[str], target: str,
                 params: Mapping | None = None) -> FittedModel:
    """Gradient-boosted trees (squared loss) with true shrinkage, as a persistable pipeline."""
    spec = boosting.Spec(0, 0, {**BOOSTING_DEFAULTS, **(params or {})})
    (ensemble,), _ = boosting.fit(train.withColumn("slice", F.lit(0)), categorical, numeric, target, [spec])
    return boosted_pipeline(train, categorical, numeric, ensemble)


def boosted_pipeline(train: DataFrame, categorical: Sequence[str], numeric: Sequence[str], ensemble: boosting.Ensemble) -> FittedModel:
    """Preprocessing fitted on ``train``, the ensemble's trees as a Spark ML model, and its mean added."""
    enc = fit_preprocessor(train, categorical, numeric, drop_first=False)
    positions = _positions(enc, categorical, numeric)
    model = boosting.spark_model(train.sparkSession, ensemble, positions, len(enc.names), enc.features_col, "__boost")
    shift = SQLTransformer(statement=f"SELECT *, __boost + {float(ensemble.mean)!r} AS prediction FROM __THIS__")
    fitted = FittedModel("boosting", PipelineModel(stages=[*enc.model.stages, model, shift]), enc, model)
    fitted.importances = np.zeros(len(enc.names))
    for key, share in ensemble.importance().items():
        fitted.importances[positions[key]] += share
    return fitted


def coefficient_table(fitted: FittedModel) -> list[tuple[str, float]]:
    """Intercept first, then encoded coefficients by |coefficient| descending."""
    m = fitted.regressor
    coefs = list(zip(fitted.encoded.names, np.asarray(fitted.coefficients).tolist()))
    coefs.sort(key=lambda kv: (-abs(kv[1]), kv[0]))
    return [("intercept", float(m.intercept)), *coefs]


def _importances(fitted: FittedModel) -> list[float]:
    """Share of the drop of squared error, by encoded column (sums to 1 if anything was split)."""
    imp = fitted.importances if fitted.importances is not None else fitted.regressor.featureImportances.toArray()
    if len(imp) != len(fitted.encoded.names):
        raise ValueError("importance count does not match encoded columns")
    return list(map(float, imp))


def encoded_importance(fitted: FittedModel) -> list[tuple[str, float]]:
    """Importance per encoded column, descending."""
    imp = _importances(fitted)
    return sorted(zip(fitted.encoded.names, imp), key=lambda kv: (-kv[1], kv[0]))


def grouped_importance(fitted: FittedModel) -> list[tuple[str, float]]:
    """Importance summed back to source features (sums to 1), descending."""
    imp = _importances(fitted)
    out = [(f, float(sum(imp[i] for i in pos))) for f, pos in fitted.encoded.groups.items()]
    return sorted(out, key=lambda kv: (-kv[1], kv[0]))
