"""Regression metrics in one aggregate over long (group…, actual, prediction) rows."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwell.functions.scalars import clip_zero


def metric_columns(actual: str = "actual", prediction: str = "prediction", clip: bool = False,
                   within: Sequence[float] = ()) -> list[Column]:
    """MAE, RMSE, R² (= 1 − SSE / (n · var_pop(y)); of a constant target 1 if all errors are 0, else 0)
    and % of rows within each tolerance."""
    y = F.col(actual).cast("double")
    p = clip_zero(prediction) if clip else F.col(prediction).cast("double")
    err = y - p
    cols = [F.count(F.lit(1)).cast("long").alias("rows"),
            F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
            F.coalesce(1 - F.try_divide(F.sum(err * err), F.var_pop(y) * F.count(y)),
                       F.when(F.sum(err * err) == 0, 1.0).when(F.count(y) > 0, 0.0)).alias("r2")]
    for k in within:
        cols.append((F.avg(F.when(F.abs(err) <= k, 1.0).otherwise(0.0)) * 100).alias(f"within_{int(k)}_pct"))
    return cols


def regression_metrics(long: DataFrame, group: Sequence[str] = (), actual: str = "actual",
                       prediction: str = "prediction", clip: bool = False, within: Sequence[float] = ()) -> DataFrame:
    """All (model, split) groups in one job."""
    cols = metric_columns(actual, prediction, clip, within)
    return long.groupBy(*group).agg(*cols) if group else long.agg(*cols)


def ttl_metrics(long: DataFrame, group: Sequence[str] = ("model", "split"), actual: str = "actual",
                prediction: str = "prediction") -> DataFrame:
    """Clipped at zero; MAE, RMSE, R², within 1 and 2 weeks (inclusive)."""
    return regression_metrics(long, group, actual, prediction, clip=True, within=(1, 2))


def prediction_table(scored: DataFrame, ids: Sequence[str], actual: str, models: Sequence[str]) -> DataFrame:
    """Ids, actual, and per model the clipped prediction and its absolute error.
    ``scored`` carries one prediction column per model (named after the model)."""
    out = [*ids, F.col(actual).alias("actual")]
    for m in models:
        p = clip_zero(m)
        out += [p.alias(f"predicted_{m}"), F.abs(F.col(actual) - p).alias(f"abs_error_{m}")]
    return scored.select(*out)
