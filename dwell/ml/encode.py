"""Preprocessing as a fitted, persistable Spark ML PipelineModel.

* M01 exact median imputation (linear interpolation, distributed ``exact_quantiles``) — Spark's
  ``Imputer`` median is approximate, so the constants are learnt by Spark and applied by a
  ``SQLTransformer`` (persisted with the pipeline).
* M02 mode imputation, ties -> smallest value. Modes and the sorted category labels come from ONE
  (column, value) count aggregate; the ``StringIndexerModel`` is built from those labels.
* M03 / M04 one-hot with sorted categories: ``StringIndexer(alphabetAsc, keep)`` puts unseen and
  null at the last index; ``OneHotEncoder(dropLast=True)`` turns that index into all zeros;
  drop-first (linear models) slices the first slot away with ``VectorSlicer``.
* M05 the categorical block comes first, then the numeric block; names ``category__x_v`` /
  ``number__x``. M06 groups map every source feature to its encoded positions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MAX_CATEGORIES = 10_000   # distinct values of a categorical feature; more is an error, before any reach the driver


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(float(v))


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """M01 fit: exact interpolated medians of all columns in one distributed plan (nulls skipped)."""
    if not columns:
        return {}
    from dwell.operators.ranking import exact_quantiles
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                         for c in columns])).alias("e")).select("e.column", "e.value")
    found = {r["column"]: r["quantile"] for r in exact_quantiles(long, ["column"], "value", [0.5]).collect()}
    return {c: found.get(c) for c in columns}


def category_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, list[tuple[str, int]]]:
    """Non-null value counts per categorical column (as text), one job: all columns exploded to
    (column, value) and counted with map-side partial aggregation. Categorical features have few
    distinct values (``MAX_CATEGORIES`` at most), so the result is driver-sized."""
    if not columns:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                for c in columns]))
    counts = (df.select(pairs.alias("p")).select("p.column", "p.value").filter(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    return _collected(counts, columns, "value")


def _collected(counts: DataFrame, columns: Sequence[str], value: str) -> dict[str, list[tuple[str, int]]]:
    """Counts (column, value, n) on the driver; more than ``MAX_CATEGORIES`` for a column are an error."""
    most = len(columns) * MAX_CATEGORIES
    out: dict[str, list[tuple[str, int]]] = {c: [] for c in columns}
    for r in counts.limit(most + 1).collect():
        out[r["column"]].append((r[value], int(r["n"])))
    large = [c for c, v in out.items() if len(v) > MAX_CATEGORIES]
    if large:
        raise ValueError(f"more than {MAX_CATEGORIES} categories: {', '.join(large)}")
    return out


def fit_statistics(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str]):
    """One scan of the fit set: every feature is exploded to (column, text, number) and counted
    per distinct value (map-side partial aggregation). Category lists / counts come from the
    categorical rows (driver-sized); exact medians of the numeric columns are computed by Spark
    from the numeric rows of the same count table."""
    from pyspark import StorageLevel

    from dwell.operators.ranking import quantiles_from_counts

    cats, nums = list(categorical), list(numeric)
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text"),
                        F.lit(None).cast("double").alias("number")) for c in cats]
    entries += [F.struct(F.lit(c).alias("column"), F.lit(None).cast("string").alias("text"),
                         F.col(c).cast("double").alias("number")) for c in nums]
    if not entries:
        return {}, {}
    counts = (df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
              .filter(F.col("text").isNotNull() | F.col("number").isNotNull())
              .groupBy("column", "text", "number").agg(F.count(F.lit(1)).alias("n"))
              .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        cat_counts = _collected(counts.filter(F.col("column").isin(cats)).select("column", "text", "n"), cats, "text") if cats else {}
        med: dict[str, float | None] = {c: None for c in nums}
        if nums:
            numeric_counts = counts.filter(F.col("column").isin(nums) & F.col("number").isNotNull())
            q = quantiles_from_counts(numeric_counts, ["column"], "number", "n", [0.5])
            med.update({r["column"]: r["quantile"] for r in q.collect()})
    finally:
        counts.unpersist()
    return med, cat_counts


def modes_from_counts(counts: dict[str, list[tuple[str, int]]]) -> dict[str, str | None]:
    """Most frequent value, ties -> smallest value."""
    return {c: (min(vals, key=lambda vn: (-vn[1], vn[0]))[0] if vals else None) for c, vals in counts.items()}


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """M02 fit on ``df``."""
    return modes_from_counts(category_counts(df, columns))


@dataclass
class Encoded:
    """A fitted preprocessor and its layout."""
    model: PipelineModel
    features_col: str
    names: list[str]
    groups: dict[str, list[int]] = field(default_factory=dict)
    medians: dict[str, float | None] = field(default_factory=dict)
    modes: dict[str, str | None] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def fit_preprocessor(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], drop_first: bool,
                     features_col: str = "features") -> Encoded:
    """Fit imputation + encoding on ``df`` (the fit set) and return the fitted pipeline."""
    cats, nums = list(categorical), list(numeric)
    med, counts = fit_statistics(df, cats, nums)
    mod = modes_from_counts(counts)
    select = ["*"]
    for c in cats:
        fill = mod.get(c)
        expr = f"CAST({_q(c)} AS STRING)"
        select.append(f"coalesce({expr}, {_lit(fill)}) AS {_q('__cat_' + c)}" if fill is not None
                      else f"{expr} AS {_q('__cat_' + c)}")
    for c in nums:
        fill = med.get(c)
        expr = f"CAST({_q(c)} AS DOUBLE)"
        select.append(f"coalesce({expr}, {_lit(fill)}) AS {_q('__num_' + c)}" if fill is not None
                      else f"{expr} AS {_q('__num_' + c)}")
    impute = SQLTransformer(statement=f"SELECT {', '.join(select)} FROM __THIS__")
    stages = [impute]
    names: list[str] = []
    groups: dict[str, list[int]] = {}
    assembled: list[str] = []
    if cats:
        imputed = impute.transform(df)
        # sorted labels (alphabetAsc); unseen / null -> index len(labels) ("keep") -> all zeros below
        # (one model per column: the multi-column constructor pads ragged label arrays with nulls)
        labels_array = [sorted(v for v, _ in counts[c]) or [str(mod.get(c))] for c in cats]
        indexers = [StringIndexerModel.from_labels(labels, inputCol=f"__cat_{c}", outputCol=f"__idx_{c}",
                                                   handleInvalid="keep") for c, labels in zip(cats, labels_array)]
        indexed = imputed
        for ix in indexers:
            indexed = ix.transform(indexed)
        encoder = OneHotEncoder(inputCols=[f"__idx_{c}" for c in cats], outputCols=[f"__oh_{c}" for c in cats],
                                dropLast=True, handleInvalid="error")
        encoder_model = encoder.fit(indexed)
        stages += [*indexers, encoder_model]
        for c, labels in zip(cats, labels_array):
            labels = list(labels)
            kept = labels[1:] if drop_first else labels
            if not kept:
                continue
            col = f"__oh_{c}"
            if drop_first:
                stages.append(VectorSlicer(inputCol=col, outputCol=f"__ohs_{c}", indices=list(range(1, len(labels)))))
                col = f"__ohs_{c}"
            start = len(names)
            names += [f"category__{c}_{v}" for v in kept]
            groups[c] = list(range(start, len(names)))
            assembled.append(col)
    for c in nums:
        groups[c] = [len(names)]
        names.append(f"number__{c}")
        assembled.append(f"__num_{c}")
    if not assembled:
        raise ValueError("no features to encode")
    stages.append(VectorAssembler(inputCols=assembled, outputCol=features_col, handleInvalid="keep"))
    return Encoded(PipelineModel(stages=stages), features_col, names, groups, med, mod)


def layout(enc: Encoded) -> list[tuple[str, int, int]]:
    """(feature, first position, size) of every encoded source feature."""
    return [(f, pos[0], len(pos)) for f, pos in enc.groups.items()]
