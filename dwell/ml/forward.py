"""Forward feature selection over rolling folds with Gram matrices.

The rows are encoded once, as codes over the categories of all slices, and ONE pass over the codes
gives an augmented Gram matrix [X y 1]ᵀ[X y 1] for each date slice. Grams are additive, so a fold's is
the sum of its slices'; what depends on the fold (its categories, which of them is dropped, what nulls
are filled with) is a small linear map from the columns of all slices to the fold's. Every trial OLS
(selected + candidate source features, all dummies of a feature together) is then solved on the
driver from Gram sub-blocks: p is the encoded width (tens of columns), so the driver only holds
model-sized matrices. Validation MAE needs the rows, so each round runs ONE scoring job that
evaluates every (candidate, fold) coefficient vector on the codes and sums the absolute errors.

The OLS solution mirrors least squares with an intercept on centred data: β = pinv(Sxx)·Sxy,
β0 = ȳ − x̄ᵀβ, on columns scaled to unit spread, so a small-scale feature beside a large one is kept; the
minimum-norm solution when the encoded columns are collinear.
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.ml.encode import modes_from_counts
from dwell.ml.slices import SliceCounts
from dwell.operators.ranking import materialize
from dwell.operators.splits import SlicedFolds

RCOND = 1e-10
CHUNK = 8192              # rows turned into dense columns at a time
BLOCKS = 16               # blocks of rows that a worker is handed at a time


def _gram_partials(batches):
    acc: dict[str, np.ndarray] = {}
    for batch in batches:
        folds, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "y"))
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
        z = np.column_stack([x, y, np.ones(len(y))])
        for fold in set(folds):
            own = z[folds == fold]
            acc[fold] = acc.get(fold, 0) + own.T @ own
    for fold, g in acc.items():
        yield pa.RecordBatch.from_pydict({"fold": pa.array([fold], pa.string()), "g": pa.array([g.ravel()], pa.list_(pa.float64()))})


def fold_grams(rows: DataFrame, widths: dict[str, int]) -> dict[str, np.ndarray]:
    """(fold, x array, y) rows -> per fold the augmented Gram [X y 1]ᵀ[X y 1] (driver-sized). The arrays of all
    folds have the same length."""
    parts = rows.select("fold", "x", "y").mapInArrow(_gram_partials, "fold string, g array<double>")
    summed = (parts.select("fold", F.posexplode("g").alias("pos", "v"))
              .groupBy("fold", "pos").agg(F.sum("v").alias("v")))
    out: dict[str, np.ndarray] = {}
    for fold, grp in summed.toPandas().groupby("fold"):
        k = widths[fold] + 2
        arr = np.zeros(k * k)
        arr[grp["pos"].to_numpy()] = grp["v"].to_numpy()
        out[fold] = arr.reshape(k, k)
    return out


def ols_from_gram(g: np.ndarray, idx: Sequence[int]) -> tuple[np.ndarray, float]:
    """Coefficients (for ``idx`` columns) and intercept of OLS with intercept, from the Gram."""
    p = g.shape[0] - 2
    n = g[p + 1, p + 1]
    sx = g[idx, p + 1]
    sy = g[p, p + 1]
    xbar, ybar = sx / n, sy / n
    sxx = g[np.ix_(idx, idx)] - n * np.outer(xbar, xbar)
    sxy = g[idx, p] - n * xbar * ybar
    spread = np.diag(sxx)
    scale = np.where(spread > 1e-12 * np.diag(g)[idx], np.sqrt(np.clip(spread, 0, None)), np.inf)  # constant columns: 0
    beta = np.linalg.pinv(sxx / np.outer(scale, scale), rcond=RCOND, hermitian=True) @ (sxy / scale) / scale
    return beta, float(ybar - xbar @ beta)


class _Columns:
    """Columns of all slices side by side: each category's indicator and one for null, each number (null:
    0) and an indicator of its null."""

    def __init__(self, counts: SliceCounts):
        self.categorical, self.numeric = counts.categorical, counts.numeric
        every = counts.text_counts([1 << 30])[1 << 30] if self.categorical else {}
        self.labels = {c: [v for v, _ in every[c]] for c in self.categorical}
        self.first: dict[str, int] = {}
        self.width = 0
        for c in (*self.categorical, *self.numeric):
            self.first[c] = self.width
            self.width += len(self.labels[c]) + 1 if c in self.labels else 2

    def null(self, c: str) -> int:
        return self.first[c] + (len(self.labels[c]) if c in self.labels else 1)

    def encoded(self, rows: DataFrame, target: str) -> DataFrame:
        """Blocks of rows of a slice: (slice, codes, numbers, y), a block for each slice of a batch."""
        kept = rows.select("slice", F.col(target).cast("double").alias("y"), *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(self.categorical)],
                           *[F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate(self.numeric)])
        return kept.mapInArrow(self._blocks, "slice int, codes binary, numbers binary, y binary")

    def _blocks(self, batches):
        for batch in batches:
            slices, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("slice", "y"))
            codes = np.zeros((len(self.categorical), len(batch)), dtype=np.int32)
            for i, c in enumerate(self.categorical):
                places = pa.compute.index_in(batch.column(f"c{i}"), value_set=pa.array(self.labels[c], pa.string())).fill_null(len(self.labels[c]))
                codes[i] = places.to_numpy(zero_copy_only=False) + self.first[c]
            numbers = np.array([batch.column(f"n{i}").to_numpy(zero_copy_only=False) for i in range(len(self.numeric))]).reshape(-1, len(batch))
            for s in np.unique(slices):
                own = slices == s
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (codes[:, own], numbers[:, own], y[own])]],
                    names=["slice", "codes", "numbers", "y"])

    def read(self, row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y = np.frombuffer(row["y"])
        return np.frombuffer(row["codes"], dtype=np.int32).reshape(-1, len(y)), np.frombuffer(row["numbers"]).reshape(-1, len(y)), y

    def dense(self, codes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[1], self.width))
        at = np.arange(len(out))
        for code in codes:
            out[at, code] = 1.0
        for c, x in zip(self.numeric, numbers):
            out[:, self.first[c]], out[:, self.null(c)] = np.where(np.isnan(x), 0.0, x), np.isnan(x)
        return out

    def grams(self, blocks: DataFrame) -> dict[int, np.ndarray]:
        """The augmented Gram matrix of each slice."""
        def run(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    codes, numbers, y = self.read(row)
                    for at in range(0, len(y), CHUNK):
                        part = slice(at, at + CHUNK)
                        z = np.column_stack([self.dense(codes[:, part], numbers[:, part]), y[part], np.ones(len(y[part]))])
                        sums[row["slice"]] = sums.get(row["slice"], 0) + z.T @ z
            for s, g in sums.items():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "g": pa.array([g.ravel()], pa.list_(pa.float64()))})

        size = self.width + 2
        summed = (blocks.mapInArrow(run, "slice int, g array<double>").select("slice", F.posexplode("g").alias("at", "v"))
                  .groupBy("slice", "at").agg(F.sum("v").alias("v")).toPandas())
        out = {}
        for s, part in summed.groupby("slice"):
            flat = np.zeros(size * size)
            flat[part["at"].to_numpy()] = part["v"].to_numpy()
            out[int(s)] = flat.reshape(size, size)
        return out


class _Fold:
    """A fold's encoded columns as combinations of the columns of all slices, and its Gram matrix."""

    def __init__(self, columns: _Columns, upto: int, texts, medians, grams):
        self.groups: dict[str, list[int]] = {}
        parts: list[np.ndarray] = []
        for c in columns.categorical:
            present, mode = [v for v, _ in texts[c]], modes_from_counts(texts)[c]
            for v in present[1:]:                              # the first category is dropped
                one = np.zeros(columns.width)
                one[columns.first[c] + columns.labels[c].index(v)] = 1.0
                one[columns.null(c)] = float(v == mode)
                self.groups.setdefault(c, []).append(len(parts))
                parts.append(one)
        for c in columns.numeric:
            one = np.zeros(columns.width)
            one[columns.first[c]], one[columns.null(c)] = 1.0, medians.get((upto, c)) or 0.0
            self.groups[c] = [len(parts)]
            parts.append(one)
        self.map = np.array(parts).reshape(-1, columns.width).T
        whole = sum(g for s, g in grams.items() if s <= upto)
        wide = np.zeros((columns.width + 2, self.map.shape[1] + 2))
        wide[:-2, :-2], wide[-2, -2], wide[-1, -1] = self.map, 1.0, 1.0
        self.gram = wide.T @ whole @ wide

    def trial(self, features: Sequence[str]) -> np.ndarray:
        """Coefficients over the columns of all slices, then the intercept, of OLS on ``features``."""
        out = np.zeros(len(self.map) + 1)
        idx = [i for f in features for i in self.groups.get(f, [])]
        if idx:
            beta, out[-1] = ols_from_gram(self.gram, idx)
            out[:-1] = self.map[:, idx] @ beta
        else:
            out[-1] = self.gram[-2, -1] / self.gram[-1, -1]
        return out


@contextmanager
def few_blocks(spark: SparkSession):
    """Inside, a worker gets ``BLOCKS`` rows at a time: a row is a block here, and the usual 10,000 would be a
    whole partition."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    spark.conf.set(name, str(BLOCKS))
    try:
        yield
    finally:
        spark.conf.set(name, held)


def forward_select(folds: SlicedFolds, categorical: Sequence[str], numeric: Sequence[str], target: str,
                   candidates: Sequence[str] | None = None, minimum_improvement: float = 1.0) -> tuple[list[str], list[dict]]:
    """Greedy forward selection by mean validation MAE over folds (M11 = one fold).

    Returns (selected features, history rows)."""
    candidates = list(candidates or [*categorical, *numeric])
    counts = SliceCounts(folds.rows, categorical, numeric)
    columns = _Columns(counts)
    blocks = materialize(columns.encoded(folds.rows, target))
    with few_blocks(blocks.sparkSession):
        grams = columns.grams(blocks)
    ends = sorted({a for a, _ in folds.ends})
    texts = counts.text_counts(ends) if columns.categorical else {a: {} for a in ends}
    medians = counts.medians([c for c in counts.incomplete() if c in columns.numeric], ends)
    fits = {name: _Fold(columns, a, texts[a], medians, grams) for name, (a, _) in zip(folds.names, folds.ends)}

    rounds: list[pd.Series] = []      # per accepted round the winner's MAE by fold, named after it
    while len(rounds) < len(candidates):
        chosen = [r.name for r in rounds]
        trials = [c for c in candidates if c not in chosen]
        coefs = [np.column_stack([fits[name].trial([*chosen, c]) for c in trials]) for name in folds.names]
        with few_blocks(blocks.sparkSession):
            errors = _trial_errors(columns, blocks, folds, coefs, trials)
        rounds.append(errors.loc[errors.mean(axis=1).idxmin()])       # ties: first in candidate order
        if len(rounds) > 1 and rounds[-2].mean() - rounds[-1].mean() < minimum_improvement:
            rounds.pop()
            break
    return [r.name for r in rounds], selection_history(rounds)


def _trial_errors(columns: _Columns, blocks: DataFrame, folds: SlicedFolds, coefs: Sequence[np.ndarray], trials: Sequence[str]) -> pd.DataFrame:
    """Validation MAE of every trial (rows, in order) on every fold (columns): one scoring job."""
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                own = [k for k, (a, b) in enumerate(folds_ends) if a < row["slice"] <= b]
                codes, numbers, y = columns.read(row) if own else (None, None, None)
                for k in own:
                    b = coefs[k]
                    guess = np.zeros((len(y), b.shape[1])) + b[-1]
                    for code in codes:
                        guess += b[code]
                    for c, x in zip(columns.numeric, numbers):
                        null = np.isnan(x)
                        guess += np.where(null, 0.0, x)[:, None] * b[columns.first[c]] + null[:, None] * b[columns.null(c)]
                    part = np.append(np.abs(y[:, None] - guess).sum(axis=0), len(y))
                    sums[k] = sums.get(k, 0) + part
        for k, v in sums.items():
            yield pa.RecordBatch.from_pydict({"fold": pa.array([k] * len(trials), pa.int32()), "trial": pa.array(range(len(trials)), pa.int32()),
                                              "s": v[:-1], "n": np.full(len(trials), v[-1])})

    folds_ends = tuple(folds.ends)
    found = (blocks.mapInArrow(run, "fold int, trial int, s double, n double").groupBy("fold", "trial")
             .agg((F.sum("s") / F.sum("n")).alias("mae")).toPandas())
    table = found.pivot(index="trial", columns="fold", values="mae").sort_index()
    return table.set_axis(list(trials), axis=0)[list(range(len(folds.names)))].set_axis(list(folds.names), axis=1)


def selection_history(rounds: Sequence[pd.Series]) -> list[dict]:
    """One row per added feature, derived from the winners' MAEs by fold."""
    if not rounds:
        return []
    table = pd.DataFrame([r.to_numpy() for r in rounds], columns=[f"fold_{i}_mae" for i in range(1, len(rounds[0]) + 1)])
    mean = table.mean(axis=1)
    out = table.assign(step=range(1, len(rounds) + 1), added_feature=[r.name for r in rounds], mean_rolling_mae=mean,
                       std_rolling_mae=table.std(axis=1, ddof=0), mae_improvement=-mean.diff())
    return [{k: None if k == "mae_improvement" and i == 0 else v for k, v in row.items()}
            for i, row in enumerate(out.to_dict("records"))]
