"""Boosting on histograms: shrinkage, exact splits, folds, subsamples, blocks and the Spark ML model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwell.ml import boosting as B
from dwell.ml import models as ML
from dwell.ml.slices import SliceCounts

BASE = {"n_estimators": 3, "learning_rate": 0.1, "max_depth": 2, "min_samples_leaf": 1, "subsample": 1.0, "random_state": 42}


def groups(spark):
    return spark.createDataFrame([(0, g, float(i % 7), m) for g, m in (("a", 2.0), ("b", 12.0), ("c", 22.0)) for i in range(20)],
                                 "slice int, g string, x double, y double")


@pytest.mark.parametrize("trees, want", [(1, (11.0, 12.0, 13.0)), (3, (9.29, 12.0, 14.71)), (50, tuple(12 + (1 - 0.9 ** 50) * d for d in (-10, 0, 10)))])
def test_every_tree_is_shrunk(spark, trees, want):
    model = ML.fit_boosting(groups(spark), ["g"], [], "y", {**BASE, "n_estimators": trees})
    got = {r["g"]: r["prediction"] for r in model.predict(groups(spark).select("g").distinct(), keep=["g"]).collect()}
    assert [got[g] for g in "abc"] == pytest.approx(want)


def noisy(spark, n=400, slices=3):
    r = np.random.default_rng(3)
    rows = [(int(r.integers(slices)), str(r.choice(list("abcd"))), None if r.random() < 0.1 else str(r.choice(list("xyz"))),
             float(r.integers(0, 40)), None if r.random() < 0.1 else float(np.round(r.normal(), 2)), float(r.normal())) for _ in range(n)]
    rows = [(s, a, b, x, z, y + (3.0 if a == "b" else 0.0) + x / 10) for s, a, b, x, z, y in rows]
    return rows, spark.createDataFrame(rows, "slice int, a string, b string, x double, z double, y double")


def plain_boosting(rows, params):
    """Exhaustive search over encoded columns, one tree after the other; rows of one fit set."""
    def mode(vs):
        return min(set(vs), key=lambda v: (-vs.count(v), v))
    a, b = [r[1] for r in rows], [r[2] for r in rows]
    b = [mode([v for v in b if v is not None]) if v is None else v for v in b]
    z = [r[4] for r in rows]
    z = [float(np.median([v for v in z if v is not None])) if v is None else v for v in z]
    columns = [np.array([v == k for v in col], dtype=float) for col in (a, b) for k in sorted(set(col))] + [np.array([r[3] for r in rows]), np.array(z)]
    y = np.array([r[5] for r in rows])
    guess = np.full(len(y), y.mean())

    def grow(idx, depth, res):
        best = None
        if depth:
            for c in columns:
                values = np.unique(c[idx])
                for lo, hi in zip(values, values[1:]):
                    left = c[idx] <= (lo + hi) / 2
                    if min(left.sum(), (~left).sum()) < params["min_samples_leaf"]:
                        continue
                    gain = left.sum() * res[idx][left].mean() ** 2 + (~left).sum() * res[idx][~left].mean() ** 2
                    if best is None or gain > best[0] + 1e-9:
                        best = gain, left
        if best is None:
            out = np.zeros(len(y))
            out[idx] = res[idx].mean()
            return out
        return grow(idx[best[1]], depth - 1, res) + grow(idx[~best[1]], depth - 1, res)

    for _ in range(params["n_estimators"]):
        guess = guess + params["learning_rate"] * grow(np.arange(len(y)), params["max_depth"], y - guess)
    return y, guess


def test_equals_exhaustive_search(spark):
    rows, df = noisy(spark)
    params = {**BASE, "n_estimators": 6, "max_depth": 3, "min_samples_leaf": 5, "learning_rate": 0.3}
    y, guess = plain_boosting([r for r in rows if r[0] <= 1], params)
    (_,), errors = B.fit(df, ["a", "b"], ["x", "z"], "y", [B.Spec(1, 2, params, (6,))])
    train = next(e for e in errors if e["role"] == "train")
    assert train["mae"] == pytest.approx(np.abs(y - guess).mean()) and train["rmse"] == pytest.approx(np.sqrt(((y - guess) ** 2).mean()))
    assert train["r2"] == pytest.approx(1 - ((y - guess) ** 2).sum() / ((y - y.mean()) ** 2).sum())


@pytest.mark.parametrize("subsample", [1.0, 0.7])
def test_blocks_and_partitions_do_not_matter(spark, subsample):
    _, df = noisy(spark)
    specs = [B.Spec(a, 2, {**BASE, "n_estimators": 11, "max_depth": d, "min_samples_leaf": 4, "subsample": subsample}, (5, 11)) for a, d in ((0, 2), (1, 3))]
    one = B.fit(df, ["a", "b"], ["x", "z"], "y", specs)
    for other in (B.fit(df.repartition(11), ["a", "b"], ["x", "z"], "y", specs), B.fit(df.repartition(3), ["a", "b"], ["x", "z"], "y", specs, block_rows=90)):
        for mine, theirs in zip(one[0], other[0]):
            assert mine.mean == pytest.approx(theirs.mean) and len(mine.trees) == len(theirs.trees) == 11
            for s, t in zip(mine.trees, theirs.trees):
                assert s.split.tolist() == t.split.tolist() and s.value == pytest.approx(t.value) and s.n.tolist() == t.n.tolist()
        for mine, theirs in zip(one[1], other[1]):
            assert mine == pytest.approx(theirs)


def test_subsample_takes_its_share(spark):
    key = np.arange(100_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bags = [B.in_bag(key, t, 42, 0.8) for t in range(3)]
    assert all(abs(bag.mean() - 0.8) < 0.01 for bag in bags) and abs((bags[0] & bags[1]).mean() - 0.64) < 0.01


def test_spark_model_predicts_the_same(spark):
    _, df = noisy(spark)
    params = {**BASE, "n_estimators": 9, "max_depth": 3, "min_samples_leaf": 3}
    _, errors = B.fit(df.withColumn("slice", F.lit(0)), ["a", "b"], ["x", "z"], "y", [B.Spec(0, 0, params, (9,))], keep=False)
    model = ML.fit_boosting(df, ["a", "b"], ["x", "z"], "y", params)
    mae = model.predict(df, keep=["y"]).select(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert mae == pytest.approx(errors[0]["mae"]) and sum(v for _, v in ML.encoded_importance(model)) == pytest.approx(1.0)
    assert ML.encoded_importance(model)[0][0] in ("category__a_b", "number__x")


def test_many_values_get_quantile_bins(spark):
    df = spark.range(3000).select(F.lit(0).alias("slice"), (F.col("id") * 7 % 3000).cast("double").alias("x"), (F.col("id") * 7 % 3000 > 1500).cast("double").alias("y"))
    (model,), errors = B.fit(df, [], ["x"], "y", [B.Spec(0, 0, {**BASE, "n_estimators": 1, "learning_rate": 1.0, "max_depth": 3}, (1,))])
    assert len(model.layout.cuts[0]) <= B.MAX_BINS + 1 and errors[0]["mae"] < 0.01


def test_odd_tables(spark):
    ddl = "slice int, g string, x double, y double"
    same = spark.createDataFrame([(0, "a", 1.0, 5.0)] * 30 + [(1, "new", None, 6.0)], ddl)
    (model,), errors = B.fit(same, ["g"], ["x"], "y", [B.Spec(0, 1, BASE, (3,))])
    assert model.mean == 5.0 and all(t.split[0] == -1 for t in model.trees)
    assert {e["role"]: e["mae"] for e in errors} == {"train": 0.0, "validation": 1.0}
    with pytest.raises(ValueError, match="y: 1 null"):
        B.fit(spark.createDataFrame([(0, "a", 1.0, None)], ddl), ["g"], ["x"], "y", [B.Spec(0, 0, BASE)])
    with pytest.raises(ValueError, match="0 rows"):
        B.fit(spark.createDataFrame([], ddl), ["g"], ["x"], "y", [B.Spec(0, 0, BASE)])


def test_slice_counts(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (0, "b", None), (1, "b", 3.0), (2, None, 8.0)], "slice int, g string, x double")
    counts = SliceCounts(df, ["g"], ["x"])
    assert counts.incomplete() == ["g", "x"]
    assert counts.text_counts([0, 2])[0]["g"] == [("a", 1), ("b", 1)] and counts.text_counts([0, 2])[2]["g"] == [("a", 1), ("b", 2)]
    assert counts.medians(["x"], [0, 1, 2]) == {(0, "x"): 1.0, (1, "x"): 2.0, (2, "x"): 3.0}
    assert counts.fills([0, 1]) == {0: {"g": "a", "x": 1.0}, 1: {"g": "b", "x": 2.0}}


def test_too_many_categories_are_an_error(spark, monkeypatch):
    from dwell.ml import encode, slices
    monkeypatch.setattr(encode, "MAX_CATEGORIES", 3)
    monkeypatch.setattr(slices, "MAX_CATEGORIES", 3)
    df = spark.range(10).select(F.lit(0).alias("slice"), F.col("id").cast("string").alias("g"))
    for ask in (lambda: SliceCounts(df, ["g"], []), lambda: encode.fit_preprocessor(df, ["g"], [], False), lambda: encode.modes(df, ["g"])):
        with pytest.raises(ValueError, match="categories: g"):
            ask()


@pytest.mark.parametrize("subsample", [1.0, 0.9])
def test_few_kinds_of_rows_do_not_matter(spark, subsample):
    """Two categoricals, one with nulls that folds fill differently: one block, many blocks, and kinds of rows."""
    _, df = noisy(spark)
    specs = [B.Spec(a, 2, {**BASE, "n_estimators": 30, "min_samples_leaf": 4, "subsample": subsample}, (5, 30)) for a in (0, 1)]
    one, other = (B.fit(df, ["a", "b"], [], "y", specs, block_rows=n) for n in (B.BLOCK_ROWS, 90))
    for mine, theirs in zip(one[0], other[0]):
        assert [t.split.tolist() for t in mine.trees] == [t.split.tolist() for t in theirs.trees] and mine.mean == pytest.approx(theirs.mean)
    for mine, theirs in zip(one[1], other[1]):
        assert mine == pytest.approx(theirs)


def test_jobs_do_not_grow_with_trees_on_few_kinds(spark):
    """Growth on one categorical takes the same jobs whatever the trees."""
    _, df = noisy(spark)
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for trees in (2, 40):
        spark.sparkContext.setJobGroup(f"kinds-{trees}", "")
        B.fit(df, ["a"], [], "y", [B.Spec(0, 2, {**BASE, "n_estimators": trees}, (trees,))], block_rows=90)
        jobs.append(len(tracker.getJobIdsForGroup(f"kinds-{trees}")))
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs[0] == jobs[1]


def test_large_tables_are_cut_into_small_blocks(spark):
    rows = spark.range(B.PART_ROWS * 3).select(F.lit(0).alias("slice"), (F.col("id") % 5).cast("string").alias("g"), F.lit(1.0).alias("y"))
    layout = B.layout_of(SliceCounts(rows, ["g"], []), {})
    sizes = [len(r["y"]) // 8 for r in B.pack(rows, "y", layout, B.PART_ROWS * 2).select("y").collect()]
    assert sum(sizes) == B.PART_ROWS * 3 and len(sizes) == 3 and max(sizes) < 1.1 * B.PART_ROWS


@pytest.mark.parametrize("subsample, depth", [(1.0, 2), (0.8, 5)])
def test_held_rows_in_chunks(subsample, depth, monkeypatch):
    """Rows of several chunks, some after the validation slice: nodes, counts and residuals are those of plain trees."""
    monkeypatch.setattr(B, "CHUNK", 100)
    r = np.random.default_rng(5)
    n = 1003
    codes = np.stack([r.integers(0, 4, n), r.integers(0, 30, n), r.integers(0, 9, n)])
    first = np.array([0, 5, 36, 46])
    layout = B.Layout(["g", "x", "z"], [list("abcd"), None, None], [None, np.arange(30.0), np.arange(9.0)], first, np.repeat(np.arange(3), np.diff(first)),
                      np.repeat([False, True, True], np.diff(first)), np.arange(46.0), np.arange(46.0))
    y, key, at = codes[1] / 3 + 4 * (codes[0] == 2) + r.normal(size=n), r.integers(0, 2 ** 63, n).astype(np.uint64), r.integers(0, 4, n).astype(np.int32)
    halves = [{"codes": codes[:, k].astype(np.uint8).tobytes(), "y": y[k].tobytes(), "keys": key[k].tobytes(), "slices": at[k].tobytes()}
              for k in (slice(0, 400), slice(400, n))]
    part = B.Part.joined(layout, halves, True)
    spec = B.Spec(1, 2, {**BASE, "max_depth": depth, "min_samples_leaf": 3, "learning_rate": 0.3, "subsample": subsample})
    held, bags = B.Held(layout, part, spec, {}), B.Bags(part)
    order = np.lexsort((y, key, at))
    fit, rows = int((at <= 1).sum()), int((at <= 2).sum())
    flat, guess = codes[:, order] + first[:3, None], np.full(n, y[at <= 1].mean())
    groups = B.groups_of(layout, flat)
    for t in range(6):
        tree = held.grow(bags.of(t, spec, held.n_fit))
        inside = (np.arange(n) < fit) & B.in_bag(key[order], t, 42, subsample)
        want, _ = B.grow_tree(layout, flat, groups, y[order] - guess, inside, depth, 3)
        assert tree.split.tolist() == want.split.tolist() and tree.n.tolist() == want.n.tolist() and np.allclose(tree.value, want.value)
        guess += 0.3 * want.value[want.leaves(layout, flat)]
    held.settle()
    assert held.n == rows < n and np.allclose(held.residual, (y[order] - guess)[:rows])


def test_work_is_dealt_evenly(spark):
    assert sorted(sum(w) for w in ([[5, 4, 3, 3, 3][i] for i in deal] for deal in B.dealt_by_work([5, 4, 3, 3, 3], 2))) == [8, 10]
    keys = B.task_keys(spark, 7)
    ids = spark.createDataFrame([(k,) for k in keys], "k int").repartition(7, "k").rdd.glom().map(len).collect()
    assert len(keys) == 7 and ids == [1] * 7


def test_rounds_count_the_smaller_child():
    """What the driver makes of the smaller children's histograms are those of all open nodes."""
    r = np.random.default_rng(9)
    m = B._Growing(B.Spec(0, 0, {**BASE, "max_depth": 3}), 0.0)
    sides = [r.integers(1, 9, (2, 5)).astype(float) for _ in range(2)]
    m.open(np.stack([sides[0] + sides[1]], axis=1), tuple(np.array([v]) for v in (2, 0, 0, 0, 9.0, 0, 7.0)), np.array([0]))
    assert m.counted.tolist() == [2] and m.nodes.tolist() == [1, 2] and m.level == 1
    assert np.array_equal(m.whole(sides[1][:, None]), np.stack(sides, axis=1))


def test_bins_without_rows_take_no_split():
    """What is left of sums of a bin without rows must not draw the threshold away from the values that a node has."""
    layout = B.Layout(["x"], [None], [np.arange(4.0)], np.array([0, 5]), np.zeros(5, dtype=np.int64), np.ones(5, dtype=bool), np.array([0, 1, 2, 3, np.nan]), np.array([0, 1, 2, 3, np.nan]))
    split, threshold, *_ = B.best_splits(layout, np.array([[[-5.0, -1e-9, 0, 5.0, 0]], [[5.0, 0, 0, 5.0, 0]]]), 1)
    assert (split[0], threshold[0]) == (1, 1.5)
