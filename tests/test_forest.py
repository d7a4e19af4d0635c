"""Forest on histograms: exhaustive search, partitions, blocks, bootstrap weights and the Spark ML model."""

import numpy as np
import pytest

from dwell.ml import forest
from dwell.ml import models as ML
from test_boosting import groups, noisy, plain_boosting

ONE_TREE = {"n_estimators": 1, "max_depth": 3, "min_samples_leaf": 4, "max_features": 1.0, "random_state": 42, "bootstrap": False}
SMALL = {"n_estimators": 4, "max_depth": 5, "min_samples_leaf": 5, "max_features": 0.8, "random_state": 42}


def nodes_of(df, params, **more):
    enc = ML.fit_preprocessor(df, ["a", "b"], ["x", "z"], drop_first=False)
    plan, nodes = forest.fit(df, ["a", "b"], ["x", "z"], "y", params, ML._positions(enc, ["a", "b"], ["x", "z"]), **more)
    return plan, sorted(map(tuple, nodes.collect()))


def same(one, other):
    assert [r[:3] for r in one] == [r[:3] for r in other]
    assert np.allclose([r[3:] for r in one], [r[3:] for r in other])


def test_one_tree_is_the_one_of_exhaustive_search(spark):
    rows, df = noisy(spark)
    model = ML.fit_forest(df, ["a", "b"], ["x", "z"], "y", ONE_TREE)
    _, want = plain_boosting(rows, {**ONE_TREE, "learning_rate": 1.0, "n_estimators": 1})
    got = model.predict(df, keep=["y"]).collect()
    assert sorted((r["y"], round(r["prediction"], 9)) for r in got) == sorted((r[5], round(float(p), 9)) for r, p in zip(rows, want))
    assert sum(v for _, v in ML.encoded_importance(model)) == pytest.approx(1)


def test_partitions_do_not_matter(spark):
    _, df = noisy(spark)
    assert nodes_of(df.repartition(3), SMALL)[1] == nodes_of(df.repartition(11), SMALL)[1]


@pytest.mark.parametrize("block_rows", [150, 37])
def test_blocks_do_not_matter(spark, block_rows):
    """Small blocks: the top of each tree is split by jobs for levels, the rest in tasks."""
    _, df = noisy(spark)
    same(nodes_of(df, SMALL)[1], nodes_of(df, SMALL, block_rows=block_rows)[1])


def test_leaves_and_features(spark):
    """No leaf under the least number of rows; trees differ by their rows and features."""
    _, df = noisy(spark)
    plan, nodes = nodes_of(df, SMALL)
    roots = [r for r in nodes if r[1] == 0]
    assert len(roots) == 4 and len({r[3:] for r in roots}) == 4 and plan.n_features == int(0.8 * plan.width)
    assert all(r[5] >= 5 for r in nodes if r[2] < 0)      # weights of 1 and more on 5 rows and more
    allowed = plan.allowed(2, np.arange(50))
    assert all(len(set(plan.feature[a])) == plan.n_features for a in allowed) and len({a.tobytes() for a in allowed}) > 5


def test_weights_are_poisson(spark):
    key = np.random.default_rng(1).integers(0, 2 ** 63, 200_000).astype(np.uint64)
    w, v = forest.bootstrap_weights(key, 3, 42), forest.bootstrap_weights(key, 4, 42)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    assert abs(np.corrcoef(w, v)[0, 1]) < 0.01


def test_forest_of_group_means(spark):
    model = ML.fit_forest(groups(spark), ["g"], [], "y", {**SMALL, "n_estimators": 20, "max_features": 1.0, "min_samples_leaf": 1}, order=["g", "x"])
    got = {r["g"]: r["prediction"] for r in model.predict(groups(spark).select("g").distinct(), keep=["g"]).collect()}
    assert [got[g] for g in "abc"] == pytest.approx([2.0, 12.0, 22.0])


def test_constant_target_and_null_target(spark):
    df = spark.createDataFrame([("a", 3.0)] * 9 + [("b", 3.0)], "g string, y double")
    model = ML.fit_forest(df, ["g"], [], "y", SMALL)
    assert {r["prediction"] for r in model.predict(df).collect()} == {3.0} and {v for _, v in ML.encoded_importance(model)} == {0.0}
    with pytest.raises(ValueError, match="null"):
        ML.fit_forest(spark.createDataFrame([("a", None), ("b", 1.0)], "g string, y double"), ["g"], [], "y", SMALL)


@pytest.mark.parametrize("depth", [1, 2])
def test_large_leaves_move_no_rows(spark, monkeypatch, depth):
    """Leaves of more rows than a block come from the histograms: no task gets their rows."""
    _, df = noisy(spark)
    params = {**ONE_TREE, "max_depth": depth}
    want = nodes_of(df, params)[1]
    moved = []
    grown = forest._rows_of
    monkeypatch.setattr(forest, "_rows_of", lambda plan, tops, left: moved.append(sum(map(len, left.values()))) or grown(plan, tops, left))
    same(want, nodes_of(df, params, block_rows=10)[1])
    assert moved == [0]


def test_moved_rows_are_small(spark):
    """A moved row takes a byte a column, its target and its weight."""
    _, df = noisy(spark)
    enc = ML.fit_preprocessor(df, ["a", "b"], ["x", "z"], drop_first=False)
    plan, _ = forest.fit(df, ["a", "b"], ["x", "z"], "y", SMALL, ML._positions(enc, ["a", "b"], ["x", "z"]))
    blocks = forest.boosting.pack(df, "y", plan.layout, 100)
    moved = blocks.mapInArrow(forest._rows_of(plan, {0: forest.boosting.Tree(0)}, {0: np.array([0])}), forest.ROWS).collect()
    n = sum(len(r["weights"]) for r in moved)
    assert 0 < n < 400 and sum(len(r["codes"]) + len(r["y"]) + len(r["weights"]) for r in moved) == n * (4 + 8 + 1)


def test_held_tables_move_no_rows(spark, monkeypatch):
    """A table that a task holds grows there: rows are not dealt out for each tree."""
    _, df = noisy(spark)
    monkeypatch.setattr(forest, "_rows_of", lambda *a: pytest.fail("rows were moved"))
    assert {r[0] for r in nodes_of(df, SMALL)[1]} == {0, 1, 2, 3}


@pytest.mark.parametrize("bootstrap, share", [(True, 0.8), (False, 1.0)])
def test_counting_the_smaller_child_is_enough(bootstrap, share):
    """Every node of a subtree has the split that its own rows' histogram gives; more rows than are counted together."""
    r = np.random.default_rng(7)
    n = 3 * forest.FEW
    codes = np.stack([r.integers(0, 4, n), r.integers(0, 30, n), r.integers(0, 9, n)]).astype(np.uint8)
    first = np.array([0, 5, 36, 46])
    layout = forest.boosting.Layout(["g", "x", "z"], [list("abcd"), None, None], [None, np.arange(30.0), np.arange(9.0)], first, np.repeat(np.arange(3), np.diff(first)),
                                    np.repeat([False, True, True], np.diff(first)), np.arange(46.0), np.arange(46.0))
    feature = np.array([0, 1, 2, 3, -1, *[4] * 30, -1, *[5] * 9, -1])
    plan = forest.Plan(layout, {**SMALL, "max_features": share, "bootstrap": bootstrap}, feature, {}, 2.0)
    y = np.round(codes[1] / 3 + 4 * (codes[0] == 2) + r.normal(size=n)) - 2.0
    weights = plan.weights(r.integers(0, 2 ** 63, n).astype(np.uint64), 1).astype(np.uint8)
    nodes = {x[0]: x for x in forest._subtree(plan, 1, 0, codes, y, weights, np.flatnonzero(weights))}
    flat, at = codes + first[:3, None], np.zeros(n, dtype=np.int64)
    for node in sorted(nodes):
        rows = np.flatnonzero((at == node) & (weights > 0))
        _, split, threshold, gain, count, value = nodes[node]
        assert count == weights[rows].sum() and value == pytest.approx(np.average(y[rows], weights=weights[rows]) + 2.0)
        hist = plan.histogram(flat[:, rows], y[rows], weights[rows].astype(float), np.zeros(len(rows), dtype=np.int64), 1)
        want = plan.splits(1, np.array([node]), hist)
        if split >= 0:
            assert split == want[0][0] and threshold == want[1][0] and gain == pytest.approx(want[2][0])
            rows = np.flatnonzero(at == node)
            code = flat[layout.column[split], rows]
            at[rows] = 2 * node + 1 + (code > split if layout.numeric[split] else code == split)
        else:
            assert node >= 31 or len(rows) < 10 or want[0][0] < 0
    assert len(nodes) > 40
