"""Random forest regression (M08, M21, M22) on the bins of ``boosting``.

A row's bootstrap weight in a tree is a Poisson(1) draw from a hash of (tree, row key), and a node's
random features come from a hash of (tree, node, feature), so a forest depends on neither partitions
nor the order of rows. A split is the best among all bins of the node's features (one-hot columns and
numeric columns count as one feature each); where none of these splits the node, all features are
tried. The minimum of rows a leaf counts rows, not their weights.

Up to ``HELD_ROWS`` rows, every core gets all blocks and grows its share of the trees; no row is moved for
a tree. Larger tables grow in two phases. While a node has more rows than a task takes, every level of all
trees is one job: blocks give histograms of (tree, node), which are summed and read in groups, and only
splits reach the driver. The rows of the nodes that are left go to one task for each (tree, node), which
grows the rest of the tree there. Nodes stay in tables; the driver holds the splits of the first phase only.
"""

from __future__ import annotations

import math
import uuid
from typing import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.ml import boosting
from dwell.ml.slices import SliceCounts
from dwell.operators.ranking import materialize
from dwell.session import ensure_checkpoint_dir

SLOTS = 64   # nodes whose histograms are held at a time while nodes are large
BATCH = 16   # the same in a task, where few of them stay in a core's cache
FEW = 2048   # rows whose columns are counted together
HELD_ROWS = 1 << 23    # tables of up to so many rows (a byte a code, target and key each) are held whole by a task
BAGGED = 0.64          # share of the rows with a weight in a tree's sample, at most about
ROW = 2.0 ** 26        # weights are counted together with rows, as multiples of this: exact up to 2^26 of each
NODE = "tree int, node int, split int, threshold double, gain double, n double, value double"
ROWS = "tree int, node int, block int, codes binary, y binary, weights binary"


def bootstrap_weights(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) draws: how often each row stands in a tree's sample."""
    draw = boosting._mixed(key ^ boosting._mixed(np.array([(seed << 20) + tree + 1], dtype=np.uint64)))
    upto = np.exp(-1) * np.cumsum(1 / np.cumprod([1.0, *range(1, 18)]))
    return np.searchsorted(upto, (draw >> np.uint64(11)) / 2.0 ** 53, side="right").astype(np.float64)


class Plan:
    """What every task needs: bins, parameters, the vector index of each bin's feature (-1: none)."""

    def __init__(self, layout: boosting.Layout, params: Mapping, feature: np.ndarray, fill: Mapping, centre: float):
        self.layout, self.feature, self.fill, self.centre = layout, feature, fill, centre
        self.trees, self.depth, self.least = (int(params[k]) for k in ("n_estimators", "max_depth", "min_samples_leaf"))
        self.seed, self.bootstrap = int(params["random_state"]), bool(params.get("bootstrap", True))
        self.width = len(np.unique(feature[feature >= 0]))
        self.unit, self.place = np.unique(feature, return_inverse=True)
        share = params["max_features"]
        self.n_features = max(1, int(share * self.width)) if isinstance(share, float) else self.width

    def weights(self, key: np.ndarray, tree: int) -> np.ndarray:
        return bootstrap_weights(key, tree, self.seed) if self.bootstrap else np.ones(len(key))

    def allowed(self, tree: int, nodes: np.ndarray) -> np.ndarray | None:
        """For each node, the bins of its random features."""
        if self.n_features >= self.width:
            return None
        unit, place = self.unit, self.place
        of_node = boosting._mixed(nodes.astype(np.uint64) + np.uint64((self.seed << 40) + ((tree + 1) << 20)))
        draw = boosting._mixed(of_node[:, None] ^ boosting._mixed(unit.astype(np.uint64) + np.uint64(1))[None, :])
        draw[:, unit < 0] = np.iinfo(np.uint64).max
        taken = np.zeros(draw.shape, dtype=bool)
        np.put_along_axis(taken, np.argsort(draw, axis=1, kind="stable")[:, :self.n_features], True, axis=1)
        return taken[:, place]

    def histogram(self, flat: np.ndarray, y: np.ndarray, weights: np.ndarray, slot: np.ndarray, slots: int) -> np.ndarray:
        """(3, slots, bins): sum of weighted targets, of weights, and the rows."""
        bins = int(self.layout.first[-1])
        out = np.zeros((3, slots * bins))
        for codes in flat:
            at = slot * bins + codes
            out += np.stack([np.bincount(at, weights=w, minlength=slots * bins) for w in (y * weights, weights, None)])
        return out.reshape(3, slots, bins)

    def splits(self, tree: int, nodes: np.ndarray, hist: np.ndarray) -> tuple[np.ndarray, ...]:
        found = boosting.best_splits(self.layout, hist, self.least, self.allowed(tree, nodes))
        none = np.flatnonzero(found[0] < 0)
        if len(none) and self.n_features < self.width:
            for have, again in zip(found, boosting.best_splits(self.layout, hist[:, none], self.least)):
                have[none] = again
        return found

    def counted(self, codes: np.ndarray, y: np.ndarray, weights: np.ndarray, rows: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
        """(2, slots, bins) of the first ``sizes[0]`` of ``rows``, the next ``sizes[1]`` and so on: sum of weighted
        targets, and of weights and rows together."""
        first, slots = self.layout.first, len(sizes)
        bins = int(first[-1])
        slot = np.repeat(np.arange(slots), sizes)
        if len(rows) <= FEW:
            w = np.take(weights, rows).astype(np.float64)
            at = (np.take(codes, rows, axis=1) + first[:-1, None] + slot * bins).ravel()
            return np.stack([np.bincount(at, weights=np.broadcast_to(x, (len(codes), len(x))).ravel(), minlength=slots * bins)
                             for x in (np.take(y, rows) * w, w + ROW)]).reshape(2, slots, bins)
        out = np.zeros((2, slots, bins))
        for i in range(0, len(rows), boosting.CHUNK):
            part, of = rows[i:i + boosting.CHUNK], slot[i:i + boosting.CHUNK]
            w = np.take(weights, part).astype(np.float64)
            sums, both = np.take(y, part) * w, w + ROW
            for c, column in enumerate(codes):
                a, b = int(first[c]), int(first[c + 1])
                at = np.take(column, part).astype(np.int64)
                if slots > 1:
                    at += of * (b - a)
                for plane, x in zip(out, (sums, both)):
                    plane[:, a:b] += np.bincount(at, weights=x, minlength=slots * (b - a)).reshape(slots, b - a)
        return out

    def best(self, tree: int, nodes: np.ndarray, hist: np.ndarray) -> tuple[np.ndarray, ...]:
        """``boosting.best_splits`` on what ``counted`` gives, and for nodes without a split again on all features."""
        layout = self.layout
        whole = hist[:, :, :layout.first[1]].sum(axis=2)
        left = np.empty_like(hist)
        for c in range(len(layout.names)):
            a, b = int(layout.first[c]), int(layout.first[c + 1])
            if layout.numeric[a]:
                np.cumsum(hist[:, :, a:b], axis=2, out=left[:, :, a:b])
            else:
                np.subtract(whole[:, :, None], hist[:, :, a:b], out=left[:, :, a:b])
        rows = np.floor(left[1] / ROW)
        left[1] -= rows * ROW
        total, all_rows = whole[0], np.floor(whole[1] / ROW)
        n = whole[1] - all_rows * ROW
        # a bin without rows splits as the one before it
        fits = (rows >= self.least) & (all_rows[:, None] - rows >= self.least) & (hist[1] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            drop = left[0] * left[0] / left[1]
            rest = total[:, None] - left[0]
            rest *= rest
            rest /= n[:, None] - left[1]
        drop += rest
        allowed, slots = self.allowed(tree, nodes), np.arange(len(nodes))
        free = np.where(fits, drop, -np.inf)
        best = (free if allowed is None else np.where(allowed, free, -np.inf)).argmax(axis=1)
        own = np.divide(total * total, n, out=np.zeros_like(n), where=n > 0)
        enough = boosting.LEAST_GAIN * np.maximum(own, 1e-300)

        def gained(at):
            may = free[slots, at] if allowed is None else np.where(allowed[slots, at], free[slots, at], -np.inf)
            return may - own
        gain = gained(best)
        if allowed is not None and (gain <= enough).any():
            again = free.argmax(axis=1)
            none = gain <= enough
            best, gain = np.where(none, again, best), np.where(none, free[slots, again] - own, gain)
        split, threshold = np.where(gain > enough, best, -1), np.full(len(nodes), 0.5)
        for k in np.flatnonzero((split >= 0) & layout.numeric[best]):
            at = int(best[k])
            after = int((hist[1, k, at + 1:layout.first[layout.column[at] + 1]] > 0).argmax()) + at + 1
            threshold[k] = (layout.high[at] + layout.low[after]) / 2
            split[k] = at + np.searchsorted(layout.high[at:after], threshold[k], side="right") - 1
            if layout.low[after] < layout.high[after]:
                threshold[k] = layout.high[split[k]]
        return split, threshold, gain, total, n, left[0][slots, best], left[1][slots, best]


def _subtree(plan: Plan, tree: int, root: int, codes: np.ndarray, y: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> list[tuple]:
    """The nodes at and below ``root`` on its rows (places in the columns), as (node, split, threshold, gain, n, value).
    Nodes of a level go together in batches, depth first; of two children the smaller one is counted, the other is the rest."""
    layout, out = plan.layout, []

    def leaf(node: int, s: float, n: float):
        out.append((node, -1, 0.0, 0.0, n, s / n + plan.centre))

    level = int(root + 1).bit_length() - 1
    if not len(rows):
        return out
    if level == plan.depth or len(rows) < 2 * plan.least:
        w = weights[rows].astype(np.float64)
        leaf(root, float((y[rows] * w).sum()), float(w.sum()))
        return out
    todo = [(level, [root], [rows], plan.counted(codes, y, weights, rows, [len(rows)]))]
    while todo:
        level, nodes, held, hist = todo.pop()
        found = plan.best(tree, np.array(nodes), hist)
        pairs = []                # (parent's place, smaller child, its rows, larger child, its rows)
        for k, (node, split, threshold, gain, s, n, left_s, left_n) in enumerate(zip(nodes, *(x.tolist() for x in found[:7]))):
            if split < 0:
                leaf(node, s, n)
                continue
            out.append((node, split, threshold, gain, n, s / n + plan.centre))
            if level + 1 == plan.depth:
                leaf(2 * node + 1, left_s, left_n)
                leaf(2 * node + 2, s - left_s, n - left_n)
                continue
            c = int(layout.column[split])
            code = np.take(codes[c], held[k])
            right = code > split - int(layout.first[c]) if layout.numeric[split] else code == split - int(layout.first[c])
            sides = []
            for i, side, s_side, n_side in ((2 * node + 1, ~right, left_s, left_n), (2 * node + 2, right, s - left_s, n - left_n)):
                own = np.take(held[k], np.flatnonzero(side))
                if len(own) < 2 * plan.least:
                    leaf(i, s_side, n_side)
                sides.append((i, own))
            if max(len(own) for _, own in sides) >= 2 * plan.least:
                pairs.append((k, *sorted(sides, key=lambda x: len(x[1]))))
        held = None
        for i in range(0, len(pairs), BATCH // 2):
            some = pairs[i:i + BATCH // 2]
            small = plan.counted(codes, y, weights, np.concatenate([own for _, (_, own), _ in some]), [len(own) for _, (_, own), _ in some])
            large = hist[:, [k for k, *_ in some]] - small
            grow = [(j, side, child) for j, (_, *sides) in enumerate(some) for side, child in enumerate(sides) if len(child[1]) >= 2 * plan.least]
            todo.append((level + 1, [i for _, _, (i, _) in grow], [own for _, _, (_, own) in grow],
                         np.stack([(small, large)[side][:, j] for j, side, _ in grow], axis=1)))
        del hist
    return out


def _block(plan: Plan, row: Mapping) -> boosting.Block:
    return boosting.Block.read(plan.layout, row).of(plan.layout, boosting.Spec(0, 0, {}), plan.fill)


def _open_nodes(plan: Plan, block: boosting.Block, tops: Mapping[int, boosting.Tree], tree: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's weight in the tree, and its node among those grown so far."""
    return plan.weights(block.key, tree), tops[tree].leaves(plan.layout, block.flat)


def _level(plan: Plan, tops: Mapping[int, boosting.Tree], wanted: Mapping[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}        # of all blocks of the partition
        for batch in batches:
            for k in range(batch.num_rows):
                block = _block(plan, batch.slice(k, 1).to_pylist()[0])
                for tree, nodes in wanted.items():
                    weights, at = _open_nodes(plan, block, tops, tree)
                    for i in range(0, len(nodes), SLOTS):
                        own = nodes[i:i + SLOTS]
                        rows = np.flatnonzero((weights > 0) & np.isin(at, own))
                        hist = plan.histogram(block.flat[:, rows], block.y[rows] - plan.centre, weights[rows], np.searchsorted(own, at[rows]), len(own))
                        if (tree, i) in sums:
                            sums[tree, i] += hist
                        else:
                            sums[tree, i] = hist
        for (tree, i), hist in sums.items():
            yield pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()), "part": pa.array([i], pa.int32()),
                                              "hist": pa.array([hist.tobytes()], pa.binary())})
    return run


def _choose(plan: Plan, wanted: Mapping[int, np.ndarray]):
    def run(batches: Iterator[pa.Table]) -> pa.Table:
        table, hist = batches, 0
        tree, part = table["tree"][0].as_py(), table["part"][0].as_py()
        for raw in table["hist"].to_pylist():
            hist = hist + np.frombuffer(raw)
        own = wanted[tree][part:part + SLOTS]
        hist = hist.reshape(3, len(own), -1)
        rows = hist[2][:, :plan.layout.first[1]].sum(axis=1)      # every row stands once in the first column's bins
        numbers = [own.astype(float), rows, *(x.astype(float) for x in plan.splits(tree, own, hist))]
        return pa.table({"tree": pa.array([tree], pa.int32()), "numbers": pa.array([np.concatenate(numbers)], pa.list_(pa.float64()))})
    return run


def _top(blocks: DataFrame, plan: Plan, total: int, block_rows: int) -> tuple[dict[int, boosting.Tree], dict[int, np.ndarray], dict[int, list[int]]]:
    """Splits of all nodes with more rows than a block, the nodes left open below them, and the leaves
    among these large nodes (no split, or the last level), whose rows need not be moved."""
    tops = {t: boosting.Tree(0) for t in range(plan.trees)}
    left = {t: np.array([0]) for t in tops}
    leaves: dict[int, list[int]] = {t: [] for t in tops}
    if total <= block_rows or not plan.depth:
        return tops, left, leaves
    blocks = blocks.coalesce(blocks.sparkSession.sparkContext.defaultParallelism)      # histograms are as many as cores
    wanted = dict(left)
    for level in range(plan.depth):
        found = blocks.mapInArrow(_level(plan, tops, wanted), "tree int, part int, hist binary").groupBy("tree", "part").applyInArrow(
            _choose(plan, wanted), "tree int, numbers array<double>").collect()
        done: dict[int, list] = {}
        for r in found:
            nodes, rows, *splits = np.array(r["numbers"]).reshape(9, -1)
            many = rows > block_rows
            done.setdefault(r["tree"], []).append((nodes.astype(np.int64)[many], (splits[0].astype(np.int64)[many], *(s[many] for s in splits[1:]))))
        wanted = {}
        for tree, parts in done.items():
            deeper = boosting.Tree(level + 1)
            for name in ("split", "value", "n", "gain", "threshold"):
                getattr(deeper, name)[:len(tops[tree].split)] = getattr(tops[tree], name)
            tops[tree], more = deeper, []
            for nodes, splits in parts:
                last = level == plan.depth - 1
                at = nodes[boosting.set_splits(deeper, nodes, splits, last)]
                ends = np.concatenate([np.setdiff1d(nodes, at), *((2 * at + 1, 2 * at + 2) if last else ())])
                leaves[tree] += ends.tolist()
                more += [] if last else [2 * at + 1, 2 * at + 2]
                left[tree] = np.setdiff1d(left[tree], nodes)
            more = np.sort(np.concatenate(more)) if more else np.zeros(0, dtype=np.int64)
            left[tree] = np.union1d(left[tree], more)
            if len(more):
                wanted[tree] = more
        if not wanted:
            break
    return tops, left, leaves


def _rows_of(plan: Plan, tops: Mapping[int, boosting.Tree], left: Mapping[int, np.ndarray]):
    """Task: the rows of a block at each open (tree, node)."""
    names = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block = _block(plan, row)
                codes = (block.flat - plan.layout.first[:-1, None]).astype(boosting.code_type(plan.layout))
                for tree, nodes in left.items():
                    weights, at = _open_nodes(plan, block, tops, tree)
                    for node in nodes.tolist():
                        rows = np.flatnonzero((weights > 0) & (at == node))
                        if len(rows):
                            packed = (codes[:, rows], block.y[rows], weights[rows].astype(np.uint8))
                            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (tree, node, row["block"])),
                                                              *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=names)
    return run


def _grown(plan: Plan):
    kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 4]

    def run(table: pa.Table) -> pa.Table:
        tree, root = table["tree"][0].as_py(), table["node"][0].as_py()
        parts = table.sort_by("block").to_pylist()       # sums do not depend on how blocks arrive; their rows are in order of the key
        codes = np.concatenate([np.frombuffer(p["codes"], dtype=boosting.code_type(plan.layout)).reshape(len(plan.layout.names), -1) for p in parts], axis=1)
        y, weights = (np.concatenate([np.frombuffer(p[name], dtype=kind) for p in parts]) for name, kind in (("y", np.float64), ("weights", np.uint8)))
        nodes = _subtree(plan, tree, root, codes, y - plan.centre, weights, np.arange(len(y)))
        columns = [[tree] * len(nodes), *zip(*nodes)]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in NODE.split(", ")])
    return run


def _grow_whole(blocks: DataFrame, plan: Plan) -> DataFrame:
    """Each task has all rows and grows some of the trees."""
    n = max(1, min(plan.trees, blocks.sparkSession.sparkContext.defaultParallelism))
    keys = boosting.task_keys(blocks.sparkSession, n)
    keys = keys if len(keys) == n else list(range(n))
    kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
    names = [c.split()[0] for c in NODE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row.pop("task"), []).append(row)
        while held:
            task, rows = held.popitem()
            rows.sort(key=lambda r: r["block"])
            codes = np.concatenate([np.frombuffer(r["codes"], dtype=boosting.code_type(plan.layout)).reshape(len(plan.layout.names), -1) for r in rows], axis=1)
            y, key = np.concatenate([np.frombuffer(r["y"]) for r in rows]) - plan.centre, np.concatenate([np.frombuffer(r["keys"], dtype=np.uint64) for r in rows])
            rows.clear()
            for c, name in enumerate(plan.layout.names):
                if name in plan.fill:
                    codes[c][codes[c] == plan.layout.first[c + 1] - plan.layout.first[c] - 1] = plan.layout.code(c, plan.fill[name])
            for tree in range(keys.index(task), plan.trees, n):
                weights = np.concatenate([plan.weights(key[a:a + boosting.CHUNK], tree).astype(np.uint8) for a in range(0, len(key), boosting.CHUNK)])
                nodes = _subtree(plan, tree, 0, codes, y, weights, np.flatnonzero(weights))
                columns = [[tree] * len(nodes), *zip(*nodes)] if nodes else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    each = blocks.select("block", "codes", "y", "keys", F.explode(F.array(*[F.lit(k) for k in keys])).alias("task")).repartition(n, "task")
    return each.mapInArrow(run, NODE)


def fit(rows: DataFrame, categorical: Sequence[str], numeric: Sequence[str], target: str, params: Mapping,
        positions: Mapping[tuple[str, str | None], int], key: Sequence[str] = (), block_rows: int = boosting.BLOCK_ROWS) -> tuple[Plan, DataFrame]:
    """The nodes of all trees (tree, node as in a heap, split, threshold, gain, n, value). ``positions``:
    vector index of each (column, label); ``key``: what tells rows apart (else all their values)."""
    rows = rows.withColumn("slice", F.lit(0))
    total, mean, bad = rows.agg(F.count("*"), F.avg(F.col(target).cast("double")), F.count_if(F.col(target).isNull())).first()
    if bad or not total:
        raise ValueError(f"{target}: {bad} null values in {total} rows")
    counts = SliceCounts(rows, categorical, numeric)
    fills = counts.fills([0])
    layout = boosting.layout_of(counts, fills)
    feature = np.full(int(layout.first[-1]), -1, dtype=np.int64)
    for c, name in enumerate(layout.names):
        for j in range(int(layout.first[c]), int(layout.first[c + 1]) - 1):
            feature[j] = positions.get((name, None if layout.labels[c] is None else layout.labels[c][j - layout.first[c]]), -1)
    # only near the mean, so the order of its sum does not matter; few binary digits, so that whole targets have exact sums
    centre = math.ldexp(round(math.ldexp(math.frexp(mean)[0], 10)), math.frexp(mean)[1] - 10)
    plan = Plan(layout, params, feature, fills[0], centre)
    blocks = materialize(boosting.pack(rows, target, layout, min(block_rows, boosting.PART_ROWS), total, key))
    spark = rows.sparkSession
    if total <= (block_rows if block_rows < boosting.BLOCK_ROWS else HELD_ROWS):
        tops, leaves, nodes = {}, {}, _grow_whole(blocks, plan)
    else:
        tops, left, leaves = _top(blocks, plan, total * (BAGGED if plan.bootstrap else 1), block_rows)
        n_open = sum(map(len, left.values()))
        # a number of partitions of its own: few bytes still mean many trees to grow
        dealt = blocks.mapInArrow(_rows_of(plan, tops, left), ROWS).repartition(max(1, min(n_open, 16 * spark.sparkContext.defaultParallelism)), "tree", "node")
        nodes = dealt.groupBy("tree", "node").applyInArrow(_grown(plan), NODE)
    upper = [(t, int(i), int(top.split[i]), float(top.threshold[i]), float(top.gain[i]), float(top.n[i]), float(top.value[i] + centre))
             for t, top in tops.items() for i in np.flatnonzero(top.split >= 0)]
    upper += [(t, i, -1, 0.0, 0.0, float(tops[t].n[i]), float(tops[t].value[i] + centre)) for t, ends in leaves.items() for i in ends]
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"      # a checkpoint would grow the trees twice
    nodes.unionByName(spark.createDataFrame(upper, NODE)).write.parquet(path)
    nodes = spark.read.schema(NODE).parquet(path)
    # a sample without any row, as a few rows may give, leaves a tree of one leaf
    empty = [(t, 0, -1, 0.0, 0.0, float(total), float(mean)) for t in
             sorted(set(range(plan.trees)) - {r["tree"] for r in nodes.filter("node = 0").select("tree").collect()})]     # at most a row a tree
    return plan, nodes.unionByName(spark.createDataFrame(empty, NODE)) if empty else nodes


def importances(plan: Plan, nodes: DataFrame) -> dict[int, float]:
    """Mean over trees of each feature's share of the drop of squared error, by vector index."""
    feature = F.element_at(F.array(*[F.lit(int(f)) for f in plan.feature]), F.col("split") + 1)
    found = nodes.filter("split >= 0").groupBy("tree", feature.alias("feature")).agg(F.sum("gain").alias("gain")).collect()  # trees x features
    whole: dict[int, float] = {}
    for r in found:
        whole[r["tree"]] = whole.get(r["tree"], 0.0) + r["gain"]
    out: dict[int, float] = {}
    for r in sorted(found, key=lambda r: (r["tree"], r["feature"])):
        out[r["feature"]] = out.get(r["feature"], 0.0) + r["gain"] / whole[r["tree"]] / len(whole)
    return out


def spark_model(plan: Plan, nodes: DataFrame, width: int, features_col: str, prediction_col: str) -> RandomForestRegressionModel:
    """The trees as a Spark ML forest."""
    feature = plan.feature
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
    schema = "tree int, id int, left int, right int, feature int, threshold double, gain double, n double, value double"

    def numbered(table: pa.Table) -> pa.Table:
        """Nodes of one tree, numbered without gaps, parents first."""
        table = table.sort_by("node")
        node, split = table["node"].to_numpy(), table["split"].to_numpy()
        inner = split >= 0
        left, right = (np.where(inner, np.searchsorted(node, 2 * node.astype(np.int64) + k), -1) for k in (1, 2))
        columns = [table["tree"].to_numpy(), np.arange(len(node)), left, right, np.where(inner, feature[np.maximum(split, 0)], -1),
                   *(table[c].to_numpy() for c in ("threshold", "gain", "n", "value"))]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in schema.split(", ")])

    leaf = F.col("left") < 0
    thresholds = F.when(leaf, F.array().cast("array<double>")).otherwise(F.array("threshold"))
    data = nodes.groupBy("tree").applyInArrow(numbered, schema).select(F.col("tree").alias("treeID"), F.struct(
        "id", F.col("value").alias("prediction"), F.lit(0.0).alias("impurity"),
        F.array(F.col("n"), F.col("n") * F.col("value"), F.col("n") * F.col("value") * F.col("value")).alias("impurityStats"),
        F.col("n").cast("long").alias("rawCount"), F.when(leaf, F.lit(-1.0)).otherwise(F.col("gain") / F.col("n")).alias("gain"),
        F.col("left").alias("leftChild"), F.col("right").alias("rightChild"),
        F.struct(F.col("feature").alias("featureIndex"), thresholds.alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories")).alias("split"),
    ).alias("nodeData"))
    path = boosting.saved_trees(nodes.sparkSession, data, "RandomForestRegressionModel", plan.trees, 1.0, plan.depth, width,
                                {"featuresCol": features_col, "predictionCol": prediction_col, "numTrees": plan.trees})
    return RandomForestRegressionModel.load(path)
