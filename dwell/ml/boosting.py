"""Gradient-boosted regression trees (M09, M12, M13) with true shrinkage, grown from histograms.

An ensemble starts at the mean of the target; each tree is fitted to the residuals and added with the
learning rate, the first one included: prediction = mean + rate * sum of the trees' leaf means. A
split is the one with the largest drop of squared error among all bins, as exact search finds it:
numeric columns with up to ``MAX_BINS`` distinct values have a bin for each, others quantile bins.

All models of a tuning run (parameter sets x folds) grow on one binned table. A row's codes do not
depend on the fold; what a fold fills nulls with is one code a column. Sets that differ only in their
number of trees share one ensemble and are read off its stages.

The binned rows are packed into blocks of about ``PART_ROWS``, dealt by the hash of the row. A row is in a
tree's subsample if a hash of (row, tree) says so, so results do not depend on how rows are partitioned.
Blocks are kept as cells of groups of columns. Up to ``BLOCK_ROWS`` rows, every core gets all blocks and
grows its share of the models (``Held``). With more rows, spread over the cores, every level of the current trees of all models is one job of one stage: each core gives histograms of
(model, node) over its blocks, and the driver adds these (models x nodes x bins, whatever the rows) and
chooses the splits. The models' predictions are kept beside the blocks, anew every ``KEPT_TREES`` trees.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field, replace
from typing import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.ml.slices import SliceCounts
from dwell.operators.ranking import materialize
from dwell.session import ensure_checkpoint_dir

MAX_BINS = 255
BLOCK_ROWS = 1 << 22      # tables of up to so many rows (about 40 bytes, and 10 a model) are held whole by a task
PART_ROWS = 1 << 17       # rows of a block
CHUNK = 1 << 15           # rows handled at a time, so that what is between two steps stays in a core's cache
KEPT_TREES = 4
CUT_STEPS = 24             # predictions written anew until their lineage is cut
MOST_CELLS = 4096
MOST_KINDS = 1 << 18       # combinations of codes, times stages, up to which models grow on kinds of rows
LEAST_GAIN = 1e-12        # share of a node's sum of squares


@dataclass(frozen=True)
class Spec:
    """One model: fitted on the rows up to slice ``train``, validated on the later ones up to ``valid``."""
    train: int
    valid: int
    params: Mapping
    stages: tuple[int, ...] = ()

    @property
    def trees(self) -> int:
        return max((int(self.params["n_estimators"]), *self.stages))


@dataclass
class Layout:
    """Bins of all columns side by side: column c owns bins ``first[c]`` to ``first[c + 1]``, the last
    of them for nulls. A categorical bin is a label; a numeric one holds the values from low to high."""
    names: list[str]
    labels: list[list[str] | None]
    cuts: list[np.ndarray | None]
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    column: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    numeric: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=bool))
    low: np.ndarray = field(default_factory=lambda: np.zeros(0))
    high: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def code(self, c: int, value) -> int:
        """Bin of a value (None: null) within its column."""
        size = int(self.first[c + 1] - self.first[c])
        if value is None:
            return size - 1
        return self.labels[c].index(value) if self.labels[c] is not None else int(np.searchsorted(self.cuts[c], value))

    def codes(self, c: int, values: pa.Array) -> np.ndarray:
        null = int(self.first[c + 1] - self.first[c]) - 1
        if self.labels[c] is not None:
            places = pa.compute.index_in(values.cast(pa.string()), value_set=pa.array(self.labels[c], pa.string()))
            return places.fill_null(null).to_numpy(zero_copy_only=False).astype(np.uint16)
        numbers = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
        return np.where(np.isnan(numbers), null, np.searchsorted(self.cuts[c], numbers)).astype(np.uint16)


def code_type(layout: Layout) -> type:
    """A byte a code where all columns' bins fit."""
    return np.uint8 if np.diff(layout.first).max(initial=0) <= 256 else np.uint16


def layout_of(counts: SliceCounts, fills: Mapping[int, Mapping]) -> Layout:
    """Bins from the value counts; what nulls are filled with has a bin of its own where bins are values."""
    labels = [sorted(v for v, _ in vs) for vs in counts.text_counts([1 << 30])[1 << 30].values()] if counts.categorical else []
    few = [c for c in counts.numeric if c in counts.sizes and counts.sizes[c]["numbers"] <= MAX_BINS]
    exact = counts.distinct_numbers(few)
    wide = counts.quantiles([c for c in counts.numeric if c not in few], [i / MAX_BINS for i in range(1, MAX_BINS + 1)])
    out = Layout([*counts.categorical, *counts.numeric], [*labels, *[None] * len(counts.numeric)], [None] * len(labels))
    low, high, numeric, column, first = [], [], [], [], [0]
    for c, names in enumerate(labels):
        size = len(names) + 1
        low += [np.zeros(size)]
        high += [np.zeros(size)]
    for name in counts.numeric:
        if name in few:
            cuts = np.unique([*exact[name], *[f[name] for f in fills.values() if f.get(name) is not None]])
            below = cuts
        else:
            cuts = np.unique(wide[name])
            below = np.concatenate((cuts[:1], cuts[:-1]))
        out.cuts.append(cuts)
        low.append(np.append(below, np.nan))
        high.append(np.append(cuts, np.nan))
    for c, bins in enumerate(low):
        column += [c] * len(bins)
        numeric += [c >= len(labels)] * len(bins)
        first.append(first[-1] + len(bins))
    out.first, out.column, out.numeric = np.array(first), np.array(column, dtype=np.int64), np.array(numeric, dtype=bool)
    out.low, out.high = (np.concatenate(x) if x else np.zeros(0) for x in (low, high))
    return out


# ---------------------------------------------------------------- growing on one block's rows
def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with well spread bits (murmur3's)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def in_bag(key: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Rows of a tree's subsample."""
    if share >= 1.0:
        return np.ones(len(key), dtype=bool)
    draw = _mixed(key ^ _mixed(np.array([(seed << 20) + tree + 1], dtype=np.uint64)))
    return draw < np.uint64(math.ceil(share * 2 ** 53) << 11)       # its first 53 bits are below the share


class Tree:
    """Nodes as a heap: the children of node i are 2i + 1 (left) and 2i + 2."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.split = np.full(size, -1, dtype=np.int64)         # bin of the split; -1: leaf
        self.value, self.n, self.gain, self.threshold = np.zeros(size), np.zeros(size), np.zeros(size), np.zeros(size)

    def packed(self) -> np.ndarray:
        return np.concatenate([self.split, self.value, self.n, self.gain, self.threshold])

    @staticmethod
    def unpacked(flat: Sequence[float]) -> "Tree":
        parts = np.array(flat, dtype=float).reshape(5, -1)
        out = Tree.__new__(Tree)
        out.split = parts[0].astype(np.int64)
        out.value, out.n, out.gain, out.threshold = parts[1:]
        return out

    def descend(self, layout: Layout, flat: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Each row's node one level further down (rows at a leaf stay)."""
        going = np.flatnonzero(self.split[node] >= 0)
        here = self.split[node[going]]
        code = flat[layout.column[here], going]
        right = np.where(layout.numeric[here], code > here, code == here)
        out = node.copy()
        out[going] = 2 * node[going] + 1 + right
        return out

    def leaves(self, layout: Layout, flat: np.ndarray) -> np.ndarray:
        node = np.zeros(flat.shape[1], dtype=np.int64)
        for _ in range(int(np.log2(len(self.split) + 1)) - 1):
            node = self.descend(layout, flat, node)
        return node


Group = tuple[np.ndarray, np.ndarray]     # each row's cell; (cells, bins): the bins that a cell counts for


def groups_of(layout: Layout, flat: np.ndarray, most: int = MOST_CELLS) -> list[Group]:
    """Columns counted together: a group's cells are the combinations of its columns' codes that occur, so
    columns with few values, or that follow from each other, cost one count. ``most``: cells of a group."""
    out: list[Group] = []
    cells, members = None, []
    for c in np.argsort(np.diff(layout.first), kind="stable"):
        own = np.unique(flat[c], return_inverse=True)[1]
        if cells is not None:
            seen, joint = np.unique(cells * (int(own.max(initial=0)) + 1) + own, return_inverse=True)
        if cells is not None and len(seen) <= most:
            cells, members = joint, [*members, c]
        else:
            out += [_group(layout, flat, cells, members)] if members else []
            cells, members = own, [c]
    return out + ([_group(layout, flat, cells, members)] if members else [])


def _group(layout: Layout, flat: np.ndarray, cells: np.ndarray, members: list[int]) -> Group:
    first = np.unique(cells, return_index=True)[1]
    marginal = np.zeros((len(first), int(layout.first[-1])))
    for c in members:
        marginal[np.arange(len(first)), flat[c, first]] = 1.0
    return cells.reshape(-1), marginal


def histogram(groups: Sequence[Group], rows: np.ndarray, slot: np.ndarray | None, slots: int, residual: np.ndarray,
              number: np.ndarray | None = None) -> np.ndarray:
    """(2, slots, bins): sum of residuals and count of ``rows`` for each (slot, bin); no slots: one for all.
    ``number``: how many rows of the table each one stands for (default: one)."""
    counted = None if number is None else number[rows]
    out, weights = 0.0, residual[rows] if number is None else residual[rows] * counted
    for cells, marginal in groups:
        at = cells[rows] if slot is None else cells[rows] + slot * len(marginal)
        size = slots * len(marginal)
        both = np.stack([np.bincount(at, weights=weights, minlength=size), np.bincount(at, weights=counted, minlength=size)])
        out = out + both.reshape(2, slots, -1) @ marginal
    return out


def best_splits(layout: Layout, hist: np.ndarray, least: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """For each slot: the split's bin (-1: none), its threshold, gain, and the sum and count of all rows
    and of the left side. Left: at most the bin's values, or not its label. The last plane of ``hist``
    is held against ``least``; ``allowed``: the bins that a slot may use (default: all)."""
    counts = hist[1]
    a, b = layout.first[:-1], layout.first[1:]
    whole = hist[:, :, :b[0]].sum(axis=2)
    total, n = whole[:2]
    run = np.cumsum(hist, axis=2)
    before = np.concatenate((np.zeros((len(hist), len(total), 1)), run), axis=2)[:, :, a][:, :, layout.column]
    left = np.where(layout.numeric, run - before, whole[:, :, None] - hist)
    left_n, right_n = left[1], n[:, None] - left[1]
    fits = (left[-1] >= least) & (whole[-1][:, None] - left[-1] >= least)
    fits &= counts > 0           # a bin without rows splits as the one before it
    if allowed is not None:
        fits &= allowed
    with np.errstate(divide="ignore", invalid="ignore"):
        drop = left[0] ** 2 / left_n + (total[:, None] - left[0]) ** 2 / right_n - (total ** 2 / np.maximum(n, 1))[:, None]
    drop = np.where(fits, drop, -np.inf)
    best = drop.argmax(axis=1)
    slots = np.arange(len(total))
    gain = drop[slots, best]
    bin_ = np.where(gain > LEAST_GAIN * np.maximum(total ** 2 / np.maximum(n, 1), 1e-300), best, -1)
    threshold = np.full(len(total), 0.5)
    for k in np.flatnonzero((bin_ >= 0) & layout.numeric[best]):     # half-way to the next value that the node has
        at = best[k]
        after = np.flatnonzero(counts[k, at + 1:b[layout.column[at]]])[0] + at + 1
        threshold[k] = (layout.high[at] + layout.low[after]) / 2
        # values that the node does not have stand on their side of the threshold
        bin_[k] = at + np.searchsorted(layout.high[at:after], threshold[k], side="right") - 1
        if layout.low[after] < layout.high[after]:
            threshold[k] = layout.high[bin_[k]]
    return bin_, threshold, gain, total, n, left[0][slots, best], left_n[slots, best]


def set_splits(tree: Tree, nodes: np.ndarray, found: tuple[np.ndarray, ...], last: bool) -> np.ndarray:
    """Writes a level's splits and the means of its nodes and their children; returns the positions of
    the nodes that were split."""
    bin_, threshold, gain, total, n, left, left_n = found
    tree.n[nodes], tree.value[nodes] = n, total / np.maximum(n, 1)
    done = np.flatnonzero(bin_ >= 0)
    at = nodes[done]
    tree.split[at], tree.threshold[at], tree.gain[at] = bin_[done], threshold[done], gain[done]
    if last:
        tree.n[2 * at + 1], tree.value[2 * at + 1] = left_n[done], left[done] / left_n[done]
        right_n = n[done] - left_n[done]
        tree.n[2 * at + 2], tree.value[2 * at + 2] = right_n, (total[done] - left[done]) / right_n
    return done


def grow_tree(layout: Layout, flat: np.ndarray, groups: Sequence[Group], residual: np.ndarray, bag: np.ndarray, depth: int,
              least: int, number: np.ndarray | None = None) -> tuple[Tree, dict[int, np.ndarray]]:
    """A tree on the rows of ``bag``, and all rows of each leaf."""
    tree, bins = Tree(depth), int(layout.first[-1])
    nodes, rows_of = np.array([0]), {0: np.arange(flat.shape[1])}
    hist = histogram(groups, np.flatnonzero(bag), None, 1, residual, number)
    for level in range(depth):
        found = best_splits(layout, hist, least)
        done = set_splits(tree, nodes, found, level == depth - 1)
        for i in nodes[done]:
            rows, split = rows_of.pop(i), tree.split[i]
            code = flat[layout.column[split], rows]
            right = code > split if layout.numeric[split] else code == split
            rows_of[2 * i + 1], rows_of[2 * i + 2] = rows[~right], rows[right]
        if not len(done) or level == depth - 1:
            break
        # the smaller child of each split is counted, the other one is the rest
        small_left = 2 * found[6][done] <= found[4][done]
        small = [rows_of[i] for i in 2 * nodes[done] + np.where(small_left, 1, 2)]
        small = [rows[bag[rows]] for rows in small]
        part = histogram(groups, np.concatenate(small), np.repeat(np.arange(len(small)), [len(rows) for rows in small]), len(small), residual, number)
        rest = hist[:, done] - part
        hist = np.stack([np.where(small_left[:, None], part, rest), np.where(small_left[:, None], rest, part)], axis=2).reshape(2, -1, bins)
        nodes = np.stack([2 * nodes[done] + 1, 2 * nodes[done] + 2], axis=1).reshape(-1)
    return tree, rows_of


@dataclass
class Block:
    """Rows as (columns, rows) bin codes, targets, hashes and slices."""
    flat: np.ndarray
    y: np.ndarray
    key: np.ndarray
    slice: np.ndarray

    @staticmethod
    def read(layout: Layout, row: Mapping) -> "Block":
        codes = np.frombuffer(row["codes"], dtype=code_type(layout)).reshape(len(layout.names), -1)
        return Block(codes + layout.first[:-1, None], np.frombuffer(row["y"]), np.frombuffer(row["keys"], dtype=np.uint64),
                     np.frombuffer(row["slices"], dtype=np.int32))

    def of(self, layout: Layout, spec: Spec, fill: Mapping) -> "Block":
        """The rows of a model's two sides, with its fold's values in place of nulls."""
        rows = np.flatnonzero(self.slice <= spec.valid)
        out = Block(self.flat[:, rows], self.y[rows], self.key[rows], self.slice[rows])
        for c, name in enumerate(layout.names):
            if name in fill:
                null = layout.first[c + 1] - 1
                out.flat[c] = np.where(out.flat[c] == null, layout.first[c] + layout.code(c, fill[name]), out.flat[c])
        return out


def error_sums(block: Block, spec: Spec, prediction: np.ndarray, centre: float) -> list[list[float]]:
    """For each side: rows, sums of absolute and squared errors, of the target about ``centre`` and of its square."""
    out = []
    for side in (block.slice <= spec.train, block.slice > spec.train):
        e, d = block.y[side] - prediction[side], block.y[side] - centre
        out.append([float(side.sum()), np.abs(e).sum(), (e * e).sum(), d.sum(), (d * d).sum()])
    return out


ROWS = "spec int, step int, role string, numbers array<double>"
ROLES = ("train", "validation")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64()))
    columns = zip(*rows) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["spec", "step", "role", "numbers"])


# ---------------------------------------------------------------- fitting
@dataclass
class Ensemble:
    spec: Spec
    layout: Layout
    mean: float
    trees: list[Tree]

    def importance(self) -> dict[tuple[str, str | None], float]:
        """Share of the drop of squared error of each (column, label); label None: a numeric column."""
        total: dict[tuple[str, str | None], float] = {}
        for tree in self.trees:
            for i in np.flatnonzero(tree.split >= 0):
                c = self.layout.column[tree.split[i]]
                labels = self.layout.labels[c]
                key = self.layout.names[c], labels[tree.split[i] - self.layout.first[c]] if labels is not None else None
                total[key] = total.get(key, 0.0) + tree.gain[i] / tree.n[0]
        whole = sum(total.values())
        return {k: v / whole for k, v in total.items()} if whole else {}


def pack(rows: DataFrame, target: str, layout: Layout, block_rows: int = BLOCK_ROWS, total: int | None = None,
         id_cols: Sequence[str] = ()) -> DataFrame:
    """Rows (slice, target, columns) as blocks of binned rows, one row each. A row's key is the hash of
    ``id_cols``, else of its values."""
    total = rows.count() if total is None else total
    n_blocks = max(1, -(-total // min(block_rows, PART_ROWS)))
    key = F.xxhash64(*[F.col(c) for c in id_cols or (target, *layout.names)])
    keyed = rows.select(key.alias("key"), F.col("slice").cast("int"), F.col(target).cast("double").alias("y"),
                        *[F.col(c).alias(f"x{i}") for i, c in enumerate(layout.names)])
    # equal rows have equal keys but need not share a block: they are dealt out by their place as well
    dealt = keyed.withColumn("block", F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int"))
    # a number of partitions of its own: blocks are few bytes but much work
    dealt = dealt.repartition(min(n_blocks, 4 * rows.sparkSession.sparkContext.defaultParallelism), "block")

    def binned(table: pa.Table) -> pa.Table:
        codes = np.stack([layout.codes(c, table[f"x{c}"].combine_chunks()) for c in range(len(layout.names))]).astype(code_type(layout))
        # in order of the key, so that sums do not depend on the order in which rows arrive
        order = np.lexsort((table["y"].to_numpy(), table["slice"].to_numpy(), table["key"].to_numpy()))
        parts = {"codes": codes[:, order], "y": table["y"].to_numpy()[order], "keys": table["key"].to_numpy()[order].astype(np.uint64),
                 "slices": table["slice"].to_numpy()[order].astype(np.int32)}
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()),
                         **{k: pa.array([v.tobytes()], pa.binary()) for k, v in parts.items()}})

    return dealt.groupBy("block").applyInArrow(binned, "block int, codes binary, y binary, keys binary, slices binary")


def fit(rows: DataFrame, categorical: Sequence[str], numeric: Sequence[str], target: str, specs: Sequence[Spec],
        keep: bool = True, block_rows: int = BLOCK_ROWS) -> tuple[list[Ensemble], list[dict]]:
    """Ensembles of all ``specs`` (their trees only with ``keep``) on rows with a ``slice`` column, and
    one row of error sums for each (spec, stage, side). A null target is an error."""
    sides = rows.groupBy("slice").agg(F.count("*").alias("n"), F.sum(F.col(target).cast("double")).alias("sum"), F.count_if(F.col(target).isNull()).alias("bad")).collect()
    total, bad = sum(r["n"] for r in sides), sum(r["bad"] for r in sides)
    if bad or not total:
        raise ValueError(f"{target}: {bad} null values in {total} rows")
    centre = sum(r["sum"] for r in sides) / total
    counts = SliceCounts(rows, categorical, numeric)
    fills = counts.fills(sorted({s.train for s in specs}))
    layout = layout_of(counts, fills)
    blocks = materialize(pack(rows, target, layout, block_rows, total))
    n_cells = math.prod(np.diff(layout.first).tolist())
    if total > block_rows and n_cells * max(1, sum(len(s.stages) for s in specs)) <= MOST_KINDS and all(float(s.params["subsample"]) >= 1.0 for s in specs):
        found = _grow_on_kinds(blocks, layout, specs, fills, centre, keep, n_cells)
    elif total <= block_rows:
        found = _grow_whole(blocks, layout, specs, fills, centre, keep, {r["slice"]: r["n"] for r in sides})
    else:
        found = _grow_in_rounds(blocks, layout, specs, fills, centre, keep)
    return _read(found, layout, specs, centre)


def _read(found: Sequence, layout: Layout, specs: Sequence[Spec], centre: float) -> tuple[list[Ensemble], list[dict]]:
    ensembles = [Ensemble(s, layout, float("nan"), []) for s in specs]
    sums: dict[tuple[int, int, str], np.ndarray] = {}
    for r in sorted(found, key=lambda r: (r["spec"], r["role"], r["step"])):
        if r["role"] == "mean":
            ensembles[r["spec"]].mean = r["numbers"][0]
        elif r["role"] == "tree":
            ensembles[r["spec"]].trees.append(Tree.unpacked(r["numbers"]))
        else:
            key = r["spec"], r["step"], r["role"]
            sums[key] = sums.get(key, 0) + np.array(r["numbers"])
    rows = []
    for (spec, step, role), (n, a, q, d, dd) in sorted(sums.items()):
        spread = dd - d * d / n if n else 0.0
        r2 = None if not n else 1 - q / spread if spread > 0 else 1.0 if q == 0 else 0.0
        rows.append({"spec": spec, "step": step, "role": role, "rows": int(n), "mae": float(a / n) if n else None,
                     "rmse": float(np.sqrt(q / n)) if n else None, "r2": None if r2 is None else float(r2)})
    return ensembles, rows


# ---------------------------------------------------------------- tables that a task holds whole
class Held:
    """A model on a part whose rows stand in order of their slices, so that the fit set comes first. Every row
    has its residual and its node in the tree being grown; both move on chunk by chunk, in the same pass
    that counts the next level."""

    def __init__(self, layout: Layout, part: "Part", spec: Spec, fill: Mapping):
        self.layout, self.part, self.spec, self.bins = layout, part, spec, part.bins(layout, fill)
        self.n_fit, self.n = (int(np.searchsorted(part.slice, s, side="right")) for s in (spec.train, spec.valid))
        self.start = float(part.y[:self.n_fit].mean()) if self.n_fit else float("nan")
        self.residual = part.y[:self.n] - self.start
        self.size = 2 ** (int(spec.params["max_depth"]) + 1)
        self.node = np.zeros(self.n, dtype=np.min_scalar_type(self.size))
        self.place = {c: (g, j) for g, members in enumerate(part.members) for j, c in enumerate(members)}
        self.rows_of_cells = [np.bincount(cells[:self.n_fit], minlength=table.shape[1]) for cells, table in zip(part.cells, self.bins)]
        self.waiting: tuple[list, np.ndarray] | None = None       # steps and values of a tree not yet in the residuals

    def steps(self, tree: Tree, nodes: np.ndarray) -> list[tuple[int, bool, list[tuple[np.ndarray, np.ndarray]]]]:
        """For each eight nodes of a level: the first one, whether all of them are split, and by group of columns
        its cells and for each cell a bit a node, which is set where the row goes right."""
        out = []
        if not len(nodes):
            return out
        first = 2 ** (int(nodes[0] + 1).bit_length() - 1) - 1
        for start in range(first, 2 * first + 1, 8):
            luts: dict[int, np.ndarray] = {}
            own = nodes[(nodes >= start) & (nodes < start + 8)].tolist()
            for i in own:
                split = int(tree.split[i])
                g, j = self.place[int(self.layout.column[split])]
                right = self.bins[g][j] > split if self.layout.numeric[split] else self.bins[g][j] == split
                luts[g] = luts.get(g, 0) | (right.astype(np.uint8) << np.uint8(i - start))
            if own:
                out.append((start, own, [(self.part.cells[g], lut) for g, lut in luts.items()]))
        return out

    def move(self, steps: Sequence, a: int, b: int, values: np.ndarray | None):
        """Rows a to b go a level down; ``values``: of the nodes of a finished tree, which leave the residuals."""
        b = min(b, self.n)
        node = self.node[a:b]
        at = node.copy() if len(steps) > 1 else node
        for start, own, luts in steps:
            bits = 0
            for cells, lut in luts:
                bits = np.take(lut, cells[a:b], mode="clip") | bits
            if start == 0:
                node += bits + node.dtype.type(1)
                continue
            local = (at - node.dtype.type(start)).astype(np.uint8) if node.dtype == np.uint8 else np.where((at >= start) & (at < start + 8), at - start, 255).astype(np.uint8)
            down = ((bits >> (local & np.uint8(7))) & np.uint8(1)).astype(node.dtype) + at + node.dtype.type(1)        # 2i + 1 or 2i + 2, less i
            split = np.zeros(256, dtype=bool)
            split[[i - start for i in own]] = True
            if len(own) == 8 or start + len(own) == 2 * start + 1:       # all rows at this level or below go; others are at leaves above it
                down *= local < 8
            else:
                down *= np.take(split, local, mode="clip")
            node += down
        if values is not None:
            self.residual[a:b] -= np.take(values, node, mode="clip")
            node[:] = 0

    def settle(self):
        """The residuals after all trees."""
        if self.waiting is not None:
            for a in range(0, self.n, CHUNK):
                self.move(self.waiting[0], a, a + CHUNK, self.waiting[1])
            self.waiting = None

    def count(self, bag: np.ndarray | None, steps: Sequence, values: np.ndarray | None, children: np.ndarray | None) -> np.ndarray:
        """(2, slots, bins) of the rows of ``bag`` (None: all) that these steps bring to ``children`` (None: the
        root, which is all rows less the few that are not in the bag)."""
        slots = 1 if children is None else len(children)
        slot_of = np.zeros(self.size, dtype=np.min_scalar_type(slots))
        if children is not None:
            slot_of[children] = np.arange(1, slots + 1)
        sums = [np.zeros((2, slots * table.shape[1])) for table in self.bins]
        size = max(CHUNK, 2 * max(x.shape[1] for x in sums))
        for a in range(0, self.n, size):
            self.move(steps, a, a + size, values)
            b, slot = min(a + size, self.n_fit), None
            if b <= a:
                continue
            residual = self.residual[a:b]
            if children is None:
                for cells, out in zip(self.part.cells, sums):
                    out[0] += np.bincount(cells[a:b], weights=residual, minlength=out.shape[1])
                if bag is None:
                    continue
                rows, sign = np.flatnonzero(~bag[a:b]), -1
            else:
                slot = np.take(slot_of, self.node[a:b], mode="clip")
                rows, sign = np.flatnonzero(slot.astype(bool) if bag is None else slot.astype(bool) & bag[a:b]), 1
                slot = np.take(slot, rows, mode="clip").astype(np.int64) - 1 if slots > 1 else None
            weights = np.take(residual, rows, mode="clip")
            for cells, out, table in zip(self.part.cells, sums, self.bins):
                at = np.take(cells[a:b], rows, mode="clip").astype(np.int64)
                if slot is not None:
                    at += slot * table.shape[1]
                out[0] += sign * np.bincount(at, weights=weights, minlength=out.shape[1])
                out[1] += sign * np.bincount(at, minlength=out.shape[1])
        if children is None:
            for n, out in zip(self.rows_of_cells, sums):
                out[1] += n
        return spread(int(self.layout.first[-1]), self.bins, sums, slots)

    def grow(self, bag: np.ndarray | None) -> Tree:
        """The next tree, on the rows of ``bag`` (None: all)."""
        p = self.spec.params
        depth, least = int(p["max_depth"]), int(p["min_samples_leaf"])
        tree, nodes = Tree(depth), np.array([0])
        hist = self.count(bag, *(self.waiting or ([], None)), None)
        steps: list = []
        for level in range(depth):
            found = best_splits(self.layout, hist, least)
            done = set_splits(tree, nodes, found, level == depth - 1)
            steps = self.steps(tree, nodes[done])
            if not len(done) or level == depth - 1:
                break
            # the smaller child of each split is counted, the other one is the rest
            small_left = 2 * found[6][done] <= found[4][done]
            part = self.count(bag, steps, None, 2 * nodes[done] + np.where(small_left, 1, 2))
            rest = hist[:, done] - part
            hist = np.stack([np.where(small_left[:, None], part, rest), np.where(small_left[:, None], rest, part)], axis=2).reshape(2, -1, hist.shape[2])
            nodes = np.stack([2 * nodes[done] + 1, 2 * nodes[done] + 2], axis=1).reshape(-1)
        self.waiting = steps, float(p["learning_rate"]) * tree.value
        return tree

    def errors(self, centre: float) -> list[list[float]]:
        self.settle()
        y = self.part.y[:self.n]
        return error_sums(Block(np.zeros((0, 0)), y, np.zeros(0), self.part.slice[:self.n]), self.spec, y - self.residual, centre)


class Bags:
    """Subsamples of a part's rows in the current tree, drawn once for all models that have the same."""

    def __init__(self, part: "Part"):
        self.part, self.held = part, {}

    def of(self, t: int, spec: Spec, n: int) -> np.ndarray | None:
        seed, share = int(spec.params["random_state"]), float(spec.params["subsample"])
        if share >= 1.0:
            return None
        tree, bag = self.held.get((seed, share), (-1, None))
        if tree != t:
            bag = np.concatenate([in_bag(self.part.key[a:a + CHUNK], t, seed, share) for a in range(0, len(self.part.key), CHUNK)])
            self.held[seed, share] = t, bag
        return bag[:n]


def spread(n_bins: int, bins: Sequence[np.ndarray], sums: Sequence[np.ndarray], slots: int) -> np.ndarray:
    """(planes, slots, bins) from each group's (planes, slots x cells)."""
    out = np.zeros((len(sums[0]), slots * n_bins))
    for table, counted in zip(bins, sums):
        to = (np.arange(slots)[:, None, None] * n_bins + table).ravel()
        for plane, x in zip(out, counted):
            plane += np.bincount(to, weights=np.broadcast_to(x.reshape(slots, 1, -1), (slots, *table.shape)).ravel(), minlength=slots * n_bins)
    return out.reshape(-1, slots, n_bins)


def dealt_by_work(work: Sequence[float], n: int) -> list[list[int]]:
    """The places of ``work`` in ``n`` lists of about equal work."""
    out, loads = [[] for _ in range(n)], np.zeros(n)
    for i in sorted(range(len(work)), key=lambda i: -work[i]):
        out[int(loads.argmin())].append(i)
        loads[loads.argmin()] += work[i]
    return [x for x in out if x]


def task_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` hash partitions, a number that falls into it."""
    found = spark.range(32 * n + 64).select(F.col("id").cast("int").alias("id")).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    return [r["id"] for r in found]


def _grow_whole(blocks: DataFrame, layout: Layout, specs: Sequence[Spec], fills: Mapping, centre: float, keep: bool, sizes: Mapping[int, int]) -> list[dict]:
    """Each task has all rows and some of the models, dealt out by rows x levels."""
    spark = blocks.sparkSession
    work = [s.trees * (1 + int(s.params["max_depth"])) * sum(n for at, n in sizes.items() if at <= s.valid) for s in specs]
    deals = dealt_by_work(work, max(1, min(len(specs), spark.sparkContext.defaultParallelism)))
    keys = task_keys(spark, len(deals))
    deals = dict(zip(keys, deals)) if len(keys) == len(deals) else dict(enumerate(deals))
    drawn = any(float(s.params["subsample"]) < 1.0 for s in specs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row.pop("task"), []).append(row)
        while held:
            task, rows = held.popitem()
            part = Part.joined(layout, rows, drawn)
            rows.clear()
            models, bags = {i: Held(layout, part, specs[i], fills[specs[i].train]) for i in deals[task]}, Bags(part)
            out = [(i, 0, "mean", [m.start, float(m.n_fit)]) for i, m in models.items()]
            for t in range(max(s.trees for s in specs)):
                for i, m in models.items():
                    if t >= m.spec.trees or not m.n_fit:
                        continue
                    tree = m.grow(bags.of(t, m.spec, m.n_fit))
                    if keep:
                        out.append((i, t, "tree", tree.packed()))
                    if t + 1 in m.spec.stages:
                        out += [(i, t + 1, role, x) for role, x in zip(ROLES, m.errors(centre))]
            yield _rows(out)

    each = blocks.withColumn("task", F.explode(F.array(*[F.lit(k) for k in deals]))).repartition(len(deals), "task")
    return each.mapInArrow(run, ROWS).collect()


# ---------------------------------------------------------------- several blocks, few kinds of rows
def _grow_on_kinds(blocks: DataFrame, layout: Layout, specs: Sequence[Spec], fills: Mapping, centre: float, keep: bool, n_cells: int) -> list[dict]:
    """Columns with so few bins that all combinations of codes are few: a tree sees a combination's rows by
    their number and mean alone, so models grow on these, one a task, whatever the rows. The rows
    themselves are read once for the numbers and once for the errors."""
    shape = np.diff(layout.first).tolist()

    def read(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for codes, y, slices in zip(*(batch.column(c) for c in ("codes", "y", "slices"))):
                codes = np.frombuffer(codes.as_buffer(), dtype=code_type(layout)).reshape(len(shape), -1).astype(np.int64)
                yield np.ravel_multi_index(codes, shape), np.frombuffer(y.as_buffer()), np.frombuffer(slices.as_buffer(), dtype=np.int32)

    def kinds(batches):
        for cell, y, slices in read(batches):
            for at in np.unique(slices).tolist():
                own = slices == at
                n, s = np.bincount(cell[own], minlength=n_cells), np.bincount(cell[own], weights=y[own] - centre, minlength=n_cells)
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(seen), pa.int32()), pa.array(seen, pa.int64()), pa.array(n[seen], pa.int64()),
                                                  pa.array(s[seen], pa.float64())], names=["slice", "cell", "n", "s"])

    def grow(table: pa.Table) -> pa.Table:
        i = table["spec"][0].as_py()
        spec, table = specs[i], table.sort_by([("cell", "ascending"), ("slice", "ascending")])
        cell, n, at = table["cell"].to_numpy(), table["n"].to_numpy().astype(float), table["slice"].to_numpy()
        codes = np.stack(np.unravel_index(cell, shape)).astype(np.int64) + layout.first[:-1, None]
        y, fit, p = table["s"].to_numpy() / n + centre, at <= spec.train, spec.params
        block = Block(codes, y, np.zeros(len(y), dtype=np.uint64), np.full(len(y), spec.valid)).of(layout, spec, fills[spec.train])
        start = float((n * y)[fit].sum() / n[fit].sum()) if fit.any() else float("nan")
        guess, groups = np.full(len(y), start), groups_of(layout, block.flat)
        out = [(i, 0, "mean", [start, float(n[fit].sum())])]
        for t in range(spec.trees if fit.any() else 0):
            tree, leaves = grow_tree(layout, block.flat, groups, y - guess, fit, int(p["max_depth"]), int(p["min_samples_leaf"]), n)
            for node, rows in leaves.items():
                guess[rows] += float(p["learning_rate"]) * tree.value[node]
            if keep:
                out.append((i, t, "tree", tree.packed()))
            if t + 1 in spec.stages:
                of_cell = np.full(n_cells, np.nan)
                of_cell[cell] = guess
                out.append((i, t + 1, "guess", of_cell))
        return pa.Table.from_batches([_rows(out)])

    table = blocks.mapInArrow(kinds, "slice int, cell bigint, n bigint, s double").groupBy("slice", "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    each = materialize(table).withColumn("spec", F.explode(F.array(*[F.lit(i) for i in range(len(specs))])))
    found = [r.asDict() for r in each.groupBy("spec").applyInArrow(grow, ROWS).collect()]
    guesses = {(r["spec"], r["step"]): np.array(r["numbers"]) for r in found if r["role"] == "guess"}

    def errors(batches):
        for cell, y, slices in read(batches):
            out = []
            for (i, step), guess in guesses.items():
                rows = slices <= specs[i].valid
                block = Block(np.zeros((0, 0)), y[rows], np.zeros(0), slices[rows])
                out += [(i, step, role, x) for role, x in zip(ROLES, error_sums(block, specs[i], guess[cell[rows]], centre))]
            yield _rows(out)

    if guesses:
        found += [r.asDict() for r in _summed(blocks.mapInArrow(errors, ROWS)).collect()]
    return [r for r in found if r["role"] != "guess"]


def _summed(errors: DataFrame) -> DataFrame:
    """Error sums of blocks, added by (spec, step, side)."""
    return errors.groupBy("spec", "step", "role").agg(F.array(*[F.sum(F.col("numbers")[k]) for k in range(5)]).alias("numbers"))


# ---------------------------------------------------------------- several blocks: a job for each level
def _dense(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values (0 to ``size`` - 1) among those that occur, and these."""
    seen = np.zeros(size, dtype=bool)
    seen[values] = True
    return (np.cumsum(seen) - 1)[values], np.flatnonzero(seen)


def joint_cells(layout: Layout, codes: np.ndarray, most: int = MOST_CELLS) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """``groups_of`` in the form that blocks keep: (columns, each row's cell, (columns, cells): codes)."""
    out: list[tuple[list[int], np.ndarray, np.ndarray]] = []
    for c in np.argsort(np.diff(layout.first), kind="stable"):
        own, seen = _dense(codes[c], int(layout.first[c + 1] - layout.first[c]))
        if out:
            members, cells, table = out[-1]
            joint, pairs = _dense(cells.astype(np.int64) * len(seen) + own, table.shape[1] * len(seen))
            if len(pairs) <= most:
                out[-1] = [*members, int(c)], joint, np.vstack([table[:, pairs // len(seen)], seen[pairs % len(seen)]])
                continue
        out.append(([int(c)], own, seen[None, :]))
    return out


@dataclass
class Part:
    """A block whose rows are cells of few groups of columns; what a fold fills nulls with is read off the
    groups' tables, so rows are the same for all models."""
    y: np.ndarray
    key: np.ndarray
    slice: np.ndarray
    cells: list[np.ndarray]
    codes: list[np.ndarray]
    members: list[list[int]]
    kept: list[np.ndarray]

    @staticmethod
    def of(layout: Layout, row: Mapping, models: int, drawn: bool) -> "Part":
        """From a row of ``pack``; keys only where a model draws subsamples."""
        return Part.joined(layout, [row], drawn, models)

    @staticmethod
    def joined(layout: Layout, rows: Sequence[Mapping], drawn: bool, models: int = 0) -> "Part":
        """From rows of ``pack``, in order of slice and key."""
        column = {c: np.concatenate([np.frombuffer(r[c], dtype=kind) for r in rows]) for c, kind in (("y", np.float64), ("keys", np.uint64), ("slices", np.int32))}
        order = np.lexsort((column["y"], column["keys"], column["slices"]))
        codes = np.empty((len(layout.names), len(order)), dtype=code_type(layout))
        at = 0
        for r in rows:
            block = np.frombuffer(r["codes"], dtype=codes.dtype).reshape(len(codes), -1)
            codes[:, at:at + block.shape[1]] = block
            at += block.shape[1]
        for c, x in enumerate(codes):
            codes[c] = x[order]
        found = joint_cells(layout, codes)
        members, cells, tables = map(list, zip(*found))
        return Part(column["y"][order], column["keys"][order] if drawn else np.zeros(0, dtype=np.uint64), column["slices"][order].astype(np.int16),
                    [x.astype(np.uint16) for x in cells], [x.astype(np.uint16) for x in tables], members, [np.zeros(0)] * models)

    def bins(self, layout: Layout, fill: Mapping) -> list[np.ndarray]:
        """Each group's (columns, cells) table of bins, with the fold's values in place of nulls."""
        out = []
        for members, codes in zip(self.members, self.codes):
            table = codes.astype(np.int64)
            for j, c in enumerate(members):
                if layout.names[c] in fill:
                    null = int(layout.first[c + 1] - layout.first[c]) - 1
                    table[j][table[j] == null] = layout.code(c, fill[layout.names[c]])
            out.append(table + layout.first[members][:, None])
        return out

    def leaves(self, layout: Layout, tree: Tree, bins: list[np.ndarray]) -> np.ndarray:
        """Each row's node, one level of the tree after the other."""
        place = {c: (g, j) for g, members in enumerate(self.members) for j, c in enumerate(members)}
        node = np.zeros(len(self.y), dtype=np.int16 if len(tree.split) < 1 << 15 else np.int64)
        first, last = 0, 1
        while last <= len(tree.split):
            step = np.zeros_like(node)
            for i in first + np.flatnonzero(tree.split[first:last] >= 0):
                split = int(tree.split[i])
                g, j = place[int(layout.column[split])]
                right = bins[g][j] > split if layout.numeric[split] else bins[g][j] == split
                going = np.take(right.astype(step.dtype) + step.dtype.type(i + 1), self.cells[g], mode="clip")       # 2i + 1 or 2i + 2, less i
                if i:
                    going *= node == i
                step += going
            if not step.any():
                break
            node += step
            first, last = last, 2 * last + 1
        return node

    def prediction(self, layout: Layout, i: int, m: "_Growing", bins: list[np.ndarray]) -> np.ndarray:
        """Predictions of a model's finished trees."""
        out = np.full(len(self.y), m.start)
        if len(self.kept[i]):
            out += self.kept[i]
        for tree in m.pending:
            out += np.take(float(m.spec.params["learning_rate"]) * tree.value, self.leaves(layout, tree, bins), mode="clip")
        return out

    def histogram(self, n_bins: int, bins: list[np.ndarray], rows: np.ndarray | None, slot: np.ndarray | None, slots: int, residual: np.ndarray) -> np.ndarray:
        """(2, slots, bins): sum of residuals and count of ``rows`` (None: all)."""
        weights, sums = residual if rows is None else residual[rows], []
        for cells, table in zip(self.cells, bins):
            n = table.shape[1]
            at = cells if rows is None else cells[rows]
            if slots > 1:
                at = at + slot * n
            sums.append(np.stack([np.bincount(at, weights=weights, minlength=slots * n), np.bincount(at, minlength=slots * n)]))
        return spread(n_bins, bins, sums, slots)


class _Growing:
    """What the driver knows of one model: finished trees, those not yet in the kept predictions, and
    the tree being grown."""

    def __init__(self, spec: Spec, start: float):
        self.spec, self.start, self.pending, self.done = spec, start, [], 0
        self.next_tree()

    def next_tree(self):
        self.tree, self.level, self.nodes = Tree(int(self.spec.params["max_depth"])), 0, np.array([0])
        self.counted, self.parents, self.small_left = self.nodes, None, None

    def whole(self, hist: np.ndarray) -> np.ndarray:
        """Histograms of all open nodes from those of the counted ones, the root or the smaller child of each split."""
        if self.parents is None:
            return hist
        rest, left = self.parents - hist, self.small_left[:, None]
        return np.stack([np.where(left, hist, rest), np.where(left, rest, hist)], axis=2).reshape(2, -1, hist.shape[2])

    def open(self, hist: np.ndarray, found: tuple[np.ndarray, ...], done: np.ndarray):
        """The children of the nodes that were split come next."""
        at = self.nodes[done]
        self.level, self.parents, self.small_left = self.level + 1, hist[:, done], 2 * found[6][done] <= found[4][done]
        self.counted = 2 * at + np.where(self.small_left, 1, 2)
        self.nodes = np.stack([2 * at + 1, 2 * at + 2], axis=1).reshape(-1)

    @property
    def active(self) -> bool:
        return self.done < self.spec.trees


def _grow_in_rounds(blocks: DataFrame, layout: Layout, specs: Sequence[Spec], fills: Mapping, centre: float, keep: bool) -> list[dict]:
    def sides(batches):
        for batch in batches:
            for y, slices in zip(batch.column("y"), batch.column("slices")):
                y, at = np.frombuffer(y.as_buffer()), np.frombuffer(slices.as_buffer(), dtype=np.int32)
                yield _rows([(i, 0, "mean", [y[at <= s.train].sum(), float((at <= s.train).sum())]) for i, s in enumerate(specs)])

    starts = {r["spec"]: r for r in blocks.mapInArrow(sides, ROWS).groupBy("spec").agg(
        F.sum(F.col("numbers")[0]).alias("s"), F.sum(F.col("numbers")[1]).alias("n")).collect()}
    models = [_Growing(s, starts[i]["s"] / starts[i]["n"] if starts[i]["n"] else float("nan")) for i, s in enumerate(specs)]
    out = [{"spec": i, "step": 0, "role": "mean", "numbers": [m.start, starts[i]["n"]]} for i, m in enumerate(models)]
    # a partition a core, so that the histograms that reach the driver are as many as cores, however many the rows
    n = max(1, min(blocks.sparkSession.sparkContext.defaultParallelism, blocks.count()))
    drawn = any(float(s.params["subsample"]) < 1.0 for s in specs)
    state = blocks.rdd.map(lambda row: (row["block"], row)).partitionBy(n, int).map(
        lambda pair: Part.of(layout, pair[1], len(specs), drawn)).persist(StorageLevel.MEMORY_AND_DISK)
    before, steps = None, 0
    while any(m.active for m in models):
        hists: dict[int, np.ndarray] = {}
        if any(len(m.pending) >= KEPT_TREES for m in models if m.active):       # written anew by the job that needs them
            before, state, steps = state, state.map(_kept(layout, models, fills)).persist(StorageLevel.MEMORY_AND_DISK), steps + 1
            if steps % CUT_STEPS == 0:
                state.checkpoint()
            for m in models:
                m.pending = []
        for i, hist in state.mapPartitions(_level(layout, models, fills)).collect():
            hists[i] = hists[i] + hist if i in hists else hist
        for i, hist in hists.items():
            m = models[i]
            depth, hist = int(m.spec.params["max_depth"]), m.whole(hist)
            found = best_splits(layout, hist, int(m.spec.params["min_samples_leaf"]))
            done = set_splits(m.tree, m.nodes, found, m.level == depth - 1)
            m.open(hist, found, done)
            if m.level == depth or not len(done):
                m.pending.append(m.tree)
                if keep:
                    out.append({"spec": i, "step": m.done, "role": "tree", "numbers": m.tree.packed()})
                m.done += 1
                if m.done in m.spec.stages:
                    out += _stage_errors(state, layout, models, fills, centre, i)
                m.next_tree()
        if before is not None:
            before.unpersist()
            before = None
    state.unpersist()
    return out


def _level(layout: Layout, models: Sequence[_Growing], fills: Mapping):
    """Task: histograms of the open nodes of all models, summed over the blocks of a partition."""
    n_bins = int(layout.first[-1])

    def run(parts: Iterator[Part]) -> Iterator[tuple[int, np.ndarray]]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            tables = {train: part.bins(layout, fill) for train, fill in fills.items()}
            for i, m in enumerate(models):
                if not m.active:
                    continue
                p, bins = m.spec.params, tables[m.spec.train]
                residual = part.y - part.prediction(layout, i, m, bins)
                wanted = part.slice <= m.spec.train
                if float(p["subsample"]) < 1.0:
                    wanted &= in_bag(part.key, m.done, int(p["random_state"]), float(p["subsample"]))
                slot = None
                if m.level:
                    slots = np.full(len(m.tree.split), -1)
                    slots[m.counted] = np.arange(len(m.counted))
                    slot = np.take(slots, part.leaves(layout, m.tree, bins), mode="clip")
                    wanted &= slot >= 0
                rows = None if wanted.all() else np.flatnonzero(wanted)
                hist = part.histogram(n_bins, bins, rows, slot if rows is None or slot is None else slot[rows], len(m.counted), residual)
                sums[i] = sums[i] + hist if i in sums else hist
        return iter(sums.items())
    return run


def _kept(layout: Layout, models: Sequence[_Growing], fills: Mapping):
    """Task: sums of rate * value of the finished trees, beside the blocks."""
    def run(part: Part) -> Part:
        tables = {train: part.bins(layout, fill) for train, fill in fills.items()}
        return replace(part, kept=[part.prediction(layout, i, m, tables[m.spec.train]) - m.start if m.active else np.zeros(0) for i, m in enumerate(models)])
    return run


def _stage_errors(state: RDD, layout: Layout, models: Sequence[_Growing], fills: Mapping, centre: float, i: int) -> list[dict]:
    m = models[i]

    def run(parts: Iterator[Part]) -> Iterator[np.ndarray]:
        total = np.zeros((2, 5))
        for part in parts:
            guess = part.prediction(layout, i, m, part.bins(layout, fills[m.spec.train]))
            rows = part.slice <= m.spec.valid
            block = Block(np.zeros((0, 0)), part.y[rows], part.key, part.slice[rows])
            total += np.array(error_sums(block, m.spec, guess[rows], centre))
        yield total

    # Chan's sums need no correction here: all blocks are taken about one centre
    sums = sum(state.mapPartitions(run).collect())
    return [{"spec": i, "step": m.done, "role": role, "numbers": x.tolist()} for role, x in zip(ROLES, sums)]


# ---------------------------------------------------------------- a Spark ML model of an ensemble
def spark_model(spark: SparkSession, ensemble: Ensemble, positions: Mapping[tuple[str, str | None], int], width: int,
                features_col: str, prediction_col: str) -> GBTRegressionModel:
    """The trees as a Spark ML ensemble (sum of rate * tree, without the mean), by way of the files in
    which Spark ML persists one. ``positions``: vector index of each (column, label)."""
    rate = float(ensemble.spec.params["learning_rate"])
    nodes = [(t, node) for t, tree in enumerate(ensemble.trees) for node in _node_rows(ensemble.layout, tree, positions)]
    n = len(ensemble.trees)
    path = saved_trees(spark, spark.createDataFrame(nodes, TREE_NODES).coalesce(1), "GBTRegressionModel", n, rate, int(ensemble.spec.params["max_depth"]), width,
                       {"featuresCol": features_col, "predictionCol": prediction_col, "maxIter": n, "stepSize": rate})
    return GBTRegressionModel.load(path)


TREE_NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
              "gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def saved_trees(spark: SparkSession, nodes: DataFrame, kind: str, n_trees: int, weight: float, depth: int, width: int, params: Mapping) -> str:
    """A folder of the files in which Spark ML persists an ensemble of the class ``kind``, with these nodes."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    shared = {"maxDepth": max(1, depth), "impurity": "variance", "featuresCol": params["featuresCol"]}

    def metadata(name: str, own: Mapping, **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.regression.{name}", "timestamp": 0, "sparkVersion": spark.version,
                           "uid": f"dwell_{uuid.uuid4().hex[:12]}", "paramMap": {**shared, **own}, "defaultParamMap": {}, **more})

    trees = [(t, metadata("DecisionTreeRegressionModel", {}), weight) for t in range(n_trees)]
    spark.createDataFrame([(metadata(kind, params, numFeatures=width, numTrees=n_trees),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    nodes.write.parquet(f"{path}/data")
    return path


def _node_rows(layout: Layout, tree: Tree, positions: Mapping) -> list[tuple]:
    """Nodes in preorder, numbered from 0."""
    out: list[tuple] = []

    def visit(i: int) -> int:
        number, n, mean = len(out), float(tree.n[i]), float(tree.value[i])
        head, stats = (number, mean, 0.0, [n, n * mean, n * mean * mean], int(n)), tree.split[i]
        out.append(())
        if stats < 0:
            out[number] = (*head, -1.0, -1, -1, (-1, [], -1))
            return number
        c = layout.column[stats]
        labels = layout.labels[c]
        feature = positions[layout.names[c], labels[stats - layout.first[c]] if labels is not None else None]
        left, right = visit(2 * i + 1), visit(2 * i + 2)
        out[number] = (*head, float(tree.gain[i] / max(n, 1.0)), left, right, (int(feature), [float(tree.threshold[i])], -1))
        return number

    visit(0)
    return out
