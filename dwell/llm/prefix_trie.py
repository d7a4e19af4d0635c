"""Prefix trie of conversations: which beginnings conversations share, and what sharing saves.

Method: padded turn-id matrices. Conversations, as sequences of 128-bit turn digests, are dealt into
range shards by (sequence, conv_id). A shard takes its conversations as padded integer matrices of 64
columns (depths) at a time; numpy's lexsort orders them, and change masks, OR-accumulated over the
columns, mark the row at which each node of each depth starts. What a node needs is then a sum or
minimum over consecutive rows (``reduceat``).

All members of a node stand together in the order, so a node that holds neither the first nor the
last row of a shard lies wholly inside it. The others, the two boundary paths of each shard, are
combined over the shards first (members, smallest member, members that end there) and given back, so
that each row knows at which depths it is its node's smallest member. That makes the sums over
subtrees plain sums over members:

* children: members that are the smallest of their node one level down;
* leaves: members that are the smallest of a childless node;
* saved tokens: each member's bytes from the node's depth down, as far as it is not the smallest.

Turns are digested in one pass over the texts, so a conversation is 32 characters a turn from then on;
one conversation stays in one task. A hot beginning or a group of copies spreads over many shards.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwell.llm import scratch

ID_HEX = 32               # characters of a turn's digest
COLUMNS = 64              # depths of a matrix
SHARD_CONVERSATIONS = 4096
SHARD_TURNS = 65_536
PATHS = "shard long, depth long, node binary, side long, smallest long, n_convs long, n_ends long"
NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string, node binary, shard long, ends string")
TRIE = NODES.split(", node ")[0]


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs of (id, size).

    Turns are in order of ``turn``, null first, equal ones in order of their digest; repeated rows are
    turns of their own. A null role or text is empty. Rows without conv_id belong to no conversation and
    are left out. Other columns are not read."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = rows.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn"), F.substring(F.sha2(key, 256), 1, ID_HEX).alias("id"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda x: F.struct(x["id"], x["size"])).alias("turns"))


def rebuilt(convs: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """Each conversation with its first ``heads`` turns (at most ``most``) replaced by those of
    conversation ``base``: all of them if it has fewer, none if there is no such conversation."""
    first = convs.select(F.col("conv_id").alias("head_of"), F.slice("turns", 1, most).alias("head"))
    joined = convs.withColumns({"base": base, "h": heads}).join(first, F.col("base") == F.col("head_of"), "left")
    own = F.when(F.col("h") >= F.size("turns"), F.slice("turns", 1, 0)).otherwise(
        F.expr("slice(turns, cast(h + 1 as int), greatest(size(turns), 1))"))
    taken = F.coalesce(F.expr("slice(head, 1, cast(h as int))"), F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(taken, own).alias("turns"))


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns of (conv_id, turns), the empty one included.

    conv_id: smallest member; depth; parent_conv_id: the parent's conv_id (root: null); n_convs; n_children;
    n_leaves: childless nodes in the subtree; saved_tokens: over the subtree, (n_convs - 1) times the size
    of a node's last turn; ends_sha256: digest of the ids of the members that end there. Conversations
    without turns are members of the root. No conversations: no rows."""
    flat = convs.select("conv_id", F.array_join(F.transform("turns", lambda x: x["id"]), "").alias("seq"),
                        F.transform("turns", lambda x: x["size"]).alias("sizes"))
    flat = scratch.stored(flat, "trie-sequences")
    n, turns = flat.agg(F.count("*"), F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()
    shards = max(1, -(-n // SHARD_CONVERSATIONS), -(-turns // SHARD_TURNS))
    sharded = flat.repartitionByRange(shards, "seq", "conv_id").withColumn("shard", F.spark_partition_id().cast("long"))
    sharded = scratch.stored(sharded, "trie-shards")
    own = sharded.groupBy("shard").applyInArrow(_boundaries, PATHS)
    own = scratch.stored(own, "trie-paths")
    whole = own.select("shard", "depth", "node", "smallest", "n_convs", "n_ends").distinct().groupBy("depth", "node").agg(
        F.min("smallest").alias("of_all"), F.sum("n_convs").alias("all_convs"), F.sum("n_ends").alias("all_ends"))
    met = own.join(whole, ["depth", "node"]).select("shard", "depth", "side", "node", F.col("of_all").alias("smallest"),
                                                    F.col("all_convs").alias("n_convs"), F.col("all_ends").alias("n_ends"))
    nodes = sharded.groupBy("shard").cogroup(met.groupBy("shard")).applyInArrow(_nodes, NODES)
    nodes = scratch.stored(nodes, "trie-nodes")
    inside = nodes.filter(F.col("node").isNull()).drop("node", "shard", "ends")
    parts = nodes.filter(F.col("node").isNotNull()).repartition(shards, "depth", "node").sortWithinPartitions("depth", "node", "shard")
    return inside.unionByName(parts.mapInArrow(_combined, TRIE))


class _Shard:
    """A shard's conversations in order, and what each depth's nodes are."""

    def __init__(self, table: pa.Table):
        self.conv = table["conv_id"].to_numpy()
        seqs = table["seq"].to_pylist()
        self.raw = [bytes.fromhex(s) for s in seqs]
        self.count = np.array([len(r) // (ID_HEX // 2) for r in self.raw], dtype=np.int64)
        ids = np.frombuffer(b"".join(self.raw), dtype=f"V{ID_HEX // 2}")
        # local ids in the order of the digests' bytes; 0 is the padding, before every turn
        known, places = np.unique(ids.view("S16") if not len(ids) else ids, return_inverse=True)
        self.flat = places.reshape(-1).astype(np.int64) + 1
        sizes = table["sizes"].combine_chunks()
        self.sizes = np.asarray(sizes.flatten() if len(sizes) else [], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.order = self._ordered()

    def matrix(self, rows: np.ndarray, block: int) -> np.ndarray:
        """Turn ids of ``rows`` at the depths of ``block``, padded with 0."""
        at = np.arange(block * COLUMNS, (block + 1) * COLUMNS)
        at = at[:max(0, int(self.count[rows].max(initial=0)) - block * COLUMNS)]
        there = at[None, :] < self.count[rows][:, None]
        out = np.zeros(there.shape, dtype=np.int64)
        out[there] = self.flat[(self.first[rows][:, None] + at[None, :])[there]]
        return out

    def blocks(self) -> range:
        return range(-(-int(self.count.max(initial=0)) // COLUMNS))

    def _ordered(self) -> np.ndarray:
        """By sequence, then conv_id: stable sorts by blocks of columns, the least significant first."""
        order = np.argsort(self.conv, kind="stable")
        for block in reversed(self.blocks()):
            longer = self.count[order] > block * COLUMNS
            rows = order[longer]
            order = np.concatenate((order[~longer], rows[np.lexsort(self.matrix(rows, block).T[::-1])]))
        return order

    def depths(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(depth, rows that reach it, in order; the positions among them at which nodes start)."""
        yield 0, self.order, np.zeros(min(1, len(self.order)), dtype=np.int64)
        group = np.zeros(len(self.conv), dtype=np.int64)       # of each row, at the end of the block before
        for block in self.blocks():
            rows = self.order[self.count[self.order] > block * COLUMNS]
            m = self.matrix(rows, block)
            changed = np.ones(m.shape, dtype=bool)
            changed[1:] = m[1:] != m[:-1]
            changed[1:, 0] |= group[rows][1:] != group[rows][:-1]
            new = np.logical_or.accumulate(changed, axis=1)
            for j in range(m.shape[1]):
                there = np.flatnonzero(m[:, j])
                yield block * COLUMNS + j + 1, rows[there], np.flatnonzero(new[there, j])
            group[rows] = np.cumsum(new[:, -1])

    def prefixes(self, row: int) -> list[bytes]:
        """The digest of the first 0, 1, 2, ... turns of a row: names its nodes in all shards."""
        width, state, out = ID_HEX // 2, hashlib.sha256(), []
        for d in range(self.count[row] + 1):
            state.update(self.raw[row][(d - 1) * width:d * width] if d else b"")
            out.append(state.digest())
        return out


def _boundaries(table: pa.Table) -> pa.Table:
    """Nodes on the paths of the shard's first (side 0) and last (side 1) row."""
    shard = _Shard(table)
    ends = shard.order[0], shard.order[-1]
    names = [shard.prefixes(row) for row in ends]
    out = []
    for depth, rows, starts in shard.depths():
        stops = np.append(starts[1:], len(rows))
        for side, row, k in ((0, ends[0], 0), (1, ends[1], -1)):
            if shard.count[row] >= depth:
                here = rows[starts[k]:stops[k]]
                out.append((table["shard"][0].as_py(), depth, names[side][depth], side, int(shard.conv[here].min()), len(here),
                            int((shard.count[here] == depth).sum())))
    return _arrow(out, PATHS)


def _nodes(table: pa.Table, paths: pa.Table) -> pa.Table:
    """All nodes of the shard; those of its boundary paths, named by ``node``, with this shard's share."""
    if not len(table):
        return _arrow([], NODES)
    shard = _Shard(table)
    ends = shard.order[0], shard.order[-1]
    met = {(r["side"], r["depth"]): r for r in paths.to_pylist()}
    conv, count = shard.conv, shard.count
    levels, leaf = [], np.zeros(len(conv), dtype=np.int64)
    above = np.zeros(len(conv), dtype=np.int64)                # smallest member of the row's node one level up
    for depth, rows, starts in shard.depths():
        n = np.diff(np.append(starts, len(rows)))
        smallest = np.minimum.reduceat(conv[rows], starts)
        done = count[rows] == depth
        all_n, all_done = n.copy(), np.add.reduceat(done.astype(np.int64), starts)
        own_done = all_done.copy()
        names: dict[int, bytes] = {}
        for side, k in ((0, 0), (1, len(starts) - 1)):
            if count[ends[side]] >= depth:
                r = met[side, depth]
                smallest[k], all_n[k], all_done[k], names[k] = r["smallest"], r["n_convs"], r["n_ends"], r["node"]
        of_row = np.repeat(smallest, n)
        stands_for = conv[rows] == of_row
        leaf[rows] = np.where(done, stands_for & np.repeat(all_n == all_done, n), leaf[rows])
        levels.append((depth, rows, starts, n, smallest, above[rows[starts]], stands_for, own_done, names))
        above[rows] = of_row
    below = np.zeros(len(conv), dtype=np.int64)                # bytes that the row shares, from this depth down
    child = np.zeros(len(conv), dtype=np.int64)                # the row stands for its node one level down
    columns = []
    nothing = hashlib.sha256(b"").hexdigest()
    number = table["shard"][0].as_py()
    for depth, rows, starts, n, smallest, parents, stands_for, done, names in reversed(levels):
        if depth:
            below[rows] += np.where(stands_for, 0, shard.sizes[shard.first[rows] + depth - 1])
        children, leaves, saved = (np.add.reduceat(x[rows], starts) for x in (child, leaf, below))
        child[:] = 0
        child[rows] = stands_for
        hashes, texts = [nothing] * len(starts), [None] * len(starts)
        for k in np.flatnonzero(done):                         # those that end there come first
            ids = ",".join(map(str, conv[rows[starts[k]:starts[k] + done[k]]].tolist()))
            hashes[k] = hashlib.sha256(ids.encode()).hexdigest()
            if k in names:
                texts[k] = ids
        size = len(starts)
        columns.append((smallest, np.full(size, depth), [None] * size if depth == 0 else parents, n, children, leaves, saved, hashes,
                        [names.get(k) for k in range(size)], np.full(size, number), texts))
    schema = _schema(NODES)
    return pa.concat_tables([pa.table([pa.array(c, t) for c, t in zip(cs, schema.types)], schema=schema) for cs in columns])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boundary nodes from their shards' shares, which come in order: sums, and one digest fed share by
    share, so that the list of a node's ends is never held whole."""
    now, held, state, many = None, None, None, False
    schema = _schema(TRIE)
    out: list[tuple] = []

    def closed() -> tuple:
        return (*held[:7], state.hexdigest())

    for batch in batches:
        for r in batch.to_pylist():
            if (r["depth"], r["node"]) != now:
                if now is not None:
                    out.append(closed())
                now, state, many = (r["depth"], r["node"]), hashlib.sha256(), False
                held = [r["conv_id"], r["depth"], r["parent_conv_id"], 0, 0, 0, 0]
            for i, c in enumerate(("n_convs", "n_children", "n_leaves", "saved_tokens"), 3):
                held[i] += r[c]
            if r["ends"] is not None:
                state.update((("," if many else "") + r["ends"]).encode())
                many = True
        if out:
            yield _arrow(out, TRIE).to_batches()[0]
            out = []
    if now is not None:
        yield _arrow([closed()], TRIE).to_batches()[0]


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _arrow(rows: list[tuple], ddl: str) -> pa.Table:
    schema = _schema(ddl)
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
