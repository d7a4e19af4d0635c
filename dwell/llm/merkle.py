"""Merkle manifest of a dataset: one root over all rows, and for each row the path that proves it.

Method: concatenated-level strings. A group's leaves, in order, are cut into aligned blocks of 4,096.
A block keeps each of its levels as one string of hex digests, 64 characters a node: a parent is the
hash of 1,024 characters at a fixed place, a node's siblings are the characters on both sides of it.
The blocks' top nodes are the leaves of the next round, until one node is left in each group; the
groups' roots, in order of the group, are put together the same way.

Places in a group come from a table range-partitioned by (group, order) and the counts of its pieces,
so a group with a third of all rows is spread like any other; a block holds 4,096 digests at most.
Only the number of rounds, one integer, reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwell.llm import scratch

# Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 16                  # children of a node
BLOCK_LEVELS = 3
BLOCK = RUN ** BLOCK_LEVELS
HEX = 64                  # characters of a digest
PIECE_ROWS = 16_384       # rows of a piece of the ordered table
MOST_PIECES = 100_000
PATH = "array<struct<before:binary,after:binary>>"


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf_of(*values: Column) -> Column:
    """Digest of a row: every value as `-` if null, else its UTF-8 byte count, `:`, and itself."""
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")),
                                        F.lit("-")) for v in values]))


def manifest(docs: DataFrame, altered_text: Column | None = None) -> DataFrame:
    """(doc_id, leaf, altered_leaf, path, subroot, root) of every row of ``docs``.

    ``path`` holds, from the leaf's level up to the root, the siblings before and after the node, as
    concatenated hex digests. ``altered_text`` (null: as it is) gives the leaf of a changed row,
    null where nothing is changed, to be checked against the path. Rows of a source are in order of
    doc_id, nulls first; rows with equal ids in order of their leaf, and wholly equal rows take
    places of their own. An empty table has an empty manifest. Other columns are not read."""
    plain = docs.select(*FIELDS, (F.lit(None).cast("string") if altered_text is None else altered_text).alias("altered"))
    rest = [F.col(c) for c in FIELDS[:-1]]
    leaves = scratch.stored(plain.select(
        _group_key(F.col("source")).alias("g"), "doc_id", leaf_of(*rest, F.col("text")).alias("node"),
        F.when(F.col("altered").isNotNull(), leaf_of(*rest, F.col("altered"))).alias("altered_leaf")), "merkle-leaves")
    placed = _placed(leaves, ["doc_id", "node"], "merkle-placed")
    subroots, rounds = _climb(placed)
    groups = _placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), "node"), ["of"], "merkle-subroots")
    roots, upper = _climb(groups)
    above = roots.select("g", F.lit(0).cast("long").alias("block"), F.lit(None).cast(PATH).alias("path"),
                         F.struct(F.col("node").alias("root")).alias("tops"))
    for nodes in reversed(upper[1:]):
        above = _descend(nodes, above).select("g", F.col("pos").alias("block"), "path", "tops")
    above = _descend(upper[0], above).select(
        F.col("item.of").alias("g"), F.lit(0).cast("long").alias("block"), "path",
        F.struct(F.col("item.node").alias("subroot"), F.col("tops.root").alias("root")).alias("tops"))
    for nodes in reversed(rounds[1:]):
        above = _descend(nodes, above).select("g", F.col("pos").alias("block"), "path", "tops")
    return _descend(rounds[0], above).select("item.doc_id", F.col("item.node").alias("leaf"), "item.altered_leaf", "path", "tops.*")


def siblings(path: Column) -> Column:
    """All siblings of a path, from the leaf up, left to right."""
    return F.aggregate(path, F.lit(b""), lambda got, x: F.concat(got, x["before"], x["after"]))


def folded(node: Column, path: Column) -> Column:
    """The root that ``node`` leads to along ``path``."""
    return F.aggregate(path, node, lambda got, x: digest(F.concat(x["before"], got.cast("binary"), x["after"])))


def _group_key(value: Column) -> Column:
    """Never null, in the order of the value's bytes with null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _placed(nodes: DataFrame, order: list[str], what: str) -> DataFrame:
    """``nodes`` with ``pos``, the place in the group ``g``, and ``n``, the group's size."""
    rows = nodes.count()
    pieces = min(MOST_PIECES, max(1, -(-rows // PIECE_ROWS)))
    own = "own"              # tells equal rows apart, so that they spread over pieces too
    ordered = nodes.withColumn(own, F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(pieces, "g", *order, own).sortWithinPartitions("g", *order, own)
    ordered = scratch.stored(ordered.drop(own).withColumn("at", F.monotonically_increasing_id()), what)
    piece = F.shiftright("at", 33)
    counts = ordered.groupBy("g", piece.alias("piece")).agg(F.count("*").alias("here"), F.min("at").alias("first"))
    group = Window.partitionBy("g")     # a row for each piece of a group
    offsets = counts.select(
        F.col("g").alias("of_g"), F.col("piece").alias("of_piece"), F.sum("here").over(group).alias("n"),
        (F.coalesce(F.sum("here").over(group.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"))
    return (ordered.join(offsets, (F.col("g") == F.col("of_g")) & (piece == F.col("of_piece")))
            .withColumn("pos", F.col("at") + F.col("shift")).drop("of_g", "of_piece", "shift", "at"))


def _climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(g, node) of each group's root, and the nodes (g, pos, n, node, ...) of each round."""
    rounds = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        top = _blocks(rounds[-1]).select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"),
                                         _level(BLOCK_LEVELS).cast("string").alias("node"))
        top = scratch.stored(top, f"merkle-round-{len(rounds)}")
        if most <= BLOCK:
            return top.select("g", "node"), rounds
        rounds.append(top)
        most = -(-most // BLOCK)


def _level(k: int) -> Column:
    return F.col(f"level_{k}")


def _blocks(nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """A row for each block: its nodes in order (``items``), its levels as strings (a level that the
    block does not have repeats the one below it) and, from ``above``, its path and tops."""
    payload = [c for c in nodes.columns if c not in ("g", "pos", "n", "node")]
    rows = nodes.select("g", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"), "n", F.struct("pos", "node", *payload).alias("item"))
    more = []
    if above is not None:       # the block's path comes as one more row of its group: no join
        more = [F.first("path", ignorenulls=True).alias("path"), F.first("tops", ignorenulls=True).alias("tops")]
        rows = rows.unionByName(above, allowMissingColumns=True)
    blocks = rows.groupBy("g", "block").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("item")).alias("items"), *more)
    blocks = blocks.withColumn("level_0", F.array_join(F.transform("items", lambda x: x["node"]), "").cast("binary"))
    for k in range(BLOCK_LEVELS):
        below, width = _level(k), RUN * HEX
        starts = F.sequence(F.lit(0), F.ceil(F.octet_length(below) / width).cast("int") - 1)
        parents = F.array_join(F.transform(starts, lambda i: digest(F.substring(below, i * width + 1, F.lit(width)))), "")
        blocks = blocks.withColumn(f"level_{k + 1}", F.when(_has_level(k), parents.cast("binary")).otherwise(below))
    return blocks


def _has_level(k: int) -> Column:
    """More than one node stands at level ``k`` of the whole group, so its runs are hashed."""
    return F.col("n") > RUN ** k


def _flanks(level: Column, i: Column) -> Column:
    """The siblings of node ``i`` in its run."""
    start = i - i % RUN
    return F.struct(F.substring(level, start * HEX + 1, (i - start) * HEX).alias("before"),
                    F.substring(level, (i + 1) * HEX + 1, (start + RUN - 1 - i) * HEX).alias("after"))


def _steps(step: Column, there: Column) -> Column:
    return F.when(there, F.array(step)).otherwise(F.array()).cast(PATH)


def _descend(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(g, pos, item, path, tops) of every node, from the paths of the blocks."""
    blocks = _blocks(nodes, above)
    runs = F.sequence(F.lit(0), F.ceil(F.size("items") / RUN).cast("int") - 1)
    upper = [_steps(_flanks(_level(k), F.floor(F.col("run") / RUN ** (k - 1)).cast("int")), _has_level(k)) for k in range(1, BLOCK_LEVELS)]
    by_run = blocks.withColumn("run", F.explode(runs)).select(
        "g", "n", "tops", F.slice("items", F.col("run") * RUN + 1, F.lit(RUN)).alias("items"),
        F.substring("level_0", F.col("run") * RUN * HEX + 1, F.lit(RUN * HEX)).alias("run"),
        F.concat(*upper, F.coalesce("path", F.array().cast(PATH))).alias("path"))
    each = by_run.select("g", "n", "tops", "run", F.col("path").alias("above"), F.posexplode("items").alias("i", "item"))
    return each.select("g", "item.pos", "item", F.concat(_steps(_flanks(F.col("run"), F.col("i")), _has_level(0)), "above").alias("path"), "tops")
