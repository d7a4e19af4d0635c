"""Sharding (5): minimum-cost-flow resharding.

From the bytes of the old shards and the capacities of the new ones (any number of both; without
capacities, equal shares), a minimum-cost flow says how many bytes each old shard gives to each new one
so that the fewest bytes move. The flow network has
one node per shard, whatever the data's size. Each old shard is laid out as a line of bytes in a
fixed order of its documents, cut at the flow's amounts (what stays comes first); a document goes
where its middle byte lies. New shards then differ by about a document at each cut.

Scale: lines are made in two levels, blocks of a shard (about ``BLOCK_ROWS`` rows, dealt by a hash of
the row) and rows inside a block, so a large shard is never one group. Only block totals are ordered
per shard; only one number per shard reaches the driver. ``resharded`` shuffles the rows once;
``rewrite`` writes just the shards that gain or lose rows, and removes those that lose all.

Defined results: a null text has size 1 and the CRC-32 of no bytes (0); null ids and repeated rows
are rows like others (equal rows are interchangeable); an empty table gives no rows; a document
larger than a capacity stays whole; capacities that don't hold all bytes are an error; further columns are kept by ``resharded`` whatever their names.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwell.llm import scratch

SHARDS = 8
BLOCK_ROWS = 4096


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def fewest_moves(old: list[int], new: list[int]) -> list[list[int]]:
    """flow[i][j]: bytes from old shard i to new shard j, none beyond its capacity new[j]. Bytes that stay
    in the shard of the same number cost 0, others 1 a byte. Successive cheapest paths in the residual
    network."""
    if sum(old) > sum(new):
        raise ValueError(f"{sum(old)} bytes do not fit capacities of {sum(new)}")
    flow = [[0] * len(new) for _ in old]
    give, room = list(old), list(new)

    def cost(i: int, j: int) -> int:
        return int(i != j)

    while any(give):
        # Bellman-Ford over shards: reach[j] is the cheapest way for a unit to arrive in new shard j
        reach: dict[tuple[str, int], tuple[int, tuple[str, int] | None]] = {("old", i): (0, None) for i in range(len(old)) if give[i]}
        changed = True
        while changed:
            changed = False
            for (side, a), (spent, _) in list(reach.items()):
                for b in range(len(new) if side == "old" else len(old)):
                    if side == "old":
                        step, to = cost(a, b), ("new", b)
                    elif flow[b][a]:  # undo part of b -> a
                        step, to = -cost(b, a), ("old", b)
                    else:
                        continue
                    if to not in reach or reach[to][0] > spent + step:
                        reach[to] = (spent + step, (side, a))
                        changed = True
        node = min((reach["new", j][0], j) for j in range(len(new)) if room[j])[1]
        path = [("new", node)]
        while (back := reach[path[-1]][1]) is not None:
            path.append(back)
        path.reverse()
        steps = list(zip(path, path[1:]))
        amount = min([give[path[0][1]], room[node], *(flow[b][a] for (side, a), (_, b) in steps if side == "new")])
        for (side, a), (_, b) in steps:
            if side == "old":
                flow[a][b] += amount
            else:
                flow[b][a] -= amount
        give[path[0][1]] -= amount
        room[node] -= amount
    return flow


def _cells(rows: DataFrame, blocks: int) -> DataFrame:
    """rows (old, size, doc_id, crc, …) with their cell (old shard, block) and order in it."""
    return (rows.withColumn("h", F.xxhash64("doc_id", "crc", "size"))
            .withColumn("cell", F.col("old").cast("long") * blocks + F.pmod(F.col("h"), F.lit(blocks))))


def _placed(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Shard of each row, and its place among the rows of its cell that go there."""
    order = Window.partitionBy("cell").orderBy("h", "doc_id", "crc", "size")
    middle = (F.col("bytes_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
              - F.col("size") / 2)
    rows = rows.join(cells, "cell").withColumn("middle", middle)
    cut = F.filter("cuts", lambda c: (F.col("middle") >= c["from"]) & (F.col("middle") < c["upto"]))
    inside = Window.partitionBy("cell", "shard").orderBy("h", "doc_id", "crc", "size")
    return (rows.withColumn("shard", F.element_at(cut, 1)["shard"])
            .withColumn("place", F.row_number().over(inside) - 1))


def _plan(slim: DataFrame, shards: int, capacities: Sequence[int] | None) -> tuple[int, DataFrame]:
    """Blocks, and a row per cell: bytes before it in its old shard, the cuts of that shard and the
    first slot in each new shard."""
    spark = slim.sparkSession
    sums = slim.groupBy("old").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()  # one row a shard
    blocks = max(1, -(-sum(r["n"] for r in sums) // BLOCK_ROWS))
    old = [0] * (1 + max((r["old"] for r in sums), default=-1))
    for r in sums:
        old[r["old"]] = r["bytes"]
    even, more = divmod(sum(old), shards)
    flow = fewest_moves(old, [even + (j < more) for j in range(shards)] if capacities is None else list(capacities))
    cuts = []
    for i, amounts in enumerate(flow):
        at = 0
        for j in sorted(range(len(amounts)), key=lambda j: (j != i, j)):
            if amounts[j]:
                cuts.append((i, float(at), float(at + amounts[j]), j))
                at += amounts[j]
    cut_rows = (spark.createDataFrame(cuts, "old int, `from` double, upto double, shard int")
                .groupBy("old").agg(F.sort_array(F.collect_list(F.struct("from", "upto", "shard"))).alias("cuts")))
    in_shard = Window.partitionBy("old").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = _cells(slim, blocks).groupBy("old", "cell").agg(F.sum("size").alias("bytes"))
    cells = scratch.stored(
        totals.withColumn("bytes_before", F.coalesce(F.sum("bytes").over(in_shard), F.lit(0)))
        .join(F.broadcast(cut_rows), "old").select("cell", "bytes_before", "cuts"), "shard-cells")
    counts = (_placed(_cells(slim, blocks), cells).groupBy("cell", "shard")
              .agg(F.count(F.lit(1)).alias("n")))
    in_new = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    slots = (counts.withColumn("first_slot", F.coalesce(F.sum("n").over(in_new), F.lit(0)))
             .groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("shard", "first_slot"))).alias("first_slots")))
    return blocks, scratch.stored(cells.join(slots, "cell"), "shard-plan")


def _slim(docs: DataFrame, old: Column, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(old.cast("int"), F.lit(0)).alias("old"), size_of(text).alias("size"),
                       crc_of(text).alias("crc"))


def _assign(rows: DataFrame, slim: DataFrame, shards: int, capacities: Sequence[int] | None) -> DataFrame:
    blocks, cells = _plan(slim, shards, capacities)
    return (_placed(_cells(rows, blocks), cells)
            .withColumn("slot", F.col("first_slots")[F.col("shard")] + F.col("place"))
            .withColumn("moved", F.col("shard") != F.col("old")))


def reshard(docs: DataFrame, old: Column, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
            capacities: Sequence[int] | None = None) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard, old_shard, moved.
    ``old``: the shard in which a row lies now (null: 0), of any number of shards. ``capacities``: bytes that
    each new shard may take (then their number is that of the shards); else equal shares for ``shards``."""
    slim = scratch.stored(_slim(docs, old, id_col, text_col), "shard-sizes")
    return _assign(slim, slim, shards, capacities).select(
        F.col("doc_id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"), "moved")


def resharded(docs: DataFrame, old: Column, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
              capacities: Sequence[int] | None = None) -> DataFrame:
    """The documents with all their columns, and shard, slot, old_shard and moved beside them (a column
    of such a name in ``docs`` keeps its name; the new one gets a leading underscore)."""
    slim = scratch.stored(_slim(docs, old, id_col, text_col), "shard-sizes")
    text = F.col(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"),
                       F.coalesce(old.cast("int"), F.lit(0)).alias("old"), size_of(text).alias("size"), crc_of(text).alias("crc"))
    return _assign(rows, slim, shards, capacities).select(
        "row.*", *[F.col(c).alias(scratch.fresh(docs, name)) for c, name in
                   (("shard", "shard"), ("slot", "slot"), ("old", "old_shard"), ("moved", "moved"))])


def rewrite(placed: DataFrame, path: str) -> None:
    """Write the shards of ``resharded`` that gain or lose rows, one folder ``shard=N`` each; the files
    of other shards stay as they are. A shard that loses all its rows has no folder afterwards."""
    spark = placed.sparkSession
    gains = placed.filter("moved").select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct()
    (placed.join(F.broadcast(gains), "shard", "left_semi")  # at most one row a shard
     .repartition("shard", F.floor(F.col("slot") / BLOCK_ROWS)).sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path))
    left = placed.select("shard").distinct()
    for (shard,) in gains.join(left, "shard", "left_anti").collect():                # at most one row a shard
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
