"""Mixing sources to target weights (10): Pareto order sampling, DataFrame functions only.

Each source has a target number of words. Every document is given the whole copies that the target
holds of the whole source; what is left, R words, is a sample. A document of s words is included with
probability p = min(1, c * s), with the c of its source for which the expected words, the sum of p * s,
are R: documents that reach 1 are certain, the others share what they leave in proportion to their size.
Documents of a source are ranked by the odds u/(1-u) of a fixed random number u divided by the inclusion
odds p/(1-p), the certain ones first. A target is a number of words, not of documents, so the sample ends
at the last rank whose words still fit R, near the rounded sum of all p; one more document, the one whose
size comes nearest to the words still missing, closes the gap: a source misses its target by less than
that document's misfit.

Scale: a source may hold most rows, and so may repeats of one row. Rows with equal id and text are
counted first and go through as one. The c of a source is read off its distinct sizes. Ranks are a table
range-partitioned by (source, rank), with running words in each piece and the totals of the pieces
before. What is left of a source is its last rank and its closing document, so the mix itself is one map
over the documents. The table of sources is broadcast only after its row count was checked.

Defined results: null text has size 0; the null source is a source, last in order; a null id is an
id like another; u depends on the id and the text, and rows with both equal are taken together; documents
without words are not sampled; a source without words has target 0; an empty table gives no rows; further
columns are kept by ``mixed_copies`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwell.llm import scratch

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)            # all targets together: 3/2 of all sizes
MOST = 2                  # copies of a document, and target by size of a source
PIECE_ROWS = 16_384       # rows of a piece of the ranks
MOST_PIECES = 100_000
BROADCAST_SOURCES = 100_000
SALT = "mix:"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mark(doc_id: Column, text: Column) -> Column:
    """Digest of a document's id and text."""
    return F.md5(F.concat(F.lit(SALT), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def uniform(digest: Column) -> Column:
    """Fixed random number in (0, 1): the digest's first 52 bits."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2 ** 52)


def targets(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: k (order), source, source_size, n_docs, target, whole (copies for certain),
    rest (words the sample may take).

    Targets share the budget by weight; none exceeds MOST times its source. Sharing the excess anew
    until none is above ends at min(cap, level * weight) with one common level, found by ordering the
    sources by cap / weight. The windows are global, over one row per source."""
    up, down = SHARE
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("k"), F.lit(len(weights))) + 1).cast("int"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = (slim.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n_docs"))
            .withColumn("k", F.row_number().over(order) - 1)
            .withColumn("w", w).withColumn("cap", MOST * F.col("source_size")))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "k")
    whole_table = Window.partitionBy()
    rows = (rows.withColumn("capped", F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("left_w", F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("budget", up * F.sum("source_size").over(whole_table))
            .withColumn("level", (F.col("budget") - down * F.coalesce("capped", F.lit(0))) / (down * F.col("left_w")))
            .withColumn("free", F.col("cap") / F.col("w") > F.col("level"))
            .withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "k", "level")))
                        .over(whole_table)["level"]))
    cap = F.col("cap").cast("double")
    rows = rows.withColumn("target", F.least(cap, F.coalesce(F.col("level") * F.col("w"), cap)))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (rows.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
            .select("k", "source", "source_size", "n_docs", "target", "whole", "rest"))


def _with_sources(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    side = sources.withColumnRenamed("source", "_source")
    side = F.broadcast(side) if few else side
    return rows.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def inclusion(size: Column, c: Column) -> Column:
    """Probability that a document of the size is in the sample."""
    return F.least(F.lit(1.0), c * size)


def rank(size: Column, c: Column, digest: Column) -> Column:
    """(odds of u by the inclusion odds, digest): the order of a source's documents; null: not sampled."""
    u, p = uniform(digest), inclusion(size, c)
    q = F.when(p >= 1, 0.0).otherwise((u / (1 - u)) / (p / F.when(p < 1, 1 - p)))
    return F.when((size > 0) & (c > 0), F.struct(q.alias("q"), digest.alias("d")))


def _scales(slim: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """The c of each source: of its distinct sizes, from the largest down, the first that is not certain."""
    sizes = _with_sources(slim.filter(F.col("size") > 0).groupBy("source", "size").agg(F.sum("m").alias("n")), sources.select("source", "k", "rest"), few)
    down = Window.partitionBy("k").orderBy(F.desc("size"))
    words, squares = (F.col("size").cast("decimal(38,0)") * F.col("n"), F.col("size").cast("decimal(20,0)") * F.col("size") * F.col("n"))
    larger = F.coalesce(F.sum(words.cast("decimal(28,0)")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    others = F.sum(squares.cast("decimal(28,0)")).over(down.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    tried = sizes.withColumn("c", (F.col("rest") - larger) / others)
    return tried.filter(F.col("c") * F.col("size") < 1).groupBy("source").agg(F.max(F.struct("size", "c"))["c"].alias("c"))


def _plan(slim: DataFrame) -> tuple[DataFrame, bool]:
    """Sources with their c, last rank and closing document, and whether they are few."""
    sources = scratch.stored(targets(slim), "mix-sources")
    n_sources = sources.count()
    few = n_sources <= BROADCAST_SOURCES
    scales = _scales(slim, sources, few).withColumnRenamed("source", "_s")
    sources = scratch.stored(sources.join(scales, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
                             .withColumn("c", F.coalesce("c", F.lit(0.0))), "mix-scales")
    ranked = _with_sources(slim, sources, few).withColumn("rank", rank(F.col("size"), F.col("c"), F.col("d"))).filter(F.col("rank").isNotNull())
    ranked = ranked.select("k", "rank", (F.col("size") * F.col("m")).alias("words"), "rest")
    pieces = min(MOST_PIECES, max(1, -(-slim.count() // PIECE_ROWS)))
    order = ["k", F.col("rank.q"), F.col("rank.d")]
    ranked = scratch.stored(ranked.repartitionByRange(pieces, *order).withColumn("piece", F.spark_partition_id()), "mix-ranks")
    totals = ranked.groupBy("k", "piece").agg(F.sum("words").alias("here"))
    before = Window.partitionBy("k").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)      # a row for each piece
    offsets = totals.select(F.col("k").alias("_k"), F.col("piece").alias("_piece"), F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("k", "piece").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    upto = ranked.withColumn("run", F.sum("words").over(inside)).join(offsets, (F.col("k") == F.col("_k")) & (F.col("piece") == F.col("_piece")))
    upto = scratch.stored(upto.select("k", "rank", "words", "rest", (F.col("before") + F.col("run")).alias("upto")), "mix-running")
    fits = F.col("upto") <= F.col("rest")
    last = scratch.stored(upto.groupBy("k").agg(F.max(F.when(fits, F.col("rank"))).alias("last"), (
        F.first("rest") - F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0))).alias("gap")), "mix-last")
    side = last.select(F.col("k").alias("_k"), "gap")
    beyond = upto.filter(~fits).join(F.broadcast(side) if few else side, F.col("k") == F.col("_k"))
    miss = F.abs(F.col("words") - F.col("gap"))
    closing = beyond.filter(miss < F.col("gap")).groupBy("k").agg(F.min(F.struct(miss.alias("miss"), "rank"))["rank"].alias("closing"))
    ends = sources.join(last.select("k", "last"), "k", "left").join(closing, "k", "left")
    return scratch.stored(ends, "mix-plan"), few


def _copies(rows: DataFrame, plan: tuple[DataFrame, bool]) -> DataFrame:
    placed = _with_sources(rows, *plan).withColumn("rank", rank(F.col("size"), F.col("c"), F.col("d")))
    chosen = F.coalesce((F.col("rank") <= F.col("last")), F.lit(False)) | F.coalesce(F.col("rank") == F.col("closing"), F.lit(False))
    return placed.withColumn("copies", F.col("whole") + F.when(chosen, 1).otherwise(0))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
            mark(F.col(id_col), F.col(text_col)).alias("d")]


def _units(slim: DataFrame) -> DataFrame:
    """Rows with equal source, id and text as one, with their number ``m``."""
    return scratch.stored(slim.groupBy("source", "d").agg(F.max("size").alias("size"), F.count("*").alias("m")), "mix-units")


def pareto_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words, repeats counted), copies."""
    slim = scratch.stored(docs.select(*_rows(docs, id_col, text_col, source_col)), "mix-sizes")
    mixed = _copies(slim, _plan(_units(slim)))
    return mixed.select(F.col("doc_id").alias(id_col), "size", "source_size", "target",
                        (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document as many times as it is taken, with all its columns."""
    columns = _rows(docs, id_col, text_col, source_col)
    plan = _plan(_units(docs.select(*columns)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)
    return (_copies(rows, plan).filter(F.col("copies") > 0)
            .select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*"))
