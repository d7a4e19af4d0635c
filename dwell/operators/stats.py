"""Statistics (A01–A20): exact, distributed aggregates.

Quantiles are exact with linear interpolation (pandas' default, DuckDB ``quantile_cont``) and
computed by ``ranking.exact_quantiles``: distinct-value counts, range-partitioned positions and at
most two rows per (group, p) at the end — a hot group is never gathered into one task (Spark's
``percentile`` would merge all distinct values of a group in one task). Approximate sketches are
never the result (N7).
"""

from __future__ import annotations

from typing import Sequence

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwell.operators.ranking import join_keys, materialize, quantile_columns, running_ranks


def _r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def correlation(a: str, b: str) -> Column:
    """Pearson correlation over the rows where both are present; null where one of them is constant."""
    x, y = (F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c)).cast("double") for c in (a, b))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def with_quantiles(agg: DataFrame, df: DataFrame, group: Sequence[str], column: str, probs: Sequence[float],
                   names: Sequence[str]) -> DataFrame:
    """Attach exact quantiles of ``column`` per ``group`` to an aggregate keyed by ``group``
    (null-safe keys, left join: a group without values gets null quantiles)."""
    g = list(group)
    q = quantile_columns(df, g, column, probs, names)
    if not g:
        # one global row: the quantiles are (merged) scalar subqueries
        return agg.select("*", *[q.select(n).scalar().alias(n) for n in names])
    q = q.select(*[F.col(c).alias(f"__q_{c}") for c in g], *names)
    cond = reduce(and_, [agg[c].eqNullSafe(q[f"__q_{c}"]) for c in g])
    return agg.join(q, cond, "left").drop(*[f"__q_{c}" for c in g])


def stats_by_split(df: DataFrame, split_col: str, target: str, order: Sequence[str]) -> DataFrame:
    """Count / mean / median / max per split, in ``order``; absent splits give null rows.
    One partial aggregate (map-side) over a handful of groups, joined to a literal split list."""
    spark = df.sparkSession
    agg = df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("m"), F.max(target).alias("mx"))
    agg = with_quantiles(agg, df, [split_col], target, [0.5], ["med"])
    names = spark.createDataFrame([(s, i) for i, s in enumerate(order)], f"{split_col} string, ordinal int")
    return (F.broadcast(names).join(agg, split_col, "left")
            .select(split_col, "ordinal", F.coalesce("n", F.lit(0)).cast("long").alias("count"),
                    _r6(F.col("m")).alias("mean"), _r6(F.col("med")).alias("median"),
                    _r6(F.col("mx")).alias("max"))
            .orderBy("ordinal"))


DESCRIBE_PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def describe(df: DataFrame, column: str, percentiles: Sequence[float] = DESCRIBE_PERCENTILES) -> DataFrame:
    """Count, mean, sample std, min, percentiles (exact, linear), max — one aggregate."""
    names = [f"p{int(round(p * 100))}" for p in percentiles]
    agg = df.agg(F.count(column).alias("count"), F.avg(column).alias("mean"),
                 F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    agg = with_quantiles(agg, df, [], column, percentiles, names)
    return agg.select(F.col("count").cast("long"), *[_r6(F.col(c)).alias(c) for c in ("mean", "std", "min")],
                      *[_r6(F.col(n)).alias(n) for n in names], _r6(F.col("max")).alias("max"))


def grouped_describe(df: DataFrame, group: str, column: str) -> DataFrame:
    """Mean, median, max per group (nulls in the group key dropped, N6)."""
    kept = df.filter(F.col(group).isNotNull())
    agg = kept.groupBy(group).agg(_r6(F.avg(column)).alias("mean"), _r6(F.max(column)).alias("max"))
    return with_quantiles(agg, kept, [group], column, [0.5], ["median"]) \
        .select(group, "mean", _r6(F.col("median")).alias("median"), "max")


def by_dimensions(df: DataFrame, dimensions: Sequence[str], column: str) -> DataFrame:
    """Count / median / mean of ``column`` per value of each dimension, null category kept.

    One pass: every row is exploded to one (dimension, value) pair per dimension (values cast to
    text), then a single group-by — equivalent to GROUPING SETS over the dimensions."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
                                for d in dimensions]))
    long = df.select(pairs.alias("p"), F.col(column).alias("__y")).select("p.dimension", "p.value", "__y")
    agg = long.groupBy("dimension", "value").agg(F.count("__y").cast("long").alias("count"),
                                                 _r6(F.avg("__y")).alias("mean"))
    return with_quantiles(agg, long, ["dimension", "value"], "__y", [0.5], ["median"]) \
        .select("dimension", "value", "count", _r6(F.col("median")).alias("median"), "mean")


def per_group_summary(df: DataFrame, group: str, column: str) -> DataFrame:
    """Per group count / median / mean, ordered by median (null keys dropped)."""
    kept = df.filter(F.col(group).isNotNull())
    agg = kept.groupBy(group).agg(F.count(column).cast("long").alias("count"), _r6(F.avg(column)).alias("mean"))
    return (with_quantiles(agg, kept, [group], column, [0.5], ["median"])
            .select(group, "count", _r6(F.col("median")).alias("median"), "mean").orderBy("median", group))


def split_audit(df: DataFrame, split_col: str, success_col: str, date_col: str, order: Sequence[str]) -> DataFrame:
    """Listings, successes, failures, success %, first and last date per split; an empty
    split has 0 rows and a null rate."""
    spark = df.sparkSession
    s = F.col(success_col)
    agg = df.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("listings"), F.count_if(s).alias("successes"), F.count_if(~s).alias("failures"),
        F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"))
    names = spark.createDataFrame([(x, i) for i, x in enumerate(order)], f"{split_col} string, ordinal int")
    return (F.broadcast(names).join(agg, split_col, "left")
            .select(split_col, "ordinal",
                    *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("listings", "successes", "failures")],
                    _r6(F.try_divide(F.col("successes").cast("double") * 100, F.col("listings"))).alias("success_pct"),
                    "first_date", "last_date"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, descending (null values dropped as in pandas)."""
    return (df.filter(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count(F.lit(1)).cast("long").alias("count")).orderBy(F.desc("count"), column))


def monthly_trend(df: DataFrame, date_col: str, column: str) -> DataFrame:
    """Median and count per calendar month (months without rows absent, rows without a date dropped)."""
    monthly = df.select(F.trunc(F.to_date(date_col), "month").alias("month"), column).filter(F.col("month").isNotNull())
    agg = monthly.groupBy("month").agg(F.count(column).cast("long").alias("count"))
    return (with_quantiles(agg, monthly, ["month"], column, [0.5], ["median"])
            .select("month", _r6(F.col("median")).alias("median"), "count").orderBy("month"))


def tukey(df: DataFrame, column: str) -> DataFrame:
    """A10: q1, q3, iqr and upper fence q3 + 1.5·(q3 − q1) (one row)."""
    return (quantile_columns(df, [], column, [0.25, 0.75], ["q1", "q3"])
            .withColumn("iqr", F.col("q3") - F.col("q1"))
            .withColumn("upper_fence", F.col("q3") + 1.5 * F.col("iqr")))


def exceedance(df: DataFrame, column: str, limits: Sequence[float] = (26, 52, 104)) -> DataFrame:
    """Rows with value > each limit and > the Tukey upper fence, long (threshold, rows).

    The fence is a scalar subquery (planned once, no driver round trip)."""
    fence = tukey(df, column).select("upper_fence").scalar()
    x = F.col(column)
    aggs = [F.count_if(x > F.lit(float(v))).alias(f"gt_{int(v)}") for v in limits] + \
           [F.count_if(x > fence).alias("gt_upper_fence")]
    wide = df.agg(*aggs)
    names = [f"gt_{int(v)}" for v in limits] + ["gt_upper_fence"]
    return wide.unpivot([], names, "threshold", "rows").select("threshold", F.col("rows").cast("long"))


def coverage(df: DataFrame, column: str, limit: float = 52) -> DataFrame:
    """% of rows with value <= limit; count of value = 0."""
    x = F.col(column)
    return df.agg(_r6(F.avg(F.when(x <= limit, 1.0).otherwise(0.0)) * 100).alias("pct_within"),
                  F.count_if(x == 0).cast("long").alias("zero_rows"))


def adjusted_skewness(df: DataFrame, column: str) -> DataFrame:
    """Bias-adjusted Fisher–Pearson skewness = g1 · sqrt(n(n−1)) / (n−2); null below three values."""
    n = F.count(column).cast("double")
    return df.agg(F.when(n > 2, F.try_divide(F.skewness(column) * F.sqrt(n * (n - 1)), n - 2)).alias("skew")) \
        .select(_r6(F.col("skew")).alias("skewness"))


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairs in one aggregate, long (row, col, corr); pairwise-complete by construction."""
    pairs = [(a, b) for a in columns for b in columns]
    wide = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    names = [str(i) for i in range(len(pairs))]
    spark = df.sparkSession
    keys = spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(pairs)], "k string, row string, col string")
    long = wide.unpivot([], names, "k", "corr")
    return long.join(F.broadcast(keys), "k").select("row", "col", _r6(F.col("corr")).alias("corr"))


FEW_VALUES = 20_000       # distinct values of a column whose rank table is broadcast
SALTS = 1_000             # rows without a value spread over so many keys


def spearman_pairs(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Spearman correlation (average ranks, pairwise-complete nulls) of the given pairs: (row, col, corr).

    A pair ranks its columns inside the rows where both are non-null, a set of null patterns. Values are
    counted once by (column, value) for every such set of patterns; running sums of these counts are the
    ranks in each set. A row stays one row and looks its ranks up column by column: rank tables of columns
    with at most ``FEW_VALUES`` values, whose values are hot, are broadcast, so only columns of many values
    move the rows."""
    cols = list(columns)
    # pandas semantics: NaN is missing
    values = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)]
    pattern = sum((F.when(F.col(f"x{i}").isNotNull(), 1 << i).otherwise(0) for i in range(len(cols))), F.lit(0)).alias("pattern")
    salt = (F.monotonically_increasing_id() % SALTS + 1).cast("int").alias("salt")
    rows = materialize(df.select(*values).select("*", pattern, salt))
    seen = [r["pattern"] for r in rows.select("pattern").distinct().collect()]          # at most 2^columns, in fact a few
    index = {c: i for i, c in enumerate(cols)}
    sets: dict[frozenset, int] = {}
    places = []                                                    # (a, b, set of patterns) of each pair
    for a, b in pairs:
        i, j = index[a], index[b]
        both = frozenset(p for p in seen if p >> i & 1 and p >> j & 1)
        places.append((i, j, sets.setdefault(both, len(sets))))
    entry = F.inline(F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"x{i}").alias("value")) for i in range(len(cols))]))
    long = rows.select("pattern", entry).filter(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(*[F.count_if(F.col("pattern").isin(list(s)) if s else F.lit(False)).alias(f"n{k}")
                                                   for s, k in sets.items()])
    ranks = materialize(running_ranks(counts, ["column"], "value", [f"n{k}" for k in sets.values()]))
    sizes = {r["column"]: r["count"] for r in ranks.groupBy("column").count().collect()}
    needed: dict[int, set[int]] = {}                               # the sets in which a column is ranked
    for i, j, k in places:
        needed.setdefault(i, set()).add(k)
        needed.setdefault(j, set()).add(k)
    ranked = rows.select(*[f"x{i}" for i in needed], "salt")
    for i in sorted(needed, key=lambda i: -sizes.get(i, 0)):       # those that move the rows first, while they are narrow
        # rows without a value meet no rank and are spread
        own = ranks.filter(F.col("column") == i).select(F.col("value").alias("at"), F.when(F.col("value").isNull(), 1).otherwise(0).alias("none"),
                                                        *[F.col(f"n{k}").alias(f"r{i}_{k}") for k in sorted(needed[i])])
        own = F.broadcast(own) if sizes.get(i, 0) <= FEW_VALUES else own
        given = F.when(F.col(f"x{i}").isNull(), F.col("salt")).otherwise(0)
        ranked = ranked.join(own, (F.col(f"x{i}") == F.col("at")) & (given == F.col("none")), "left").drop("at", "none", f"x{i}")
    found = ranked.agg(*[correlation(f"r{i}_{k}", f"r{j}_{k}").alias(f"p{m}") for m, (i, j, k) in enumerate(places)])
    return found.select(F.inline(F.array(*[F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), F.col(f"p{m}").alias("corr"))
                                           for m, (a, b) in enumerate(pairs)])))


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spearman matrix, long (row, col, corr)."""
    cols = list(columns)
    upper = spearman_pairs(df, cols, [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]])
    both = F.inline(F.array(F.struct("row", "col", "corr"), F.struct(F.col("col").alias("row"), F.col("row").alias("col"), "corr")))
    diag = df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "row string, col string, corr double")
    return upper.select(both).unionByName(diag).select("row", "col", _r6(F.col("corr")).alias("corr"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins over [min, max], the last bin closed; empty bins appear with 0.

    min / max are scalar subqueries; the bin list is ``range(bins)`` (size set by the caller)."""
    spark = df.sparkSession
    lo = df.select(F.min(column).cast("double")).scalar()
    hi = df.select(F.max(column).cast("double")).scalar()
    width = (hi - lo) / bins
    x = F.col(column).cast("double")
    b = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((x - lo) / width), F.lit(bins - 1))).cast("long")
    counts = df.filter(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = spark.range(bins).select(F.col("id").alias("bin"), (lo + F.col("id") * width).alias("lower"),
                                     (lo + (F.col("id") + 1) * width).alias("upper"))
    return (edges.join(counts, "bin", "left")
            .select("bin", _r6(F.col("lower")).alias("lower"), _r6(F.col("upper")).alias("upper"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def grouped_density(df: DataFrame, group: str, column: str, bins: int) -> DataFrame:
    """Shared-edge bins over the whole range, each group normalised to area 1:
    density = count / (n_group · width). The bin grid is generated per group by ``sequence``."""
    lo = df.select(F.min(column).cast("double")).scalar()
    hi = df.select(F.max(column).cast("double")).scalar()
    width = (hi - lo) / bins
    x = F.col(column).cast("double")
    b = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((x - lo) / width), F.lit(bins - 1))).cast("long")
    counts = df.filter(x.isNotNull()).groupBy(group, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    sizes = df.filter(x.isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    grid = sizes.select(group, "n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>")).alias("bin"))
    return (grid.join(counts, [group, "bin"], "left")
            .select(group, "bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                    _r6(F.coalesce("count", F.lit(0)) / (F.col("n") * width)).alias("density")))


def box_stats(df: DataFrame, group: str, column: str) -> DataFrame:
    """q1, median, q3, whiskers (furthest values inside 1.5 IQR) and outlier count per group.
    Per-group quartiles are joined back to the rows (one row per group)."""
    q = quantile_columns(df.filter(F.col(column).isNotNull()), [group], column, [0.25, 0.5, 0.75],
                         ["q1", "median", "q3"])
    x = F.col(column)
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    joined = join_keys(df.select(group, column).filter(x.isNotNull()), q, [group])
    return joined.groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(x >= lo, x)).alias("whisker_low"), F.max(F.when(x <= hi, x)).alias("whisker_high"),
        F.count_if((x < lo) | (x > hi)).cast("long").alias("outliers"), F.count(F.lit(1)).cast("long").alias("count"),
    ).select(group, *[_r6(F.col(c)).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")],
             "outliers", "count")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count per column — one aggregate, unpivoted to (column, nulls)."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).cast("long").alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column", "nulls")


def sizes_with_zero(dim: DataFrame, fact: DataFrame, key: str) -> DataFrame:
    """Group size per dimension key, missing groups as 0 (dimension left join)."""
    counts = fact.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return dim.select(key).distinct().join(counts, key, "left") \
        .select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
