"""Statistics of the fit sets of expanding folds, from one scan.

Rows carry a ``slice`` number that grows with time; a fold's fit set is all rows up to a slice. Value
counts by (slice, column, value) are additive, so every fold's categories, modes and medians are sums
over one count table instead of a scan, an encoder and a count for each fold.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.ml.encode import MAX_CATEGORIES, modes_from_counts
from dwell.operators.ranking import materialize, quantiles_from_counts


class SliceCounts:
    """Counts of the values of categorical (as text) and numeric columns, by slice."""

    def __init__(self, rows: DataFrame, categorical: Sequence[str], numeric: Sequence[str]):
        self.categorical, self.numeric = list(categorical), list(numeric)
        none = F.lit(None)
        entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text"), none.cast("double").alias("number"))
                   for c in self.categorical]
        entries += [F.struct(F.lit(c).alias("column"), none.cast("string").alias("text"), F.col(c).cast("double").alias("number"))
                    for c in self.numeric]
        self.table = materialize(rows.select("slice", F.inline(F.array(*entries))).groupBy("slice", "column", "text", "number")
                                 .agg(F.count("*").alias("n")))
        wide = self.table.groupBy("column").agg(F.count_distinct("text").alias("texts"), F.count_distinct("number").alias("numbers"),
                                                F.sum(F.when(F.col("text").isNull() & F.col("number").isNull(), F.col("n"))).alias("nulls"))
        self.sizes = {r["column"]: r for r in wide.collect()}
        large = [c for c in self.categorical if c in self.sizes and self.sizes[c]["texts"] > MAX_CATEGORIES]
        if large:
            raise ValueError(f"more than {MAX_CATEGORIES} categories: {', '.join(large)}")

    def incomplete(self) -> list[str]:
        """Columns with nulls."""
        return [c for c in (*self.categorical, *self.numeric) if c in self.sizes and self.sizes[c]["nulls"]]

    def text_counts(self, upto: Sequence[int]) -> dict[int, dict[str, list[tuple[str, int]]]]:
        """Non-null value counts of the categorical columns in the slices up to each of ``upto``."""
        found = self.table.filter(F.col("text").isNotNull()).groupBy("slice", "column", "text").agg(F.sum("n").alias("n")).collect()
        out: dict[int, dict] = {u: {c: {} for c in self.categorical} for u in upto}
        for r in found:
            for u in upto:
                if r["slice"] <= u:
                    held = out[u][r["column"]]
                    held[r["text"]] = held.get(r["text"], 0) + r["n"]
        return {u: {c: sorted(v.items()) for c, v in counts.items()} for u, counts in out.items()}

    def medians(self, columns: Sequence[str], upto: Sequence[int]) -> dict[tuple[int, str], float]:
        """Exact medians in the slices up to each of ``upto``."""
        if not columns or not upto:
            return {}
        numbers = self.table.filter(F.col("column").isin(list(columns)) & F.col("number").isNotNull())
        ends = F.explode(F.array(*[F.lit(int(u)) for u in sorted(set(upto))]))
        counts = (numbers.withColumn("upto", ends).filter(F.col("slice") <= F.col("upto"))
                  .groupBy("upto", "column", "number").agg(F.sum("n").alias("n")))
        found = quantiles_from_counts(counts, ["upto", "column"], "number", "n", [0.5]).collect()
        return {(r["upto"], r["column"]): r["quantile"] for r in found}

    def distinct_numbers(self, columns: Sequence[str]) -> dict[str, list[float]]:
        """Sorted distinct values; for columns that ``sizes`` shows to have few."""
        if not columns:
            return {}
        found = self.table.filter(F.col("column").isin(list(columns)) & F.col("number").isNotNull()).select("column", "number").distinct().collect()
        out: dict[str, list[float]] = {c: [] for c in columns}
        for r in found:
            out[r["column"]].append(r["number"])
        return {c: sorted(v) for c, v in out.items()}

    def quantiles(self, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
        if not columns:
            return {}
        numbers = self.table.filter(F.col("column").isin(list(columns)) & F.col("number").isNotNull()).groupBy("column", "number").agg(
            F.sum("n").alias("n"))
        found = quantiles_from_counts(numbers, ["column"], "number", "n", list(probs)).collect()
        out: dict[str, list[float]] = {c: [] for c in columns}
        for r in sorted(found, key=lambda r: r["p_index"]):
            out[r["column"]].append(r["quantile"])
        return out

    def fills(self, upto: Sequence[int]) -> dict[int, Mapping[str, object]]:
        """What replaces a null of each incomplete column (mode or median) in the fit set up to a slice."""
        gaps = self.incomplete()
        cats, nums = [c for c in gaps if c in self.categorical], [c for c in gaps if c in self.numeric]
        texts = self.text_counts(upto) if cats else {}
        medians = self.medians(nums, upto)
        return {u: {**{c: modes_from_counts(texts[u])[c] for c in cats}, **{c: medians.get((u, c)) for c in nums}} for u in upto}
