"""Declarative data-quality rules (Q02): a rule is a column expression that is true where a row
fails. All rules over one DataFrame are evaluated in ONE aggregate (one scan, map-side partial
counts) and unpivoted to (area, check, failures, status, note) rows."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT_SCHEMA = "ordinal int, area string, check string, failures bigint, status string, note string"


@dataclass(frozen=True)
class Rule:
    area: str
    check: str
    fails: Column
    note: str = ""
    severity: str = "FAIL"      # status when failures > 0 (FAIL or WARN)


def evaluate(df: DataFrame, rules: Sequence[Rule], ordinals: Sequence[int] | None = None) -> DataFrame:
    """One aggregate for all ``rules`` over ``df``; PASS when no row fails. ``ordinals``: 0, 1, 2, ... if not given."""
    ordinals = range(len(rules)) if ordinals is None else ordinals
    aggs = [F.count_if(r.fails).cast("long").alias(f"r{i}") for i, r in enumerate(rules)]
    wide = df.agg(*aggs)
    meta = F.array(*[F.struct(F.lit(ordinals[i]).alias("ordinal"), F.lit(r.area).alias("area"),
                              F.lit(r.check).alias("check"), F.col(f"r{i}").alias("failures"),
                              F.lit(r.severity).alias("severity"), F.lit(r.note).alias("note"))
                     for i, r in enumerate(rules)])
    rows = wide.select(F.inline(meta))
    return rows.select("ordinal", "area", "check", "failures",
                       F.when(F.col("failures") == 0, "PASS").otherwise(F.col("severity")).alias("status"), "note")


def counted(first_ordinal: int, area: str, check: str, failures: Column, severity: str = "FAIL",
            note: str = "") -> Column:
    """A result row built from an already aggregated failure count (for set-based checks)."""
    return F.struct(F.lit(first_ordinal).alias("ordinal"), F.lit(area).alias("area"), F.lit(check).alias("check"),
                    failures.cast("long").alias("failures"),
                    F.when(failures == 0, "PASS").otherwise(F.lit(severity)).alias("status"), F.lit(note).alias("note"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
