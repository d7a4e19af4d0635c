"""The audit on dirty rows, and what its joins move."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from dwell.operators.quality import evaluate
from dwell.plans import audit
from dwell.sources import binding

SF = "/root/testdata/sf0.001"


def dirty(spark):
    t = dict(binding.views(spark, SF))
    k = F.abs(F.hash("lease_id")) % 10
    t["leases"] = t["leases"].select(
        F.when(k == 0, F.lit(None)).when(k == 1, "C-same").otherwise(F.col("lease_id")).alias("lease_id"),
        F.when(k == 2, -1).otherwise(F.col("unit_id")).alias("unit_id"), "project_id", "date_start",
        F.when(k == 3, F.lit(None)).otherwise(F.col("week_start")).cast("int").alias("week_start"), "lease_months", "week_end",
        F.when(k == 4, -F.col("rent")).when(k == 5, F.lit(None)).otherwise(F.col("rent")).alias("rent"), "is_renewal",
        F.when(k == 6, "other").otherwise(F.col("tenant_segment")).alias("tenant_segment"))
    return t


def counts(df):
    return {r["check"]: r["failures"] for r in df.collect()}


def test_rules_count_the_same_rows_before_and_after_the_joins(spark):
    t = dirty(spark)
    rules = [r for r in audit.row_rules(binding.WEEK_ZERO) if r.table == "leases"]
    free = [r.rule for r in rules if not r.needs]
    (found,) = audit.evaluated(t, rules)
    got, want = counts(found), counts(evaluate(t["leases"], free))
    assert len(free) > 3 and sum(want.values()) > 0
    assert {check: got[check] for check in want} == want
    assert got["leases.unit_id -> units"] == t["leases"].filter("unit_id = -1").count() > 0


def test_joins_move_only_what_they_compare(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        (found,) = audit.evaluated(binding.views(spark, SF), [r for r in audit.row_rules(binding.WEEK_ZERO) if r.table == "leases"])
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            found.explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan.getvalue())
    assert any("unit_id" in columns for columns in moved)
    assert not any(re.search(r"\b(rent|week_end|tenant_segment|date_start)#", columns) for columns in moved)


def test_keys_are_counted_by_their_columns(spark):
    t = dirty(spark)
    found = audit.checks(t, binding.WEEK_ZERO, wanted=lambda area, check: area == "Primary key" or check.startswith("units per"))
    got = counts(found)
    n = t["leases"].count() - t["leases"].select("lease_id").distinct().count()
    assert got["leases: lease_id is unique"] == n > 0 and got["listings: listing_id is unique"] == 0 and len(got) == 6
    t["projects"] = t["projects"].unionByName(t["projects"].limit(2))
    both = counts(audit.checks(t, binding.WEEK_ZERO, wanted=lambda area, check: area == "Primary key" or check.startswith("units per")))
    alone = counts(audit.checks(t, binding.WEEK_ZERO, wanted=lambda area, check: area == "Primary key"))
    assert both["projects: project_id is unique"] == alone["projects: project_id is unique"] == 2
