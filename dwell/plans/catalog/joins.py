"""Join queries J01–J08."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwell.functions.nulls import differs_null_safe
from dwell.operators import joins
from dwell.plans import features as feat
from dwell.plans.catalog.quality import PAIRS_SQL
from dwell.plans.registry import query, r6, tables

PRIMARY_DONE = "NOT coalesce(ends_with(l.listing_id, '-B'), false) AND coalesce(l.leased, false)"


@query("j01", sql="""
SELECT le.lease_id, le.unit_id, le.project_id, u.floor, round(u.size_sqm, 6) AS size_sqm, u.room_type, u.view, u.furnished,
  p.project_name, p.university, p.distance_to_campus_m, p.facility_count
FROM leases le LEFT JOIN units u ON u.unit_id = le.unit_id LEFT JOIN projects p ON p.project_id = le.project_id""")
def j01(spark, sf):
    t = tables(spark, sf)
    j = joins.leases_with_dimensions(t["leases"], t["units"], t["projects"])
    return j.select("lease_id", "unit_id", "project_id", "floor", r6("size_sqm").alias("size_sqm"), "room_type", "view",
                    "furnished", "project_name", "university", "distance_to_campus_m", "facility_count")


@query("j02", sql=f"""
SELECT l.listing_id, CAST(m.week AS DOUBLE) AS market_history_week, CAST(m.n_searchers AS DOUBLE) AS n_searchers,
  CAST(m.n_listings_open AS DOUBLE) AS n_listings_open, round(m.occupancy, 6) AS market_occupancy,
  round(m.median_asking_rent, 6) AS market_median_asking_rent
FROM listings l LEFT JOIN weekly_market m ON m.project_id = l.project_id AND m.week + 1 = l.week_listed WHERE {PRIMARY_DONE}""")
def j02(spark, sf):
    t = tables(spark, sf)
    feat.market_gate(t["weekly_market"], "1999-06-30")
    j = joins.previous_week_market(feat.completed_primary(t["listings"]).select("listing_id", "project_id", "week_listed"),
                                   t["weekly_market"])
    return j.select("listing_id", *[F.col(c).cast("double").alias(c) for c in ("market_history_week", "n_searchers",
                                                                             "n_listings_open")],
                    r6("market_occupancy").alias("market_occupancy"),
                    r6("market_median_asking_rent").alias("market_median_asking_rent"))


@query("j03", sql=f"""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE m.week IS NULL) AS BIGINT) AS no_market_row,
  CAST(count(*) FILTER (WHERE m.date + 7 > l.date_listed) AS BIGINT) AS future_market_rows
FROM listings l LEFT JOIN weekly_market m ON m.project_id = l.project_id AND m.week + 1 = l.week_listed WHERE {PRIMARY_DONE}""")
def j03(spark, sf):
    t = tables(spark, sf)
    market = t["weekly_market"].withColumnRenamed("date", "market_date")
    base = feat.completed_primary(t["listings"]).select("listing_id", "project_id", "week_listed", "date_listed")
    hist = market.select("project_id", (F.col("week") + 1).alias("week_listed"), F.col("week").alias("market_history_week"),
                         "market_date")
    feat.market_gate(t["weekly_market"], "1999-06-30")
    j = base.join(hist, ["project_id", "week_listed"], "left")
    return joins.point_in_time_audit(j)


@query("j04", sql=PAIRS_SQL + """
SELECT listing_id, base_listing_id, matched,
  NOT matched OR """ + " OR ".join(f"{c} IS DISTINCT FROM {c}_base" for c in joins.ALTERNATIVE_EVENT_COLUMNS) + """ AS pair_fails,
  coalesce(asking_rent <> asking_rent_base, true) AS rent_changed, coalesce(agent_id <> agent_id_base, true) AS agent_changed
FROM pairs""")
def j04(spark, sf):
    from dwell.functions.nulls import differs
    p = joins.alternative_pairs(tables(spark, sf)["listings"])
    return p.select("listing_id", "base_listing_id", "matched",
                    (~F.col("matched") | joins.pair_differs(joins.ALTERNATIVE_EVENT_COLUMNS)).alias("pair_fails"),
                    differs("asking_rent", "asking_rent_base").alias("rent_changed"),
                    differs("agent_id", "agent_id_base").alias("agent_changed"))


@query("j05", sql=PAIRS_SQL + "\nSELECT * FROM (" + " UNION ALL ".join(
    [f"SELECT '{c}' AS check_column, CAST(count(*) FILTER (WHERE {c} IS DISTINCT FROM {c}_base) AS BIGINT) AS mismatches FROM pairs"
     for c in joins.ALTERNATIVE_CHECK_COLUMNS]
    + ["SELECT '_merge_both', CAST(count(*) FILTER (WHERE matched) AS BIGINT) FROM pairs",
       "SELECT '_merge_left_only', CAST(count(*) FILTER (WHERE NOT matched) AS BIGINT) FROM pairs"]) + ")")
def j05(spark, sf):
    p = joins.alternative_pairs(tables(spark, sf)["listings"])
    names = list(joins.ALTERNATIVE_CHECK_COLUMNS) + ["_merge_both", "_merge_left_only"]
    aggs = [F.count_if(differs_null_safe(c, f"{c}_base")).cast("long").alias(c) for c in joins.ALTERNATIVE_CHECK_COLUMNS]
    merge = F.when(F.col("matched"), "both").otherwise("left_only")
    aggs += [F.count_if(merge == "both").cast("long").alias("_merge_both"),
             F.count_if(merge == "left_only").cast("long").alias("_merge_left_only")]
    return p.agg(*aggs).unpivot([], names, "check_column", "mismatches")


@query("j06", sql="SELECT project_id FROM projects WHERE project_id IS NULL OR project_id NOT IN (SELECT project_id FROM units WHERE project_id IS NOT NULL)")
def j06(spark, sf):
    t = tables(spark, sf)
    return joins.orphans(t["projects"].select("project_id"), t["units"], "project_id")


J07_KEYS = (("projects", ("project_id",)), ("units", ("unit_id",)), ("listings", ("listing_id",)),
            ("listings", ("unit_id", "date_listed")), ("leases", ("lease_id",)), ("weekly_market", ("project_id", "week")))


@query("j07", sql=" UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{', '.join(k)}' AS keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows, "
    f"CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS duplicate_keys, CAST(count(*) AS BIGINT) AS distinct_keys "
    f"FROM (SELECT count(*) AS n FROM {t} GROUP BY {', '.join(k)})" for t, k in J07_KEYS))
def j07(spark, sf):
    t = tables(spark, sf)
    parts = [joins.key_violations(t[name], keys).select(F.lit(name).alias("table"), F.lit(", ".join(keys)).alias("keys"), "*")
             for name, keys in J07_KEYS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("j08", sql="""
SELECT le.lease_id, CASE le.lease_months WHEN 6 THEN 24 WHEN 12 THEN 48 END AS term_weeks, round(u.size_sqm, 6) AS unit_size_sqm
FROM leases le LEFT JOIN units u ON u.unit_id = le.unit_id""")
def j08(spark, sf):
    t = tables(spark, sf)
    looked = joins.lookup(t["leases"].select("lease_id", "unit_id", "lease_months"), t["units"], "unit_id", ["size_sqm"],
                          prefix="unit_")
    return looked.select("lease_id", joins.lease_term_weeks().alias("term_weeks"), r6("unit_size_sqm").alias("unit_size_sqm"))
