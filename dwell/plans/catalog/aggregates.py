"""Aggregation queries A01–A20 over the modeling datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwell.operators import stats
from dwell.plans import features as feat
from dwell.plans.registry import query, r6, tables
from dwell.plans.catalog.common import (ANALYSIS_CTE, EDA, PEARSON_COLUMNS, SPEARMAN_COLUMNS, TTL_CTE, _p, _w, analysis,
                                       eda, price_train, ttl)

# A05 ---------------------------------------------------------------------------------------
def a05(spark, sf_dir):
    """Target stats per split in fixed order; an absent split is a null row."""
    return stats.stats_by_split(ttl(spark, sf_dir), "data_split", feat.TTL_TARGET,
                                ("train", "validation", "test", "post_test"))


query("a05", sql=TTL_CTE + """,
splits AS (SELECT * FROM (VALUES ('train', 0), ('validation', 1), ('test', 2), ('post_test', 3)) s(data_split, ordinal)),
agg AS (SELECT data_split, count(*) AS n, avg(weeks_on_market) AS m, quantile_cont(weeks_on_market, 0.5) AS med,
               max(weeks_on_market) AS mx FROM ttl GROUP BY data_split)
SELECT s.data_split, CAST(s.ordinal AS INTEGER) AS ordinal, CAST(coalesce(a.n, 0) AS BIGINT) AS count,
  round(a.m, 6) AS mean, round(a.med, 6) AS median, round(a.mx, 6) AS max
FROM splits s LEFT JOIN agg a ON a.data_split = s.data_split
""")(a05)

# A01 -----------------------------------------------------------------------------------------
query("a01", sql=_w("""
SELECT CAST(count(weeks_on_market) AS BIGINT) AS count, round(avg(weeks_on_market), 6) AS mean,
  round(stddev_samp(weeks_on_market), 6) AS std, round(min(weeks_on_market), 6) AS min,
  round(quantile_cont(weeks_on_market, 0.25), 6) AS p25, round(quantile_cont(weeks_on_market, 0.5), 6) AS p50,
  round(quantile_cont(weeks_on_market, 0.75), 6) AS p75, round(quantile_cont(weeks_on_market, 0.9), 6) AS p90,
  round(quantile_cont(weeks_on_market, 0.95), 6) AS p95, round(quantile_cont(weeks_on_market, 0.99), 6) AS p99,
  round(max(weeks_on_market), 6) AS max FROM eda""", EDA))(
    lambda spark, sf: stats.describe(eda(spark, sf), feat.TTL_TARGET))

# A02 -----------------------------------------------------------------------------------------
query("a02", sql=_w("""
SELECT data_split, round(avg(weeks_on_market), 6) AS mean, round(quantile_cont(weeks_on_market, 0.5), 6) AS median,
  round(max(weeks_on_market), 6) AS max FROM ttl GROUP BY data_split"""))(
    lambda spark, sf: stats.grouped_describe(ttl(spark, sf), "data_split", feat.TTL_TARGET))

# A03 -----------------------------------------------------------------------------------------
A03_DIMS = ("room_type", "view", "furnished", "season_listed")
query("a03", sql=_w(" UNION ALL ".join(
    f"""SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, CAST(count(weeks_on_market) AS BIGINT) AS count,
  round(quantile_cont(weeks_on_market, 0.5), 6) AS median, round(avg(weeks_on_market), 6) AS mean
  FROM eda GROUP BY {d}""" for d in A03_DIMS), EDA))(
    lambda spark, sf: stats.by_dimensions(eda(spark, sf), A03_DIMS, feat.TTL_TARGET))

# A04 -----------------------------------------------------------------------------------------
query("a04", sql=_w("""
SELECT project_name, CAST(count(weeks_on_market) AS BIGINT) AS count, round(quantile_cont(weeks_on_market, 0.5), 6) AS median,
  round(avg(weeks_on_market), 6) AS mean FROM eda WHERE project_name IS NOT NULL GROUP BY project_name""", EDA))(
    lambda spark, sf: stats.per_group_summary(eda(spark, sf), "project_name", feat.TTL_TARGET))


# A06 -----------------------------------------------------------------------------------------
query("a06", sql=ANALYSIS_CTE.strip() + """,
splits AS (SELECT * FROM (VALUES ('train', 0), ('validation', 1), ('test', 2), ('post_test', 3)) s(data_split, ordinal)),
agg AS (SELECT data_split, count(*) AS listings, count(*) FILTER (WHERE leased) AS successes,
  count(*) FILTER (WHERE NOT leased) AS failures, min(date_listed) AS first_date, max(date_listed) AS last_date
  FROM analysis GROUP BY data_split)
SELECT s.data_split, CAST(s.ordinal AS INTEGER) AS ordinal, CAST(coalesce(listings, 0) AS BIGINT) AS listings,
  CAST(coalesce(successes, 0) AS BIGINT) AS successes, CAST(coalesce(failures, 0) AS BIGINT) AS failures,
  round(CAST(successes AS DOUBLE) * 100 / listings, 6) AS success_pct, first_date, last_date
FROM splits s LEFT JOIN agg a ON a.data_split = s.data_split""")(
    lambda spark, sf: stats.split_audit(analysis(spark, sf), "data_split", "leased", "date_listed",
                                        ("train", "validation", "test", "post_test")))

# A07 -----------------------------------------------------------------------------------------
query("a07", sql=_w("SELECT data_split, CAST(count(*) AS BIGINT) AS count FROM ttl GROUP BY data_split"))(
    lambda spark, sf: stats.value_counts(ttl(spark, sf), "data_split"))

# A08 -----------------------------------------------------------------------------------------
query("a08", sql=_w("""
SELECT CAST(date_trunc('month', date_listed) AS DATE) AS month, round(quantile_cont(weeks_on_market, 0.5), 6) AS median,
  CAST(count(weeks_on_market) AS BIGINT) AS count FROM eda GROUP BY 1""", EDA))(
    lambda spark, sf: stats.monthly_trend(eda(spark, sf), "date_listed", feat.TTL_TARGET))

# A09 / A10 -----------------------------------------------------------------------------------
FENCE = "fence AS (SELECT quantile_cont(weeks_on_market, 0.25) AS q1, quantile_cont(weeks_on_market, 0.75) AS q3 FROM eda)"
query("a09", sql=_w("""
SELECT threshold, CAST(rows AS BIGINT) AS rows FROM (
  SELECT 'gt_26' AS threshold, count(*) FILTER (WHERE weeks_on_market > 26) AS rows FROM eda UNION ALL
  SELECT 'gt_52', count(*) FILTER (WHERE weeks_on_market > 52) FROM eda UNION ALL
  SELECT 'gt_104', count(*) FILTER (WHERE weeks_on_market > 104) FROM eda UNION ALL
  SELECT 'gt_upper_fence', count(*) FILTER (WHERE weeks_on_market > (SELECT q3 + 1.5 * (q3 - q1) FROM fence)) FROM eda)""",
                    EDA, FENCE))(
    lambda spark, sf: stats.exceedance(eda(spark, sf), feat.TTL_TARGET))
query("a10", sql=_w("""
SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, round(q3 + 1.5 * (q3 - q1), 6) AS upper_fence
FROM fence""", EDA, FENCE))(
    lambda spark, sf: stats.tukey(eda(spark, sf), feat.TTL_TARGET).select(*[r6(c).alias(c) for c in
                                                                             ("q1", "q3", "iqr", "upper_fence")]))

# A11 / A12 -----------------------------------------------------------------------------------
query("a11", sql=_w("""
SELECT round(avg(CASE WHEN weeks_on_market <= 52 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_within,
  CAST(count(*) FILTER (WHERE weeks_on_market = 0) AS BIGINT) AS zero_rows FROM eda""", EDA))(
    lambda spark, sf: stats.coverage(eda(spark, sf), feat.TTL_TARGET))
query("a12", sql=_w("SELECT round(skewness(weeks_on_market), 6) AS skewness FROM eda", EDA))(
    lambda spark, sf: stats.adjusted_skewness(eda(spark, sf), feat.TTL_TARGET))

# A13 -----------------------------------------------------------------------------------------
query("a13", sql=_p(" UNION ALL ".join(
    f"SELECT '{a}' AS row, '{b}' AS col, round(corr({a}, {b}), 6) AS corr FROM price_train"
    for a in PEARSON_COLUMNS for b in PEARSON_COLUMNS)))(
    lambda spark, sf: stats.pearson_matrix(price_train(spark, sf), PEARSON_COLUMNS))


# A14 -----------------------------------------------------------------------------------------
def _spearman_sql(cols) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            ra = f"rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0"
            rb = f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0"
            sub = f"(SELECT {ra} AS ra, {rb} AS rb FROM eda WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
            parts.append(f"SELECT '{a}' AS row, '{b}' AS col, corr(ra, rb) AS corr FROM {sub}")
            parts.append(f"SELECT '{b}' AS row, '{a}' AS col, corr(ra, rb) AS corr FROM {sub}")
    for c in cols:
        parts.append(f"SELECT '{c}' AS row, '{c}' AS col, 1.0 AS corr")
    return "SELECT row, col, round(CAST(corr AS DOUBLE), 6) AS corr FROM (" + " UNION ALL ".join(parts) + ")"


query("a14", sql=_w(_spearman_sql(SPEARMAN_COLUMNS), EDA))(
    lambda spark, sf: stats.spearman_matrix(eda(spark, sf), SPEARMAN_COLUMNS))


# A15 / A16 -----------------------------------------------------------------------------------
def _hist_sql(source: str, column: str, bins: int) -> str:
    return f"""
SELECT CAST(b.bin AS BIGINT) AS bin, round(lo + b.bin * w, 6) AS lower, round(lo + (b.bin + 1) * w, 6) AS upper,
  CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM (SELECT range AS bin FROM range({bins})) b
CROSS JOIN (SELECT CAST(min({column}) AS DOUBLE) AS lo, (CAST(max({column}) AS DOUBLE) - CAST(min({column}) AS DOUBLE)) / {bins} AS w FROM {source}) e
LEFT JOIN (SELECT CASE WHEN e2.w = 0 THEN 0 ELSE least(floor((CAST({column} AS DOUBLE) - e2.lo) / e2.w), {bins - 1}) END AS bin, count(*) AS n
           FROM {source}, (SELECT CAST(min({column}) AS DOUBLE) AS lo, (CAST(max({column}) AS DOUBLE) - CAST(min({column}) AS DOUBLE)) / {bins} AS w FROM {source}) e2
           WHERE {column} IS NOT NULL GROUP BY 1) c ON c.bin = b.bin"""


query("a15", sql=_w(_hist_sql("eda", "weeks_on_market", 40), EDA))(
    lambda spark, sf: stats.histogram(eda(spark, sf), feat.TTL_TARGET, 40))
query("a16", sql=_p("""
SELECT g.room_type, CAST(b.bin AS BIGINT) AS bin, CAST(coalesce(c.n, 0) AS BIGINT) AS count,
  round(coalesce(c.n, 0) / (g.n * e.w), 6) AS density
FROM (SELECT room_type, count(*) AS n FROM price_train WHERE rent IS NOT NULL GROUP BY room_type) g
CROSS JOIN (SELECT range AS bin FROM range(50)) b
CROSS JOIN (SELECT CAST(min(rent) AS DOUBLE) AS lo, (max(rent) - min(rent)) / 50 AS w FROM price_train) e
LEFT JOIN (SELECT room_type, least(floor((rent - e2.lo) / e2.w), 49) AS bin, count(*) AS n
           FROM price_train, (SELECT min(rent) AS lo, (max(rent) - min(rent)) / 50 AS w FROM price_train) e2
           WHERE rent IS NOT NULL GROUP BY 1, 2) c ON c.room_type IS NOT DISTINCT FROM g.room_type AND c.bin = b.bin"""))(
    lambda spark, sf: stats.grouped_density(price_train(spark, sf), "room_type", "rent", 50))

# A17 -----------------------------------------------------------------------------------------
query("a17", sql=_p("""
SELECT p.view, round(q.q1, 6) AS q1, round(q.median, 6) AS median, round(q.q3, 6) AS q3,
  round(min(rent) FILTER (WHERE rent >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(rent) FILTER (WHERE rent <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  CAST(count(*) FILTER (WHERE rent < q1 - 1.5 * (q3 - q1) OR rent > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers,
  CAST(count(*) AS BIGINT) AS count
FROM price_train p JOIN q ON q.view = p.view WHERE rent IS NOT NULL GROUP BY p.view, q.q1, q.median, q.q3""",
                    """q AS (SELECT view, quantile_cont(rent, 0.25) AS q1, quantile_cont(rent, 0.5) AS median,
      quantile_cont(rent, 0.75) AS q3 FROM price_train WHERE rent IS NOT NULL GROUP BY view)"""))(
    lambda spark, sf: stats.box_stats(price_train(spark, sf), "view", "rent"))

# A19 -----------------------------------------------------------------------------------------
query("a19", sql=_w(" UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS nulls FROM eda"
    for c in feat.TTL_FEATURES), EDA))(
    lambda spark, sf: stats.null_counts(eda(spark, sf), feat.TTL_FEATURES))

# A20 -----------------------------------------------------------------------------------------
query("a20", sql="""
SELECT p.project_id, CAST(coalesce(u.n, 0) AS BIGINT) AS n FROM projects p
LEFT JOIN (SELECT project_id, count(*) AS n FROM units GROUP BY project_id) u ON u.project_id = p.project_id""")(
    lambda spark, sf: stats.sizes_with_zero(tables(spark, sf)["projects"], tables(spark, sf)["units"], "project_id"))
