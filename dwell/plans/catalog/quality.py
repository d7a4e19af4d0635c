"""Data-quality queries Q01–Q24, T03 and P05 (the audit of the five rental tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwell.functions.nulls import differs
from dwell.operators import quality as qo
from dwell.plans import audit
from dwell.sources import binding, contracts
from dwell.sources.contracts import REQUIRED_COLUMNS, missing_columns
from dwell.plans.registry import query, tables

RULE_COLS = ("area", "check", "failures", "status")

# Spark types of the bound tables (for the data dictionary oracle).
SCHEMA = {
    "projects": (("project_id", "int"), ("project_name", "string"), ("university", "string"),
                 ("distance_to_campus_m", "int"), ("total_units", "int"), ("year_completed", "int"),
                 ("facility_count", "int")),
    "units": (("unit_id", "bigint"), ("project_id", "int"), ("floor", "int"), ("size_sqm", "double"),
              ("room_type", "string"), ("view", "string"), ("furnished", "boolean"), ("agent_id", "string")),
    "listings": (("listing_id", "string"), ("unit_id", "bigint"), ("project_id", "int"), ("project_name", "string"),
                 ("university", "string"), ("distance_to_campus_m", "int"), ("facility_count", "int"),
                 ("agent_id", "string"), ("floor", "int"), ("size_sqm", "double"), ("room_type", "string"),
                 ("view", "string"), ("furnished", "boolean"), ("week_listed", "int"), ("date_listed", "date"),
                 ("season_listed", "string"), ("first_asking_rent", "double"), ("asking_rent", "double"),
                 ("leased", "boolean"), ("week_leased", "int"), ("n_viewings", "int"), ("tenant_segment", "string"),
                 ("lease_months", "int"), ("weeks_on_market", "int")),
    "leases": (("lease_id", "string"), ("unit_id", "bigint"), ("project_id", "int"), ("date_start", "date"),
               ("week_start", "int"), ("lease_months", "int"), ("week_end", "int"), ("rent", "double"),
               ("is_renewal", "boolean"), ("tenant_segment", "string")),
    "weekly_market": (("week", "int"), ("project_id", "int"), ("n_listings_open", "int"), ("n_searchers", "int"),
                      ("n_units_leased", "int"), ("occupancy", "double"), ("median_asking_rent", "double"),
                      ("date", "date")),
}

RAW_LISTINGS_SQL = """
raw_listings AS (SELECT listing_id, unit_id, project_id, project_name, university, distance_to_campus_m, facility_count,
  agent_id, floor, CASE WHEN week_listed % 50 = 0 THEN size_sqm * 10 ELSE size_sqm END AS size_sqm,
  CASE WHEN floor = 3 THEN concat(' ', room_type) ELSE room_type END AS room_type,
  CASE WHEN floor = 5 THEN upper(view) ELSE view END AS view,
  CASE WHEN week_listed % 6 = 0 THEN NULL ELSE furnished END AS furnished, week_listed,
  CASE WHEN floor = 7 THEN strftime(date_listed, '%d/%m/%Y') ELSE CAST(date_listed AS VARCHAR) END AS date_listed,
  season_listed, first_asking_rent, CASE WHEN week_listed % 40 = 0 THEN asking_rent * 100 ELSE asking_rent END AS asking_rent,
  leased, week_leased, n_viewings, tenant_segment, lease_months, weeks_on_market FROM listings)
"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rule_sql(area: str, check: str, source: str, pred: str, severity: str = "FAIL") -> str:
    return (f"SELECT {_q(area)} AS area, {_q(check)} AS \"check\", CAST(count(*) FILTER (WHERE {pred}) AS BIGINT) AS failures, "
            f"CASE WHEN count(*) FILTER (WHERE {pred}) = 0 THEN 'PASS' ELSE '{severity}' END AS status FROM {source}")


def count_sql(area: str, check: str, count_expr: str, severity: str = "FAIL") -> str:
    return (f"SELECT {_q(area)} AS area, {_q(check)} AS \"check\", CAST(({count_expr}) AS BIGINT) AS failures, "
            f"CASE WHEN ({count_expr}) = 0 THEN 'PASS' ELSE '{severity}' END AS status")


def union(*parts: str) -> str:
    return "\nUNION ALL ".join(parts)


def rules(df):
    return df.select(*RULE_COLS)


# ----------------------------------------------------------------------------- SQL rule texts
def fb(c, lo, hi):
    return f"NOT coalesce({c} BETWEEN {lo} AND {hi}, false)"


def fi(c, values):
    return f"NOT coalesce({c} IN ({', '.join(_q(v) for v in values)}), false)"


def df_(a, b):
    return f"coalesce({a} <> {b}, true)"


def f_(cond):
    return f"coalesce({cond}, false)"


SQL_Q06 = union(
    rule_sql("Missing", "leased listings have all outcome columns", "listings", f_("leased AND (" + " OR ".join(f"{c} IS NULL" for c in audit.OUTCOME_COLUMNS) + ")")),
    rule_sql("Missing", "unleased listings have no outcome column", "listings", f_("NOT leased AND (" + " OR ".join(f"{c} IS NOT NULL" for c in audit.OUTCOME_COLUMNS) + ")")),
    rule_sql("Missing", "median_asking_rent is null only without open listings", "weekly_market",
             f_("median_asking_rent IS NULL AND n_listings_open > 0")))
SQL_Q07 = union(*[
    count_sql("Primary key", f"{t}: {', '.join(k)} is unique",
              f"SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {t} GROUP BY {', '.join(k)})")
    for t, k in audit.PRIMARY_KEYS.items()])
SQL_Q08 = union(*[
    count_sql("Foreign key", f"{c}.{k} -> {p}",
              f"SELECT count(*) FROM {c} WHERE {k} IS NULL OR {k} NOT IN (SELECT {pk} FROM {p} WHERE {pk} IS NOT NULL)")
    for c, k, p, pk in audit.FOREIGN_KEYS])
LST_J = ("(SELECT l.*, u.project_id AS u_project_id, " + ", ".join(f"u.{c} AS u_{c}" for c in audit.UNIT_ATTRIBUTES)
         + ", " + ", ".join(f"p.{c} AS p_{c}" for c in audit.PROJECT_ATTRIBUTES)
         + " FROM listings l LEFT JOIN units u ON u.unit_id = l.unit_id LEFT JOIN projects p ON p.project_id = l.project_id) j")
SQL_Q09 = union(
    rule_sql("Cross-table", "listings.project_id matches units.project_id", LST_J, df_("project_id", "u_project_id")),
    *[rule_sql("Cross-table", f"listings.{c} matches projects.{c}", LST_J, df_(c, f"p_{c}")) for c in audit.PROJECT_ATTRIBUTES],
    *[rule_sql("Cross-table", f"listings.{c} matches units.{c}", LST_J, df_(c, f"u_{c}")) for c in audit.UNIT_ATTRIBUTES],
    rule_sql("Cross-table", "leases.project_id matches units.project_id",
             "(SELECT le.project_id, u.project_id AS u_project_id FROM leases le LEFT JOIN units u ON u.unit_id = le.unit_id) j",
             df_("project_id", "u_project_id")))
SQL_Q10 = rule_sql("Cross-table", "units per project equals projects.total_units",
                   "(SELECT p.total_units, coalesce(u.n, 0) AS n FROM projects p LEFT JOIN "
                   "(SELECT project_id, count(*) AS n FROM units GROUP BY project_id) u ON u.project_id = p.project_id) j",
                   df_("n", "total_units"))
SQL_Q11 = union(
    rule_sql("Domain", "units.floor within 1-8", "units", fb("floor", 1, 8)),
    rule_sql("Domain", "units.size_sqm within 20-50", "units", fb("size_sqm", 20, 50)),
    rule_sql("Domain", "units.room_type in the allowed set", "units", fi("room_type", audit.VALID_ROOM_TYPES)),
    rule_sql("Domain", "units.view in the allowed set", "units", fi("view", audit.VALID_VIEWS)))
SQL_Q12 = union(
    rule_sql("Domain", "listing rents are positive", "listings",
             f"{f_('asking_rent <= 0')} OR {f_('first_asking_rent <= 0')}"),
    rule_sql("Domain", "weeks_on_market and n_viewings are not negative", "listings",
             f"{f_('weeks_on_market < 0')} OR {f_('n_viewings < 0')}"),
    rule_sql("Domain", "season_listed in the allowed set", "listings", fi("season_listed", audit.VALID_SEASONS)),
    rule_sql("Domain", "leases.rent is positive", "leases", f_("rent <= 0")),
    rule_sql("Domain", "occupancy within 0-1", "weekly_market", fb("occupancy", 0, 1)),
    rule_sql("Domain", "weekly_market counts are not negative", "weekly_market",
             " OR ".join(f_(f"{c} < 0") for c in ("n_searchers", "n_listings_open", "n_units_leased"))))
SQL_Q13 = rule_sql("Logic", "week_leased = week_listed + weeks_on_market when leased", "listings",
                   f_(f"leased AND {df_('week_leased', 'week_listed + weeks_on_market')}"))
SQL_Q14 = rule_sql("Logic", "lease length matches lease_months", "leases",
                   df_("week_end - week_start", "CASE lease_months WHEN 6 THEN 24 WHEN 12 THEN 48 END"))
SQL_Q15 = rule_sql("Logic", "is_renewal matches tenant_segment = renewal", "leases",
                   df_("is_renewal", "coalesce(tenant_segment = 'renewal', false)"))
SQL_Q16 = rule_sql("Logic", "occupancy = n_units_leased / total_units",
                   "(SELECT m.occupancy, CAST(m.n_units_leased AS DOUBLE) / p.total_units AS e FROM weekly_market m "
                   "LEFT JOIN projects p ON p.project_id = m.project_id) j",
                   "NOT coalesce(abs(occupancy - e) <= 1e-8 + 1e-5 * abs(e), false)")
_DATE = [("listings", "date_listed", "week_listed"), ("leases", "date_start", "week_start"), ("weekly_market", "date", "week")]


def _parsed(c):
    return f"TRY_CAST(CAST({c} AS VARCHAR) AS DATE)"


SQL_Q17 = union(*[
    x for t, d, w in _DATE for x in (
        rule_sql("Date", f"{t}.{d} parses as a date", t, f"{_parsed(d)} IS NULL"),
        rule_sql("Date", f"{t}: date matches the week number", t,
                 f"{_parsed(d)} IS NOT NULL AND {df_(_parsed(d), f'DATE {_q(binding.WEEK_ZERO)} + CAST({w} * 7 AS INTEGER)')}"))])
SQL_Q18 = union(*[
    f"SELECT {_q(t)} AS \"table\", CAST(count(*) FILTER (WHERE {_parsed(d)} IS NULL) AS BIGINT) AS invalid_dates, "
    f"CAST(count(*) FILTER (WHERE {_parsed(d)} IS NOT NULL AND {df_(_parsed(d), f'DATE {_q(binding.WEEK_ZERO)} + CAST({w} * 7 AS INTEGER)')}) AS BIGINT) AS week_date_mismatches, "
    f"min({_parsed(d)}) AS min_date, max({_parsed(d)}) AS max_date FROM {t}" for t, d, w in _DATE])


def _missing_cells(t, src):
    return " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c, _ in SCHEMA[t]) + f" FROM {src}"


SQL_Q19 = union(*[
    f"SELECT {_q(t)} AS \"table\", CAST((SELECT count(*) FROM {raw}) AS BIGINT) AS raw_rows, "
    f"CAST((SELECT count(*) FROM {t}) AS BIGINT) AS processed_rows, "
    f"(SELECT count(*) FROM {raw}) = (SELECT count(*) FROM {t}) AS row_count_preserved, "
    f"CAST((SELECT {_missing_cells(t, raw)}) AS BIGINT) AS raw_missing_cells, "
    f"CAST((SELECT {_missing_cells(t, t)}) AS BIGINT) AS processed_missing_cells"
    for t, raw in [(x, "raw_listings" if x == "listings" else x) for x in audit.TABLE_ORDER]])
Q20_RANGE = (5_000, 400_000)


def _issues(src):
    lo, hi = Q20_RANGE
    return [
        ("size_sqm outside 20-50", fb("size_sqm", 20, 50)),
        (f"asking_rent outside the review range {lo}-{hi}", fb("asking_rent", lo, hi)),
        ("room_type has leading or trailing spaces", df_("room_type", "trim(room_type)")),
        ("view is not lower case", df_("view", "lower(view)")),
        ("furnished is missing", "furnished IS NULL"),
        ("date_listed is not YYYY-MM-DD",
         "NOT coalesce(regexp_full_match(CAST(date_listed AS VARCHAR), '[0-9]{4}-[0-9]{2}-[0-9]{2}'), false)"),
    ]


SQL_Q20 = union(*[
    f"SELECT {k} AS ordinal, {_q(n)} AS issue, CAST((SELECT count(*) FILTER (WHERE {p}) FROM raw_listings) AS BIGINT) AS raw, "
    f"CAST((SELECT count(*) FILTER (WHERE {p}) FROM listings) AS BIGINT) AS processed, "
    f"CAST((SELECT count(*) FILTER (WHERE {p}) FROM raw_listings) - (SELECT count(*) FILTER (WHERE {p}) FROM listings) AS BIGINT) AS fixed"
    for k, (n, p) in enumerate(_issues("x"))])
EV = ("unit_id", "project_id", "week_listed", "date_listed", "first_asking_rent", "weeks_on_market", "leased", "week_leased")
PAIRS_SQL = ("pairs AS (SELECT a.*, b.listing_id IS NOT NULL AS matched, "
             + ", ".join(f"b.{c} AS {c}_base" for c in (*EV, "asking_rent", "agent_id"))
             + " FROM (SELECT *, substr(listing_id, 1, length(listing_id) - 2) AS base_listing_id FROM listings "
               "WHERE ends_with(listing_id, '-B')) a LEFT JOIN (SELECT * FROM listings WHERE NOT coalesce(ends_with(listing_id, '-B'), false)) b "
               "ON b.listing_id = a.base_listing_id)")
PAIR_BAD = "NOT matched OR " + " OR ".join(f"{c} IS DISTINCT FROM {c}_base" for c in EV)
SQL_Q21 = ("SELECT CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) FILTER (WHERE " + PAIR_BAD + ") AS BIGINT) AS invalid_pairs, "
           f"CAST(count(*) FILTER (WHERE {df_('asking_rent', 'asking_rent_base')}) AS BIGINT) AS changed_asking_rent, "
           f"CAST(count(*) FILTER (WHERE {df_('agent_id', 'agent_id_base')}) AS BIGINT) AS changed_agent_id FROM pairs")
SQL_ALT_RULE = ("SELECT 'Logic' AS area, '-B listings pair with their base listing and share the event' AS \"check\", "
                "CAST(count(*) FILTER (WHERE " + PAIR_BAD + ") AS BIGINT) AS failures, CASE WHEN count(*) FILTER (WHERE "
                + PAIR_BAD + ") = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM pairs")
SQL_Q19_RULES = union(*[
    count_sql("Raw->processed", f"{t}: row count unchanged",
              f"CASE WHEN (SELECT count(*) FROM {'raw_listings' if t == 'listings' else t}) = (SELECT count(*) FROM {t}) THEN 0 ELSE 1 END")
    for t in audit.TABLE_ORDER])
ALL_CHECKS_SQL = f"""{PAIRS_SQL}, {RAW_LISTINGS_SQL.strip()},
checks AS ({union(SQL_Q06, SQL_Q07, SQL_Q08, SQL_Q09, SQL_Q10, SQL_Q11, SQL_Q12, SQL_Q13, SQL_Q14, SQL_Q15, SQL_Q16,
                  SQL_ALT_RULE, SQL_Q17, SQL_Q19_RULES)})"""


def t_(spark, sf):
    return tables(spark, sf)


def checks(spark, sf, wanted=lambda area, check: True):
    t = t_(spark, sf)
    return audit.checks(t, binding.WEEK_ZERO, binding.raw_tables(t), wanted)


# ----------------------------------------------------------------------------- queries
@query("q01", sql=union(*[
    f"SELECT {_q(t)} AS \"table\", CAST(count(*) AS BIGINT) AS rows, '' AS missing_columns, count(*) = 0 AS is_empty FROM {t}"
    for t in audit.TABLE_ORDER]))
def q01(spark, sf):
    t = t_(spark, sf)
    parts = [t[n].agg(F.count(F.lit(1)).cast("long").alias("rows")).select(
        F.lit(n).alias("table"), "rows", F.lit(", ".join(sorted(missing_columns(t[n], REQUIRED_COLUMNS[n])))).alias("missing_columns"),
        (F.col("rows") == 0).alias("is_empty")) for n in audit.TABLE_ORDER]
    return qo.union_all(parts)


@query("q01_errors", sql="""
SELECT 'projects' AS "table", 'missing table' AS error UNION ALL SELECT 'units', 'missing columns: floor, size_sqm'
UNION ALL SELECT 'listings', 'missing columns: leased' UNION ALL SELECT 'listings', 'empty table' WHERE NOT EXISTS (SELECT * FROM listings WHERE week_listed < 0)
UNION ALL SELECT 'weekly_market', 'empty table' WHERE NOT EXISTS (SELECT * FROM weekly_market WHERE n_listings_open < 0)
UNION ALL SELECT 'leases', 'empty table' WHERE NOT EXISTS (SELECT * FROM leases)""")
def q01_errors(spark, sf):
    """The contract on broken twins: a table left out, columns left out, no rows, both, and a sound one."""
    t = t_(spark, sf)
    broken = {"units": t["units"].drop("size_sqm", "floor"), "listings": t["listings"].drop("leased").filter("week_listed < 0"),
              "leases": t["leases"], "weekly_market": t["weekly_market"].filter("n_listings_open < 0")}
    return contracts.errors_frame(spark, contracts.table_errors(broken))


@query("q02", sql=union(
    rule_sql("Domain", "asking_rent equals first_asking_rent", "listings", df_("asking_rent", "first_asking_rent"), "WARN"),
    rule_sql("Missing", "first_asking_rent is present", "listings", "first_asking_rent IS NULL")))
def q02(spark, sf):
    lst = t_(spark, sf)["listings"]
    return rules(qo.evaluate(lst, [
        qo.Rule("Domain", "asking_rent equals first_asking_rent", differs("asking_rent", "first_asking_rent"), severity="WARN"),
        qo.Rule("Missing", "first_asking_rent is present", F.col("first_asking_rent").isNull()),
    ]))


@query("q03", sql=union(*[
    f"SELECT {_q(t)} AS \"table\", CAST(count(*) AS BIGINT) AS rows, CAST({len(SCHEMA[t])} AS BIGINT) AS columns, "
    f"CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS BIGINT) AS duplicate_rows FROM {t}"
    for t in audit.TABLE_ORDER]))
def q03(spark, sf):
    return audit.inventory(t_(spark, sf))


@query("q04", sql=union(*[
    f"SELECT {_q(t)} AS \"table\", {_q(c)} AS \"column\", {i} AS position, {_q(ty)} AS type, CAST(count({c}) AS BIGINT) AS non_null, "
    f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS nulls, CAST(count(DISTINCT {c}) AS BIGINT) AS \"distinct\" FROM {t}"
    for t in audit.TABLE_ORDER for i, (c, ty) in enumerate(SCHEMA[t])]))
def q04(spark, sf):
    return audit.dictionary(t_(spark, sf))


@query("q05", sql="SELECT * FROM (" + union(*[
    f"SELECT {_q(t)} AS \"table\", {_q(c)} AS \"column\", CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS missing, "
    f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 6) AS missing_pct FROM {t}"
    for t in audit.TABLE_ORDER for c, _ in SCHEMA[t]]) + ") WHERE missing > 0")
def q05(spark, sf):
    return audit.missing_summary(t_(spark, sf)).select("table", "column", "missing", F.col("missing_pct").cast("double"))


def _some(wanted):
    return lambda spark, sf: rules(checks(spark, sf, wanted))


def _named(*names):
    return _some(lambda area, check: check in names)


PER_PROJECT = "units per project equals projects.total_units"
query("q06", sql=SQL_Q06)(_some(lambda area, check: area == "Missing"))
query("q07", sql=SQL_Q07)(_some(lambda area, check: area == "Primary key"))
query("q08", sql=SQL_Q08)(_some(lambda area, check: area == "Foreign key"))
query("q09", sql=SQL_Q09)(_some(lambda area, check: area == "Cross-table" and check != PER_PROJECT))
query("q10", sql=SQL_Q10)(_named(PER_PROJECT))
query("q11", sql=SQL_Q11)(_named("units.floor within 1-8", "units.size_sqm within 20-50", "units.room_type in the allowed set",
                                 "units.view in the allowed set"))
query("q12", sql=SQL_Q12)(_named("listing rents are positive", "weeks_on_market and n_viewings are not negative", "season_listed in the allowed set",
                                 "leases.rent is positive", "occupancy within 0-1", "weekly_market counts are not negative"))
query("q13", sql=SQL_Q13)(_named("week_leased = week_listed + weeks_on_market when leased"))
query("q14", sql=SQL_Q14)(_named("lease length matches lease_months"))
query("q15", sql=SQL_Q15)(_named("is_renewal matches tenant_segment = renewal"))
query("q16", sql=SQL_Q16)(_named("occupancy = n_units_leased / total_units"))
query("q17", sql=SQL_Q17)(_some(lambda area, check: area == "Date"))
query("q18", sql=SQL_Q18)(lambda spark, sf: audit.date_summary(t_(spark, sf), binding.WEEK_ZERO))
query("q19", sql=RAW_LISTINGS_SQL.strip() + "\n" + SQL_Q19)(
    lambda spark, sf: audit.raw_vs_processed(binding.raw_tables(t_(spark, sf)), t_(spark, sf)))


@query("q20", sql=RAW_LISTINGS_SQL.strip() + "\n" + SQL_Q20)
def q20(spark, sf):
    t = t_(spark, sf)
    return audit.cleanup_effect(binding.dirty_listings(t["listings"]), t["listings"], Q20_RANGE)


query("q21", sql=PAIRS_SQL + "\n" + SQL_Q21)(lambda spark, sf: audit.alternative_audit(t_(spark, sf)))


@query("q22", sql=ALL_CHECKS_SQL + """
SELECT area, CAST(count(*) AS BIGINT) AS rules, CAST(count(*) FILTER (WHERE status = 'FAIL') AS BIGINT) AS failed_rules,
  CAST(count(*) FILTER (WHERE status = 'WARN') AS BIGINT) AS warned_rules, CAST(sum(failures) AS BIGINT) AS failing_rows
FROM checks GROUP BY area""")
def q22(spark, sf):
    return audit.area_rollup(checks(spark, sf))


@query("q23", sql=ALL_CHECKS_SQL + """
SELECT CASE WHEN count(*) FILTER (WHERE status = 'FAIL') = 0 THEN 'PASS' ELSE 'FAIL' END AS overall_status,
  CAST(count(*) FILTER (WHERE status = 'FAIL') AS BIGINT) AS n_fail, CAST(count(*) FILTER (WHERE status = 'WARN') AS BIGINT) AS n_warn,
  CAST((SELECT count(*) FILTER (WHERE NOT leased) FROM listings) AS BIGINT) AS unleased_listings,
  CAST((SELECT count(*) FILTER (WHERE median_asking_rent IS NULL) FROM weekly_market) AS BIGINT) AS null_medians,
  CAST((SELECT count(*) FROM projects WHERE project_id NOT IN (SELECT project_id FROM listings WHERE project_id IS NOT NULL)) AS BIGINT)
    AS projects_without_listings
FROM checks""")
def q23(spark, sf):
    return audit.final_summary(checks(spark, sf), t_(spark, sf))


@query("q24", sql="""
SELECT CAST(count(*) FILTER (WHERE NOT ends_with(listing_id, '-B')) AS BIGINT) AS base_rows,
  CAST(count(*) FILTER (WHERE ends_with(listing_id, '-B')) AS BIGINT) AS alternatives,
  CAST(count(*) FILTER (WHERE NOT ends_with(listing_id, '-B') AND leased) AS BIGINT) AS leased_true,
  CAST(count(*) FILTER (WHERE NOT ends_with(listing_id, '-B') AND NOT leased) AS BIGINT) AS leased_false,
  CAST((SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM listings WHERE NOT ends_with(listing_id, '-B')
        GROUP BY unit_id, date_listed)) AS BIGINT) AS same_unit_date_repeats
FROM listings""")
def q24(spark, sf):
    return audit.base_listing_summary(t_(spark, sf)["listings"])


@query("t03", sql=ALL_CHECKS_SQL + """
SELECT CASE status WHEN 'FAIL' THEN 0 WHEN 'WARN' THEN 1 WHEN 'PASS' THEN 2 ELSE 3 END AS status_rank, area, "check", failures, status
FROM checks""")
def t03(spark, sf):
    return audit.ordered_report(checks(spark, sf)).select("status_rank", "area", "check", "failures", "status")


@query("p05", sql=ALL_CHECKS_SQL + """
SELECT area, "check", failures, status FROM checks WHERE area = 'Domain' OR area IN ('Primary key', 'Foreign key')""")
def p05(spark, sf):
    """An area by name, and a list of areas; only their rules are evaluated."""
    return rules(checks(spark, sf, lambda area, check: area == "Domain" or area in ("Primary key", "Foreign key")))
