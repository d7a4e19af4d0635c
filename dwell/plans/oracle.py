"""DuckDB text of the test binding, used as the prefix of every oracle query.

Each oracle statement is ``WITH <BINDING>, <query CTEs> SELECT ...`` over the driver's base
tables, so the oracle never sees anything computed by Spark. The derivation rules are the
fixed values of FIXTURES.md §4 and must stay identical to ``dwell.sources.binding``.
"""

DAYS = "date_diff('day', DATE '1995-01-01', CAST({x} AS DATE))"


def _days(x: str) -> str:
    return DAYS.format(x=x)


BINDING = f"""
projects AS (
  SELECT n_nationkey AS project_id, n_name AS project_name, r_name AS university,
    50 + (n_nationkey*37)%950 AS distance_to_campus_m, CAST(coalesce(u.n,0) AS INT) AS total_units,
    1990 + n_nationkey%6 AS year_completed, 20 + (n_nationkey*7)%41 AS facility_count
  FROM nation JOIN region ON n_regionkey=r_regionkey
  LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey<>24 GROUP BY c_nationkey) u
    ON u.c_nationkey=n_nationkey),
units AS (
  SELECT c_custkey AS unit_id, c_nationkey AS project_id, CAST(c_custkey%8+1 AS INT) AS floor,
    20 + CAST((c_custkey*13)%271 AS DOUBLE)/10 AS size_sqm,
    CASE c_custkey%3 WHEN 0 THEN 'studio' WHEN 1 THEN '1BR' ELSE '1BR Plus' END AS room_type,
    CASE WHEN c_custkey%5<3 THEN 'standard' WHEN c_custkey%5=3 THEN 'city' ELSE 'pool' END AS view,
    c_acctbal>2000 AS furnished, concat('AG0',CAST(c_custkey%6+1 AS VARCHAR)) AS agent_id
  FROM customer WHERE c_nationkey<>24),
base_listings AS (
  SELECT concat('L',CAST(o_orderkey AS VARCHAR)) AS listing_id, o_custkey AS unit_id, u.project_id,
    p.project_name, p.university, p.distance_to_campus_m, p.facility_count, u.agent_id, u.floor, u.size_sqm,
    u.room_type, u.view, u.furnished,
    CAST(floor({_days('o_orderdate')}/7) AS INT) AS week_listed, CAST(o_orderdate AS DATE) AS date_listed,
    CASE WHEN month(o_orderdate) IN (5,6,7) THEN 'peak' WHEN month(o_orderdate) IN (10,11) THEN 'shoulder'
         WHEN month(o_orderdate) IN (2,3,4) THEN 'off' ELSE 'normal' END AS season_listed,
    o_totalprice AS first_asking_rent, o_totalprice*(1-CAST(o_orderkey%4 AS DOUBLE)/100) AS asking_rent,
    s.lease_dt IS NOT NULL AS leased, CAST(floor({_days('s.lease_dt')}/7) AS INT) AS week_leased,
    CAST(floor({_days('o_orderdate')}/7) AS INT) % 7 AS n_viewings,
    CASE WHEN s.lease_dt IS NOT NULL THEN CASE o_orderkey%3 WHEN 0 THEN 'renewal' WHEN 1 THEN 'year1' ELSE 'firstjob' END END AS tenant_segment,
    CASE WHEN s.lease_dt IS NOT NULL THEN CASE WHEN o_orderkey%2=0 THEN 12 ELSE 6 END END AS lease_months
  FROM orders o JOIN units u ON u.unit_id=o_custkey JOIN projects p ON p.project_id=u.project_id
  LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS lease_dt FROM lineitem JOIN orders ON o_orderkey=l_orderkey
             WHERE l_shipdate>=o_orderdate GROUP BY l_orderkey) s ON s.l_orderkey=o.o_orderkey),
listings AS (
  SELECT b.*, coalesce(week_leased, 347)-week_listed AS weeks_on_market FROM base_listings b
  UNION ALL
  SELECT concat(listing_id,'-B') AS listing_id, unit_id, project_id, project_name, university,
    distance_to_campus_m, facility_count, concat(agent_id,'x') AS agent_id, floor, size_sqm, room_type, view,
    furnished, week_listed, date_listed, season_listed, first_asking_rent, asking_rent*1.01 AS asking_rent,
    leased, week_leased, n_viewings, tenant_segment, lease_months, coalesce(week_leased,347)-week_listed AS weeks_on_market
  FROM base_listings WHERE unit_id%20=0),
leases AS (
  SELECT concat('C',CAST(l_orderkey AS VARCHAR),'-',CAST(l_linenumber AS VARCHAR),'-',CAST(l_partkey AS VARCHAR),'-',
                CAST(l_suppkey AS VARCHAR)) AS lease_id, u.unit_id, u.project_id, CAST(l_shipdate AS DATE) AS date_start,
    CAST(floor({_days('l_shipdate')}/7) AS INT) AS week_start,
    CASE WHEN l_linenumber%2=0 THEN 12 ELSE 6 END AS lease_months,
    CAST(floor({_days('l_shipdate')}/7) AS INT) + CASE WHEN l_linenumber%2=0 THEN 48 ELSE 24 END AS week_end,
    l_extendedprice AS rent, l_returnflag='R' AS is_renewal,
    CASE l_returnflag WHEN 'R' THEN 'renewal' WHEN 'A' THEN 'year1' ELSE 'firstjob' END AS tenant_segment
  FROM lineitem JOIN orders ON o_orderkey=l_orderkey JOIN units u ON u.unit_id=o_custkey),
weekly_market AS (
  SELECT b.week_listed AS week, b.project_id, CAST(count(*) AS INT) AS n_listings_open,
    CAST(count(*)+sum(b.floor)%17 AS INT) AS n_searchers,
    CAST(count(DISTINCT b.unit_id) AS INT) AS n_units_leased,
    CAST(count(DISTINCT b.unit_id) AS DOUBLE)/max(p.total_units) AS occupancy,
    quantile_cont(b.asking_rent, 0.5) AS median_asking_rent,
    CAST(DATE '1995-01-01' + INTERVAL (b.week_listed*7) DAY AS DATE) AS date
  FROM base_listings b JOIN projects p ON p.project_id=b.project_id GROUP BY b.week_listed, b.project_id)
"""


def with_binding(body: str) -> str:
    """``body`` is ``name AS (...), ... SELECT ...`` or a bare ``SELECT``."""
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return f"WITH {BINDING}\n{body}"
    return f"WITH {BINDING},\n{body}"
