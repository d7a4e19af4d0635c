"""The data-quality audit of the five rental tables (Q01–Q24) as Spark plans.

Results are (ordinal, area, check, failures, status, note) rows. The rules are declared once, each with
the table it reads and the master tables it looks up; ``checks`` compiles the wanted ones:

* row rules are grouped by table, joined with the masters that one of them needs, and counted in one
  aggregate a table, so a rule alone reads its own table alone;
* key rules (primary keys, units per project) are read off counts by the key's own columns, a table at a time;
* a reference is a row rule: the looked-up master key is absent.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.functions.nulls import (any_of, differs, fails, fails_between, fails_isin, not_close)
from dwell.functions.scalars import (is_alternative_id, is_iso_date_text, not_lowercase, parse_date,
                                     untrimmed, week_to_date)
from dwell.operators import joins, windows
from dwell.operators.ordering import status_rank
from dwell.operators.quality import Rule, counted, evaluate, union_all

# ------------------------------------------------------------------ fixed values of the audit
VALID_ROOM_TYPES = ("studio", "1BR", "1BR Plus")
VALID_VIEWS = ("standard", "city", "pool")
VALID_SEASONS = ("normal", "peak", "shoulder", "off")
VALID_FLOOR_RANGE = (1, 8)
VALID_SIZE_RANGE_SQM = (20, 50)
RENT_REVIEW_RANGE = (5_000, 30_000)
LEASE_WEEKS_BY_MONTHS = {6: 24, 12: 48}
OUTCOME_COLUMNS = ("week_leased", "tenant_segment", "lease_months")
PRIMARY_KEYS = {
    "projects": ("project_id",),
    "units": ("unit_id",),
    "listings": ("listing_id",),
    "leases": ("lease_id",),
    "weekly_market": ("project_id", "week"),
}
FOREIGN_KEYS = (
    ("units", "project_id", "projects", "project_id"),
    ("listings", "project_id", "projects", "project_id"),
    ("listings", "unit_id", "units", "unit_id"),
    ("leases", "project_id", "projects", "project_id"),
    ("leases", "unit_id", "units", "unit_id"),
    ("weekly_market", "project_id", "projects", "project_id"),
)
PROJECT_ATTRIBUTES = ("project_name", "university", "distance_to_campus_m", "facility_count")
UNIT_ATTRIBUTES = ("floor", "size_sqm", "room_type", "view", "furnished")
DATE_RULES = (("listings", "date_listed", "week_listed"), ("leases", "date_start", "week_start"),
              ("weekly_market", "date", "week"))
TABLE_ORDER = ("projects", "units", "listings", "leases", "weekly_market")


# ------------------------------------------------------------------ Q03 / Q04 / Q05 profiles
def inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Q03: rows, columns and whole-row duplicates per table (N5 counts)."""
    parts = []
    for name in TABLE_ORDER:
        df = tables[name]
        per_row = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
        parts.append(per_row.agg(F.sum("__n").cast("long").alias("rows"),
                                 F.sum(F.col("__n") - 1).cast("long").alias("duplicate_rows"))
                     .select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"),
                             F.coalesce("duplicate_rows", F.lit(0)).cast("long").alias("duplicate_rows")))
    return union_all(parts)


def dictionary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Q04: (table, column, position, type, non_null, nulls, distinct), exact.

    Each row sends its cells as (column, value) entries, which are counted by value before they are
    shuffled; distinct values, nulls and rows are then sums over one count table."""
    parts = []
    for name in TABLE_ORDER:
        df = tables[name]
        types = dict(df.dtypes)
        # 0.0 and -0.0 are the same value
        cell = [F.col(c) + F.lit(0.0) if types[c] in ("double", "float") else F.col(c) for c in df.columns]
        entries = F.inline(F.array(*[F.struct(F.lit(i).alias("position"), x.cast("string").alias("value")) for i, x in enumerate(cell)]))
        counts = df.select(entries).groupBy("position", "value").agg(F.count(F.lit(1)).alias("n"))
        sums = counts.groupBy(F.col("position").alias("of")).agg(
            F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("non_null"), F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("nulls"),
            F.count("value").alias("distinct"))
        columns = df.sparkSession.createDataFrame([(name, c, i, types[c]) for i, c in enumerate(df.columns)],
                                                  "table string, column string, position int, type string")
        parts.append(columns.join(sums, F.col("position") == F.col("of"), "left").select(
            "table", "column", "position", "type", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("non_null", "nulls", "distinct")]))
    return union_all(parts)


def missing_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Q05: only columns with nulls: count and percent of rows; one aggregate a table."""
    parts = []
    for name in TABLE_ORDER:
        df = tables[name]
        wide = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
        rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").cast("long").alias("missing")) for i, c in enumerate(df.columns)])
        parts.append(wide.select(F.lit(name).alias("table"), "rows", F.inline(rows)).filter(F.col("missing") > 0).select(
            "table", "column", "missing", F.round(F.col("missing") * 100.0 / F.col("rows"), 6).alias("missing_pct")))
    return union_all(parts)


# ------------------------------------------------------------------ the rules
@dataclass(frozen=True)
class RowRule:
    """A rule on the rows of ``table``, which may look at the masters in ``needs`` (columns ``u_...`` of the
    row's unit, ``p_...`` of its project)."""
    table: str
    ordinal: int
    rule: Rule
    needs: tuple[str, ...] = ()


def row_rules(week_zero: str) -> list[RowRule]:
    """Q06, Q08, Q09, Q11-Q17 as row rules."""
    leased = F.col("leased")
    out = [
        RowRule("listings", 100, Rule("Missing", "leased listings have all outcome columns",
                                      fails(leased & any_of(F.col(c).isNull() for c in OUTCOME_COLUMNS)))),
        RowRule("listings", 101, Rule("Missing", "unleased listings have no outcome column",
                                      fails(~leased & any_of(F.col(c).isNotNull() for c in OUTCOME_COLUMNS)))),
        RowRule("weekly_market", 102, Rule("Missing", "median_asking_rent is null only without open listings",
                                           fails(F.col("median_asking_rent").isNull() & (F.col("n_listings_open") > 0)))),
    ]
    for i, (child, key, parent, _) in enumerate(FOREIGN_KEYS):
        out.append(RowRule(child, 300 + i, Rule("Foreign key", f"{child}.{key} -> {parent}", F.col(f"{MASTERS[parent][1]}known").isNull()), (parent,)))
    out.append(RowRule("listings", 400, Rule("Cross-table", "listings.project_id matches units.project_id", differs("project_id", "u_project_id")), ("units",)))
    out += [RowRule("listings", 401 + i, Rule("Cross-table", f"listings.{c} matches projects.{c}", differs(c, f"p_{c}")), ("projects",))
            for i, c in enumerate(PROJECT_ATTRIBUTES)]
    out += [RowRule("listings", 405 + i, Rule("Cross-table", f"listings.{c} matches units.{c}", differs(c, f"u_{c}")), ("units",))
            for i, c in enumerate(UNIT_ATTRIBUTES)]
    out.append(RowRule("leases", 410, Rule("Cross-table", "leases.project_id matches units.project_id", differs("project_id", "u_project_id")), ("units",)))
    domain = [
        ("units", Rule("Domain", "units.floor within 1-8", fails_between("floor", *VALID_FLOOR_RANGE)), ()),
        ("units", Rule("Domain", "units.size_sqm within 20-50", fails_between("size_sqm", *VALID_SIZE_RANGE_SQM)), ()),
        ("units", Rule("Domain", "units.room_type in the allowed set", fails_isin("room_type", VALID_ROOM_TYPES)), ()),
        ("units", Rule("Domain", "units.view in the allowed set", fails_isin("view", VALID_VIEWS)), ()),
        ("listings", Rule("Domain", "listing rents are positive", any_of([fails(F.col("asking_rent") <= 0), fails(F.col("first_asking_rent") <= 0)])), ()),
        ("listings", Rule("Domain", "weeks_on_market and n_viewings are not negative",
                          any_of([fails(F.col("weeks_on_market") < 0), fails(F.col("n_viewings") < 0)])), ()),
        ("listings", Rule("Domain", "season_listed in the allowed set", fails_isin("season_listed", VALID_SEASONS)), ()),
        ("listings", Rule("Logic", "week_leased = week_listed + weeks_on_market when leased",
                          fails(leased & differs("week_leased", F.col("week_listed") + F.col("weeks_on_market")))), ()),
        ("leases", Rule("Logic", "lease length matches lease_months", differs(F.col("week_end") - F.col("week_start"), joins.lease_term_weeks("lease_months"))), ()),
        ("leases", Rule("Logic", "is_renewal matches tenant_segment = renewal",
                        differs("is_renewal", F.coalesce(F.col("tenant_segment") == "renewal", F.lit(False)))), ()),
        ("leases", Rule("Domain", "leases.rent is positive", fails(F.col("rent") <= 0)), ()),
        ("weekly_market", Rule("Domain", "occupancy within 0-1", fails_between("occupancy", 0, 1)), ()),
        ("weekly_market", Rule("Domain", "weekly_market counts are not negative",
                               any_of([fails(F.col(c) < 0) for c in ("n_searchers", "n_listings_open", "n_units_leased")])), ()),
        ("weekly_market", Rule("Logic", "occupancy = n_units_leased / total_units", not_close("occupancy", F.col("n_units_leased") / F.col("p_total_units"))),
         ("projects",)),
    ]
    out += [RowRule(table, 500 + i, rule, needs) for i, (table, rule, needs) in enumerate(domain)]
    for i, (name, date_col, week_col) in enumerate(DATE_RULES):
        parsed = parse_date(date_col)
        out += [RowRule(name, 600 + 2 * i, Rule("Date", f"{name}.{date_col} parses as a date", parsed.isNull())),
                RowRule(name, 601 + 2 * i, Rule("Date", f"{name}: date matches the week number",
                                                parsed.isNotNull() & differs(parsed, week_to_date(week_col, week_zero))))]
    return out


#: master table -> its key, the prefix of its looked-up columns, and these columns
MASTERS = {"units": ("unit_id", "u_", ("project_id", *UNIT_ATTRIBUTES)), "projects": ("project_id", "p_", ("total_units", *PROJECT_ATTRIBUTES))}


def looked_up(df: DataFrame, master: DataFrame, name: str) -> DataFrame:
    """``df`` with the attributes of its master row and ``..known`` (null: no such row); one row stays one
    row even where the master repeats a key."""
    key, prefix, attributes = MASTERS[name]
    dim = master.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"{prefix}key")).agg(
        F.min(F.struct(*attributes)).alias(f"{prefix}row"))
    joined = df.join(dim, F.col(key) == F.col(f"{prefix}key"), "left")
    return joined.select(*df.columns, F.col(f"{prefix}key").alias(f"{prefix}known"), *[F.col(f"{prefix}row")[c].alias(f"{prefix}{c}") for c in attributes])


def evaluated(t: Mapping[str, DataFrame], chosen: Sequence[RowRule]) -> list[DataFrame]:
    """One aggregate for each table that one of the rules reads. An absent column is an error.

    A rule is judged as soon as its masters are there and carried as a bit of one number, projects (few) before
    units, so a join moves only that and the columns that the rules still to come compare."""
    parts = []
    for table in TABLE_ORDER:
        own = [r for r in chosen if r.table == table]
        if own:
            frame, rules, there, judged = t[table], [r.rule for r in own], set(), set()
            for master in ("projects", "units"):
                if any(master in r.needs for r in own):
                    ready = {i for i, r in enumerate(own) if there.issuperset(r.needs)} - judged
                    failed = [F.when(rules[i].fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in sorted(ready)]
                    if failed:
                        frame = frame.withColumn("__failed", sum(failed, F.col("__failed") if judged else F.lit(0).cast("long")))
                    judged |= ready
                    frame = looked_up(frame, t[master], master)
                    there.add(master)
            rules = [replace(r, fails=F.col("__failed").bitwiseAND(F.lit(1 << i).cast("long")) != 0) if i in judged else r for i, r in enumerate(rules)]
            parts.append(evaluate(frame, rules, [r.ordinal for r in own]))
    return parts


def key_rules(t: Mapping[str, DataFrame], wanted: Callable[[str], bool]) -> list[DataFrame]:
    """Q07 and Q10. Rows are counted by key, a table at a time and by its own columns; the two tables with a
    project's key and size are counted together."""
    unique = {name: f"{name}: {', '.join(keys)} is unique" for name, keys in PRIMARY_KEYS.items()}
    per_project = "units per project equals projects.total_units"
    parts = []
    for i, (name, keys) in enumerate(PRIMARY_KEYS.items()):
        if wanted(unique[name]) and not (name == "projects" and wanted(per_project)):
            counts = t[name].groupBy(*keys).agg(F.count(F.lit(1)).alias("own"))
            found = counts.agg(F.coalesce(F.sum(F.col("own") - 1), F.lit(0)).alias("repeats"))
            parts.append(found.select(F.inline(F.array(counted(200 + i, "Primary key", unique[name], F.col("repeats"))))))
    if wanted(per_project):
        none = F.lit(None).cast("long")
        both = t["projects"].select("project_id", F.lit(1).alias("own"), F.lit(0).alias("units"), F.col("total_units").cast("long").alias("total")).unionByName(
            t["units"].select("project_id", F.lit(0).alias("own"), F.lit(1).alias("units"), none.alias("total")))
        found = both.groupBy("project_id").agg(F.sum("own").alias("own"), F.sum("units").alias("units"), F.min("total").alias("total")).agg(
            F.coalesce(F.sum(F.when(F.col("own") > 0, F.col("own") - 1)), F.lit(0)).alias("repeats"),
            F.count_if((F.col("own") > 0) & differs("units", "total")).alias("sizes"))
        rows = [counted(411, "Cross-table", per_project, F.col("sizes"))]
        if wanted(unique["projects"]):
            rows.append(counted(200 + list(PRIMARY_KEYS).index("projects"), "Primary key", unique["projects"], F.col("repeats")))
        parts.append(found.select(F.inline(F.array(*rows))))
    return parts


def alternative_audit(t: Mapping[str, DataFrame]) -> DataFrame:
    """Pairs, invalid pairs, pairs with changed asking_rent and agent_id (one row)."""
    pairs = joins.alternative_pairs(t["listings"])
    bad = ~F.col("matched") | joins.pair_differs(joins.ALTERNATIVE_EVENT_COLUMNS)
    return pairs.agg(F.count(F.lit(1)).cast("long").alias("pairs"),
                     F.count_if(bad).cast("long").alias("invalid_pairs"),
                     F.count_if(differs("asking_rent", "asking_rent_base")).cast("long").alias("changed_asking_rent"),
                     F.count_if(differs("agent_id", "agent_id_base")).cast("long").alias("changed_agent_id"))


def alternative_rule(t: Mapping[str, DataFrame], base: int = 520) -> DataFrame:
    a = alternative_audit(t)
    note = F.format_string("%d pairs; asking_rent changed in %d, agent_id in %d", "pairs", "changed_asking_rent",
                           "changed_agent_id")
    return a.select(F.inline(F.array(F.struct(
        F.lit(base).alias("ordinal"), F.lit("Logic").alias("area"),
        F.lit(ALTERNATIVE_CHECK).alias("check"),
        F.col("invalid_pairs").alias("failures"),
        F.when(F.col("invalid_pairs") == 0, "PASS").otherwise("FAIL").alias("status"), note.alias("note")))))


def date_summary(t: Mapping[str, DataFrame], week_zero: str) -> DataFrame:
    """Q18: invalid dates, mismatches with the week number and the range of dates, one aggregate a table."""
    parts = []
    for name, date_col, week_col in DATE_RULES:
        parsed = parse_date(date_col)
        mismatch = parsed.isNotNull() & differs(parsed, week_to_date(week_col, week_zero))
        parts.append(t[name].agg(F.count_if(parsed.isNull()).cast("long").alias("invalid_dates"), F.count_if(mismatch).cast("long").alias("week_date_mismatches"),
                                 F.min(parsed).alias("min_date"), F.max(parsed).alias("max_date")).select(F.lit(name).alias("table"), "*"))
    return union_all(parts)


def raw_vs_processed(raw: Mapping[str, DataFrame], processed: Mapping[str, DataFrame]) -> DataFrame:
    """Q19: per table raw/processed rows, preserved flag, total missing cells. A table that is its own raw
    version is read once."""
    parts = []
    for name in TABLE_ORDER:
        def summary(df, tag):
            return df.agg(F.count(F.lit(1)).cast("long").alias(f"{tag}_rows"),
                          sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0)).cast("long")
                          .alias(f"{tag}_missing_cells"))
        r = summary(raw[name], "raw")
        if raw[name] is processed[name]:
            both = r.select("*", F.col("raw_rows").alias("processed_rows"), F.col("raw_missing_cells").alias("processed_missing_cells"))
        else:
            p = summary(processed[name], "processed")
            both = r.select("*", p.select("processed_rows").scalar().alias("processed_rows"),
                            p.select("processed_missing_cells").scalar().alias("processed_missing_cells"))
        parts.append(both.select(F.lit(name).alias("table"), "raw_rows", "processed_rows",
                                 (F.col("raw_rows") == F.col("processed_rows")).alias("row_count_preserved"),
                                 "raw_missing_cells", "processed_missing_cells"))
    return union_all(parts)


def raw_rules(raw: Mapping[str, DataFrame], processed: Mapping[str, DataFrame], wanted: Callable[[str], bool], base: int = 700) -> list[DataFrame]:
    """Row counts raw against processed; a table that is its own raw version passes unread."""
    parts = []
    for i, name in enumerate(TABLE_ORDER):
        check = f"{name}: row count unchanged"
        if not wanted(check):
            continue
        if raw[name] is processed[name]:
            parts.append(processed[name].sparkSession.range(1).select(F.inline(F.array(counted(base + i, "Raw->processed", check, F.lit(0))))))
        else:
            sides = raw[name].select(F.lit(1).alias("d")).unionByName(processed[name].select(F.lit(-1).alias("d")))
            parts.append(sides.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("d")).select(
                F.inline(F.array(counted(base + i, "Raw->processed", check, F.when(F.col("d") == 0, 0).otherwise(1))))))
    return parts


def cleanup_effect(raw_listings: DataFrame, listings: DataFrame, rent_range=RENT_REVIEW_RANGE) -> DataFrame:
    """Q20: six listing issues counted on raw and processed data (one aggregate each) + fixed."""
    def issues(df):
        date_text = F.col("date_listed").cast("string")
        return [
            ("size_sqm outside 20-50", fails_between("size_sqm", *VALID_SIZE_RANGE_SQM)),
            (f"asking_rent outside the review range {rent_range[0]}-{rent_range[1]}",
             fails_between("asking_rent", *rent_range)),
            ("room_type has leading or trailing spaces", differs("room_type", F.trim("room_type"))),
            ("view is not lower case", differs("view", F.lower("view"))),
            ("furnished is missing", F.col("furnished").isNull()),
            ("date_listed is not YYYY-MM-DD", ~F.coalesce(is_iso_date_text(date_text), F.lit(False))),
        ]
    names = [n for n, _ in issues(listings)]
    raw_agg = raw_listings.agg(*[F.count_if(c).cast("long").alias(f"i{k}") for k, (_, c) in enumerate(issues(raw_listings))])
    pro_agg = listings.agg(*[F.count_if(c).cast("long").alias(f"i{k}") for k, (_, c) in enumerate(issues(listings))])
    raw_long = raw_agg.select(F.inline(F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(n).alias("issue"),
                                                           F.col(f"i{k}").alias("raw")) for k, n in enumerate(names)])))
    pro_long = pro_agg.select(F.inline(F.array(*[F.struct(F.lit(k).alias("ordinal"), F.col(f"i{k}").alias("processed"))
                                                  for k in range(len(names))])))
    return raw_long.join(pro_long, "ordinal").select("ordinal", "issue", "raw", "processed",
                                                      (F.col("raw") - F.col("processed")).alias("fixed"))


# ------------------------------------------------------------------ report
ALTERNATIVE_CHECK = "-B listings pair with their base listing and share the event"


def checks(t: Mapping[str, DataFrame], week_zero: str, raw: Mapping[str, DataFrame] | None = None,
           wanted: Callable[[str, str], bool] = lambda area, check: True) -> DataFrame:
    """The results of the wanted rules (of Q06-Q19); only what they need is read."""
    raw = t if raw is None else raw
    parts = evaluated(t, [r for r in row_rules(week_zero) if wanted(r.rule.area, r.rule.check)])
    parts += key_rules(t, lambda check: wanted("Cross-table" if check.startswith("units per") else "Primary key", check))
    if wanted("Logic", ALTERNATIVE_CHECK):
        parts.append(alternative_rule(t))
    return union_all(parts + raw_rules(raw, t, lambda check: wanted("Raw->processed", check)))


def ordered_report(checks: DataFrame) -> DataFrame:
    """FAIL < WARN < PASS, then area, then check."""
    return checks.withColumn("status_rank", status_rank("status")).orderBy("status_rank", "area", "check")


def area_rollup(checks: DataFrame) -> DataFrame:
    """Q22: rules, failed rules and failing rows per area."""
    return checks.groupBy("area").agg(F.count(F.lit(1)).cast("long").alias("rules"),
                                      F.count_if(F.col("status") == "FAIL").cast("long").alias("failed_rules"),
                                      F.count_if(F.col("status") == "WARN").cast("long").alias("warned_rules"),
                                      F.sum("failures").cast("long").alias("failing_rows"))


def final_summary(checks: DataFrame, t: Mapping[str, DataFrame]) -> DataFrame:
    """Q23: overall status, n_fail, n_warn, unleased listings, null medians, projects without listings."""
    c = checks.agg(F.count_if(F.col("status") == "FAIL").cast("long").alias("n_fail"),
                   F.count_if(F.col("status") == "WARN").cast("long").alias("n_warn"))
    unleased = t["listings"].select(F.count_if(~F.col("leased")).cast("long")).scalar()
    null_medians = t["weekly_market"].select(F.count_if(F.col("median_asking_rent").isNull()).cast("long")).scalar()
    no_listings = (t["projects"].select("project_id").join(t["listings"].select("project_id").distinct(),
                                                           "project_id", "left_anti")
                   .select(F.count(F.lit(1)).cast("long")).scalar())
    return c.select(F.when(F.col("n_fail") == 0, "PASS").otherwise("FAIL").alias("overall_status"), "n_fail", "n_warn",
                    unleased.alias("unleased_listings"), null_medians.alias("null_medians"),
                    no_listings.alias("projects_without_listings"))


def base_listing_summary(listings: DataFrame) -> DataFrame:
    """Q24: after dropping alternatives: rows, alternatives dropped, same unit+date repeats and
    leased value counts (one row)."""
    alt = is_alternative_id("listing_id")
    base = listings.filter(~alt)
    repeats = windows.duplicate_count(base, ["unit_id", "date_listed"]).select("duplicates").scalar()
    return listings.agg(
        F.count_if(~alt).cast("long").alias("base_rows"), F.count_if(alt).cast("long").alias("alternatives"),
        F.count_if(~alt & F.col("leased")).cast("long").alias("leased_true"),
        F.count_if(~alt & ~F.col("leased")).cast("long").alias("leased_false"),
    ).select("*", repeats.alias("same_unit_date_repeats"))

