"""Join operators J01–J08.

Broadcast policy: a side is broadcast only when its size is bounded by the domain (projects:
one row per project); anything else is left to the planner (sort-merge / shuffle-hash) and to AQE, which re-plans to a broadcast
join only when the shuffled size turns out to be small and splits skewed partitions.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.functions.nulls import differs_null_safe
from dwell.functions.scalars import base_id, is_alternative_id


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row with the number of *excess* rows (rows after the first) per key."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
                 F.count_if(F.col("n") > 1).cast("long").alias("duplicate_keys"),
                 F.count(F.lit(1)).cast("long").alias("distinct_keys")))


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> int:
    """J07 guard (``validate='many_to_one'``): raise if ``keys`` repeat; returns distinct key count."""
    row = key_violations(df, keys).first()
    if row["duplicate_rows"]:
        raise ValueError(f"{what}: key {list(keys)} repeats ({row['duplicate_keys']} keys)")
    return int(row["distinct_keys"])


UNIT_COLUMNS = ("unit_id", "floor", "size_sqm", "room_type", "view", "furnished")
PROJECT_COLUMNS = ("project_id", "project_name", "university", "distance_to_campus_m", "facility_count")


def leases_with_dimensions(leases: DataFrame, units: DataFrame, projects: DataFrame) -> DataFrame:
    """Every lease kept; unit attributes by unit_id, project attributes by project_id.

    The planner joins both by their size (AQE picks broadcast when one is small)."""
    return (leases.join(units.select(*UNIT_COLUMNS), "unit_id", "left")
            .join(projects.select(*PROJECT_COLUMNS), "project_id", "left"))


def previous_week_market(listings: DataFrame, market: DataFrame) -> DataFrame:
    """The market row of the week *before* listing (``week + 1 = week_listed``), same project,
    left join. Market columns are renamed ``market_*``; ``market_history_week`` is exposed.
    The caller guarantees (project_id, week) is unique (J07)."""
    history = market.select(
        "project_id",
        (F.col("week") + 1).alias("week_listed"),
        F.col("week").alias("market_history_week"),
        "n_searchers", "n_listings_open",
        F.col("occupancy").alias("market_occupancy"),
        F.col("median_asking_rent").alias("market_median_asking_rent"),
    )
    return listings.join(history, ["project_id", "week_listed"], "left")


def point_in_time_audit(joined: DataFrame, available_after_days: int = 7) -> DataFrame:
    """A market row of date d is known at d + 7 days, which must not be after date_listed.
    Input is J02 output carrying ``market_date``."""
    known_at = F.date_add(F.col("market_date"), available_after_days)
    return joined.agg(
        F.count(F.lit(1)).cast("long").alias("rows"),
        F.count_if(F.col("market_history_week").isNull()).cast("long").alias("no_market_row"),
        F.count_if(known_at > F.col("date_listed")).cast("long").alias("future_market_rows"),
    )


# J04/J05 shared event columns (fixed values).
ALTERNATIVE_EVENT_COLUMNS = ("unit_id", "project_id", "week_listed", "date_listed", "first_asking_rent",
                             "weeks_on_market", "leased", "week_leased")
ALTERNATIVE_CHECK_COLUMNS = ("unit_id", "project_id", "date_listed", "leased", "weeks_on_market", "week_leased")


def alternative_pairs(listings: DataFrame, columns: Sequence[str] = ALTERNATIVE_EVENT_COLUMNS,
                      extra: Sequence[str] = ("asking_rent", "agent_id")) -> DataFrame:
    """Every ``-B`` row left-joined to its base row (id without the suffix).

    Columns of the alternative side keep their name, the base side gets ``_base``; ``matched`` is
    the join indicator (J05 ``_merge == 'both'``). Both sides are shuffled on the base id; an
    alternative has at most one base (listing ids are unique)."""
    wanted = list(dict.fromkeys([*columns, *extra]))
    alt = listings.filter(is_alternative_id("listing_id")).select(
        "listing_id", base_id("listing_id").alias("base_listing_id"), *wanted)
    base = listings.filter(~is_alternative_id("listing_id")).select(
        F.col("listing_id").alias("base_listing_id"), F.lit(True).alias("matched"),
        *[F.col(c).alias(f"{c}_base") for c in wanted])
    return alt.join(base, "base_listing_id", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def pair_differs(columns: Sequence[str]):
    """A pair fails if any shared column differs null-safely."""
    return reduce(or_, [differs_null_safe(c, f"{c}_base") for c in columns])


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose key is absent from the parent key set; a null key is an orphan.

    ``left_anti`` keeps null keys (null never matches), as required. The parent side is reduced
    to its distinct keys first (map-side partial distinct)."""
    parent_key = parent_key or key
    keys = parent.select(F.col(parent_key).alias(f"__{key}")).distinct()
    return child.join(keys, child[key] == keys[f"__{key}"], "left_anti")


def lookup(fact: DataFrame, dim: DataFrame, key: str, columns: Sequence[str], prefix: str = "",
           fact_key: str | None = None, broadcast: bool = False, validate: bool = False) -> DataFrame:
    """Attach dimension attributes (``Series.map``); null when the key is unknown.
    The dimension must be unique on ``key`` (a repeated key is an error, as for ``Series.map``);
    ``validate=True`` checks it first (J07, one grouped count). ``broadcast`` only for a
    dimension whose size is bounded."""
    fact_key = fact_key or key
    if validate:
        require_unique(dim, [key], "lookup dimension")
    dim_small = dim.select(F.col(key).alias("__k"), *[F.col(c).alias(prefix + c) for c in columns])
    if broadcast:
        dim_small = F.broadcast(dim_small)
    return fact.join(dim_small, fact[fact_key] == F.col("__k"), "left").drop("__k")


def lease_term_weeks(months_col: str = "lease_months"):
    """J08 fixed map: lease term in months -> weeks (6 -> 24, 12 -> 48); unknown -> null."""
    return F.create_map(F.lit(6), F.lit(24), F.lit(12), F.lit(48))[F.col(months_col).cast("int")]
