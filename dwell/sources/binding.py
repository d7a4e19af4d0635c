"""Binding of the driver's TPC-H-style tables to the five rental tables.

The rental tables (projects, units, listings, leases, weekly_market) are derived from
region / nation / customer / orders / lineitem with plain DataFrame operations so that
every downstream plan grows with the input. The derivation rules are fixed values of the
test binding (see FIXTURES.md §4) and must stay identical to the DuckDB text in
``dwell.plans.oracle``.

Scale notes
-----------
* No join is hinted: the planner and AQE broadcast a side only when its size is under
  ``spark.sql.autoBroadcastJoinThreshold`` (``projects`` has one row per nation, ``units`` grows).
* The lease date of an order is ``min(l_shipdate)`` over its lines shipped on/after the order
  date: a partial (map-side) aggregate on ``l_orderkey`` after a shuffle join with orders.
* ``weekly_market`` is a group-by over (week, project); the exact median comes from the
  distributed quantile operator, so a hot (week, project) is never gathered into one task.
* ``views()`` writes the five tables once for each version of the input files, as parquet in the
  checkpoint folder (a written table cuts lineage and survives executor loss), one after the other: the
  market reads the written listings, so orders and lineitem are joined once for listings and once for leases.
* Listings and leases are sorted by date inside each file (no range shuffle): time-split filters skip pages.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.operators.ranking import join_keys, quantile_columns
from dwell.session import ensure_checkpoint_dir

TABLES = ("projects", "units", "listings", "leases", "weekly_market")
BASE_TABLES = ("region", "nation", "customer", "orders", "lineitem")

# Fixed values of the test binding.
WEEK_ZERO = "1995-01-01"
CENSORED_END_WEEK = 347          # weeks_on_market of an unleased listing = 347 - week_listed
EXCLUDED_NATION = 24             # nation without units or listings
ALTERNATIVE_EVERY = 20           # unit_id % 20 = 0 gets an alternative "-B" advert
ALTERNATIVE_RENT_FACTOR = 1.01
ALTERNATIVE_AGENT = "x"          # ends the agent of an alternative advert
# Cut-offs used with this binding.
TTL_TRAIN_END = "1998-12-31"
TTL_VALIDATION_END = "1999-03-31"
TTL_TEST_END = "1999-06-30"
PRICE_TRAIN_END = "1999-12-31"
PRICE_VALIDATION_END = "2000-03-31"
PRICE_FOLDS = (
    ("1999_Q1", "1998-12-31", "1999-03-31"),
    ("1999_Q2", "1999-03-31", "1999-06-30"),
    ("1999_Q3", "1999-06-30", "1999-09-30"),
    ("1999_Q4", "1999-09-30", "1999-12-31"),
)

ROWS_A_PARTITION = 500_000       # about 100 MB of lease rows in a sort
MERGED_PARTITION = "8m"          # small shuffle partitions are merged up to this size

_lock = threading.Lock()
_cache: dict[tuple[str, str], tuple[str, dict[str, DataFrame], str]] = {}


def read_base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _weeks_since_zero(c) -> F.Column:
    return F.floor(F.datediff(F.to_date(c), F.lit(WEEK_ZERO)) / 7).cast("int")


@contextmanager
def spread(spark: SparkSession, rows: int):
    """Inside, shuffles have a partition for about every ``ROWS_A_PARTITION`` rows (or the session's number, if
    larger), so what a task sorts does not grow with the input and never goes to disk."""
    wanted = {"spark.sql.shuffle.partitions": str(max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows // ROWS_A_PARTITION))),
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": MERGED_PARTITION}
    held = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in held.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def derive(spark: SparkSession, sf_dir: str, stored: Callable[[str, DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """The five rental tables, one after the other: ``stored(name, rows)`` writes a table and reads it back, so
    that later tables read earlier ones instead of deriving them again."""
    customer = read_base(spark, sf_dir, "customer").filter(F.col("c_nationkey") != EXCLUDED_NATION)
    orders = read_base(spark, sf_dir, "orders")
    lineitem = read_base(spark, sf_dir, "lineitem")
    out = {"projects": stored("projects", projects_of(read_base(spark, sf_dir, "nation"), read_base(spark, sf_dir, "region"), customer)),
           "units": stored("units", units_of(customer))}
    out["listings"] = stored("listings", listings_of(orders, lineitem, out["units"], out["projects"]))
    out["leases"] = stored("leases", leases_of(orders, lineitem, out["units"]))
    out["weekly_market"] = stored("weekly_market", market_of(out["listings"], out["projects"]))
    return out


def projects_of(nation: DataFrame, region: DataFrame, customer: DataFrame) -> DataFrame:
    units_per_nation = customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_units"))
    return (
        nation.join(region, nation.n_regionkey == region.r_regionkey)
        .join(units_per_nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("n_nationkey").alias("project_id"),
            F.col("n_name").alias("project_name"),
            F.col("r_name").alias("university"),
            (F.lit(50) + (F.col("n_nationkey") * 37) % 950).alias("distance_to_campus_m"),
            F.coalesce(F.col("n_units"), F.lit(0)).cast("int").alias("total_units"),
            (F.lit(1990) + F.col("n_nationkey") % 6).alias("year_completed"),
            (F.lit(20) + (F.col("n_nationkey") * 7) % 41).alias("facility_count"),
        )
    )


def units_of(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.select(
        key.alias("unit_id"),
        F.col("c_nationkey").alias("project_id"),
        (key % 8 + 1).cast("int").alias("floor"),
        (F.lit(20) + ((key * 13) % 271).cast("double") / 10).alias("size_sqm"),
        F.when(key % 3 == 0, "studio").when(key % 3 == 1, "1BR").otherwise("1BR Plus").alias("room_type"),
        F.when(key % 5 < 3, "standard").when(key % 5 == 3, "city").otherwise("pool").alias("view"),
        (F.col("c_acctbal") > 2000).alias("furnished"),
        F.concat(F.lit("AG0"), (key % 6 + 1).cast("string")).alias("agent_id"),
    )


def listings_of(orders: DataFrame, lineitem: DataFrame, units: DataFrame, projects: DataFrame) -> DataFrame:
    """Orders meet their lease dates by order key, then, still narrow, their units. A row of some units also
    makes the alternative advert."""
    # first ship date on/after the order date = the lease date of the listing (order)
    order_dates = orders.select("o_orderkey", "o_orderdate")
    lease_dates = (
        lineitem.select("l_orderkey", "l_shipdate")
        .join(order_dates, F.col("l_orderkey") == F.col("o_orderkey"))
        .filter(F.col("l_shipdate") >= F.col("o_orderdate"))
        .groupBy("l_orderkey")
        .agg(F.min("l_shipdate").alias("lease_dt"))
    )

    month = F.month("o_orderdate")
    adverts = F.when(F.col("unit_id") % ALTERNATIVE_EVERY == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    other = F.col("alternative")
    listing_id = F.concat(F.lit("L"), F.col("o_orderkey").cast("string"))
    asking_rent = F.col("o_totalprice") * (1 - (F.col("o_orderkey") % 4).cast("double") / 100)
    return (
        orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
        .join(lease_dates, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(units, F.col("unit_id") == F.col("o_custkey"))
        .join(projects.drop("total_units", "year_completed"), "project_id")
        .sortWithinPartitions("o_orderdate")
        .select("*", F.explode(adverts).alias("alternative"))
        .select(
            F.when(other, F.concat(listing_id, F.lit("-B"))).otherwise(listing_id).alias("listing_id"),
            "unit_id", "project_id", "project_name", "university", "distance_to_campus_m",
            "facility_count", F.when(other, F.concat("agent_id", F.lit(ALTERNATIVE_AGENT))).otherwise(F.col("agent_id")).alias("agent_id"),
            "floor", "size_sqm", "room_type", "view", "furnished",
            _weeks_since_zero(F.col("o_orderdate")).alias("week_listed"),
            F.to_date("o_orderdate").alias("date_listed"),
            F.when(month.isin(5, 6, 7), "peak").when(month.isin(10, 11), "shoulder")
            .when(month.isin(2, 3, 4), "off").otherwise("normal").alias("season_listed"),
            F.col("o_totalprice").alias("first_asking_rent"),
            F.when(other, asking_rent * ALTERNATIVE_RENT_FACTOR).otherwise(asking_rent).alias("asking_rent"),
            F.col("lease_dt").isNotNull().alias("leased"),
            _weeks_since_zero(F.col("lease_dt")).alias("week_leased"),
            (_weeks_since_zero(F.col("o_orderdate")) % 7).alias("n_viewings"),
            F.when(F.col("lease_dt").isNotNull(), F.when(F.col("o_orderkey") % 3 == 0, "renewal").when(F.col("o_orderkey") % 3 == 1, "year1")
                   .otherwise("firstjob")).alias("tenant_segment"),
            F.when(F.col("lease_dt").isNotNull(), F.when(F.col("o_orderkey") % 2 == 0, 12).otherwise(6)).alias("lease_months"),
        )
        .select("*", (F.coalesce(F.col("week_leased"), F.lit(CENSORED_END_WEEK)) - F.col("week_listed")).alias("weeks_on_market"))
    )


def leases_of(orders: DataFrame, lineitem: DataFrame, units: DataFrame) -> DataFrame:
    line_even = F.col("l_linenumber") % 2 == 0
    start_week = _weeks_since_zero(F.col("l_shipdate"))
    # orders -> (unit, project) first (an orders-sized shuffle by customer), so the lineitem-sized
    # side is shuffled once, by order key
    order_units = (orders.select("o_orderkey", "o_custkey")
                   .join(units.select("unit_id", "project_id"), F.col("unit_id") == F.col("o_custkey")))
    return (
        lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                        "l_extendedprice", "l_returnflag")
        .join(order_units.drop("o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
        .sortWithinPartitions("l_shipdate")
        .select(
            F.concat_ws("-", F.concat(F.lit("C"), F.col("l_orderkey").cast("string")),
                        F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"),
                        F.col("l_suppkey").cast("string")).alias("lease_id"),
            "unit_id", "project_id",
            F.to_date("l_shipdate").alias("date_start"),
            start_week.alias("week_start"),
            F.when(line_even, 12).otherwise(6).alias("lease_months"),
            (start_week + F.when(line_even, 48).otherwise(24)).alias("week_end"),
            F.col("l_extendedprice").alias("rent"),
            (F.col("l_returnflag") == "R").alias("is_renewal"),
            F.when(F.col("l_returnflag") == "R", "renewal").when(F.col("l_returnflag") == "A", "year1")
            .otherwise("firstjob").alias("tenant_segment"),
        )
    )


def market_of(listings: DataFrame, projects: DataFrame) -> DataFrame:
    """Week by project over the primary listings (an order without a key has no id that tells, its agent does)."""
    market_rows = (listings.filter(~F.col("agent_id").endswith(ALTERNATIVE_AGENT))
                   .select(F.col("week_listed").alias("week"), "project_id", "floor", "unit_id", "asking_rent")
                   .join(projects.select("project_id", "total_units"), "project_id"))
    medians = quantile_columns(market_rows, ["week", "project_id"], "asking_rent", [0.5], ["median_asking_rent"])
    return (
        market_rows.groupBy("week", "project_id")
        .agg(
            F.count(F.lit(1)).cast("int").alias("n_listings_open"),
            (F.count(F.lit(1)) + F.sum("floor") % 17).cast("int").alias("n_searchers"),
            F.count_distinct("unit_id").cast("int").alias("n_units_leased"),
            (F.count_distinct("unit_id").cast("double") / F.max("total_units")).alias("occupancy"),
        )
        .transform(lambda rows: join_keys(rows, medians, ["week", "project_id"], "left"))
        .withColumn("date", F.date_add(F.lit(WEEK_ZERO).cast("date"), F.col("week") * 7))
        .select("week", "project_id", "n_listings_open", "n_searchers", "n_units_leased", "occupancy",
                "median_asking_rent", "date")
    )


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path (local, HDFS, object stores) and the path in it."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _file_system(spark, path)
    return bool(fs.exists(hpath))


def version(spark: SparkSession, sf_dir: str) -> str:
    """Names the contents of the base tables: path, length and time of every file of each."""
    h = hashlib.sha256()
    for name in BASE_TABLES:
        fs, hpath = _file_system(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")
        files, listed = fs.listFiles(hpath, True), []
        while files.hasNext():
            f = files.next()
            listed.append(f"{f.getPath().toString()}:{f.getLen()}:{f.getModificationTime()}")
        h.update("\n".join([name, *sorted(listed), ""]).encode())
    return h.hexdigest()[:24]


def raw_tables(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The raw version of the tables: listings before clean-up, all others as they are."""
    return {**t, "listings": dirty_listings(t["listings"])}


def dirty_listings(listings: DataFrame) -> DataFrame:
    """The deterministic raw twin of listings used by Q19/Q20 (fixed values of the test binding)."""
    wl = F.col("week_listed")
    dirty = {
        "size_sqm": F.when(wl % 50 == 0, F.col("size_sqm") * 10).otherwise(F.col("size_sqm")),
        "room_type": F.when(F.col("floor") == 3, F.concat(F.lit(" "), F.col("room_type"))).otherwise(F.col("room_type")),
        "view": F.when(F.col("floor") == 5, F.upper("view")).otherwise(F.col("view")),
        "furnished": F.when(wl % 6 == 0, F.lit(None).cast("boolean")).otherwise(F.col("furnished")),
        "date_listed": F.when(F.col("floor") == 7, F.date_format("date_listed", "dd/MM/yyyy")).otherwise(F.col("date_listed").cast("string")),
        "asking_rent": F.when(wl % 40 == 0, F.col("asking_rent") * 100).otherwise(F.col("asking_rent")),
    }
    return listings.select(*[dirty[c].alias(c) if c in dirty else F.col(c) for c in listings.columns])


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five rental tables for ``sf_dir``, written once for each version of its files.

    They lie in the shared checkpoint folder under the version's name, so every query scans columnar files
    with pushdown and pruning, and changed files give new tables. A version is complete when its marker
    is there; a version that this session has replaced is removed."""
    found = version(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    with _lock:
        held = _cache.get(key)
        if held is not None and held[0] == found:
            return held[1]
        base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/dwell-binding/v5-{found}"
        if not path_exists(spark, f"{base}/_COMPLETE"):
            def stored(name: str, rows: DataFrame) -> DataFrame:
                rows.write.mode("overwrite").parquet(f"{base}/{name}")
                return spark.read.parquet(f"{base}/{name}")

            with spread(spark, read_base(spark, sf_dir, "lineitem").count()):
                derive(spark, sf_dir, stored)
            fs, marker = _file_system(spark, f"{base}/_COMPLETE")
            fs.create(marker, True).close()
        out = {name: spark.read.parquet(f"{base}/{name}") for name in TABLES}
        _cache[key] = (found, out, base)
        if held is not None and all(base_ != held[2] for _, _, base_ in _cache.values()):
            fs, old = _file_system(spark, held[2])
            fs.delete(old, True)
        return out
