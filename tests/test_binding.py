"""The binding reads each base table as often as it must, and its shuffles grow in number, not in size."""

import contextlib
import io
import tempfile

from pyspark.sql import functions as F

from dwell.sources import binding

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_tables_are_derived_once_and_not_moved_again_for_their_order(spark):
    folder, plans = tempfile.mkdtemp(prefix="dwell-derive-"), {}

    def stored(name, rows):
        plans[name] = plan(rows)
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    tables = binding.derive(spark, SF, stored)
    assert [n for n, text in plans.items() if "lineitem.parquet" in text] == ["listings", "leases"]
    assert all(plans[n].count("lineitem.parquet") == 1 for n in ("listings", "leases"))
    assert not any("rangepartitioning" in plans[n].lower() for n in ("listings", "leases"))
    for name, date in (("listings", "date_listed"), ("leases", "date_start")):
        files = tables[name].select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), date).toPandas()
        assert all(part.sort_values("at")[date].is_monotonic_increasing for _, part in files.groupby("file"))


def test_shuffles_follow_the_rows(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    with binding.spread(spark, 100 * binding.ROWS_A_PARTITION + 1):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "101"
    assert spark.conf.get("spark.sql.shuffle.partitions") == held
    with binding.spread(spark, 1):
        assert spark.conf.get("spark.sql.shuffle.partitions") == held


def test_an_order_without_a_key_is_one_listing_of_its_week(spark):
    orders = spark.sql("SELECT cast(null AS bigint) o_orderkey, 20L o_custkey, timestamp'1996-03-05' o_orderdate, 100.0D o_totalprice")
    lineitem = spark.createDataFrame([], "l_orderkey bigint, l_shipdate timestamp")
    units = binding.units_of(spark.createDataFrame([(20, 3, 5000.0)], "c_custkey bigint, c_nationkey int, c_acctbal double"))
    projects = spark.sql("SELECT 3 project_id, 'n' project_name, 'r' university, 60 distance_to_campus_m, 1 total_units, 1993 year_completed, 41 facility_count")
    listings = binding.listings_of(orders, lineitem, units, projects)
    assert listings.count() == 2                                   # its primary and its alternative advert
    assert [r["n_listings_open"] for r in binding.market_of(listings, projects).collect()] == [1]
