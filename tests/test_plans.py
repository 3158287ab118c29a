"""Physical plan checks: the shapes the scale argument depends on."""

from __future__ import annotations

import contextlib
import io

import pytest
from conftest import SF_CHECK

from lodging.operators.enrich import own_method
from lodging.plans import catalog
from lodging.plans.inputs import from_parquet, from_table, from_testdata
from lodging.plans.statements import revenue_by_year
from lodging.sources import testdata
from lodging.sources.files import write_bookings

Q = catalog.queries()


def formatted(df) -> str:
    """The text ``df.explain("formatted")`` prints."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """The booking table as a deployment has it: written, partitioned by year."""
    path = str(tmp_path_factory.mktemp("plans") / "bookings")
    write_bookings(testdata.bookings(spark, SF_CHECK), path)
    return from_table(spark, path, testdata.market_segments(spark), testdata.meal_costs(spark))


A = catalog.analyses()


def test_lookups_are_broadcast(table):
    text = formatted(A["booking_revenue"](table))
    assert text.count("Join type:") == 2
    assert text.count("BroadcastExchange") >= 2 * 2
    assert "SortMergeJoin" not in text
    assert "Exchange hashpartitioning" not in text


def test_revenue_by_year_has_no_window_and_partial_aggregate(spark):
    text = formatted(Q["revenue_by_year"](spark, SF_CHECK))
    assert "Window" not in text
    assert "partial_sum" in text


def test_window_runs_on_monthly_sums(table):
    """One fact scan, one pass of lookups, a real window over the aggregate, nothing joined back."""
    text = formatted(A["revenue_by_year_window"](table))
    assert text.count("Scan parquet") == 2  # the node and its details
    assert text.count("Join type:") == 2
    tree = text.split("(1)")[0]
    assert tree.index("Window") < tree.index("HashAggregate") or "partial_sum" in text
    assert "Window" in text and "partial_sum" in text


def test_yearly_table_pushes_its_range_into_the_orders_scan(spark):
    text = formatted(Q["scan_bookings_2019"](spark, SF_CHECK))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text


def test_customer_is_read_only_for_the_market_segment(spark):
    for name in ("region", "season", "guest_type", "arrival_day_of_week", "reservation_count", "parking_percentage"):
        text = formatted(Q[name](spark, SF_CHECK))
        assert "customer.parquet" not in text and "Join type:" not in text, name


def test_questions_without_lookup_columns_join_nothing(spark, table):
    for name in ("busiest_months", "average_stay", "weekday_by_guest_type"):
        for text in (formatted(A[name](table)), formatted(Q[name](spark, SF_CHECK))):
            assert "Join type:" not in text, name
            assert "market_segment" not in text and "meal" not in text, name


def test_audit_sort_splits_one_hot_rate(spark, table):
    """Most bookings share one rate, nights, status, segment and meal: the sort still has many parts."""
    from pyspark.sql import functions as F

    from lodging.plans.inputs import Inputs

    hot = table.bookings.where("arrival_date_year IN (2018, 2019)").withColumns(
        {
            "adr": F.lit(0).cast("decimal(10,2)"), "stays_in_week_nights": F.lit(1), "stays_in_weekend_nights": F.lit(1),
            "reservation_status": F.lit("Check-Out"), "market_segment": F.lit("Direct"), "meal": F.lit("BB"),
        }
    )
    inp = Inputs(lambda: hot, lambda: table.segments, lambda: table.meals, lambda: [], lambda y: hot)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for name in ("adr_anomalies", "adr_anomalies_as_written"):
            parts = A[name](inp).withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
            assert len(parts) > 3 and max(r["count"] for r in parts) < 0.6 * hot.count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_audit_filter_reaches_booking_scan(table):
    text = formatted(A["adr_anomalies"](table))
    assert "Or(EqualTo(adr,0.00),LessThan(adr,0.00))" in text
    assert "Not(EqualTo(market_segment,Complementary))" in text
    assert "Join type: Inner" in text  # NOT IN on the lookup side rejects NULL: left join becomes inner


def test_count_reads_no_columns_and_skips_lookup_joins(table):
    text = formatted(A["reservation_count"](table))
    assert "Join type:" not in text
    assert "ReadSchema: struct<>" in text


def test_category_queries_read_only_their_columns(table):
    text = formatted(A["region"](table))
    assert "ReadSchema: struct<country:string>" in text


def test_year_scan_prunes_partitions(table):
    text = formatted(A["scan_bookings_2019"](table))
    assert "PartitionFilters: [isnotnull(arrival_date_year" in text and "= 2019)" in text


def test_top5_is_take_ordered(spark):
    text = formatted(Q["top5_countries"](spark, SF_CHECK))
    assert "TakeOrderedAndProject" in text


def test_partitioned_table_prunes_years_and_pushes_filters(spark, scratch):
    path = f"{scratch}/bookings"
    write_bookings(testdata.bookings(spark, "/root/testdata/sf0.001"), path)
    seg = f"{scratch}/seg"
    meal = f"{scratch}/meal"
    testdata.market_segments(spark).write.parquet(seg)
    testdata.meal_costs(spark).write.parquet(meal)
    inp = from_parquet(spark, path, seg, meal)
    assert inp.bookings.count() == from_testdata(spark, "/root/testdata/sf0.001").bookings.count()
    one_year = inp.bookings.where("arrival_date_year = 2019 AND adr <= 0")
    text = formatted(one_year)
    assert "PartitionFilters: [isnotnull(arrival_date_year" in text and "= 2019)" in text
    assert "LessThanOrEqual(adr" in text
    assert inp.years == list(range(2015, 2022))
    # the same analysis code runs unchanged on the written table
    rows = revenue_by_year(inp).collect()
    assert [r[0] for r in rows] == list(range(2015, 2022))


def test_hot_year_is_split_across_write_tasks(spark, scratch):
    """One year holding most rows is written by several tasks, with or without rebalance."""
    import glob

    from pyspark.sql import functions as F

    bookings = from_testdata(spark, SF_CHECK).bookings.repartition(4, "arrival_date_month")
    hot = bookings.withColumn("arrival_date_year", F.lit(2019)).unionByName(bookings.where("arrival_date_year = 2018"))
    write_bookings(hot, f"{scratch}/narrow")
    assert len(glob.glob(f"{scratch}/narrow/arrival_date_year=2019/*.parquet")) > 1

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        write_bookings(hot, f"{scratch}/rebalanced", rebalance=True)
    finally:
        spark.conf.set(key, before)
    assert len(glob.glob(f"{scratch}/rebalanced/arrival_date_year=2019/*.parquet")) > 1
    assert spark.read.parquet(f"{scratch}/rebalanced").count() == hot.count()


def test_hot_customer_key_is_split_by_skew_join(spark):
    """The ingest join at scale (no broadcast): a key with 2/3 of all orders is split."""
    from pyspark.sql import functions as F

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        orders = testdata._orders(spark, SF_CHECK)
        hot = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.lit(1)).otherwise(F.col("o_custkey")))
        df = testdata.bookings_from(hot.repartition(8, "o_orderkey"), testdata._customers(spark, SF_CHECK))
        assert len(df.collect()) == hot.count()
        text = formatted(df)
        assert "SortMergeJoin(skew=true)" in text
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def method_sizes(spark, df) -> list[int]:
    """Bytes of bytecode of the largest method of each code-generation stage of a plan."""
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]


@pytest.fixture
def static_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_every_generated_method_is_small_enough_to_be_compiled(spark, table, static_plans):
    """HotSpot compiles no method over 8000 bytes (without a flag that clusters may not have)."""
    for name, fn in A.items():
        for inputs in (from_testdata(spark, SF_CHECK), table):
            sizes = method_sizes(spark, fn(inputs))
            assert sizes and max(sizes) < 8000, (name, sizes)


def test_the_export_stage_moves_no_row_and_reads_only_what_is_used(spark):
    enriched = from_testdata(spark, SF_CHECK).enriched
    assert "Exchange hashpartitioning" not in formatted(enriched) and "RoundRobin" not in formatted(enriched)
    assert "ReadSchema: struct<o_custkey:bigint" in formatted(enriched.select("country", "region"))
    assert "o_totalprice" not in formatted(enriched.select("country", "region")).split("ReadSchema")[1].split("\n")[0]
    spread = testdata.bookings(spark, SF_CHECK).repartition(7)
    assert own_method(spread).rdd.getNumPartitions() == 7


def test_filters_pass_the_export_stage(table):
    text = formatted(table.enriched.where("arrival_date_year = 2018 AND is_canceled = 1"))
    assert "PartitionFilters: [isnotnull(arrival_date_year" in text
    assert "PushedFilters: [IsNotNull(is_canceled), EqualTo(is_canceled,1)" in text


def test_the_union_of_the_years_reads_customer_once(spark):
    text = formatted(Q["union_bookings"](spark, SF_CHECK)).split("(1) Scan")[1]
    assert text.count("customer.parquet") == 1
    assert text.count("orders.parquet") == len(from_testdata(spark, SF_CHECK).years)
