"""Cross-query invariants and the values FIXTURES.md records for sf0.01."""

from __future__ import annotations

from decimal import Decimal

import pytest
from conftest import SF_CHECK
from pyspark.sql import functions as F

from lodging.functions import rules
from lodging.operators.aggregates import window_total
from lodging.plans import catalog
from lodging.plans.inputs import from_testdata

Q = catalog.queries()


@pytest.fixture(scope="module")
def inp(spark):
    return from_testdata(spark, SF_CHECK)


def _count(df):
    return df.count()


def test_booking_count(inp):
    assert _count(inp.bookings) == 15000


def test_union_count_is_sum_of_years(spark, inp):
    yearly = inp.yearly()
    assert sum(_count(df) for df in yearly.values()) == _count(Q["union_bookings"](spark, SF_CHECK)) == 15000


def test_left_joins_keep_every_booking(inp):
    assert _count(inp.joined) == _count(inp.bookings)


def test_enriched_count_equals_reservation_count(spark):
    n = Q["reservation_count"](spark, SF_CHECK).first()[0]
    assert _count(Q["bookings_enriched"](spark, SF_CHECK)) == n == 15000


def test_revenue_arm_counts(inp):
    """Canceled / adr<0 / non-positive check-out / formula: 4979 / 192 / 577 / 9252."""
    status, adr = F.col("reservation_status"), F.col("adr")
    arm = (
        F.when(status == "Canceled", 1)
        .when(adr < 0, 2)
        .when(status.isin("Check-Out", "No-Show") & (adr <= 0), 3)
        .otherwise(4)
    )
    counts = {r[0]: r[1] for r in inp.revenue_rows.groupBy(arm).count().collect()}
    assert counts == {1: 4979, 2: 192, 3: 577, 4: 9252}
    arm4 = inp.revenue_rows.where(arm == 4)
    assert arm4.where(F.col("revenue").isNull()).count() == 3375
    assert arm4.where(F.col("revenue") < 0).count() == 1361


def test_revenue_per_year_values(spark):
    rows = {r[0]: (r[1], r[2]) for r in Q["revenue_by_year"](spark, SF_CHECK).collect()}
    assert sorted(rows) == list(range(2015, 2022))
    assert rows[2015] == (317145.626, "$0.32M")
    assert rows[2018] == (311937.566, "$0.31M")
    assert rows[2019] == (337164.7305, "$0.34M")
    assert rows[2020] == (328571.1785, "$0.33M")


def test_window_form_equals_group_by(spark):
    a = sorted(Q["revenue_by_year"](spark, SF_CHECK).collect())
    b = sorted(Q["revenue_by_year_window"](spark, SF_CHECK).collect())
    assert a == b


def test_years_sum_to_total(inp):
    per_year = inp.revenue_rows.groupBy("arrival_date_year").agg(F.sum("revenue").alias("t"))
    total = inp.revenue_rows.agg(F.sum("revenue")).first()[0]
    assert sum(r.t for r in per_year.collect()) == total


def test_all_region_labels_reached(spark):
    labels = {r[0] for r in Q["revenue_by_region"](spark, SF_CHECK).select("region").collect()}
    assert len(labels) == 23


def test_leap_day_rows(inp):
    feb29 = inp.bookings.where(
        (F.col("arrival_date_month") == "February") & (F.col("arrival_date_day_of_month") == 29)
    )
    assert feb29.count() == 11


def test_window_total_null_keys_and_skew(spark):
    """NULL keys form their own partition; a dominant key still gets its sum."""
    rows = [(None, 1, Decimal("1.00"))] * 3 + [(1, i % 7, Decimal("2.00")) for i in range(50)] + [(2, None, Decimal("5.00"))]
    df = spark.createDataFrame(rows, "k int, d int, v decimal(10,2)")
    totals = window_total(df, ["k"], ["d"], "v", "total")
    assert totals.count() == 9  # a row per key and detail
    got = sorted((r.k if r.k is not None else -1, r.total) for r in totals.select("k", "total").distinct().collect())
    assert got == [(-1, Decimal("3.00")), (1, Decimal("100.00")), (2, Decimal("5.00"))]


def test_mutation_coalesced_discount_changes_results(inp):
    """Treating a missing discount as 0 must change revenue (the NULL is meaningful)."""
    mutated = inp.joined.transform(lambda d: d.withColumn("Discount", F.coalesce("Discount", F.lit(Decimal("0")))))
    mutated = mutated.withColumn("Number_of_Rooms_Sold", rules.rooms_sold()).withColumn("revenue", rules.revenue())
    a = inp.revenue_rows.agg(F.count("revenue")).first()[0]
    b = mutated.agg(F.count("revenue")).first()[0]
    assert a != b


def test_every_order_becomes_a_booking(spark, inp):
    orders = spark.read.parquet(f"{SF_CHECK}/orders.parquet")
    assert _count(inp.bookings) == _count(inp.without_segment) == orders.count()
    assert "market_segment" not in inp.without_segment.columns


def test_building_a_query_writes_nothing(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    def refuse(*args, **kwargs):
        raise AssertionError("a query wrote while it was built")

    for method in ("save", "parquet", "saveAsTable", "csv"):
        monkeypatch.setattr(DataFrameWriter, method, refuse)
    # These write files to read them back; that is what they are for.
    through_files = {"csv_sheets_ingested", "lookup_sheets_joined", "export_written", "export_streamed"}
    for name, fn in Q.items():
        if name in through_files:
            with pytest.raises(AssertionError, match="a query wrote"):
                fn(spark, SF_CHECK)
        else:
            fn(spark, SF_CHECK)
