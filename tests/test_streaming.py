"""The streaming export equals the batch export on the same booking files."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from lodging.operators.enrich import enrich
from lodging.plans.inputs import from_testdata
from lodging.schema import BOOKING_COLUMNS
from lodging.sources import testdata
from lodging.streaming.export import booking_stream, start_enriched_export


def test_stream_export_matches_batch(spark, scratch):
    inp = from_testdata(spark, SF_SMALL)
    source = f"{scratch}/incoming"
    # three "arrivals" of booking files, one per year
    for year, table in inp.yearly().items():
        table.select(*BOOKING_COLUMNS).write.mode("append").parquet(source)

    stream = booking_stream(spark, source, max_files_per_trigger=1)
    assert stream.isStreaming
    query = start_enriched_export(
        stream, testdata.market_segments(spark), testdata.meal_costs(spark), f"{scratch}/sink", f"{scratch}/ckpt"
    )
    query.awaitTermination(300)
    assert query.exception() is None

    streamed = spark.read.parquet(f"{scratch}/sink")
    batch = enrich(inp.bookings, inp.segments, inp.meals)
    assert streamed.count() == batch.count()

    def totals(df):
        return sorted(
            tuple(r) for r in df.groupBy("arrival_date_year", "region").agg(F.sum("revenue"), F.count("*")).collect()
        )

    assert totals(streamed) == totals(batch)

    # a restart with nothing new writes nothing twice
    again = start_enriched_export(
        booking_stream(spark, source),
        testdata.market_segments(spark),
        testdata.meal_costs(spark),
        f"{scratch}/sink",
        f"{scratch}/ckpt",
    )
    again.awaitTermination(300)
    assert spark.read.parquet(f"{scratch}/sink").count() == batch.count()


def test_stream_of_csv_sheets(spark, scratch):
    """CSV sheets arriving in a folder are typed like the batch reader and enriched."""
    inp = from_testdata(spark, SF_SMALL)
    source = f"{scratch}/sheets"
    for year, table in inp.yearly().items():
        table.write.mode("append").option("header", True).csv(source)
    query = start_enriched_export(
        booking_stream(spark, source, fmt="csv"),
        testdata.market_segments(spark),
        testdata.meal_costs(spark),
        f"{scratch}/sink",
        f"{scratch}/ckpt",
    )
    query.awaitTermination(300)
    assert query.exception() is None
    streamed = spark.read.parquet(f"{scratch}/sink")
    batch = enrich(inp.bookings, inp.segments, inp.meals)
    assert streamed.count() == batch.count()
    assert streamed.where(F.col("country") == "NULL").count() == batch.where(F.col("country") == "NULL").count()
    assert streamed.agg(F.sum("revenue")).first()[0] == batch.agg(F.sum("revenue")).first()[0]


def test_stream_refuses_a_sheet_in_another_column_order(spark, scratch):
    """Reading it by position would silently swap columns."""
    inp = from_testdata(spark, SF_SMALL)
    source = f"{scratch}/sheets"
    inp.bookings.limit(5).write.option("header", True).csv(source)
    swapped = list(BOOKING_COLUMNS)
    i, j = swapped.index("adults"), swapped.index("babies")
    swapped[i], swapped[j] = swapped[j], swapped[i]
    inp.bookings.limit(5).select(*swapped).write.mode("append").option("header", True).csv(source)
    query = start_enriched_export(
        booking_stream(spark, source, fmt="csv"),
        testdata.market_segments(spark),
        testdata.meal_costs(spark),
        f"{scratch}/sink",
        f"{scratch}/ckpt",
    )
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        query.awaitTermination(300)


def test_restart_processes_only_new_files(spark, scratch):
    inp = from_testdata(spark, SF_SMALL)
    source, sink, ckpt = f"{scratch}/in", f"{scratch}/out", f"{scratch}/ckpt"
    yearly = inp.yearly()
    yearly[2018].select(*BOOKING_COLUMNS).write.mode("append").parquet(source)

    def run_once():
        q = start_enriched_export(
            booking_stream(spark, source), testdata.market_segments(spark), testdata.meal_costs(spark), sink, ckpt
        )
        q.awaitTermination(300)
        assert q.exception() is None

    run_once()
    assert spark.read.parquet(sink).count() == yearly[2018].count()
    # new sheets arrive; the restarted query picks up only those files
    for year in sorted(set(yearly) - {2018}):
        yearly[year].select(*BOOKING_COLUMNS).write.mode("append").parquet(source)
    run_once()
    out = spark.read.parquet(sink)
    assert out.count() == inp.bookings.count()
    assert {r[0] for r in out.select("arrival_date_year").distinct().collect()} == set(yearly)
