"""Sources and sinks as queries: what Spark wrote from ``orders``, read back.

Each writes to a fresh folder under ``spark.checkpoint.dir`` and returns the
rows that come back, so its result says whether the path in and out keeps
every value: CSV sheets through the ingest, the partitioned table, tables by
name in Spark SQL, and the enriched export in one batch and as a stream.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodging.operators.consolidate import consolidate, with_lookups
from lodging.operators.enrich import money_as_double
from lodging.plans.inputs import from_testdata
from lodging.plans.views import register_views
from lodging.schema import BOOKING_COLUMNS, MARKET_SEGMENT, MEAL_COST
from lodging.session import shared_dir
from lodging.sources import files, testdata
from lodging.streaming.export import booking_stream, start_enriched_export


def _folder(spark: SparkSession, name: str) -> str:
    return shared_dir(spark, f"lodging-{name}-{uuid.uuid4().hex[:12]}")


def csv_sheets_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly CSV sheets -> checked, typed bookings -> the partitioned table -> all its rows.

    Bookings without a year are on no sheet: a sheet is of one year.
    """
    folder = _folder(spark, "sheets")
    inp = from_testdata(spark, sf_dir)
    years = [y for y in inp.years if y is not None]
    paths = {y: f"{folder}/{y}" for y in years}
    for year, path in paths.items():
        inp.year_table(year).write.option("header", True).csv(path)
    sheets = files.read_yearly_csv(spark, paths, same_header=True)
    if not sheets:
        return money_as_double(inp.consolidated)
    files.check_years(sheets)
    table = _folder(spark, "table")
    files.write_bookings(consolidate(sheets.values()), table, rebalance=True)
    return money_as_double(files.read_bookings(spark, table))


def lookup_sheets_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookups written as CSV sheets, read back with checked keys, joined to all bookings."""
    folder = _folder(spark, "lookups")
    inp = from_testdata(spark, sf_dir)
    inp.segments.write.option("header", True).csv(f"{folder}/segments")
    inp.meals.write.option("header", True).csv(f"{folder}/meals")
    segments = files.read_lookup_csv(spark, f"{folder}/segments", MARKET_SEGMENT, "market_segment")
    meals = files.read_lookup_csv(spark, f"{folder}/meals", MEAL_COST, "meal")
    joined = with_lookups(inp.bookings, segments, meals)
    return money_as_double(joined.select(*BOOKING_COLUMNS, "Discount", "Cost"))


def named_tables_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star join as Spark SQL over the tables' names."""
    prefix = f"v{uuid.uuid4().hex[:12]}_"
    register_views(from_testdata(spark, sf_dir), prefix)
    columns = ", ".join(f"b.{c}" for c in BOOKING_COLUMNS)
    return money_as_double(
        spark.sql(
            f"SELECT {columns}, m.Discount, c.Cost FROM {prefix}bookings b "
            f"LEFT JOIN {prefix}market_segment m ON b.market_segment = m.market_segment "
            f"LEFT JOIN {prefix}meal_cost c ON b.meal = c.meal"
        )
    )


def export_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched export written by year in one batch, read back."""
    folder = _folder(spark, "export")
    enriched = from_testdata(spark, sf_dir).enriched
    files.write_bookings(enriched, folder)
    return money_as_double(spark.read.schema(enriched.schema).parquet(folder).select(*enriched.columns))


def export_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched export of booking files that arrive as a stream, read back."""
    incoming, sink, progress = (_folder(spark, n) for n in ("incoming", "streamed", "progress"))
    inp = from_testdata(spark, sf_dir)
    inp.bookings.write.parquet(incoming)
    query = start_enriched_export(
        booking_stream(spark, incoming), testdata.market_segments(spark), testdata.meal_costs(spark), sink, progress
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    enriched = inp.enriched
    return money_as_double(spark.read.schema(enriched.schema).parquet(sink).select(*enriched.columns))
