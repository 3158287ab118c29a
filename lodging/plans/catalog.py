"""Registry of every query, by name: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lodging.plans import questions, roundtrips, statements
from lodging.plans.inputs import Inputs, from_testdata

# The original's yearly tables.
YEARS = (2018, 2019, 2020)
# One output row per booking: reports write these on request only.
ROW_LEVEL = frozenset(
    {
        "union_bookings",
        "baseline_join",
        "revenue_inputs",
        "revenue_inputs_as_written",
        "booking_revenue",
        "guest_type",
        "region",
        "season",
        "arrival_day_of_week",
        "revenue_columns",
        "bookings_enriched",
        "bookings_enriched_as_written",
    }
)

Query = Callable[[SparkSession, str], DataFrame]


def _on_testdata(fn: Callable[[Inputs], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(from_testdata(spark, sf_dir))

    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def analyses(years: Iterable[int] = YEARS) -> dict[str, Callable[[Inputs], DataFrame]]:
    """Every analysis as a function of ``Inputs`` (any source), with a scan for each of ``years``."""
    out: dict[str, Callable[[Inputs], DataFrame]] = {}
    for year in years:
        out[f"scan_bookings_{year}"] = partial(statements.scan_bookings, year=year)
    out.update(
        {
            "union_bookings": statements.union_bookings,
            "baseline_join": statements.baseline_join,
            "revenue_inputs": statements.revenue_inputs,
            "revenue_inputs_as_written": partial(statements.revenue_inputs, as_written=True),
            "adr_anomalies": statements.adr_anomalies,
            "adr_anomalies_as_written": partial(statements.adr_anomalies, as_written=True),
            "booking_revenue": statements.booking_revenue,
            "revenue_by_year": statements.revenue_by_year,
            "revenue_by_year_window": statements.revenue_by_year_window,
            "total_revenue": statements.total_revenue,
            "guest_type": statements.guest_type,
            "region": statements.region,
            "season": statements.season,
            "arrival_day_of_week": statements.arrival_day_of_week,
            "revenue_columns": statements.revenue_columns,
            "bookings_enriched": statements.bookings_enriched,
            "bookings_enriched_as_written": statements.bookings_enriched_as_written,
            "reservation_count": statements.reservation_count,
            "busiest_months": questions.busiest_months,
            "average_stay": questions.average_stay,
            "weekday_by_guest_type": questions.weekday_by_guest_type,
            "revenue_by_hotel_guest_type": questions.revenue_by_hotel_guest_type,
            "revenue_by_region": questions.revenue_by_region,
            "top5_countries": questions.top5_countries,
            "revenue_yoy": questions.revenue_yoy,
            "revenue_by_year_hotel": questions.revenue_by_year_hotel,
            "revenue_by_season_hotel": questions.revenue_by_season_hotel,
            "revenue_by_month": questions.revenue_by_month,
            "parking_percentage": questions.parking_percentage,
        }
    )
    return out


#: Ways in and out, over what Spark wrote from ``orders``.
ROUND_TRIPS: dict[str, Query] = {
    "csv_sheets_ingested": roundtrips.csv_sheets_ingested,
    "lookup_sheets_joined": roundtrips.lookup_sheets_joined,
    "named_tables_joined": roundtrips.named_tables_joined,
    "export_written": roundtrips.export_written,
    "export_streamed": roundtrips.export_streamed,
}


def queries() -> dict[str, Query]:
    """Every analysis bound to the booking tables derived under ``sf_dir``, and the round trips."""
    return {name: _on_testdata(fn) for name, fn in analyses().items()} | ROUND_TRIPS
