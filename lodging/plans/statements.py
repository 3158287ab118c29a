"""The analysis statements: inspection, consolidation, audits, revenue, exports.

One function per statement of the original script.  Each takes ``Inputs``
and returns a lazy DataFrame; nothing here collects.  Money is exact decimal
until the last projection, where it becomes double.

Where a statement LEFT JOINs the lookups but reads no lookup column
(categories, the reservation count), the joins are left out: lookup keys
are unique (checked when the lookups are built), so such a join can neither
add nor drop a booking, and leaving it out saves the probe per row.
Catalyst cannot do this itself because it has no uniqueness metadata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodging.functions import rules
from lodging.operators.aggregates import sum_by, window_total
from lodging.operators.consolidate import MEAL_KEY, SEGMENT_KEY
from lodging.operators.enrich import money_as_double, with_rooms
from lodging.plans.inputs import Inputs
from lodging.schema import BOOKING_COLUMNS

YEAR = "arrival_date_year"
ROOMS = "Number_of_Rooms_Sold"
# Booking columns that together differ between most bookings.
VARYING = ("lead_time", YEAR, "arrival_date_week_number", "arrival_date_day_of_month", "country", "agent", "company")


def _lookup_side() -> list[Column]:
    """meal / Cost / market_segment / Discount as the lookup side reports them."""
    return [
        F.col(MEAL_KEY).alias("meal"),
        F.col("Cost"),
        F.col(SEGMENT_KEY).alias("market_segment"),
        F.col("Discount"),
    ]


def _with_rooms(inp: Inputs, as_written: bool) -> DataFrame:
    """Lookups joined plus Number_of_Rooms_Sold.  The default form reuses the
    session's revenue frame (its unused revenue column is pruned)."""
    return with_rooms(inp.joined, as_written=True) if as_written else inp.revenue_rows


def _millions(total: DataFrame, total_col: str, value_name: str, text_name: str, *keys: str) -> DataFrame:
    return total.select(
        *keys,
        F.col(total_col).cast("double").alias(value_name),
        rules.millions_text(total_col).alias(text_name),
    )


# --- inspection and consolidation -------------------------------------------------


def scan_bookings(inp: Inputs, year: int) -> DataFrame:
    """SELECT * from one yearly table."""
    return money_as_double(inp.year_table(year))


def union_bookings(inp: Inputs) -> DataFrame:
    """UNION ALL of the yearly tables."""
    return money_as_double(inp.consolidated)


def baseline_join(inp: Inputs) -> DataFrame:
    """Consolidated bookings with both lookups: 32 columns + Discount, Cost."""
    return money_as_double(inp.joined.select(*BOOKING_COLUMNS, "Discount", "Cost"))


# --- revenue inputs and the ADR audit -------------------------------------------


def revenue_inputs(inp: Inputs, as_written: bool = False) -> DataFrame:
    """Columns that feed revenue; ``as_written`` keeps week nights counted twice."""
    joined = _with_rooms(inp, as_written)
    if as_written:
        nights = [F.col("stays_in_week_nights"), F.col("stays_in_week_nights").alias("stays_in_week_nights_2")]
    else:
        nights = [F.col("stays_in_weekend_nights"), F.col("stays_in_week_nights")]
    return money_as_double(joined.select("reservation_status", *nights, ROOMS, "adr", *_lookup_side()))


def adr_anomalies(inp: Inputs, as_written: bool = False) -> DataFrame:
    """Bookings with a zero or negative rate although nights were sold.

    ``NOT IN`` is on the lookup side, so a booking whose segment misses the
    lookup (NULL) is dropped too: Catalyst turns the segment LEFT JOIN into
    an inner join and pushes ``adr <= 0`` into every Parquet scan.
    The trailing sort keys only refine ties of (adr, rooms).  The last one is
    a hash of columns that vary from booking to booking and is dropped after
    the sort: however many bookings share one rate, status, segment and meal,
    the range partitioner can split them.
    """
    joined = _with_rooms(inp, as_written)
    adr = F.col("adr")
    anomalies = joined.where(
        ((adr == 0) | (adr < 0)) & ~F.col(SEGMENT_KEY).isin("Complementary") & (F.col(ROOMS) > 0)
    ).select("reservation_status", ROOMS, "adr", *_lookup_side(), F.xxhash64(*VARYING).alias("__tie"))
    ordered = money_as_double(anomalies).orderBy(
        F.asc("adr"), F.desc(ROOMS), "reservation_status", "market_segment", "meal", "__tie"
    )
    return ordered.drop("__tie")


# --- revenue ----------------------------------------------------------------------


def booking_revenue(inp: Inputs) -> DataFrame:
    """Revenue per booking next to its inputs."""
    rows = inp.revenue_rows.select(
        "hotel",
        YEAR,
        "reservation_status",
        "stays_in_weekend_nights",
        "stays_in_week_nights",
        ROOMS,
        "adr",
        *_lookup_side(),
        "revenue",
    )
    return money_as_double(rows)


def revenue_by_year(inp: Inputs) -> DataFrame:
    """Revenue per arrival year, value and '$x.xxM' text, in year order.

    Partial sums per task, one shuffle of at most (tasks x years) rows.
    """
    totals = sum_by(inp.revenue_rows, [YEAR], "revenue", "total")
    return _millions(totals, "total", "Revenue_by_Year", "Revenue_by_Year_FormattedInMillions", YEAR).orderBy(YEAR)


def revenue_by_year_window(inp: Inputs) -> DataFrame:
    """The same answer in the original's shape: a per-year window sum, then
    DISTINCT.  The window runs on monthly sums, see ``window_total``."""
    totals = window_total(inp.revenue_rows, [YEAR], ["arrival_date_month"], "revenue", "total")
    totals = totals.select(YEAR, "total").distinct()
    return _millions(totals, "total", "Revenue_by_Year", "Revenue_by_Year_FormattedInMillions", YEAR).orderBy(YEAR)


def total_revenue(inp: Inputs) -> DataFrame:
    """Revenue over all years, value and '$x.xxM' text."""
    total = inp.revenue_rows.agg(F.sum("revenue").alias("total"))
    return _millions(total, "total", "Total_Revenue", "Total_Revenue_FormattedInMillions")


def revenue_columns(inp: Inputs) -> DataFrame:
    """Revenue with the status, rate, discount, cost and rooms behind it."""
    rows = inp.revenue_rows.select("reservation_status", "adr", "Discount", "Cost", ROOMS, "revenue")
    return money_as_double(rows)


# --- categories -------------------------------------------------------------------


def guest_type(inp: Inputs) -> DataFrame:
    return inp.without_segment.select("adults", "children", "babies", rules.guest_type().alias("guest_type"))


def region(inp: Inputs) -> DataFrame:
    return inp.without_segment.select("country", rules.region().alias("region"))


def season(inp: Inputs) -> DataFrame:
    return inp.without_segment.select("arrival_date_month", rules.season().alias("seasons"))


def arrival_day_of_week(inp: Inputs) -> DataFrame:
    dated = inp.without_segment.select(
        "arrival_date_day_of_month", "arrival_date_month", YEAR, rules.arrival_date().alias("arrival_date")
    )
    return dated.withColumn("day_of_week", rules.day_of_week())


# --- the two exports ----------------------------------------------------------------


def bookings_enriched(inp: Inputs) -> DataFrame:
    """Final export #1: 41 columns, one narrow stage (money as double)."""
    return money_as_double(inp.enriched)


def bookings_enriched_as_written(inp: Inputs) -> DataFrame:
    """Final export #1 exactly as written: 40 columns, ``company`` under the
    name ``days_in_waiting_list`` (the missing comma)."""
    return money_as_double(inp.enriched_as_written)


def reservation_count(inp: Inputs) -> DataFrame:
    """Final export #2: number of bookings (the parking percentage denominator)."""
    return inp.without_segment.agg(F.count(F.lit(1)).alias("count_of_reservations_made"))
