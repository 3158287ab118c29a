"""Explicit schemas for the booking fact table and its two lookup dimensions.

Production reads never infer types: CSV and Parquet inputs are read with
these StructTypes so a stray value cannot silently widen a column.
Money is exact decimal end to end; it becomes double only in the final
projection of a report.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
RATE = T.DecimalType(4, 2)

# The 32 booking columns, in the order the yearly sheets carry them.
BOOKINGS = T.StructType(
    [
        T.StructField("hotel", T.StringType()),
        T.StructField("is_canceled", T.IntegerType()),
        T.StructField("lead_time", T.IntegerType()),
        T.StructField("arrival_date_year", T.IntegerType()),
        T.StructField("arrival_date_month", T.StringType()),
        T.StructField("arrival_date_week_number", T.IntegerType()),
        T.StructField("arrival_date_day_of_month", T.IntegerType()),
        T.StructField("stays_in_weekend_nights", T.IntegerType()),
        T.StructField("stays_in_week_nights", T.IntegerType()),
        T.StructField("adults", T.IntegerType()),
        T.StructField("children", T.IntegerType()),
        T.StructField("babies", T.IntegerType()),
        T.StructField("meal", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("market_segment", T.StringType()),
        T.StructField("distribution_channel", T.StringType()),
        T.StructField("is_repeated_guest", T.IntegerType()),
        T.StructField("previous_cancellations", T.IntegerType()),
        T.StructField("previous_bookings_not_canceled", T.IntegerType()),
        T.StructField("reserved_room_type", T.StringType()),
        T.StructField("assigned_room_type", T.StringType()),
        T.StructField("booking_changes", T.IntegerType()),
        T.StructField("deposit_type", T.StringType()),
        T.StructField("agent", T.IntegerType()),
        T.StructField("company", T.IntegerType()),
        T.StructField("days_in_waiting_list", T.IntegerType()),
        T.StructField("customer_type", T.StringType()),
        T.StructField("adr", MONEY),
        T.StructField("required_car_parking_spaces", T.IntegerType()),
        T.StructField("total_of_special_requests", T.IntegerType()),
        T.StructField("reservation_status", T.StringType()),
        T.StructField("reservation_status_date", T.DateType()),
    ]
)

BOOKING_COLUMNS: list[str] = BOOKINGS.fieldNames()

MARKET_SEGMENT = T.StructType(
    [
        T.StructField("market_segment", T.StringType(), nullable=False),
        T.StructField("Discount", RATE),
    ]
)

MEAL_COST = T.StructType(
    [
        T.StructField("meal", T.StringType(), nullable=False),
        T.StructField("Cost", MONEY),
    ]
)

# Columns added by the enrichment, in export order after the 32 base columns.
DERIVED_COLUMNS = [
    "Cost",
    "Discount",
    "guest_type",
    "region",
    "seasons",
    "arrival_date",
    "day_of_week",
    "Number_of_Rooms_Sold",
    "revenue",
]
