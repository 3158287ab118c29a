"""Booking-shaped input derived from the provided TPC-H-style tables.

The original analysis ships no data, so bookings are derived,
deterministically, from ``orders`` LEFT JOIN ``customer``: every order becomes
a booking that arrives 20 years after its order date (FIXTURES.md section 3
gives the mapping).  The derivation is lazy: a query reads the columns of
``orders`` that it needs, and ``customer`` only if it uses the market segment.

Plan shape at scale: one scan of ``orders`` (a yearly table pushes its date
range into the Parquet reader), one equi-join with ``customer`` on the customer
key (Catalyst broadcasts ``customer`` when its estimated size is under
``spark.sql.autoBroadcastJoinThreshold``; above it the join shuffles both
sides and AQE may still switch strategy or split skewed keys at runtime),
then a single narrow projection.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodging.functions.rules import MONTH_NAMES, reused
from lodging.operators.consolidate import consolidate
from lodging.sources.fixture_values import (
    CHANNELS,
    COUNTRIES,
    DEPOSITS,
    MEAL_BY_PRIORITY,
    MEAL_COSTS,
    ROOM_LETTERS,
    SEGMENT_BY_MKTSEGMENT,
    SEGMENT_DISCOUNTS,
    STATUS_BY_ORDERSTATUS,
    UNLISTED_SEGMENT,
)
from lodging.schema import BOOKING_COLUMNS, BOOKINGS, MARKET_SEGMENT, MEAL_COST
from lodging.sources.files import bounded_lookup

YEAR_SHIFT = 20  # an order of 1998 is a booking that arrives in 2018


def _pick(index: Column, values) -> Column:
    """values[index] for a 0-based integer index, from a literal array (NULL for NULL)."""
    position = (index + 1).cast("int")
    return F.when(position.isNotNull(), F.element_at(F.array(*[F.lit(v) for v in values]), position))


def _mapped(column: Column, mapping: dict[str, str], default: str | None) -> Column:
    expr = None
    for key, value in mapping.items():
        expr = F.when(column == key, value) if expr is None else expr.when(column == key, value)
    return expr.otherwise(F.lit(default))


# Schemas of the provided tables (only the columns the derivation reads).
ORDERS = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampNTZType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]
)
CUSTOMER = T.StructType(
    [
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]
)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(ORDERS).parquet(f"{sf_dir}/orders.parquet")


def of_year(orders: DataFrame, year: int | None) -> DataFrame:
    """The orders that arrive in ``year`` (None: without a date), as a range the reader prunes by."""
    date = F.col("o_orderdate")
    if year is None:
        return orders.where(date.isNull())
    first, stop = (dt.date(y - YEAR_SHIFT, 1, 1) for y in (year, year + 1))
    return orders.where((date >= F.lit(first)) & (date < F.lit(stop)))


def years(spark: SparkSession, sf_dir: str) -> list[int | None]:
    """Arrival years from the first order's to the last one's, and None for orders without a date."""
    date = F.col("o_orderdate")
    row = _orders(spark, sf_dir).agg(F.year(F.min(date)), F.year(F.max(date)), F.count(F.when(date.isNull(), 1))).first()
    found = [] if row[0] is None else list(range(row[0] + YEAR_SHIFT, row[1] + YEAR_SHIFT + 1))
    return found + ([None] if row[2] else [])


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(CUSTOMER).parquet(f"{sf_dir}/customer.parquet")


@reused
def _booking_columns() -> list[Column]:
    """The 32 booking columns over joined order and customer columns."""
    k = F.col("o_orderkey")
    ck = F.col("o_custkey")
    d = F.add_months(F.to_date("o_orderdate"), 12 * YEAR_SHIFT)
    adr_from_price = (F.floor("o_totalprice").cast("bigint") % 40000).cast("decimal(8,0)") * F.lit(
        Decimal("0.01")
    )
    cols = {
        "hotel": F.when(k % 2 == 0, "City Hotel").otherwise("Resort Hotel"),
        "is_canceled": F.when(F.col("o_orderstatus") == "O", 1).otherwise(0),
        "lead_time": k % 365,
        "arrival_date_year": F.year(d),
        "arrival_date_month": _pick(F.month(d) - 1, MONTH_NAMES),
        "arrival_date_week_number": F.weekofyear(d),
        "arrival_date_day_of_month": F.dayofmonth(d),
        "stays_in_weekend_nights": k % 3,
        "stays_in_week_nights": F.expr("o_orderkey div 3") % 5,
        "adults": ck % 4,
        "children": F.when(k % 97 == 0, F.lit(None)).when(k % 10 == 0, 1).otherwise(0),
        "babies": F.when(k % 25 == 0, 1).otherwise(0),
        "meal": _mapped(F.col("o_orderpriority"), MEAL_BY_PRIORITY, None),
        "country": _pick(ck % len(COUNTRIES), COUNTRIES),
        "market_segment": _mapped(F.col("c_mktsegment"), SEGMENT_BY_MKTSEGMENT, UNLISTED_SEGMENT),
        "distribution_channel": _pick(k % len(CHANNELS), CHANNELS),
        "is_repeated_guest": F.when(ck % 7 == 0, 1).otherwise(0),
        "previous_cancellations": ck % 3,
        "previous_bookings_not_canceled": ck % 5,
        "reserved_room_type": _pick(k % 7, ROOM_LETTERS),
        "assigned_room_type": _pick((k + ck) % 7, ROOM_LETTERS),
        "booking_changes": k % 4,
        "deposit_type": _pick(k % len(DEPOSITS), DEPOSITS),
        "agent": F.when(k % 11 == 0, F.lit(None)).otherwise(ck % 50),
        "company": F.when(k % 3 == 0, ck % 20),
        "days_in_waiting_list": k % 9,
        "customer_type": F.when(ck % 2 == 0, "Transient").otherwise("Contract"),
        "adr": F.when(k % 53 == 0, F.lit(Decimal("-6.38")))
        .when(k % 17 == 0, F.lit(Decimal("0.00")))
        .otherwise(adr_from_price),
        "required_car_parking_spaces": F.when(k % 8 == 0, 1).otherwise(0),
        "total_of_special_requests": k % 6,
        "reservation_status": _mapped(F.col("o_orderstatus"), STATUS_BY_ORDERSTATUS, None),
        "reservation_status_date": d,
    }
    return [cols[f.name].cast(f.dataType).alias(f.name) for f in BOOKINGS.fields]


def bookings_from(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Booking rows from order rows LEFT JOIN customer rows on the customer key."""
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey, "left")
    return joined.select(*_booking_columns())


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bookings: the consolidated booking table."""
    return bookings_from(_orders(spark, sf_dir), _customers(spark, sf_dir))


def bookings_of(spark: SparkSession, sf_dir: str, year: int | None) -> DataFrame:
    """One yearly booking table."""
    return bookings_from(of_year(_orders(spark, sf_dir), year), _customers(spark, sf_dir))


def bookings_of_years(spark: SparkSession, sf_dir: str, years: list[int | None]) -> DataFrame:
    """UNION ALL of the yearly booking tables.

    The orders of the years are united first and joined with ``customer`` once:
    a union of joins with the same table is the join of the union, row by row,
    and reads ``customer`` once instead of once a year.
    """
    orders = _orders(spark, sf_dir)
    parts = [of_year(orders, y) for y in years]
    united = consolidate(parts) if parts else orders.limit(0)
    return bookings_from(united, _customers(spark, sf_dir))


def bookings_without_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bookings without their market segment: no join with ``customer`` (whose key is unique)."""
    columns = [c for c, name in zip(_booking_columns(), BOOKING_COLUMNS) if name != "market_segment"]
    return _orders(spark, sf_dir).select(*columns)


def market_segments(spark: SparkSession) -> DataFrame:
    """Segment discount lookup; a literal table of 4 rows, so safe to broadcast."""
    return bounded_lookup(spark, [(name, Decimal(rate)) for name, rate in SEGMENT_DISCOUNTS], MARKET_SEGMENT)


def meal_costs(spark: SparkSession) -> DataFrame:
    """Meal cost lookup; a literal table of 4 rows, so safe to broadcast."""
    return bounded_lookup(spark, [(meal, Decimal(cost)) for meal, cost in MEAL_COSTS], MEAL_COST)
