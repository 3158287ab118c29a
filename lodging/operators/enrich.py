"""Row-level enrichment: rooms sold, revenue and the five categories.

All of it is narrow: after the two broadcast lookup joins each output row
depends on one booking only, so the whole enrichment runs in one stage with no
shuffle.  The wide export's rules get a generated method of their own
(``own_method``), apart from the joins'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodging.functions import rules
from lodging.operators.consolidate import with_lookups
from lodging.schema import BOOKING_COLUMNS, DERIVED_COLUMNS

MONEY_COLUMNS = ("adr", "Discount", "Cost", "revenue")


ALL_PARTITIONS = 2**31 - 1


def own_method(df: DataFrame) -> DataFrame:
    """What follows is computed in a generated method of its own.

    Whole-stage codegen fuses narrow operators into one method.  HotSpot
    doesn't compile a method of over 8,000 bytes of bytecode (or, told to,
    compiles it badly), and the joins with the 41-column export make one of up
    to 13,000.  ``coalesce`` to more partitions than there can be moves no row
    and merges none (where blocks have preferred hosts it may pair up a few),
    lets filters and column pruning through, and ends the method.
    """
    return df.coalesce(ALL_PARTITIONS)


def with_rooms(df: DataFrame, as_written: bool = False) -> DataFrame:
    rooms = rules.rooms_sold_as_written() if as_written else rules.rooms_sold()
    return df.withColumn("Number_of_Rooms_Sold", rooms)


def with_revenue(df: DataFrame) -> DataFrame:
    """Needs Number_of_Rooms_Sold, adr, reservation_status, Discount, Cost."""
    return df.withColumn("revenue", rules.revenue())


def with_categories(df: DataFrame) -> DataFrame:
    """guest_type, region, seasons, arrival_date and day_of_week."""
    return df.withColumns(
        {
            "guest_type": rules.guest_type(),
            "region": rules.region(),
            "seasons": rules.season(),
            "arrival_date": rules.arrival_date(),
        }
    ).withColumn("day_of_week", rules.day_of_week())


def _export_columns(as_written: bool) -> list:
    if not as_written:
        return [*BOOKING_COLUMNS, *DERIVED_COLUMNS]
    # The original list reads "company days_in_waiting_list": no comma, so the
    # company id is exported under the name days_in_waiting_list and the real
    # waiting-list column is lost.
    base = [
        F.col("company").alias("days_in_waiting_list") if c == "company" else F.col(c)
        for c in BOOKING_COLUMNS
        if c != "days_in_waiting_list"
    ]
    return [*base, *DERIVED_COLUMNS]


def enrich(bookings: DataFrame, segments: DataFrame, meals: DataFrame, as_written: bool = False) -> DataFrame:
    """The dashboard export: 32 booking columns + Cost, Discount + 7 derived.

    Both ``company`` and ``days_in_waiting_list`` are kept: the original export
    meant to list every column but a missing comma dropped the second one
    (``as_written=True`` reproduces that 40-column export).
    Money stays exact decimal; ``money_as_double`` converts for reporting.
    """
    joined = with_lookups(bookings, segments, meals)
    return (
        joined.transform(own_method)
        .transform(with_rooms)
        .transform(with_revenue)
        .transform(with_categories)
        .select(*_export_columns(as_written))
    )


def money_as_double(df: DataFrame) -> DataFrame:
    """Cast the exact money columns present in ``df`` to double, in place."""
    present = [c for c in df.columns if c in MONEY_COLUMNS]
    return df.withColumns({c: F.col(c).cast("double") for c in present}) if present else df
