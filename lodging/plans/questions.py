"""The dashboard's business questions, answered from the enriched export.

The original answered these in dashboard visuals that are not published, so
the exact definitions are ours; each docstring states it.  Every answer is a
grouped aggregate over the enriched bookings, or over plain bookings where no
lookup column is used: partial aggregation per task,
then one shuffle of partial rows whose count is bounded by the number of
groups, never by the number of bookings.  Windows and limits run only on
those small aggregated results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodging.operators.aggregates import sum_by
from lodging.plans.inputs import Inputs
from lodging.functions import rules
from lodging.functions.rules import CHECK_OUT, MONTH_NAMES

YEAR = "arrival_date_year"
MONTH = "arrival_date_month"


def _revenue_by(inp: Inputs, *keys: str) -> DataFrame:
    totals = sum_by(inp.enriched, list(keys), "revenue", "revenue")
    return totals.select(*keys, F.col("revenue").cast("double").alias("revenue"))


def busiest_months(inp: Inputs) -> DataFrame:
    """Checked-out bookings per arrival month, busiest first."""
    return (
        inp.without_segment.where(F.col("reservation_status") == CHECK_OUT)
        .groupBy(MONTH)
        .agg(F.count(F.lit(1)).alias("check_outs"))
        .orderBy(F.desc("check_outs"), MONTH)
    )


def average_stay(inp: Inputs) -> DataFrame:
    """Average nights of checked-out bookings, per hotel."""
    return (
        inp.without_segment.where(F.col("reservation_status") == CHECK_OUT)
        .groupBy("hotel")
        .agg(F.avg(rules.rooms_sold()).alias("average_nights"))
        .orderBy("hotel")
    )


def weekday_by_guest_type(inp: Inputs) -> DataFrame:
    """Bookings per (guest type, arrival weekday), ranked within guest type.

    The window runs on the aggregate (at most 4 x 8 rows), not on bookings.
    """
    dated = inp.without_segment.select(rules.guest_type().alias("guest_type"), rules.arrival_date().alias("arrival_date"))
    grouped = dated.groupBy("guest_type", rules.day_of_week().alias("day_of_week"))
    counts = grouped.agg(F.count(F.lit(1)).alias("bookings"))
    rank = Window.partitionBy("guest_type").orderBy(F.desc("bookings"), F.asc("day_of_week"))
    ranked = counts.withColumn("weekday_rank", F.row_number().over(rank).cast("bigint"))
    return ranked.orderBy("guest_type", "weekday_rank")


def revenue_by_hotel_guest_type(inp: Inputs) -> DataFrame:
    """Revenue per (hotel, guest type)."""
    return _revenue_by(inp, "hotel", "guest_type").orderBy(F.desc_nulls_last("revenue"), "hotel", "guest_type")


def revenue_by_region(inp: Inputs) -> DataFrame:
    """Revenue per region."""
    return _revenue_by(inp, "region").orderBy(F.desc_nulls_last("revenue"), "region")


def top5_countries(inp: Inputs) -> DataFrame:
    """The five countries with the most revenue (NULL sums last, ties by code).

    A top-k: Spark plans it as TakeOrderedAndProject over the aggregate, each
    task keeps its best five and only those reach the final merge.
    """
    totals = sum_by(inp.enriched, ["country"], "revenue", "total")
    top = totals.orderBy(F.desc_nulls_last("total"), F.asc_nulls_first("country")).limit(5)
    return top.select("country", F.col("total").cast("double").alias("revenue"))


def revenue_yoy(inp: Inputs) -> DataFrame:
    """Revenue per year, the change against the previous year and its percent.

    ``lag`` runs over the per-year aggregate (one row per year).
    """
    totals = sum_by(inp.enriched, [YEAR], "revenue", "total")
    by_year = Window.orderBy(YEAR)
    prev = F.lag("total").over(by_year)
    change = (F.col("total") - F.col("previous")).cast("double")
    return (
        totals.withColumn("previous", prev)
        .select(
            YEAR,
            F.col("total").cast("double").alias("revenue"),
            F.col("previous").cast("double").alias("previous_revenue"),
            change.alias("revenue_change"),
            F.when(F.col("previous") == 0, F.lit(None))
            .otherwise(F.lit(100.0) * change / F.col("previous").cast("double"))
            .alias("growth_pct"),
        )
        .orderBy(YEAR)
    )


def revenue_by_year_hotel(inp: Inputs) -> DataFrame:
    """Revenue per (year, hotel): which hotel brings more."""
    return _revenue_by(inp, YEAR, "hotel").orderBy(YEAR, "hotel")


def revenue_by_season_hotel(inp: Inputs) -> DataFrame:
    """Revenue per (season, hotel)."""
    return _revenue_by(inp, "seasons", "hotel").orderBy("seasons", "hotel")


def revenue_by_month(inp: Inputs) -> DataFrame:
    """Revenue per (year, arrival month), in calendar order."""
    calendar = F.array_position(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.col(MONTH))
    return _revenue_by(inp, YEAR, MONTH).orderBy(YEAR, calendar, MONTH)


def parking_percentage(inp: Inputs) -> DataFrame:
    """Share of bookings that asked for at least one parking space, in percent."""
    counts = inp.without_segment.agg(
        F.count(F.when(F.col("required_car_parking_spaces") > 0, F.lit(1))).alias("bookings_with_parking"),
        F.count(F.lit(1)).alias("count_of_reservations_made"),
    )
    pct = F.lit(100.0) * F.col("bookings_with_parking").cast("double") / F.col("count_of_reservations_made").cast(
        "double"
    )
    return counts.withColumn(
        "parking_percentage", F.when(F.col("count_of_reservations_made") == 0, F.lit(None)).otherwise(pct)
    )
