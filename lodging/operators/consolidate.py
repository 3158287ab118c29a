"""Consolidation and lookup enrichment: the star join at the heart of every query."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lookup-side key columns are renamed on the way in, so both sides of each
# join stay addressable: the audit statements report the lookup side (NULL
# when the lookup misses) and the export reports the booking side.
SEGMENT_KEY = "lookup_market_segment"
MEAL_KEY = "lookup_meal"


def consolidate(tables: Iterable[DataFrame]) -> DataFrame:
    """UNION ALL of the yearly tables, matched by column name, duplicates kept.

    By name, not position: a positional union of reordered columns silently
    coerces types.  A union is a narrow operation, no shuffle.
    """
    tables = list(tables)
    if not tables:
        raise ValueError("nothing to consolidate")
    return reduce(lambda a, b: a.unionByName(b), tables)


def with_lookups(bookings: DataFrame, segments: DataFrame, meals: DataFrame) -> DataFrame:
    """LEFT JOIN bookings to the segment discount and meal cost lookups.

    Keeps every booking; an unmatched key leaves ``Discount`` / ``Cost``
    NULL.  Lookup keys were checked to be unique
    (``sources.files.checked_lookup`` / ``bounded_lookup``).  Spark broadcasts a
    lookup that is below its threshold in bytes, so the booking side isn't
    shuffled: two BroadcastHashJoins in one stage.
    """
    seg = segments.select(F.col("market_segment").alias(SEGMENT_KEY), "Discount")
    meal = meals.select(F.col("meal").alias(MEAL_KEY), "Cost")
    return bookings.join(seg, F.col("market_segment") == F.col(SEGMENT_KEY), "left").join(
        meal, F.col("meal") == F.col(MEAL_KEY), "left"
    )
