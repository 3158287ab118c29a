"""The inputs every analysis takes: bookings, yearly tables and two lookups.

Analyses are written against ``Inputs`` and never against file paths, so the
same code runs on the derived test tables, on CSV sheets or on the
partitioned Parquet table.

``Inputs`` also holds the shared intermediate frames (lookups joined,
revenue, full enrichment).  DataFrames are lazy plans: making them runs and
caches nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodging.operators.consolidate import consolidate, with_lookups
from lodging.operators.enrich import enrich, with_revenue, with_rooms
from lodging.schema import MARKET_SEGMENT, MEAL_COST
from lodging.sources import files, testdata


class Inputs:
    """The frames analyses start from; each is made when it is first used."""

    def __init__(
        self,
        bookings: Callable[[], DataFrame],
        segments: Callable[[], DataFrame],
        meals: Callable[[], DataFrame],
        years: Callable[[], list[int | None]],
        year_table: Callable[[int | None], DataFrame],
        without_segment: Callable[[], DataFrame] | None = None,
        consolidated: Callable[[list[int | None]], DataFrame] | None = None,
    ) -> None:
        self._bookings, self._segments, self._meals = bookings, segments, meals
        self._years = years
        self._without_segment = without_segment or (lambda: self.bookings)
        self._consolidated = consolidated or (lambda years: consolidate(self.yearly().values()))
        self.year_table = year_table  # one yearly table

    @cached_property
    def bookings(self) -> DataFrame:
        """Consolidated: every year, 32 columns."""
        return self._bookings()

    @cached_property
    def segments(self) -> DataFrame:
        """market_segment, Discount."""
        return self._segments()

    @cached_property
    def meals(self) -> DataFrame:
        """meal, Cost."""
        return self._meals()

    @cached_property
    def without_segment(self) -> DataFrame:
        """Bookings for analyses that don't use the market segment, which may cost a join to get."""
        return self._without_segment()

    @cached_property
    def consolidated(self) -> DataFrame:
        """UNION ALL of the yearly tables."""
        return self._consolidated(self.years)

    @cached_property
    def years(self) -> list[int | None]:
        """Arrival years there are tables for; None stands for bookings without a year."""
        return self._years()

    def yearly(self) -> dict[int | None, DataFrame]:
        """One table per arrival year."""
        return {y: self.year_table(y) for y in self.years}

    @cached_property
    def joined(self) -> DataFrame:
        """Bookings LEFT JOIN both lookups (lookup keys renamed)."""
        return with_lookups(self.bookings, self.segments, self.meals)

    @cached_property
    def revenue_rows(self) -> DataFrame:
        """``joined`` plus Number_of_Rooms_Sold and revenue."""
        return self.joined.transform(with_rooms).transform(with_revenue)

    @cached_property
    def enriched(self) -> DataFrame:
        """The 41-column export, money still exact decimal."""
        return enrich(self.bookings, self.segments, self.meals)

    @cached_property
    def enriched_as_written(self) -> DataFrame:
        """The export exactly as the original lists it (40 columns)."""
        return enrich(self.bookings, self.segments, self.meals, as_written=True)


def from_table(spark: SparkSession, bookings_path: str, segments: DataFrame, meals: DataFrame) -> Inputs:
    """Analyses over a booking table written by ``files.write_bookings``.

    A yearly table is the table filtered on its year: partition pruning
    reads that year's folder only, so the union of the yearly tables reads
    every file exactly once.
    """
    bookings = files.read_bookings(spark, bookings_path)
    year = F.col(files.PARTITION_COLUMN)
    return Inputs(
        bookings=lambda: bookings,
        segments=lambda: segments,
        meals=lambda: meals,
        years=lambda: files.table_years(spark, bookings_path),
        year_table=lambda y: bookings.where(year.isNull() if y is None else year == y),
    )


def from_testdata(spark: SparkSession, sf_dir: str) -> Inputs:
    """Bookings derived from ``orders``/``customer`` under ``sf_dir``, lazily: no job, no write."""
    return Inputs(
        bookings=lambda: testdata.bookings(spark, sf_dir),
        segments=lambda: testdata.market_segments(spark),
        meals=lambda: testdata.meal_costs(spark),
        years=lambda: testdata.years(spark, sf_dir),
        year_table=lambda y: testdata.bookings_of(spark, sf_dir, y),
        without_segment=lambda: testdata.bookings_without_segment(spark, sf_dir),
        consolidated=lambda years: testdata.bookings_of_years(spark, sf_dir, years),
    )


def from_parquet(spark: SparkSession, bookings_path: str, segments_path: str, meals_path: str) -> Inputs:
    """A booking table written by ``files.write_bookings`` plus lookup files."""
    segments = files.checked_lookup(spark.read.schema(MARKET_SEGMENT).parquet(segments_path), "market_segment")
    meals = files.checked_lookup(spark.read.schema(MEAL_COST).parquet(meals_path), "meal")
    return from_table(spark, bookings_path, segments, meals)
