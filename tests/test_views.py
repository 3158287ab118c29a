"""Statements written in Spark SQL over the named views equal the DataFrame queries."""

from __future__ import annotations

from compare import sorted_rows
from conftest import SF_CHECK

from lodging.plans import catalog
from lodging.plans.inputs import from_testdata
from lodging.plans.views import register_views

YEARS = range(2015, 2022)
ALL_YEARS = "(" + " UNION ALL ".join(f"SELECT * FROM bookings_{y}" for y in YEARS) + ")"

LOOKUPS = """
LEFT JOIN market_segment AS m ON b.market_segment = m.market_segment
LEFT JOIN meal_cost AS c ON b.meal = c.meal
"""

# every zero arm at once: a TRUE arm gives 0, NULL arms fall through to the formula
REVENUE = """
IF(b.reservation_status = 'Canceled' OR b.adr < 0 OR (b.reservation_status IN ('Check-Out', 'No-Show') AND b.adr <= 0),
   0, b.adr * (b.stays_in_weekend_nights + b.stays_in_week_nights) * (1 - m.Discount) - c.Cost)
"""


def test_views_cover_every_table(spark):
    names = register_views(from_testdata(spark, SF_CHECK))
    assert set(names) == {*map(str, YEARS), "bookings", "market_segment", "meal_cost"}
    assert spark.table("bookings").count() == sum(spark.table(names[y]).count() for y in map(str, YEARS))


def test_sql_window_statement_equals_dataframe_query(spark):
    register_views(from_testdata(spark, SF_CHECK))
    sql = f"""
SELECT DISTINCT arrival_date_year,
       CAST(SUM(revenue) OVER (PARTITION BY arrival_date_year) AS DOUBLE) AS Revenue_by_Year
FROM (SELECT b.arrival_date_year, {REVENUE} AS revenue FROM {ALL_YEARS} AS b {LOOKUPS})
"""
    want = catalog.queries()["revenue_by_year"](spark, SF_CHECK).select("arrival_date_year", "Revenue_by_Year")
    assert sorted_rows(spark.sql(sql).collect()) == sorted_rows(want.collect())


def test_sql_count_statement_equals_dataframe_query(spark):
    register_views(from_testdata(spark, SF_CHECK))
    sql = f"SELECT COUNT(*) AS count_of_reservations_made FROM {ALL_YEARS} AS b {LOOKUPS}"
    got = spark.sql(sql).collect()
    want = catalog.queries()["reservation_count"](spark, SF_CHECK).collect()
    assert got == want
