"""The production path end to end: yearly CSV sheets + lookup CSVs -> table -> analyses.

The booking rows of the test world are exported as one CSV sheet per year and
the lookups as CSV files, then ingested the way a real deployment would, and
every analysis must give the same answer as on the test-world inputs.
"""

from __future__ import annotations

import pytest
from compare import sorted_rows
from conftest import SF_SMALL

from lodging.operators.consolidate import consolidate
from lodging.plans import catalog
from lodging.plans.inputs import Inputs, from_table, from_testdata
from lodging.schema import MARKET_SEGMENT, MEAL_COST
from lodging.sources import files


@pytest.fixture(scope="module")
def ingested(spark, tmp_path_factory) -> tuple[Inputs, Inputs]:
    base = str(tmp_path_factory.mktemp("ingest"))
    expected = from_testdata(spark, SF_SMALL)
    sheets = {}
    for year, table in expected.yearly().items():
        path = f"{base}/sheets/{year}"
        table.write.option("header", True).csv(path)
        sheets[year] = path
    expected.segments.write.option("header", True).csv(f"{base}/market_segment")
    expected.meals.write.option("header", True).csv(f"{base}/meal_cost")

    bookings = consolidate(files.read_yearly_csv(spark, sheets).values())
    files.write_bookings(bookings, f"{base}/bookings")
    segments = files.read_lookup_csv(spark, f"{base}/market_segment", MARKET_SEGMENT, "market_segment")
    meals = files.read_lookup_csv(spark, f"{base}/meal_cost", MEAL_COST, "meal")
    return expected, from_table(spark, f"{base}/bookings", segments, meals)


def test_csv_round_trip_keeps_every_booking(ingested):
    expected, table = ingested
    assert sorted_rows(table.bookings.collect()) == sorted_rows(expected.bookings.collect())
    assert sorted(table.yearly()) == list(range(2015, 2022))


def test_file_lookups_are_checked_and_broadcast(ingested):
    _, table = ingested
    plan = table.joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2  # by their size in bytes; no hint


@pytest.mark.parametrize("name", sorted(catalog.analyses()))
def test_every_analysis_equal_on_ingested_table(ingested, name):
    expected, table = ingested
    fn = catalog.analyses()[name]
    assert sorted_rows(fn(table).collect()) == sorted_rows(fn(expected).collect())


def test_command_line_job(spark, tmp_path):
    """``python -m lodging ingest`` / ``report``, run in-process on CSV files."""
    from lodging.__main__ import ingest, report

    base = str(tmp_path)
    expected = from_testdata(spark, SF_SMALL)
    sheets = {}
    for year, table in expected.yearly().items():
        table.write.option("header", True).csv(f"{base}/{year}")
        sheets[year] = f"{base}/{year}"
    expected.segments.write.option("header", True).csv(f"{base}/seg")
    expected.meals.write.option("header", True).csv(f"{base}/meal")

    ingest(spark, sheets, f"{base}/table")
    report(spark, f"{base}/table", f"{base}/seg", f"{base}/meal", f"{base}/out", ["revenue_by_year", "top5_countries"])

    got = spark.read.parquet(f"{base}/out/revenue_by_year").collect()
    want = catalog.analyses()["revenue_by_year"](expected).collect()
    assert sorted_rows(got) == sorted_rows(want)
    assert spark.read.parquet(f"{base}/out/bookings_enriched_export").count() == expected.bookings.count()
    assert sorted(p.name for p in tmp_path.joinpath("out").iterdir()) == [
        "bookings_enriched_export",
        "revenue_by_year",
        "top5_countries",
    ]


def test_null_year_is_its_own_yearly_table(spark, tmp_path):
    """A booking without an arrival year is kept: its own (NULL) partition and yearly table."""
    from pyspark.sql import functions as F

    expected = from_testdata(spark, SF_SMALL)
    some = expected.bookings.limit(5).withColumn("arrival_date_year", F.lit(None).cast("int"))
    files.write_bookings(expected.bookings.unionByName(some), f"{tmp_path}/t")
    table = from_table(spark, f"{tmp_path}/t", expected.segments, expected.meals)
    yearly = table.yearly()
    assert None in yearly and yearly[None].count() == 5
    assert consolidate(yearly.values()).count() == table.bookings.count() == expected.bookings.count() + 5


def test_report_as_csv(spark, tmp_path):
    from lodging.__main__ import report

    expected = from_testdata(spark, SF_SMALL)
    base = str(tmp_path)
    files.write_bookings(expected.bookings, f"{base}/table")
    expected.segments.write.option("header", True).csv(f"{base}/seg")
    expected.meals.write.option("header", True).csv(f"{base}/meal")
    report(spark, f"{base}/table", f"{base}/seg", f"{base}/meal", f"{base}/out", ["revenue_by_year"], fmt="csv")
    got = spark.read.option("header", True).csv(f"{base}/out/revenue_by_year").collect()
    assert sorted(r.Revenue_by_Year_FormattedInMillions for r in got) == sorted(
        r.Revenue_by_Year_FormattedInMillions for r in catalog.analyses()["revenue_by_year"](expected).collect()
    )
    assert spark.read.option("header", True).csv(f"{base}/out/bookings_enriched_export").count() == expected.bookings.count()


def test_reimport_one_year_replaces_only_that_year(spark, tmp_path):
    from pyspark.sql import functions as F

    from lodging.__main__ import ingest

    expected = from_testdata(spark, SF_SMALL)
    base = str(tmp_path)
    sheets = {}
    for year, table in expected.yearly().items():
        table.write.option("header", True).csv(f"{base}/{year}")
        sheets[year] = f"{base}/{year}"
    ingest(spark, sheets, f"{base}/table")
    before = {y: n for y, n in spark.read.parquet(f"{base}/table").groupBy("arrival_date_year").count().collect()}

    # a corrected 2020 sheet: only its first 10 bookings, every rate raised by 1
    fixed = expected.yearly()[2020].limit(10).withColumn("adr", F.col("adr") + 1)
    fixed.write.option("header", True).csv(f"{base}/2020_fixed")
    ingest(spark, {2020: f"{base}/2020_fixed"}, f"{base}/table")

    after = {y: n for y, n in spark.read.parquet(f"{base}/table").groupBy("arrival_date_year").count().collect()}
    assert after == {**before, 2020: 10}
    ingest(spark, {2020: f"{base}/2020_fixed"}, f"{base}/table", overwrite_table=True)
    assert {r[0] for r in spark.read.parquet(f"{base}/table").select("arrival_date_year").distinct().collect()} == {2020}


def test_all_sheets_of_a_year_are_kept(spark, tmp_path):
    from lodging.__main__ import _sheets, ingest

    base = str(tmp_path)
    table = from_testdata(spark, SF_SMALL).year_table(2018)
    table.where("lead_time % 2 = 0").write.option("header", True).csv(f"{base}/a")
    table.where("lead_time % 2 = 1").write.option("header", True).csv(f"{base}/b")
    sheets = _sheets([f"2018={base}/a", f"2018={base}/b"])
    assert sheets == {2018: [f"{base}/a", f"{base}/b"]}
    ingest(spark, sheets, f"{base}/table")
    assert spark.read.parquet(f"{base}/table").count() == table.count()


def test_a_stray_year_fails_before_anything_is_written(spark, tmp_path):
    from lodging.__main__ import ingest

    base = str(tmp_path)
    expected = from_testdata(spark, SF_SMALL)
    files.write_bookings(expected.bookings, f"{base}/table")
    before = sorted_rows(spark.read.parquet(f"{base}/table").collect())
    expected.year_table(2020).unionByName(expected.year_table(2019).limit(1)).write.option("header", True).csv(f"{base}/2020")
    with pytest.raises(files.WrongYear, match="2020 holds a booking of 2019"):
        ingest(spark, {2020: f"{base}/2020"}, f"{base}/table")
    assert sorted_rows(spark.read.parquet(f"{base}/table").collect()) == before


def test_report_on_other_years_writes_aggregates_only(spark, tmp_path):
    from lodging.__main__ import report

    base = str(tmp_path)
    expected = from_testdata(spark, SF_SMALL)
    files.write_bookings(expected.bookings.where("arrival_date_year IN (2019, 2020, 2021)"), f"{base}/table")
    expected.segments.write.option("header", True).csv(f"{base}/seg")
    expected.meals.write.option("header", True).csv(f"{base}/meal")
    report(spark, f"{base}/table", f"{base}/seg", f"{base}/meal", f"{base}/out", None)
    written = {p.name for p in tmp_path.joinpath("out").iterdir()}
    assert {"bookings_enriched_export", "reservation_count", "adr_anomalies", "revenue_by_year"} <= written
    assert not written & (catalog.ROW_LEVEL | {f"scan_bookings_{y}" for y in range(2015, 2022)})
    report(spark, f"{base}/table", f"{base}/seg", f"{base}/meal", f"{base}/out2", ["scan_bookings_2021"])
    assert spark.read.parquet(f"{base}/out2/scan_bookings_2021").count() == expected.year_table(2021).count()
