"""Every arm of the revenue, guest type, region, season and date rules (FIXTURES.md section 2)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodging.functions import rules
from lodging.functions.regions import REGION_CODES, region_of
from lodging.operators.consolidate import with_lookups
from lodging.operators.enrich import with_revenue, with_rooms
from lodging.sources import testdata


def _one_column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("v")).collect()]


REVENUE_CASES = [
    # status, adr, nights, segment, meal, expected
    ("Canceled", "100.00", 3, "Corporate", "BB", Decimal("0")),
    ("Canceled", None, 3, "Unlisted", "XX", Decimal("0")),
    ("Check-Out", "-6.38", 3, "Corporate", "BB", Decimal("0")),
    ("No-Show", "0.00", 3, "Corporate", "BB", Decimal("0")),
    (None, "0.00", 3, "Corporate", "BB", Decimal("-12.99")),
    ("Check-Out", "100.00", 3, "Corporate", "BB", Decimal("242.01")),
    ("Check-Out", "100.00", 0, "Corporate", "BB", Decimal("-12.99")),
    ("Check-Out", "100.00", 3, "Complementary", "BB", Decimal("-12.99")),
    ("Check-Out", "100.00", 3, "Unlisted", "BB", None),
    ("Check-Out", "100.00", 3, "Corporate", "XX", None),
    ("Check-Out", None, 3, "Corporate", "BB", None),
]


def test_revenue_arms(spark):
    schema = T.StructType(
        [
            T.StructField("reservation_status", T.StringType()),
            T.StructField("adr", T.DecimalType(10, 2)),
            T.StructField("stays_in_week_nights", T.IntegerType()),
            T.StructField("stays_in_weekend_nights", T.IntegerType()),
            T.StructField("market_segment", T.StringType()),
            T.StructField("meal", T.StringType()),
            T.StructField("case_id", T.IntegerType()),
        ]
    )
    rows = [
        (status, None if adr is None else Decimal(adr), nights, 0, seg, meal, i)
        for i, (status, adr, nights, seg, meal, _) in enumerate(REVENUE_CASES)
    ]
    bookings = spark.createDataFrame(rows, schema)
    joined = with_lookups(bookings, testdata.market_segments(spark), testdata.meal_costs(spark))
    got = {r.case_id: r.revenue for r in joined.transform(with_rooms).transform(with_revenue).collect()}
    for i, case in enumerate(REVENUE_CASES):
        expected = case[-1]
        assert (got[i] is None) == (expected is None), case
        if expected is not None:
            assert got[i] == expected, case


def test_revenue_is_exact_decimal(spark):
    df = spark.range(1).select(rules.revenue(F.lit("Check-Out"), F.lit(Decimal("1.10")), F.lit(3), F.lit(Decimal("0.10")), F.lit(Decimal("0.01"))).alias("r"))
    assert isinstance(df.schema["r"].dataType, T.DecimalType)
    assert df.first().r == Decimal("2.96")


def test_guest_type(spark):
    schema = "adults int, children int, babies int"
    rows = [(1, 0, 0), (2, 0, 0), (3, 0, 0), (0, 0, 0), (2, 1, 0), (2, 0, 1), (1, None, 0)]
    got = _one_column(spark, rows, schema, rules.guest_type())
    assert got == ["Single", "Couple", "Group", "Family", "Family", "Family", "Family"]


@pytest.mark.parametrize(
    "code,label",
    [
        ("MEX", "South America"),
        ("CRI", "South America"),
        ("AND", "South America"),
        ("BRB", "South America"),
        ("PRI", "North America"),
        ("TUN", "Africa"),
        ("PRT", "Europe"),
        ("NLD", "Europe"),
        ("NCL", "Oceania"),
        ("SYC", "East Africa"),
        ("NULL", "Unknown"),
        ("ATA", "Unknown"),
        (None, "Other"),
        ("ZZZ", "Other"),
        ("prt", "Other"),
    ],
)
def test_region_examples(code, label):
    assert region_of(code) == label


def test_region_table_shape():
    codes = [c for _, cs in REGION_CODES for c in cs]
    assert len(codes) == len(set(codes)) == 207
    labels = {label for label, _ in REGION_CODES}
    assert len(labels) == 22
    assert "Western Europe" not in labels and "North Africa" not in labels


def test_region_column_matches_table(spark):
    codes = [c for _, cs in REGION_CODES for c in cs] + ["ZZZ", "prt", None]
    got = _one_column(spark, [(c,) for c in codes], "country string", rules.region())
    assert got == [region_of(c) for c in codes]


def test_season(spark):
    rows = [("December",), ("March",), ("August",), ("November",), ("Foo",), (None,)]
    got = _one_column(spark, rows, "arrival_date_month string", rules.season())
    assert got == ["Winter", "Spring", "Summer", "Autumn", None, None]


def test_arrival_date_and_weekday(spark):
    schema = "arrival_date_day_of_month int, arrival_date_month string, arrival_date_year int"
    rows = [(1, "July", 2018), (29, "February", 2020), (None, "July", 2018)]
    df = spark.createDataFrame(rows, schema).select(rules.arrival_date().alias("arrival_date"))
    got = df.select("arrival_date", rules.day_of_week().alias("dow")).collect()
    assert [tuple(r) for r in got] == [
        (dt.date(2018, 7, 1), "Sunday"),
        (dt.date(2020, 2, 29), "Saturday"),
        (None, None),
    ]


def test_month_names_match_case_insensitively(spark):
    schema = "arrival_date_day_of_month int, arrival_date_month string, arrival_date_year int"
    rows = [(4, "july", 2019), (4, "JULY", 2019)]
    assert _one_column(spark, rows, schema, rules.arrival_date()) == [dt.date(2019, 7, 4)] * 2
    assert _one_column(spark, rows, schema, rules.season()) == ["Summer"] * 2


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("day,month", [(1, "Foo"), (31, "February"), (0, "May")])
def test_impossible_dates_fail_in_either_mode(spark, ansi, day, month):
    schema = "arrival_date_day_of_month int, arrival_date_month string, arrival_date_year int"
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match=f"no such date: {day} {month} 2018"):
            spark.createDataFrame([(day, month, 2018)], schema).select(rules.arrival_date()).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.mark.parametrize(
    "amount,text",
    [
        ("11700000", "$11.70M"),
        ("2500", "$0.00M"),
        ("5000", "$0.01M"),
        ("1125000", "$1.13M"),
        ("-1234567", "-$1.23M"),
        ("-4000", "$0.00M"),
        ("12345678901", "$12345.68M"),
        ("4999.9950", "$0.00M"),
        ("-5000", "-$0.01M"),
        (None, None),
    ],
)
def test_millions_text(spark, amount, text):
    df = spark.createDataFrame([(None if amount is None else Decimal(amount),)], "x decimal(38,4)")
    assert df.select(rules.millions_text("x")).first()[0] == text


def test_region_label_sizes_match_the_survey_table():
    """
    to another label, or losing one, changes a count."""
    counts = {label: len(codes) for label, codes in REGION_CODES}
    assert counts == {
        "Middle East": 15, "South America": 32, "North America": 3, "East Asia": 9,
        "Southeast Asia": 12, "Oceania": 10, "Europe": 41, "Central Europe": 1,
        "Eastern Europe": 2, "Southern Europe": 1, "Northern Europe": 1, "Africa": 43,
        "Southern Africa": 1, "East Africa": 7, "West Africa": 1, "South Asia": 5,
        "Central Asia": 4, "Nordic Countries": 1, "Caucasus": 1, "Balkans": 1,
        "Caribbean": 13, "Unknown": 3,
    }


@pytest.mark.parametrize(
    "code,label",
    [
        ("GBR", "Europe"), ("DEU", "Europe"), ("POL", "Europe"), ("FRA", "Europe"), ("NOR", "Europe"),
        ("ZAF", "Africa"), ("KEN", "Africa"), ("NGA", "Africa"), ("LBY", "Africa"),
        ("LIE", "Central Europe"), ("UKR", "Eastern Europe"), ("MCO", "Southern Europe"), ("ISL", "Northern Europe"),
        ("BWA", "Southern Africa"), ("DJI", "East Africa"), ("MRT", "West Africa"), ("VGB", "Caribbean"),
        ("KNA", "Caribbean"), ("CN", "East Asia"), ("TMP", "Southeast Asia"), ("ATF", "Unknown"),
    ],
)
def test_shadowed_codes_keep_the_first_label(code, label):
    assert region_of(code) == label

SURVEY_REGIONS = (
    ("Middle East", "ISR SYR JOR SAU ARE LBN IRQ KWT QAT OMN BHR PSE YEM TUR IRN"),
    ("South America", "BOL CHL COL AND ARG PRY URY VEN BRA PER ECU BHS BLZ CRI CUB DOM SLV GRD GTM HTI HND "
        "JAM MEX NIC PAN TTO ATG BRB DMA VCT GUY SUR"),
    ("North America", "USA CAN PRI"),
    ("East Asia", "CHN HKG MAC TWN PRK KOR JPN MNG CN"),
    ("Southeast Asia", "KHM LAO THA VNM IDN PHL BRN MYS SGP LKA MMR TMP"),
    ("Oceania", "AUS NZL FJI PNG ASM"),
    ("Europe", "GBR FRA DEU ESP ITA NLD BEL PRT CHE AUT SWE DNK NOR FIN IRL POL CZE HUN SVK SVN GRC "
        "ROU BGR EST LVA LTU LUX HRV MLT CYP MKD SMR BIH ALB MNE GIB GGY JEY IMN RUS ARM"),
    ("Central Europe", "LIE"),
    ("Eastern Europe", "BLR UKR"),
    ("Southern Europe", "MCO"),
    ("Northern Europe", "ISL"),
    ("Africa", "ZAF NGA EGY DZA KEN ETH GHA MAR UGA CMR TUN SEN CIV NER MLI AGO TZA MOZ ZMB MUS SDN "
        "RWA BEN TGO SSD BFA NAM GIN MWI COG GAB STP ZWE TCD SOM LBY SWZ LSO GMB GNB CPV SLE "
        "CAF"),
    ("Southern Africa", "BWA"),
    ("East Africa", "BDI DJI ERI COM"),
    ("West Africa", "MRT"),
    ("South Asia", "BGD IND MDV NPL PAK"),
    ("Central Asia", "KAZ AZE TJK UZB"),
    ("Nordic Countries", "FRO"),
    ("Caucasus", "GEO"),
    ("Oceania", "KIR NCL PLW PYF UMI"),
    ("East Africa", "MDG MYT SYC"),
    ("Balkans", "SRB"),
    ("Caribbean", "ABW CYM GLP KNA LCA VGB CUW MTQ MSR AIA TCA SXM MAF"),
    ("Unknown", "NULL ATA ATF"),
)


def test_every_code_has_the_label_of_the_survey(spark):
    want = {code: label for label, codes in SURVEY_REGIONS for code in codes.split()}
    assert len(want) == 207
    got = _one_column(spark, [(c,) for c in want], "country string", rules.region())
    assert dict(zip(want, got)) == want
