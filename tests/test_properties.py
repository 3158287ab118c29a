"""Property tests: the Column rules against plain-Python Decimal models on random rows."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from lodging.functions import rules
from lodging.operators.consolidate import with_lookups
from lodging.operators.enrich import with_revenue, with_rooms
from lodging.sources import testdata

SEGMENTS = dict((name, Decimal(rate)) for name, rate in testdata.SEGMENT_DISCOUNTS)
MEALS = dict((meal, Decimal(cost)) for meal, cost in testdata.MEAL_COSTS)

statuses = st.sampled_from(["Canceled", "Check-Out", "No-Show", "Other", None])
rates = st.one_of(st.none(), st.decimals(min_value=-50, max_value=500, places=2, allow_nan=False, allow_infinity=False))
nights = st.one_of(st.none(), st.integers(min_value=0, max_value=30))
segments = st.sampled_from([*SEGMENTS, "Unlisted", None])
meals = st.sampled_from([*MEALS, "XX", None])
booking = st.tuples(statuses, rates, nights, nights, segments, meals)

SCHEMA = T.StructType(
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


def revenue_model(status, adr, week, weekend, segment, meal):
    """The revenue rule read literally, with SQL NULL logic spelt out."""
    if status == "Canceled":
        return Decimal(0)
    if adr is not None and adr < 0:
        return Decimal(0)
    if status in ("Check-Out", "No-Show") and adr is not None and adr <= 0:
        return Decimal(0)
    discount, cost = SEGMENTS.get(segment), MEALS.get(meal)
    if None in (adr, week, weekend, discount, cost):
        return None
    return (week + weekend) * adr * (1 - discount) - cost


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(booking, min_size=1, max_size=60))
def test_revenue_rule_matches_model(spark, rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)
    joined = with_lookups(df, testdata.market_segments(spark), testdata.meal_costs(spark))
    got = {r.case_id: r.revenue for r in joined.transform(with_rooms).transform(with_revenue).collect()}
    assert len(got) == len(rows)  # the left joins keep every booking
    for i, r in enumerate(rows):
        want = revenue_model(*r)
        assert (got[i] is None) == (want is None), r
        if want is not None:
            assert got[i] == want, r


def millions_model(amount: Decimal | None) -> str | None:
    if amount is None:
        return None
    m = (amount / Decimal(1_000_000)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
    return ("-" if m < 0 else "") + "$" + str(abs(m)) + "M"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.one_of(
            st.none(),
            st.decimals(min_value=-10**13, max_value=10**13, places=4, allow_nan=False, allow_infinity=False),
        ),
        min_size=1,
        max_size=40,
    )
)
def test_millions_text_matches_model(spark, amounts):
    df = spark.createDataFrame([(a, i) for i, a in enumerate(amounts)], "x decimal(38,4), i int")
    got = {r.i: r.t for r in df.select("i", rules.millions_text("x").alias("t")).collect()}
    for i, a in enumerate(amounts):
        assert got[i] == millions_model(a), a


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.one_of(st.none(), st.integers(min_value=-1, max_value=5)),
            st.one_of(st.none(), st.integers(min_value=0, max_value=2)),
            st.one_of(st.none(), st.integers(min_value=0, max_value=2)),
        ),
        min_size=1,
        max_size=40,
    )
)
def test_guest_type_matches_model(spark, parties):
    def model(adults, children, babies):
        if children == 0 and babies == 0 and adults is not None:
            if adults == 1:
                return "Single"
            if adults == 2:
                return "Couple"
            if adults > 2:
                return "Group"
        return "Family"

    df = spark.createDataFrame([(*p, i) for i, p in enumerate(parties)], "adults int, children int, babies int, i int")
    got = {r.i: r.g for r in df.select("i", rules.guest_type().alias("g")).collect()}
    for i, p in enumerate(parties):
        assert got[i] == model(*p), p
