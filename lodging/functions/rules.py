"""Classification and revenue rules as Spark Column expressions.

Every rule is a pure function of Columns built from ``pyspark.sql.functions``
only, so each one stays inside whole-stage codegen; none needs a Python UDF.
Defaults name the booking columns, so ``rules.revenue()`` works on an enriched
frame and tests can pass literal columns.
"""

from __future__ import annotations

import functools
import weakref
from collections.abc import Callable
from decimal import Decimal

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodging.functions.regions import OTHER, REGION_CODES

ColumnLike = Column | str

# FIXED VALUES: reservation statuses and the guest, season and weekday labels.
CANCELED = "Canceled"
CHECK_OUT = "Check-Out"
NO_SHOW = "No-Show"
SEASON_MONTHS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Winter", ("December", "January", "February")),
    ("Spring", ("March", "April", "May")),
    ("Summer", ("June", "July", "August")),
    ("Autumn", ("September", "October", "November")),
)
# Weekday names by day number, 1 = Sunday (the numbering of dayofweek()).
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
# English month names, in calendar order.
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Built rules per live SparkContext (weakly held: a stopped context's entries go with it).
_BUILT: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def reused(build: Callable[..., Column]) -> Callable[..., Column]:
    """Build a rule once per SparkContext when it is called on column names.

    A Column is an immutable expression tree, so one instance can serve every
    query; rebuilding the region rule alone costs hundreds of calls into the
    JVM.  Calls with Column arguments are built fresh.
    """

    @functools.wraps(build)
    def rule(*args: ColumnLike, **kwargs: ColumnLike) -> Column:
        if not all(isinstance(a, str) for a in (*args, *kwargs.values())):
            return build(*args, **kwargs)
        sc = SparkContext._active_spark_context
        if sc is None:
            return build(*args, **kwargs)
        built = _BUILT.setdefault(sc, {})
        key = (build.__name__, args, tuple(sorted(kwargs.items())))
        if key not in built:
            built[key] = build(*args, **kwargs)
        return built[key]

    return rule


@reused
def rooms_sold(
    week: ColumnLike = "stays_in_week_nights",
    weekend: ColumnLike = "stays_in_weekend_nights",
) -> Column:
    """Nights booked (week + weekend); the analysis calls it rooms sold."""
    return _col(week) + _col(weekend)


def rooms_sold_as_written() -> Column:
    """The two audit statements added week nights to themselves."""
    return rooms_sold("stays_in_week_nights", "stays_in_week_nights")


@reused
def revenue(
    status: ColumnLike = "reservation_status",
    adr: ColumnLike = "adr",
    rooms: ColumnLike = "Number_of_Rooms_Sold",
    discount: ColumnLike = "Discount",
    cost: ColumnLike = "Cost",
) -> Column:
    """Booking revenue, first matching arm wins.

    Canceled bookings and non-positive rates earn 0; otherwise
    ``rooms * adr * (1 - Discount) - Cost``.  The result is NULL when a
    lookup missed (Discount or Cost NULL) and ``-Cost`` when no night was
    booked: both are the analysis' own behaviour and are kept.
    Stays decimal; callers cast to double at the very end.
    """
    status, adr = _col(status), _col(adr)
    zero = F.lit(0)
    return (
        F.when(status == CANCELED, zero)
        .when(adr < 0, zero)
        .when(status.isin(CHECK_OUT, NO_SHOW) & (adr <= 0), zero)
        .otherwise(_col(rooms) * adr * (F.lit(1) - _col(discount)) - _col(cost))
    )


@reused
def guest_type(
    adults: ColumnLike = "adults",
    children: ColumnLike = "children",
    babies: ColumnLike = "babies",
) -> Column:
    """Single / Couple / Group for adult-only parties, else Family.

    A NULL in any input makes every adult-only test unknown, so it lands in
    'Family', as does a party of zero adults.
    """
    adults = _col(adults)
    no_kids = (_col(children) == 0) & (_col(babies) == 0)
    return (
        F.when((adults == 1) & no_kids, "Single")
        .when((adults == 2) & no_kids, "Couple")
        .when((adults > 2) & no_kids, "Group")
        .otherwise("Family")
    )


@reused
def season(month: ColumnLike = "arrival_date_month") -> Column:
    """Meteorological season of an English month name in any case; NULL for anything else."""
    month = F.lower(_col(month))
    expr = None
    for label, months in SEASON_MONTHS:
        cond = month.isin(*[m.lower() for m in months])
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


@reused
def region(country: ColumnLike = "country") -> Column:
    """Region label of a country code (see ``regions``); 'Other' otherwise.

    Each arm is an IN list; Catalyst turns lists over 10 items into a hash
    set (InSet), so a row costs at most one probe per label.
    """
    country = _col(country)
    expr = None
    for label, codes in REGION_CODES:
        cond = country.isin(*codes)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(OTHER)


@reused
def arrival_date(
    day: ColumnLike = "arrival_date_day_of_month",
    month: ColumnLike = "arrival_date_month",
    year: ColumnLike = "arrival_date_year",
) -> Column:
    """The date of '<day> <Month> <year>', as the original's text conversion gives it.

    Built with ``make_date`` from the month's position in the calendar
    (matched in any case, like a month-name parse) instead of
    formatting the parts as text and parsing them back, which costs about
    three times as much per row.  Same results: any NULL part gives NULL;
    an impossible date (31 February) or an unknown month name (position 0)
    fails the query, as the parse does; the check is part of the expression,
    so it holds whatever ``spark.sql.ansi.enabled`` says.  Parts are cast to
    int first, so a fractional day can never slip through.
    """
    names = F.array(*[F.lit(m.lower()) for m in MONTH_NAMES])
    position = F.array_position(names, F.lower(_col(month))).cast("int")
    day, year = _col(day).cast("int"), _col(year).cast("int")
    first = F.make_date(year, F.greatest(position, F.lit(1)), F.lit(1))
    known = day.isNotNull() & position.isNotNull() & year.isNotNull()
    valid = (position >= 1) & (day >= 1) & (day <= F.dayofmonth(F.last_day(first)))
    parts = F.concat_ws(" ", day.cast("string"), _col(month), year.cast("string"))
    wrong = F.raise_error(F.concat(F.lit("no such date: "), parts)).cast("date")
    return F.when(known & ~F.coalesce(valid, F.lit(False)), wrong).when(known, F.date_add(first, day - 1))


@reused
def day_of_week(date: ColumnLike = "arrival_date") -> Column:
    """English weekday name; dayofweek() numbers Sunday as 1.

    One array lookup by day number: the date is evaluated once per row (a
    CASE over the day number would re-derive it in every arm).  The NULL
    guard is explicit: on Spark 4.1 a NULL index into a literal array was
    seen to return the last element instead of NULL.
    """
    dow = F.dayofweek(_col(date))
    return F.when(dow.isNotNull(), F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), dow))


@reused
def millions_text(amount: ColumnLike) -> Column:
    """Render a money amount as '$12.35M' / '-$1.23M' (millions, 2 decimals).

    Exact decimal scaling with one HALF_UP rounding: the amount is narrowed to
    decimal(30,4) so the product with 1e-6 keeps all 10 fraction digits
    (precision 38) and Spark never rounds an intermediate.  A negative that
    rounds to zero prints as '$0.00M'.
    """
    scaled = _col(amount).cast("decimal(30,4)") * F.lit(Decimal("0.000001"))
    millions = scaled.cast("decimal(28,2)")
    sign = F.when(millions < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.lit("$"), F.abs(millions).cast("string"), F.lit("M"))
