"""DuckDB SQL for every registered query, written apart from the DataFrame code.

Each statement runs on the views ``orders`` and ``customer`` and rebuilds the
booking rows itself (FIXTURES.md section 3), so a mistake in the Spark-side
derivation or rules shows up as a mismatch.  Only fixed value tables (region
codes, fixture country list) are shared with the library, never expressions.

DuckDB differences handled here: ASC sorts NULLs last (Spark: first), so
NULL order is spelt out; ``year()`` is BIGINT, so it is cast to INTEGER.
"""

from __future__ import annotations

from lodging.functions.regions import REGION_CODES
from lodging.sources.fixture_values import COUNTRIES


def _quote(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_COUNTRY_LIST = "[" + ", ".join(_quote(c) for c in COUNTRIES) + "]"

_REGION_CASE = (
    "CASE "
    + " ".join(
        f"WHEN country IN ({', '.join(_quote(c) for c in codes)}) THEN {_quote(label)}"
        for label, codes in REGION_CODES
    )
    + " ELSE 'Other' END"
)

BOOKINGS_CTE = f"""
src AS (
    SELECT o.o_orderkey AS k, o.o_custkey AS ck, o.o_orderstatus AS st, o.o_totalprice AS price,
           o.o_orderpriority AS prio, c.c_mktsegment AS seg,
           make_date(CAST(year(o.o_orderdate) AS INTEGER) + 20,
                     CAST(month(o.o_orderdate) AS INTEGER),
                     CAST(day(o.o_orderdate) AS INTEGER)) AS d
    FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
),
bookings AS (
    SELECT
        CASE WHEN k % 2 = 0 THEN 'City Hotel' ELSE 'Resort Hotel' END AS hotel,
        CAST(CASE WHEN st = 'O' THEN 1 ELSE 0 END AS INTEGER) AS is_canceled,
        CAST(k % 365 AS INTEGER) AS lead_time,
        CAST(year(d) AS INTEGER) AS arrival_date_year,
        monthname(d) AS arrival_date_month,
        CAST(weekofyear(d) AS INTEGER) AS arrival_date_week_number,
        CAST(day(d) AS INTEGER) AS arrival_date_day_of_month,
        CAST(k % 3 AS INTEGER) AS stays_in_weekend_nights,
        CAST((k // 3) % 5 AS INTEGER) AS stays_in_week_nights,
        CAST(ck % 4 AS INTEGER) AS adults,
        CAST(CASE WHEN k % 97 = 0 THEN NULL WHEN k % 10 = 0 THEN 1 ELSE 0 END AS INTEGER) AS children,
        CAST(CASE WHEN k % 25 = 0 THEN 1 ELSE 0 END AS INTEGER) AS babies,
        CASE prio WHEN '1-URGENT' THEN 'FB' WHEN '2-HIGH' THEN 'HB' WHEN '3-MEDIUM' THEN 'BB'
                  WHEN '4-NOT SPECIFIED' THEN 'SC' WHEN '5-LOW' THEN 'XX' END AS meal,
        {_COUNTRY_LIST}[ck % 38 + 1] AS country,
        CASE seg WHEN 'AUTOMOBILE' THEN 'Corporate' WHEN 'BUILDING' THEN 'Complementary'
                 WHEN 'FURNITURE' THEN 'Direct' WHEN 'HOUSEHOLD' THEN 'Groups' ELSE 'Unlisted' END AS market_segment,
        ['Direct', 'Corporate', 'Agent', 'System'][k % 4 + 1] AS distribution_channel,
        CAST(CASE WHEN ck % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS is_repeated_guest,
        CAST(ck % 3 AS INTEGER) AS previous_cancellations,
        CAST(ck % 5 AS INTEGER) AS previous_bookings_not_canceled,
        substr('ABCDEFG', CAST(k % 7 AS INTEGER) + 1, 1) AS reserved_room_type,
        substr('ABCDEFG', CAST((k + ck) % 7 AS INTEGER) + 1, 1) AS assigned_room_type,
        CAST(k % 4 AS INTEGER) AS booking_changes,
        ['No Deposit', 'Refundable', 'Non Refund'][k % 3 + 1] AS deposit_type,
        CAST(CASE WHEN k % 11 = 0 THEN NULL ELSE ck % 50 END AS INTEGER) AS agent,
        CAST(CASE WHEN k % 3 = 0 THEN ck % 20 END AS INTEGER) AS company,
        CAST(k % 9 AS INTEGER) AS days_in_waiting_list,
        CASE WHEN ck % 2 = 0 THEN 'Transient' ELSE 'Contract' END AS customer_type,
        CAST(CASE WHEN k % 53 = 0 THEN -6.38 WHEN k % 17 = 0 THEN 0.00
                  ELSE CAST(CAST(floor(price) AS BIGINT) % 40000 AS DECIMAL(8,0)) * CAST(0.01 AS DECIMAL(2,2))
             END AS DECIMAL(10,2)) AS adr,
        CAST(CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END AS INTEGER) AS required_car_parking_spaces,
        CAST(k % 6 AS INTEGER) AS total_of_special_requests,
        CASE st WHEN 'F' THEN 'Check-Out' WHEN 'O' THEN 'Canceled' WHEN 'P' THEN 'No-Show' END AS reservation_status,
        d AS reservation_status_date
    FROM src
),
seg_lookup AS (
    SELECT * FROM (VALUES ('Corporate', CAST(0.15 AS DECIMAL(4,2))), ('Complementary', CAST(1.00 AS DECIMAL(4,2))),
                          ('Direct', CAST(0.10 AS DECIMAL(4,2))), ('Groups', CAST(0.10 AS DECIMAL(4,2))))
           t(market_segment, Discount)
),
meal_lookup AS (
    SELECT * FROM (VALUES ('FB', CAST(35.00 AS DECIMAL(10,2))), ('HB', CAST(17.50 AS DECIMAL(10,2))),
                          ('BB', CAST(12.99 AS DECIMAL(10,2))), ('SC', CAST(0.00 AS DECIMAL(10,2))))
           t(meal, Cost)
),
joined AS (
    SELECT h.*, m.market_segment AS m_segment, m.Discount, c.meal AS c_meal, c.Cost,
           h.stays_in_week_nights + h.stays_in_weekend_nights AS Number_of_Rooms_Sold,
           -- all zero arms in one test: any TRUE arm gives 0, NULL arms fall through
           CASE WHEN h.reservation_status = 'Canceled' OR h.adr < 0
                     OR (h.reservation_status IN ('Check-Out', 'No-Show') AND h.adr <= 0)
                THEN 0
                ELSE h.adr * (h.stays_in_weekend_nights + h.stays_in_week_nights) * (1 - m.Discount) - c.Cost
           END AS revenue
    FROM bookings h
    LEFT JOIN seg_lookup m ON h.market_segment = m.market_segment
    LEFT JOIN meal_lookup c ON h.meal = c.meal
),
enriched AS (
    SELECT *,
        CASE WHEN babies = 0 AND children = 0 AND adults >= 1
             THEN CASE adults WHEN 1 THEN 'Single' WHEN 2 THEN 'Couple' ELSE 'Group' END
             ELSE 'Family' END AS guest_type,
        {_REGION_CASE} AS region,
        -- month position 12, 1, 2 -> 0; 3-5 -> 1; 6-8 -> 2; 9-11 -> 3; unknown month -> NULL
        ['Winter', 'Spring', 'Summer', 'Autumn'][
            (list_position(['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August',
                            'September', 'October', 'November', 'December'], arrival_date_month) % 12) // 3 + 1
        ] AS seasons,
        CAST(strptime(CAST(arrival_date_day_of_month AS VARCHAR) || ' ' || arrival_date_month || ' '
                      || CAST(arrival_date_year AS VARCHAR), '%d %B %Y') AS DATE) AS arrival_date
    FROM joined
)
"""

BOOKING_COLS = (
    "hotel, is_canceled, lead_time, arrival_date_year, arrival_date_month, arrival_date_week_number, "
    "arrival_date_day_of_month, stays_in_weekend_nights, stays_in_week_nights, adults, children, babies, "
    "meal, country, market_segment, distribution_channel, is_repeated_guest, previous_cancellations, "
    "previous_bookings_not_canceled, reserved_room_type, assigned_room_type, booking_changes, deposit_type, "
    "agent, company, days_in_waiting_list, customer_type, CAST(adr AS DOUBLE) AS adr, "
    "required_car_parking_spaces, total_of_special_requests, reservation_status, reservation_status_date"
)


def _millions(expr: str) -> str:
    m = f"CAST(CAST({expr} AS DECIMAL(30,4)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(28,2))"
    return f"(CASE WHEN {m} < 0 THEN '-' ELSE '' END || '$' || CAST(abs({m}) AS VARCHAR) || 'M')"


def _q(body: str) -> str:
    return "WITH " + BOOKINGS_CTE + body


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    for year in (2018, 2019, 2020):
        q[f"scan_bookings_{year}"] = _q(f"SELECT {BOOKING_COLS} FROM bookings WHERE arrival_date_year = {year}")
    # The yearly tables cover every year of the data.
    q["union_bookings"] = _q(f"SELECT {BOOKING_COLS} FROM bookings")
    q["baseline_join"] = _q(
        f"SELECT {BOOKING_COLS}, CAST(Discount AS DOUBLE) AS Discount, CAST(Cost AS DOUBLE) AS Cost FROM joined"
    )
    lookup_side = (
        "c_meal AS meal, CAST(Cost AS DOUBLE) AS Cost, m_segment AS market_segment, "
        "CAST(Discount AS DOUBLE) AS Discount"
    )
    q["revenue_inputs"] = _q(
        "SELECT reservation_status, stays_in_weekend_nights, stays_in_week_nights, Number_of_Rooms_Sold, "
        f"CAST(adr AS DOUBLE) AS adr, {lookup_side} FROM joined"
    )
    q["revenue_inputs_as_written"] = _q(
        "SELECT reservation_status, stays_in_week_nights, stays_in_week_nights AS stays_in_week_nights_2, "
        "stays_in_week_nights + stays_in_week_nights AS Number_of_Rooms_Sold, "
        f"CAST(adr AS DOUBLE) AS adr, {lookup_side} FROM joined"
    )
    q["adr_anomalies"] = _q(
        f"SELECT reservation_status, Number_of_Rooms_Sold, CAST(adr AS DOUBLE) AS adr, {lookup_side} FROM joined "
        "WHERE adr <= 0 AND m_segment <> 'Complementary' AND Number_of_Rooms_Sold > 0 "
        "ORDER BY adr, Number_of_Rooms_Sold DESC"
    )
    q["adr_anomalies_as_written"] = _q(
        "SELECT reservation_status, stays_in_week_nights + stays_in_week_nights AS Number_of_Rooms_Sold, "
        f"CAST(adr AS DOUBLE) AS adr, {lookup_side} FROM joined "
        "WHERE adr <= 0 AND m_segment <> 'Complementary' AND 2 * stays_in_week_nights > 0 "
        "ORDER BY adr, Number_of_Rooms_Sold DESC"
    )
    q["booking_revenue"] = _q(
        "SELECT hotel, arrival_date_year, reservation_status, stays_in_weekend_nights, stays_in_week_nights, "
        f"Number_of_Rooms_Sold, CAST(adr AS DOUBLE) AS adr, {lookup_side}, "
        "CAST(revenue AS DOUBLE) AS revenue FROM joined"
    )
    q["revenue_by_year"] = _q(
        ", per_year AS (SELECT arrival_date_year, SUM(revenue) AS total FROM joined GROUP BY arrival_date_year) "
        "SELECT arrival_date_year, CAST(total AS DOUBLE) AS Revenue_by_Year, "
        f"{_millions('total')} AS Revenue_by_Year_FormattedInMillions FROM per_year ORDER BY arrival_date_year"
    )
    q["revenue_by_year_window"] = _q(
        ", windowed AS (SELECT DISTINCT arrival_date_year, "
        "SUM(revenue) OVER (PARTITION BY arrival_date_year) AS total FROM joined) "
        "SELECT arrival_date_year, CAST(total AS DOUBLE) AS Revenue_by_Year, "
        f"{_millions('total')} AS Revenue_by_Year_FormattedInMillions FROM windowed ORDER BY arrival_date_year"
    )
    q["total_revenue"] = _q(
        ", total AS (SELECT SUM(revenue) AS total FROM joined) "
        f"SELECT CAST(total AS DOUBLE) AS Total_Revenue, {_millions('total')} AS Total_Revenue_FormattedInMillions "
        "FROM total"
    )
    q["guest_type"] = _q("SELECT adults, children, babies, guest_type FROM enriched")
    q["region"] = _q("SELECT country, region FROM enriched")
    q["season"] = _q("SELECT arrival_date_month, seasons FROM enriched")
    q["arrival_day_of_week"] = _q(
        "SELECT arrival_date_day_of_month, arrival_date_month, arrival_date_year, arrival_date, "
        "dayname(arrival_date) AS day_of_week FROM enriched"
    )
    q["revenue_columns"] = _q(
        "SELECT reservation_status, CAST(adr AS DOUBLE) AS adr, CAST(Discount AS DOUBLE) AS Discount, "
        "CAST(Cost AS DOUBLE) AS Cost, Number_of_Rooms_Sold, CAST(revenue AS DOUBLE) AS revenue FROM joined"
    )
    q["bookings_enriched"] = _q(
        f"SELECT {BOOKING_COLS}, CAST(Cost AS DOUBLE) AS Cost, CAST(Discount AS DOUBLE) AS Discount, "
        "guest_type, region, seasons, arrival_date, dayname(arrival_date) AS day_of_week, "
        "Number_of_Rooms_Sold, CAST(revenue AS DOUBLE) AS revenue FROM enriched"
    )
    as_written_cols = BOOKING_COLS.replace("agent, company, days_in_waiting_list,", "agent, company days_in_waiting_list,")
    q["bookings_enriched_as_written"] = _q(
        f"SELECT {as_written_cols}, CAST(Cost AS DOUBLE) AS Cost, CAST(Discount AS DOUBLE) AS Discount, "
        "guest_type, region, seasons, arrival_date, dayname(arrival_date) AS day_of_week, "
        "Number_of_Rooms_Sold, CAST(revenue AS DOUBLE) AS revenue FROM enriched"
    )
    q["reservation_count"] = _q("SELECT COUNT(*) AS count_of_reservations_made FROM joined")
    q["busiest_months"] = _q(
        "SELECT arrival_date_month, COUNT(*) AS check_outs FROM enriched "
        "WHERE reservation_status = 'Check-Out' GROUP BY arrival_date_month "
        "ORDER BY check_outs DESC, arrival_date_month"
    )
    q["average_stay"] = _q(
        "SELECT hotel, AVG(Number_of_Rooms_Sold) AS average_nights FROM enriched "
        "WHERE reservation_status = 'Check-Out' GROUP BY hotel ORDER BY hotel"
    )
    q["weekday_by_guest_type"] = _q(
        ", counts AS (SELECT guest_type, dayname(arrival_date) AS day_of_week, COUNT(*) AS bookings "
        "FROM enriched GROUP BY guest_type, dayname(arrival_date)) "
        "SELECT guest_type, day_of_week, bookings, ROW_NUMBER() OVER (PARTITION BY guest_type "
        "ORDER BY bookings DESC, day_of_week ASC NULLS FIRST) AS weekday_rank FROM counts "
        "ORDER BY guest_type, weekday_rank"
    )

    def revenue_by(keys: str, order: str) -> str:
        return _q(
            f"SELECT {keys}, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM enriched GROUP BY {keys} ORDER BY {order}"
        )

    q["revenue_by_hotel_guest_type"] = revenue_by("hotel, guest_type", "revenue DESC NULLS LAST, hotel, guest_type")
    q["revenue_by_region"] = revenue_by("region", "revenue DESC NULLS LAST, region")
    q["top5_countries"] = _q(
        ", per_country AS (SELECT country, SUM(revenue) AS total FROM enriched GROUP BY country) "
        "SELECT country, CAST(total AS DOUBLE) AS revenue FROM per_country "
        "ORDER BY total DESC NULLS LAST, country ASC NULLS FIRST LIMIT 5"
    )
    q["revenue_yoy"] = _q(
        ", per_year AS (SELECT arrival_date_year, SUM(revenue) AS total FROM enriched GROUP BY arrival_date_year), "
        "with_prev AS (SELECT arrival_date_year, total, "
        "LAG(total) OVER (ORDER BY arrival_date_year) AS previous FROM per_year) "
        "SELECT arrival_date_year, CAST(total AS DOUBLE) AS revenue, CAST(previous AS DOUBLE) AS previous_revenue, "
        "CAST(total - previous AS DOUBLE) AS revenue_change, "
        "CASE WHEN previous = 0 THEN NULL "
        "ELSE 100.0 * CAST(total - previous AS DOUBLE) / CAST(previous AS DOUBLE) END AS growth_pct "
        "FROM with_prev ORDER BY arrival_date_year"
    )
    q["revenue_by_year_hotel"] = revenue_by("arrival_date_year, hotel", "arrival_date_year, hotel")
    q["revenue_by_season_hotel"] = revenue_by("seasons, hotel", "seasons NULLS FIRST, hotel")
    q["revenue_by_month"] = revenue_by(
        "arrival_date_year, arrival_date_month",
        "arrival_date_year, list_position(['January', 'February', 'March', 'April', 'May', 'June', 'July', "
        "'August', 'September', 'October', 'November', 'December'], arrival_date_month), arrival_date_month",
    )
    q["parking_percentage"] = _q(
        ", counts AS (SELECT COUNT(*) FILTER (WHERE required_car_parking_spaces > 0) AS bookings_with_parking, "
        "COUNT(*) AS count_of_reservations_made FROM bookings) "
        "SELECT bookings_with_parking, count_of_reservations_made, "
        "CASE WHEN count_of_reservations_made = 0 THEN NULL ELSE "
        "100.0 * CAST(bookings_with_parking AS DOUBLE) / CAST(count_of_reservations_made AS DOUBLE) END "
        "AS parking_percentage FROM counts"
    )
    # Ways in and out give back what went in; bookings without a date are on no yearly sheet.
    q["csv_sheets_ingested"] = _q(f"SELECT {BOOKING_COLS} FROM bookings WHERE arrival_date_year IS NOT NULL")
    q["lookup_sheets_joined"] = q["named_tables_joined"] = q["baseline_join"]
    q["export_written"] = q["export_streamed"] = q["bookings_enriched"]
    return q
