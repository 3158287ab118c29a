"""Fixed values of the test world's booking derivation (FIXTURES.md section 3).

Pure Python, so the independent SQL oracle can use the same value tables
without importing Spark.
"""

from __future__ import annotations

# FIXED VALUES (fixture mapping, FIXTURES.md section 3).
COUNTRIES = (
    "PRT", "GBR", "FRA", "ESP", "DEU", "USA", "MEX", "CRI", "PRI", "AND",
    "BRA", "CHN", "CN", "THA", "AUS", "NCL", "LIE", "UKR", "MCO", "ISL",
    "TUN", "AGO", "BWA", "DJI", "SYC", "MRT", "IND", "KAZ", "FRO", "GEO",
    "SRB", "ABW", "BRB", "ISR", "NULL", "ATA", None, "ZZZ",
)
MEAL_BY_PRIORITY = {
    "1-URGENT": "FB",
    "2-HIGH": "HB",
    "3-MEDIUM": "BB",
    "4-NOT SPECIFIED": "SC",
    "5-LOW": "XX",
}
SEGMENT_BY_MKTSEGMENT = {
    "AUTOMOBILE": "Corporate",
    "BUILDING": "Complementary",
    "FURNITURE": "Direct",
    "HOUSEHOLD": "Groups",
}
UNLISTED_SEGMENT = "Unlisted"
STATUS_BY_ORDERSTATUS = {"F": "Check-Out", "O": "Canceled", "P": "No-Show"}
CHANNELS = ("Direct", "Corporate", "Agent", "System")
DEPOSITS = ("No Deposit", "Refundable", "Non Refund")
ROOM_LETTERS = "ABCDEFG"
# Lookup rows: segment discount as a fraction, meal cost per booking.
SEGMENT_DISCOUNTS = (
    ("Corporate", "0.15"),
    ("Complementary", "1.00"),
    ("Direct", "0.10"),
    ("Groups", "0.10"),
)
MEAL_COSTS = (("FB", "35.00"), ("HB", "17.50"), ("BB", "12.99"), ("SC", "0.00"))
