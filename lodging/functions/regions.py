"""Country code -> region label, the fixed classification table.

FIXED VALUES. These must equal the original analysis for results to match.
The original states the rule as a first-match-wins CASE whose code lists
overlap; a code listed under a later label that an earlier label already
claims can never reach the later label.  The table below is the effective
mapping after that first-match resolution (each code appears once), with the
labels in the original order.  Consequences worth knowing:

* 'Western Europe' and 'North Africa' are never produced: every code listed
  for them is claimed earlier ('Europe', 'Africa').
* 'AND' (Andorra), 'MEX', 'CRI', 'BRB' ... land in 'South America'.
* the text 'NULL' is a real value in the data and maps to 'Unknown';
  a SQL NULL country falls through to 'Other'.
"""

from __future__ import annotations

OTHER = "Other"

# FIXED VALUES: effective region table (label, country codes), original order.
REGION_CODES: tuple[tuple[str, tuple[str, ...]], ...] = (
    (
        "Middle East",
        (
            "ISR", "SYR", "JOR", "SAU", "ARE", "LBN", "IRQ", "KWT", "QAT", "OMN", "BHR", "PSE",
            "YEM", "TUR", "IRN",
        ),
    ),
    (
        "South America",
        (
            "BOL", "CHL", "COL", "AND", "ARG", "PRY", "URY", "VEN", "BRA", "PER", "ECU", "BHS",
            "BLZ", "CRI", "CUB", "DOM", "SLV", "GRD", "GTM", "HTI", "HND", "JAM", "MEX", "NIC",
            "PAN", "TTO", "ATG", "BRB", "DMA", "VCT", "GUY", "SUR",
        ),
    ),
    ("North America", ("USA", "CAN", "PRI")),
    ("East Asia", ("CHN", "HKG", "MAC", "TWN", "PRK", "KOR", "JPN", "MNG", "CN")),
    ("Southeast Asia", ("KHM", "LAO", "THA", "VNM", "IDN", "PHL", "BRN", "MYS", "SGP", "LKA", "MMR", "TMP")),
    ("Oceania", ("AUS", "NZL", "FJI", "PNG", "ASM", "KIR", "NCL", "PLW", "PYF", "UMI")),
    (
        "Europe",
        (
            "GBR", "FRA", "DEU", "ESP", "ITA", "NLD", "BEL", "PRT", "CHE", "AUT", "SWE", "DNK",
            "NOR", "FIN", "IRL", "POL", "CZE", "HUN", "SVK", "SVN", "GRC", "ROU", "BGR", "EST",
            "LVA", "LTU", "LUX", "HRV", "MLT", "CYP", "MKD", "SMR", "BIH", "ALB", "MNE", "GIB",
            "GGY", "JEY", "IMN", "RUS", "ARM",
        ),
    ),
    ("Central Europe", ("LIE",)),
    ("Eastern Europe", ("BLR", "UKR")),
    ("Southern Europe", ("MCO",)),
    ("Northern Europe", ("ISL",)),
    (
        "Africa",
        (
            "ZAF", "NGA", "EGY", "DZA", "KEN", "ETH", "GHA", "MAR", "UGA", "CMR", "TUN", "SEN",
            "CIV", "NER", "MLI", "AGO", "TZA", "MOZ", "ZMB", "MUS", "SDN", "RWA", "BEN", "TGO",
            "SSD", "BFA", "NAM", "GIN", "MWI", "COG", "GAB", "STP", "ZWE", "TCD", "SOM", "LBY",
            "SWZ", "LSO", "GMB", "GNB", "CPV", "SLE", "CAF",
        ),
    ),
    ("Southern Africa", ("BWA",)),
    ("East Africa", ("BDI", "DJI", "ERI", "COM", "MDG", "MYT", "SYC")),
    ("West Africa", ("MRT",)),
    ("South Asia", ("BGD", "IND", "MDV", "NPL", "PAK")),
    ("Central Asia", ("KAZ", "AZE", "TJK", "UZB")),
    ("Nordic Countries", ("FRO",)),
    ("Caucasus", ("GEO",)),
    ("Balkans", ("SRB",)),
    (
        "Caribbean",
        (
            "ABW", "CYM", "GLP", "KNA", "LCA", "VGB", "CUW", "MTQ", "MSR", "AIA", "TCA", "SXM",
            "MAF",
        ),
    ),
    ("Unknown", ("NULL", "ATA", "ATF")),
)


def region_of(code: str | None) -> str:
    """Plain-Python form of the rule, used by tests only."""
    for label, codes in REGION_CODES:
        if code in codes:
            return label
    return OTHER
