"""Command-line job: ingest booking sheets, then write the export and the reports.

    python -m lodging ingest --sheet 2018=/data/2018.csv --sheet 2019=... --table /warehouse/bookings
    python -m lodging report --table /warehouse/bookings \\
        --segments /data/market_segment.csv --meals /data/meal_cost.csv --out /warehouse/reports

``ingest`` reads each yearly CSV sheet with the booking schema (a year may
have several), checks that every row is of its sheet's year, unions them by
column name and replaces the partitions of those years in the Parquet table;
other years stay unless ``--overwrite-table`` is given.  ``report`` reads that
table and the two lookup CSVs (all keys checked), writes the enriched export
partitioned by year and the count, the audits and the aggregates, each as its
own folder under ``--out`` (Parquet, or header CSV with ``--format csv`` for
BI tools).  Statements with a row per booking are written with ``--only``.
Run it with ``spark-submit`` on a cluster; the session's own settings are kept.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from lodging.operators.consolidate import consolidate
from lodging.plans import catalog
from lodging.plans.inputs import from_table
from lodging.schema import MARKET_SEGMENT, MEAL_COST
from lodging.session import configure
from lodging.sources import files


def _sheets(values: list[str]) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for item in values:
        year, _, path = item.partition("=")
        if not path:
            raise SystemExit(f"--sheet wants YEAR=PATH, got {item!r}")
        out.setdefault(int(year), []).append(path)
    return out


def ingest(
    spark: SparkSession, sheets: Mapping[int, str | Sequence[str]], table: str, overwrite_table: bool = False
) -> None:
    """Write the sheets' bookings: their years are replaced, or with ``overwrite_table`` the whole table."""
    tables = files.read_yearly_csv(spark, sheets)
    files.check_years(tables)  # before anything is written
    bookings = consolidate(tables.values())
    files.write_bookings(bookings, table, rebalance=True, replace_years_only=not overwrite_table)


def _write(df, path: str, fmt: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def report(
    spark: SparkSession,
    table: str,
    segments: str,
    meals: str,
    out: str,
    names: list[str] | None,
    fmt: str = "parquet",
) -> None:
    inp = from_table(
        spark,
        table,
        files.read_lookup_csv(spark, segments, MARKET_SEGMENT, "market_segment"),
        files.read_lookup_csv(spark, meals, MEAL_COST, "meal"),
    )
    years = [y for y in inp.years if y is not None]
    analyses = catalog.analyses(years)
    scans = {f"scan_bookings_{y}" for y in years}
    unknown = sorted(set(names or ()) - set(analyses))
    if unknown:
        raise ValueError(f"no such analysis: {', '.join(unknown)}")
    wanted = names or [n for n in analyses if n not in catalog.ROW_LEVEL and n not in scans]
    _write(inp.enriched, f"{out}/bookings_enriched_export", fmt, files.PARTITION_COLUMN)
    for name in wanted:
        _write(analyses[name](inp), f"{out}/{name}", fmt)


def main(argv: list[str]) -> None:
    parser = argparse.ArgumentParser(prog="python -m lodging")
    sub = parser.add_subparsers(dest="command", required=True)
    p_ingest = sub.add_parser("ingest", help="yearly CSV sheets -> year-partitioned booking table")
    p_ingest.add_argument("--sheet", action="append", required=True, metavar="YEAR=PATH")
    p_ingest.add_argument("--table", required=True)
    p_ingest.add_argument(
        "--overwrite-table", action="store_true", help="drop the table's other years (they stay without this flag)"
    )
    p_report = sub.add_parser("report", help="booking table + lookups -> export and reports")
    p_report.add_argument("--table", required=True)
    p_report.add_argument("--segments", required=True, help="market_segment CSV (market_segment, Discount)")
    p_report.add_argument("--meals", required=True, help="meal_cost CSV (meal, Cost)")
    p_report.add_argument("--out", required=True)
    p_report.add_argument("--only", action="append", help="write only these analyses")
    p_report.add_argument(
        "--format", choices=("parquet", "csv"), default="parquet", help="csv: header CSV for BI tools"
    )
    args = parser.parse_args(argv)

    spark = configure(SparkSession.builder.appName(f"lodging-{args.command}").getOrCreate())
    if args.command == "ingest":
        ingest(spark, _sheets(args.sheet), args.table, args.overwrite_table)
    else:
        report(spark, args.table, args.segments, args.meals, args.out, args.only, args.format)


if __name__ == "__main__":
    main(sys.argv[1:])
