"""Summarise the physical plan of every registered query into docs/PLANS.md.

    python tools/plan_report.py [sf_dir] [out_file]

For each query: the scans (columns read, pushed and partition filters), the
joins with their strategy, every exchange (shuffle / broadcast) and any
window or sort.  Built from ``df.explain("formatted")``.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from lodging.plans import catalog  # noqa: E402
from lodging.session import local_session  # noqa: E402


def formatted(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def _details(text: str) -> dict[int, tuple[str, list[str]]]:
    """Node id -> (node name, detail lines) from the formatted plan."""
    nodes: dict[int, tuple[str, list[str]]] = {}
    for block in re.split(r"\n(?=\(\d+\) )", text.split("\n\n", 1)[1] if "\n\n" in text else text):
        m = re.match(r"\((\d+)\) ([^\n\[]+)", block.strip())
        if m:
            nodes[int(m.group(1))] = (m.group(2).strip(), block.strip().splitlines()[1:])
    return nodes


def summarise(text: str) -> list[str]:
    lines: list[str] = []
    for _, (name, detail) in sorted(_details(text).items()):
        info = {d.split(":", 1)[0].strip(): d.split(":", 1)[1].strip() for d in detail if ":" in d}
        if name.startswith("Scan parquet"):
            where = info.get("Location", "").split("[")[-1].rstrip("]").split("/")[-1]
            where = "bookings table" if where.startswith("lodging-bookings-") else where
            schema = info.get("ReadSchema", "?")
            columns = schema.count(":")
            if columns > 8:
                schema = f"{columns} columns"
            parts = [f"scan `{where}` reads {schema}"]
            if info.get("PushedFilters", "[]") != "[]":
                parts.append(f"pushed {info['PushedFilters']}")
            if info.get("PartitionFilters", "[]") != "[]":
                parts.append(f"partition filter {info['PartitionFilters']}")
            lines.append("; ".join(parts))
        elif name.startswith("LocalTableScan"):
            lines.append("lookup: LocalTableScan (literal rows)")
        elif "Join" in name:
            lines.append(f"{name.split('(')[0].strip()} ({info.get('Join type', '')})")
        elif name.startswith("Exchange"):
            lines.append(f"Exchange {info.get('Arguments', '').split(', ENSURE')[0]}")
        elif name.startswith("BroadcastExchange"):
            lines.append("BroadcastExchange")
        elif name.startswith(("Window", "TakeOrderedAndProject", "Sort ", "Sort(")) or name == "Sort":
            lines.append(f"{name} {info.get('Arguments', '')[:120]}")
        elif name.startswith("HashAggregate") and any("partial_" in d for d in detail):
            lines.append("HashAggregate (partial, map side)")
    return lines


def main(argv: list[str]) -> None:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    out_file = argv[1] if len(argv) > 1 else os.path.join(ROOT, "docs", "PLANS.md")
    spark = local_session(8, 8, app="plan-report")
    body = [
        "# Physical plans of the registered queries",
        "",
        f"Generated by `tools/plan_report.py` from `explain(\"formatted\")` on `{sf_dir}` "
        "(AQE on, so joins show the static choice; `isFinalPlan=false`). "
        "Every query derives the booking columns it needs from `orders` (and `customer`, for the market segment).",
        "",
    ]
    from lodging.sources import testdata

    targets = [("ingest (once per session): bookings derived from orders JOIN customer", lambda s, d: testdata.bookings(s, d))]
    targets += list(catalog.queries().items())
    for name, fn in targets:
        text = formatted(fn(spark, sf_dir))
        shuffles = len(re.findall(r"\(\d+\) Exchange\b", text))
        broadcasts = len(re.findall(r"\(\d+\) BroadcastExchange\b", text))
        body.append(f"## {name}")
        body.append(f"shuffles: {shuffles}, broadcasts: {broadcasts}")
        body.append("")
        # expression ids (#123) change from run to run; leave them out
        body.extend(f"- {re.sub(r'#[0-9]+L?', '', line)}" for line in summarise(text))
        body.append("")
    os.makedirs(os.path.dirname(out_file), exist_ok=True)
    with open(out_file, "w") as fh:
        fh.write("\n".join(body))
    print(f"wrote {out_file}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
