"""Command line: compare every registered query with its oracle as Arrow tables
(column names, Arrow types, rows as a multiset).

    python tests/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from compare import arrow_diff, duck  # noqa: E402

from lodging.session import local_session  # noqa: E402


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = set(argv[1:])
    spark = local_session(8, 8, app="oracle-check")
    con = duck(sf_dir)
    oracle = entry.oracle_sql()
    failures = 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        t0 = time.time()
        got = fn(spark, sf_dir).toArrow()
        t1 = time.time()
        if name not in oracle:
            print(f"{name:32s} rows={got.num_rows:7d} (no oracle) {t1 - t0:.2f}s")
            continue
        problem = arrow_diff(got, con.sql(oracle[name]).to_arrow_table())
        status = "OK" if problem is None else "MISMATCH"
        failures += problem is not None
        print(f"{name:32s} rows={got.num_rows:7d} {status} spark {t1 - t0:.2f}s")
        if problem:
            print(problem)
    print(f"failures: {failures}")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
