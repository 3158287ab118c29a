"""Compare a Spark query with its DuckDB oracle on the same tables.

Both results are taken as Arrow tables; names and Arrow types must match in
order, and the rows must be equal as a multiset (exact values).
"""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else v
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _key(row):
    return tuple((v is None, "" if v is None else str(type(v)), v if v is not None else 0) for v in row)


def sorted_rows(rows) -> list[tuple]:
    return sorted((tuple(_norm(v) for v in r) for r in rows), key=_key)


def diff(spark_result, oracle_result, limit: int = 5) -> str | None:
    """None when equal, else a short description of the first differences."""
    s_cols, s_rows = spark_result
    o_cols, o_rows = oracle_result
    if s_cols != o_cols:
        return f"columns differ: spark={s_cols} oracle={o_cols}"
    if len(s_rows) != len(o_rows):
        return f"row counts differ: spark={len(s_rows)} oracle={len(o_rows)}"
    bad = [(a, b) for a, b in zip(s_rows, o_rows) if a != b]
    if not bad:
        return None
    lines = [f"{len(bad)} rows differ"]
    for a, b in bad[:limit]:
        lines.append(f"  spark : {a}\n  oracle: {b}")
    return "\n".join(lines)


def arrow_diff(spark_table, oracle_table) -> str | None:
    """Compare two Arrow tables: column names and Arrow types in order, then
    the rows as an order-insensitive multiset."""
    s_schema = [(f.name, str(f.type)) for f in spark_table.schema]
    o_schema = [(f.name, str(f.type)) for f in oracle_table.schema]
    if s_schema != o_schema:
        return f"arrow schemas differ: spark={s_schema} oracle={o_schema}"
    names = spark_table.column_names
    s_rows = sorted_rows(zip(*[spark_table.column(c).to_pylist() for c in names]))
    o_rows = sorted_rows(zip(*[oracle_table.column(c).to_pylist() for c in names]))
    return diff((names, s_rows), (names, o_rows))

