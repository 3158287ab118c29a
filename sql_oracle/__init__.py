"""Independent SQL statements of every query, for DuckDB (the correctness oracle)."""

from sql_oracle.queries import oracle_sql

__all__ = ["oracle_sql"]
