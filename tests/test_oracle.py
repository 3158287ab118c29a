"""Every registered query equals its independent DuckDB statement (sf0.01)."""

from __future__ import annotations

import pytest
from compare import arrow_diff, duck
from conftest import SF_CHECK

import __spark_entry__ as contract
from lodging.plans import catalog
from sql_oracle import oracle_sql

QUERIES = {name: fn for name, fn in contract.queries().items() if name in catalog.queries()}
ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE) == set(catalog.queries())
    assert set(contract.oracle_sql()) >= set(ORACLE)
    assert all(isinstance(sql, str) for sql in contract.oracle_sql().values())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    """Same column names, same Arrow types, same rows (as a multiset)."""
    got = QUERIES[name](spark, SF_CHECK).toArrow()
    want = con.sql(ORACLE[name]).to_arrow_table()
    problem = arrow_diff(got, want)
    assert problem is None, problem


def test_entry_smoke(spark):
    df = contract.entry(spark)
    rows = df.collect()
    assert df.columns == ["arrival_date_year", "Revenue_by_Year", "Revenue_by_Year_FormattedInMillions"]
    assert [r.arrival_date_year for r in rows] == list(range(2015, 2022))


def test_global_sorts(spark):
    """The driver compares without order; the order itself is checked here."""
    years = [r[0] for r in QUERIES["revenue_by_year"](spark, SF_CHECK).collect()]
    assert years == sorted(years)
    rows = QUERIES["adr_anomalies"](spark, SF_CHECK).collect()
    keys = [(r.adr, -r.Number_of_Rooms_Sold) for r in rows]
    assert keys == sorted(keys)
    top = QUERIES["top5_countries"](spark, SF_CHECK).collect()
    revenues = [r.revenue for r in top if r.revenue is not None]
    assert revenues == sorted(revenues, reverse=True)


def test_months_in_calendar_order(spark):
    rows = QUERIES["revenue_by_month"](spark, SF_CHECK).where("arrival_date_year = 2019").collect()
    assert [r.arrival_date_month for r in rows][:3] == ["January", "February", "March"]


def test_oracle_needs_no_spark():
    """The SQL oracle can be built where only DuckDB is installed."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['pyspark'] = None; import sql_oracle; print(len(sql_oracle.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=60)
    assert out.returncode == 0, out.stderr
    assert out.stdout.strip() == str(len(ORACLE))
