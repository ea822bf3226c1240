"""Registered queries against their DuckDB oracle on the smallest data set."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ["orders", "customer", "events"]
FAST = ["category_breakdown", "weekday_pattern", "top_merchants_per_account", "primary_currency_blended",
        "budget_recommendations", "budget_alerts", "convert_currency", "parse_transactions",
        "parse_dates", "parse_amounts", "sanitize_text", "latest_transactions", "upsert_sessions",
        "rule_categorize", "ml_categorize", "hybrid_categorize", "recover_rows", "normalize_and_convert"]


def _norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: [str(x) for x in t])


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, res.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert not any(math.isnan(r["percentage"]) for r in df.collect() if r["percentage"] is not None)
