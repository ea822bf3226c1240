"""Invariants from the test plan: facet sums, shares, conversion identity (sf0.001 tables)."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerlake.operators import fx as X
from ledgerlake.operators import spending as S
from ledgerlake.sources.testdata import transactions


def test_facets_sum_to_total(spark):
    f = S.spending_facets(transactions(spark, SF_SMALL), ["account_id"])
    sums = (f.groupBy("account_id", "facet").agg(F.round(F.sum("amount"), 2).alias("s"))
             .groupBy("account_id").agg(F.collect_set("s").alias("vals")))
    # total, per-category, per-month and per-weekday sums agree per account (to the cent)
    for r in sums.collect():
        assert max(r.vals) - min(r.vals) <= 0.011 * 4, r


def test_category_shares_sum_to_100(spark):
    shares = S.category_share(transactions(spark, SF_SMALL), ["account_id"])
    for r in shares.groupBy("account_id").agg(F.sum("share_pct").alias("p")).collect():
        assert abs(r.p - 100.0) <= 0.1, r


def test_same_currency_conversion_is_identity(spark):
    t = transactions(spark, SF_SMALL).filter(F.col("currency") == "EUR")
    c = X.convert_transactions(t, "EUR")
    bad = c.filter((F.col("conversion_rate") != 1.0) | (F.col("amount") != F.col("original_amount")))
    assert c.count() > 0 and bad.count() == 0


def test_converting_twice_does_not_multiply(spark):
    t = transactions(spark, SF_SMALL)
    once = X.convert_transactions(t, "USD")
    twice = X.convert_transactions(once, "USD")
    diff = once.alias("a").join(twice.alias("b"), "txn_id").filter(F.abs(F.col("a.amount") - F.col("b.amount")) > 1e-9)
    assert diff.count() == 0
