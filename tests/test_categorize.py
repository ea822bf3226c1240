"""Categoriser against the derived expectation table (ml / rule / blended)."""

import pytest

from ledgerlake.operators import categorize as G

EXPECTED = [
    ("Starbucks Coffee", "food", 0.315, "food", 0.700, "food", 0.700),
    ("Shell Gas Station", "transport", 0.242, "transport", 0.900, "transport", 0.900),
    ("Amazon Purchase", "shopping", 0.197, "shopping", 0.550, "shopping", 0.550),
    ("Salary Deposit", "food", 0.156, "other", 0.000, "food", 0.156),
    ("Netflix Subscription", "entertainment", 0.205, "entertainment", 0.550, "entertainment", 0.550),
    ("Walmart Grocery", "food", 0.206, "food", 0.550, "food", 0.550),
    ("Electric Bill", "utilities", 0.183, "utilities", 0.900, "utilities", 0.900),
    ("Target Shopping", "shopping", 0.260, "shopping", 1.000, "shopping", 1.000),
    ("Restaurant Dinner", "food", 0.315, "food", 0.900, "food", 0.900),
    ("Gym Membership", "food", 0.156, "other", 0.000, "food", 0.156),
    ("Bookstore Purchase", "food", 0.156, "shopping", 0.200, "shopping", 0.200),
    ("Insurance Payment", "insurance", 0.221, "insurance", 0.750, "insurance", 0.750),
    ("New Year Dinner", "food", 0.260, "food", 0.350, "food", 0.350),
    ("Electricity Bill", "food", 0.156, "utilities", 0.550, "utilities", 0.550),
    ("Ola Cab Ride", "food", 0.156, "utilities", 0.050, "food", 0.156),
    ("Fidelity Brokerage", "investment", 0.200, "investment", 0.900, "investment", 0.900),
]


@pytest.fixture(scope="module")
def model(spark):
    return G.train(spark)


def test_model_shape(model):
    assert model.vocab.count() == 200
    assert [c for c, _, _ in model.classes] == sorted(G.CATEGORY_KEYWORDS)


def test_expectation_table(spark, model):
    texts = spark.createDataFrame([(e[0].lower(),) for e in EXPECTED], "desc string")
    got = {r["desc"]: r for r in G.classify_texts(texts, model).collect()}
    for d, mc, mp, rc, rp, bc, bp in EXPECTED:
        r = got[d.lower()]
        assert r.ml_category == mc and abs(r.ml_confidence - mp) < 0.011, d
        assert r.rule_category == rc and abs(r.rule_confidence - rp) < 0.011, d
        assert r.category == bc and abs(r.confidence - bp) < 0.011, d


def test_categorize_only_missing(spark, model):
    df = spark.createDataFrame([(1, "Starbucks Coffee", "other", 0.7), (2, "Starbucks Coffee", "travel", 0.7),
                                (3, "", "", 0.7)],
                               "txn_id long, description string, category string, confidence_score double")
    got = {r.txn_id: (r.category, round(r.confidence_score, 3)) for r in G.categorize(df, model).collect()}
    assert got[1] == ("food", 0.7)
    assert got[2] == ("travel", 0.7)
    assert got[3] == ("other", 0.0)
