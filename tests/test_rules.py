"""Rules that a user would notice when they are wrong: rates, currency and type columns, training."""

import pytest

from ledgerlake.operators import categorize as G
from ledgerlake.operators import clean as C
from ledgerlake.operators import fx as X
from ledgerlake.operators import statements as ST
from ledgerlake.session import checkpoint_dir


def test_a_code_with_several_rates_multiplies_nothing(spark):
    rates = spark.createDataFrame([("eur", 0.5, "2024-01-01"), ("EUR", 0.8, "2024-02-01"), ("USD", 1.0, "2024-01-01")],
                                  "currency string, per_usd double, as_of string")
    tx = spark.createDataFrame([(1, 8.0, "EUR"), (2, 3.0, "USD")], "txn_id long, amount double, currency string")
    got = {r["txn_id"]: r["amount"] for r in X.convert_transactions(tx, "USD", rates).collect()}
    assert got == {1: pytest.approx(10.0), 2: 3.0}


def test_a_live_rate_wins_over_the_fallback(spark):
    back = spark.createDataFrame([("EUR", 0.5, "a", "s"), ("GBP", 0.7, "a", "s")], "currency string, per_usd double, as_of string, source string")
    live = spark.createDataFrame([("eur", 0.9, "b", "live")], "currency string, per_usd double, as_of string, source string")
    got = {r["currency"]: (r["per_usd"], r["source"]) for r in X.resolve_rates(live, back).collect()}
    assert got == {"EUR": (0.9, "live"), "GBP": (0.7, "s")}
    assert X.resolve_rates(None, back) is back and X.supported_currencies(spark).count() == 129


def test_currency_and_type_columns(spark):
    raw = spark.createDataFrame([(1, "2024-01-02", "Soup", "7.00", "eur"), (2, "2024-01-02", "Tea", "£2.00", "EUR"), (3, "2024-01-02", "Pie", "3", None)],
                                "txn_id long, date string, description string, amount string, currency string")
    out = ST.parse_statements(raw)
    assert out.columns.count("currency") == 1
    got = {r["txn_id"]: (r["currency"], r["amount"], r["type"]) for r in out.filter("amount IS NOT NULL").collect()}
    # no type column: every row is a debit
    assert got == {1: ("EUR", -7.0, "debit"), 2: ("GBP", -2.0, "debit"), 3: ("USD", -3.0, "debit")}


def test_type_and_sign_follow_one_list(spark):
    raw = spark.createDataFrame([("2024-01-02", "Rent", "50", t, "home") for t in ("Payment", "debit", "Credit", "refund")],
                                "date string, description string, amount string, type string, category string")
    for r in ST.parse_statements(raw).collect():
        assert (r["amount"] < 0) == (r["type"] == "debit")


def test_missing_cents_are_none(spark):
    df = spark.createDataFrame([("a", "12", "50"), ("b", "7", None), ("c", "3", "5")], "what string, whole string, cents string")
    assert [r["whole"] for r in C.merge_split_currency(df).collect()] == ["12.50", "7.00", "3.05"]


def test_training_on_own_documents(spark, tmpdir_path):
    docs = spark.createDataFrame([("sea", "the boat and the sail of the harbour"), ("sea", "anchor in the harbour"),
                                  ("sky", "the cloud and the wind of the sky"), ("sky", "a kite for the wind")] * 2, "category string, text string")
    model = G.train(spark, docs)
    tokens = {r["token"] for r in model.vocab.collect()}
    assert not {"the", "and", "of", "for", "in"} & tokens and {"harbour", "wind"} <= tokens
    assert model.vocab.count() == len(tokens) and G.train(spark, docs, max_features=2).vocab.count() == 2
    model.save(tmpdir_path + "/m")
    again = G.NBModel.load(spark, tmpdir_path + "/m")
    texts = spark.createDataFrame([("old harbour boat",), ("strong wind",)], "desc string")
    assert {r["desc"]: r["ml_category"] for r in G.ml_scores(texts, again).collect()} == {"old harbour boat": "sea", "strong wind": "sky"}


def test_scratch_folder_is_the_named_one(spark):
    assert checkpoint_dir(spark)


def test_low_confidence_flags_and_keeps_rows(spark):
    from ledgerlake.operators import categorize as G
    rows = spark.createDataFrame([(1, 0.4), (2, 0.5), (3, None)], "txn_id long, confidence_score double")
    assert {r["txn_id"]: r["low_confidence"] for r in G.with_low_confidence(rows).collect()} == {1: True, 2: False, 3: True}


def test_monthly_average_basis(spark):
    import pytest

    from ledgerlake.operators import budget as B
    rows = spark.createDataFrame([("a", "2024-01-05", 1000.0, "salary"), ("a", "2024-01-06", -100.0, "food"), ("a", "2024-02-06", -300.0, "food"),
                                  ("b", "2024-01-05", 500.0, "salary")], "account_id string, date string, amount double, category string").selectExpr(
        "account_id", "CAST(date AS DATE) AS date", "amount", "category", "'USD' AS currency")
    got = {(r["account_id"], r["category"]): r["actual"] for r in
           B.budget_vs_actual(B.recommendations(rows, ["account_id"], current_basis="monthly_avg"), ["account_id"]).collect()}
    assert got["a", "food"] == 200.0 and got["b", "food"] == 0.0
    total = {(r["account_id"], r["category"]): r["actual"] for r in B.budget_vs_actual(B.recommendations(rows, ["account_id"]), ["account_id"]).collect()}
    assert total["a", "food"] == 400.0
    with pytest.raises(ValueError):
        B.recommendations(rows, ["account_id"], current_basis="weekly")
