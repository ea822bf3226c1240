"""The upload pipeline on a small statement: parsed, recovered, rejected, categorised."""

from ledgerlake.operators import upload as U


def test_every_row_is_accepted_or_rejected_once(spark):
    rows = spark.createDataFrame([
        (1, "a", "2024-01-15", "Night taxi home", "$4.50", "Debit", ""), (2, "a", "Harbour Kiosk", "2024-01-15", "12.50", None, None),
        (3, "b", None, None, None, None, None), (4, "b", "2024-01-16", "Kite club", "3.00", "Debit", ""), (5, "b", "2024-01-16", "Kite club", "3.00", "Debit", "Fees")],
        "txn_id long, account_id string, date string, description string, amount string, type string, category string")
    custom = spark.createDataFrame([("b", "hobby", ["kite"])], "account_id string, category string, keywords array<string>")
    good, lost = U.process(rows, "2024-06-30", custom=custom)
    got = {r["txn_id"]: r for r in good.collect()}
    assert set(got) == {1, 2, 4, 5} and [r["txn_id"] for r in lost.collect()] == [3]
    assert got[1]["how"] == "parsed" and got[2]["how"] == "fuzzy_column_matching" and got[2]["description"] == "Harbour Kiosk"
    assert got[4]["category"] == "hobby" and got[5]["category"] == "fees"


def test_missing_columns(spark):
    rows = spark.createDataFrame([(1, "2024-01-15", "Soup", "7.00")], "txn_id long, date string, description string, amount string")
    good, lost = U.accept(rows, "2024-06-30")
    r = good.first()
    assert (r["amount"], r["type"], r["how"]) == (-7.0, "debit", "parsed") and lost.count() == 0
