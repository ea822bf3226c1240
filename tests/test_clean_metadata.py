"""Column detection, split-currency repair and structure checks."""

from ledgerlake.operators import clean as C


def test_detect_columns_by_name():
    m = C.detect_columns_by_name(["Posted_Date", "Payee", "Transaction_Amount", "Type", "CCY"])
    assert m == {"date": "Posted_Date", "description": "Payee", "amount": "Transaction_Amount",
                 "type": "Type", "currency": "CCY"}


def test_chunk_alias_mapping():
    assert C.chunk_alias_mapping(["trans_date", "memo text", "value", "debit_credit"]) == \
        {"date": "trans_date", "description": "memo text", "amount": "value", "type": "debit_credit"}


def test_detect_columns_by_content(spark):
    df = spark.createDataFrame([("2024-01-15", "Coffee shop", "$4.50"), ("2024-01-16", "Grocery store", "€12,50")],
                               "a string, b string, c string")
    assert C.detect_columns_by_content(df) == {"date": "a", "description": "b", "amount": "c"}


def test_split_currency(spark):
    df = spark.createDataFrame([("2024-01-15", "Coffee", "89", "99", "Debit"), ("2024-01-16", "Lunch", "125", "5", "Debit")],
                               "Date string, Description string, P1 string, P2 string, Type string")
    merged = {r.Description: r.P1 for r in C.merge_split_currency(df).collect()}
    assert merged == {"Coffee": "89.99", "Lunch": "125.05"}
    wide = df.withColumn("Extra", df.Type)          # C5 needs > 5 columns and no 'amount' name
    got = {r.Description: r.Amount for r in C.fix_split_currency_columns(wide).collect()}
    assert got == {"Coffee": "89.99", "Lunch": "125.05"}


def test_normalize_names_and_structure(spark):
    df = spark.createDataFrame([(" 2024-01-15 ", "x", "1.5")], "` Date ` string, `Desc` string, AMOUNT string")
    n = C.normalize_column_names(df)
    assert n.columns == ["date", "desc", "amount"]
    assert C.has_valid_structure(df)
    assert not C.has_valid_structure(df.select("AMOUNT"))


def test_clean_text(spark):
    df = spark.createDataFrame([('  "Quoted  Description"  ',), ("   ",), ("plain",)], "s string")
    got = [r[0] for r in df.select(C.clean_text(df.s)).collect()]
    assert got == ["Quoted Description", None, "plain"]
