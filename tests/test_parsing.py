"""Scalar case tables (currency detection, amount parsing, dates, formats)."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlake.functions import formatting as FM
from ledgerlake.functions import parsing as P

# one text per rule: every prefix symbol, a code before and after, order of overlapping symbols, no currency at all
CURRENCY_CASES = [
    ("C$7.15", "CAD"), ("A$ 12", "AUD"), ("R$3.999,10", "BRL"), ("RM88", "MYR"), ("S$0.40", "SGD"), ("HK$61", "HKD"),
    ("NZ$5.5", "NZD"), ("Rp 70.000", "IDR"), ("₹12", "INR"), ("7 €", "EUR"), ("£0.99", "GBP"), ("₱340", "PHP"),
    ("₽18,5", "RUB"), ("9 ₩", "KRW"), ("฿71", "THB"), ("₿0.004", "BTC"), ("$8", "USD"), ("¥31", "JPY"), ("￥31", "CNY"),
    ("EUR 17", "EUR"), ("17 CHF", "CHF"), ("SEK17", "USD"), ("8.20 PLN", "PLN"), ("42", "USD"), ("8 $", "USD"), ("", "USD"),
]
# one text per separator form: none, point, comma, thousands of either kind, sign before and after the symbol
AMOUNT_CASES = [
    ("7", 7.0, "USD"), ("7.5", 7.5, "USD"), ("€7,5", 7.5, "EUR"), ("3.021,75", 3021.75, "USD"), ("3,021.75", 3021.75, "USD"),
    ("£3,021.75", 3021.75, "GBP"), ("R$9.410,02", 9410.02, "BRL"), ("-7.25", -7.25, "USD"), ("-£7.25", -7.25, "GBP"),
    ("₹64,000.10", 64000.10, "INR"), ("(31)", 31.0, "USD"), ("31-", 31.0, "USD"), ("3000000001", None, "USD"),
    ("none given", None, "USD"), ("  ", None, "USD"),
]
DATE_CASES = [
    ("2023-11-08", dt.date(2023, 11, 8)), ("11/28/2023", dt.date(2023, 11, 28)), ("28/11/2023", dt.date(2023, 11, 28)),
    ("2023/11/08", dt.date(2023, 11, 8)), ("28-11-2023", dt.date(2023, 11, 28)), ("11-28-2023", dt.date(2023, 11, 28)),
    ("08-Nov-2023", dt.date(2023, 11, 8)), ("11/28/79", dt.date(1979, 11, 28)), ("11/28/23", dt.date(2023, 11, 28)),
    ("05/06/2023", dt.date(2023, 5, 6)), ("05-06-2023", dt.date(2023, 6, 5)), ("2023-11-031", None), ("2023-02-29", None),
    ("some day", None), ("2023-11-08 23:59:01", dt.date(2023, 11, 8)), ("05/06", dt.date(2024, 5, 6)),
]


def _one_col(spark, values):
    return spark.createDataFrame([(v,) for v in values], "s string")


def test_detect_currency(spark):
    df = _one_col(spark, [c for c, _ in CURRENCY_CASES])
    got = dict(df.select("s", P.detect_currency(F.col("s")).alias("c")).collect())
    for text, want in CURRENCY_CASES:
        assert got[text] == want, text


def test_parse_amount(spark):
    df = P.with_amount(_one_col(spark, [a for a, _, _ in AMOUNT_CASES]), "s", "p")
    got = {r["s"]: (r["p"]["amount"], r["p"]["currency"]) for r in df.collect()}
    for text, amount, cur in AMOUNT_CASES:
        a, c = got[text]
        assert (a is None and amount is None) or abs(a - amount) < 1e-9, text
        assert c == cur, text


def test_parse_amount_defensive_symbol_order(spark):
    df = P.with_amount(_one_col(spark, ["C$5", "€1.234,56", "100,", "-12.5"]), "s", "p", defensive=True)
    got = {r["s"]: (r["p"]["amount"], r["p"]["currency"]) for r in df.collect()}
    assert got["C$5"] == (5.0, "USD")           # '$' is tested before 'C$'
    assert got["€1.234,56"] == (1234.56, "EUR")
    assert got["100,"] == (100.0, "USD")         # zero digits after the comma: decimal mark
    assert got["-12.5"] == (-12.5, "USD")


def test_parse_date(spark):
    df = P.with_date(_one_col(spark, [d for d, _ in DATE_CASES]), "s", "d", F.to_date(F.lit("2024-06-30")))
    got = dict(df.select("s", "d").collect())
    for text, want in DATE_CASES:
        assert got[text] == want, text


def test_locale_format(spark):
    rows = [(7.1, "USD", "$7.10"), (71.0, "INR", "₹71.00"), (7.15, "EUR", "7,15 €"), (0.4, "GBP", "£0.40"),
            (7.05, "CAD", "C$7.05"), (31.0, "AUD", "A$31.00"), (8210.0, "JPY", "¥8,210"),
            (7654321.018, "SEK", "7 654 321,02 kr"), (3.0, "XYZ", "$3.00")]
    df = spark.createDataFrame([(a, c) for a, c, _ in rows], "a double, c string")
    got = [r[0] for r in df.select(FM.format_currency_locale(F.col("a"), F.col("c"))).collect()]
    assert got == [w for _, _, w in rows]


def test_report_format(spark):
    rows = [(1234.5, "USD", "$1,234.50"), (-5.0, "USD", "$-5.00"), (1200.0, "JPY", "¥1,200"),
            (99.5, "EUR", "99.50 €"), (2.675, "USD", "$2.67"), (10.0, "XYZ", "10.00 XYZ")]
    df = spark.createDataFrame([(a, c) for a, c, _ in rows], "a double, c string")
    got = [r[0] for r in df.select(FM.format_currency_report(F.col("a"), F.col("c"))).collect()]
    assert got == [w for _, _, w in rows]
