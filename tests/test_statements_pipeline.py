"""Sample statement → parse (sign by type) → spending analysis golden totals; recovery."""

from pyspark.sql import functions as F

from ledgerlake.operators import recover as R
from ledgerlake.operators import spending as S
from ledgerlake.operators import statements as ST

# An own statement; the totals below are worked out by hand.
# food 4 + 16 + 20 = 40, transport 30, home 150, fun 10: 230 spent in 6 rows on 6 days; income 1000
SAMPLE = """2023-03-06,Farm Market Stall,4.00,Debit,Food
2023-03-07,Ferry to Island,30.00,Debit,Transport
2023-03-08,Wages Orchard Ltd,1000.00,Credit,Income
2023-03-09,Crêperie du Port,16.00,Debit,Food
2023-03-10,Power Bill North Grid,150.00,Debit,Home
2023-03-11,Riverside Cinema,10.00,Debit,Fun
2023-03-12,Spice Lane Grocery,20.00,Debit,Food"""


def _sample(spark):
    rows = [tuple(["acct"] + line.split(",")) for line in SAMPLE.splitlines()]
    return spark.createDataFrame(rows, "account_id string, date string, description string, amount string, "
                                       "type string, category string")


def test_golden_totals(spark):
    good, bad = ST.split(ST.parse_statements(_sample(spark), "2024-06-30"))
    assert bad.count() == 0
    totals = S.spending_totals(good, ["account_id"]).first()
    assert totals.total_expenses == 230.0 and totals.total_transactions == 6
    inc = S.monthly_income(good, ["account_id"]).first()
    assert abs(inc._monthly_income - 1000.0) < 1e-9
    cats = {r.category: r["sum"] for r in S.category_breakdown(good, ["account_id"]).collect()}
    assert cats == {"food": 40.0, "transport": 30.0, "home": 150.0, "fun": 10.0}
    days = {r.day_name: r.amount for r in S.weekday_pattern(good, ["account_id"]).collect()}
    assert days == {"Monday": 4.0, "Tuesday": 30.0, "Wednesday": 0.0, "Thursday": 16.0, "Friday": 150.0, "Saturday": 10.0, "Sunday": 20.0}


def test_multi_account_invariance(spark):
    one = _sample(spark)
    two = one.unionByName(one.withColumn("account_id", F.lit("other")))
    good1, _ = ST.split(ST.parse_statements(one, "2024-06-30"))
    good2, _ = ST.split(ST.parse_statements(two, "2024-06-30"))
    a = sorted(tuple(r) for r in S.category_breakdown(good1, ["account_id"]).collect())
    b = sorted(tuple(r) for r in S.category_breakdown(good2, ["account_id"]).filter("account_id = 'acct'").collect())
    assert a == b


def test_recovery_strategies(spark):
    rows = [
        (1, "2024-01-15", "Tea Room", "$4.50", "Debit", "Food"),
        (2, "Harbour Kiosk", "2024-01-15", "12.50", None, None),
        (3, None, "Paid 2024-01-15 lunch", "€12,50", None, None),
        (4, "2024-01-15", "", "1250", None, None),
        (5, "no date at all", "Vinyl", "€88094,03", "Debit", "Transport"),
        (6, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "txn_id long, date string, description string, amount string, "
                                     "type string, category string")
    got = {r.txn_id: r for r in R.recover_rows(df, "2024-06-30").collect()}
    assert (got[1].strategy_used, got[1].amount, got[1].type, got[1].category) == ("standard_parsing", 4.5, "debit", "food")
    assert (got[2].strategy_used, got[2].description, got[2].date) == ("fuzzy_column_matching", "Harbour Kiosk", "2024-01-15")
    assert (got[3].strategy_used, got[3].description, got[3].currency, got[3].amount) == \
        ("pattern_based_extraction", "Paid  lunch", "EUR", 12.5)
    assert (got[4].strategy_used, got[4].amount, got[4].description) == ("manual_field_detection", 1250.0, "Unknown transaction")
    assert (got[5].strategy_used, got[5].date, got[5].amount) == ("emergency_fallback", "2024-06-30", 88094.03)
    assert (got[6].success, got[6].strategy_used) == (False, "all_failed")
