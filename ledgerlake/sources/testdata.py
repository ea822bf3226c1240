"""Adapter from the driver's star-schema tables to the ``transactions`` model.

The test tables hold no bank statements, so a statement-like table is derived from ``orders``
with deterministic column expressions only (no join, no UDF, no shuffle): one order is one
transaction, the customer is the account. The same derivation is written in SQL for the
DuckDB oracle (``ledgerlake.plans.oracle``).

  txn_id       o_orderkey
  account_id   o_custkey
  date         CAST(o_orderdate AS DATE)
  amount       +o_totalprice for status 'O' (income), -o_totalprice otherwise (expense)
  currency     ADAPTER_CURRENCIES[o_orderkey % 10]
  category     ADAPTER_CATEGORIES[o_orderkey % 13]
  description  ADAPTER_DESCRIPTIONS[(7 * o_orderkey + o_custkey) % 30]
  type         'debit' for expenses, else 'credit'

``raw_statements`` prints the same rows as statement text (dates in six formats, amounts with
currency symbols and local decimal commas) so the parsing operators can be run over every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Adapter value lists (our own choice, not reference values).
ADAPTER_CURRENCIES = ["USD", "EUR", "INR", "GBP", "JPY", "CAD", "AUD", "CHF", "CNY", "BRL"]
ADAPTER_CATEGORIES = ["food", "transport", "entertainment", "shopping", "utilities", "healthcare",
                      "education", "travel", "insurance", "investment", "other", "health", "salary"]
ADAPTER_DESCRIPTIONS = [
    "Bäckerei Lindenhof", "Harbour Kiosk 12", "Tram Ticket Zone 3", "Monthly Wages Orchard Ltd",
    "Riverside Cinema", "Green Grocer Maple St", "City Bikes Rental", "Water Works Invoice",
    "Blue Door Hardware", "Crêperie du Port", "Yoga Studio Pass", "Vinyl Corner",
    "Second Page Bookstore", "Home Insurance Premium", "Ferry to Island", "Power Bill North Grid",
    "Night Taxi 4411", "Index Fund Savings Plan", "Niño Café", "Farm Market Stall",
    "Toy Parcel Online Order", "Spice Lane Grocery", "Fuel Stop Route 9", "Linen Shop",
    "Dental Clinic Dr Osei", "Language Course Fee", "Hostel Booking", "Quartz Watch Repair",
    "Garden Centre", "Untitled transfer",
]
# How each currency is printed in the raw statement: (prefix, decimal mark, suffix).
RAW_AMOUNT_STYLE = {
    "USD": ("$", ".", ""), "EUR": ("€", ",", ""), "INR": ("₹", ".", ""), "GBP": ("£", ".", ""),
    "JPY": ("¥", ".", ""), "CAD": ("C$", ".", ""), "AUD": ("A$", ".", ""), "CHF": ("", ".", " CHF"),
    "CNY": ("", ".", " CNY"), "BRL": ("R$", ",", ""),
}
# Date print formats, chosen by o_orderkey % 6 (Spark pattern letters).
RAW_DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "dd-MM-yyyy",
                    "dd-MMM-yyyy"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(values: list[str], idx: Column) -> Column:
    """values[idx] for a non-negative integer column (0-based)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    amount = F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    return o.select(
        F.col("o_orderkey").alias("txn_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        pick(ADAPTER_DESCRIPTIONS, (F.col("o_orderkey") * 7 + F.col("o_custkey")) % len(ADAPTER_DESCRIPTIONS)).alias("description"),
        amount.alias("amount"),
        pick(ADAPTER_CURRENCIES, F.col("o_orderkey") % len(ADAPTER_CURRENCIES)).alias("currency"),
        F.when(amount < 0, F.lit("debit")).otherwise(F.lit("credit")).alias("type"),
        pick(ADAPTER_CATEGORIES, F.col("o_orderkey") % len(ADAPTER_CATEGORIES)).alias("category"),
    )


def raw_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement text rows: (txn_id, account_id, date, description, amount, type, category)
    all STRING, the shape a CSV statement has after ``spark.read.csv`` with a string schema."""
    o = table(spark, sf_dir, "orders")
    cur = pick(ADAPTER_CURRENCIES, F.col("o_orderkey") % len(ADAPTER_CURRENCIES))
    num = F.col("o_totalprice").cast("decimal(15,2)").cast("string")
    amount_text = None
    for code, (prefix, dec, suffix) in RAW_AMOUNT_STYLE.items():
        body = num if dec == "." else F.replace(num, F.lit("."), F.lit(dec))
        txt = F.concat(F.lit(prefix), body, F.lit(suffix))
        amount_text = (F.when(cur == code, txt) if amount_text is None
                       else amount_text.when(cur == code, txt))
    fmt_idx = F.col("o_orderkey") % len(RAW_DATE_FORMATS)
    date_text = None
    for i, fmt in enumerate(RAW_DATE_FORMATS):
        txt = F.date_format(F.col("o_orderdate"), fmt)
        date_text = F.when(fmt_idx == i, txt) if date_text is None else date_text.when(fmt_idx == i, txt)
    return o.select(
        F.col("o_orderkey").alias("txn_id"),
        F.col("o_custkey").alias("account_id"),
        date_text.alias("date"),
        pick(ADAPTER_DESCRIPTIONS, (F.col("o_orderkey") * 7 + F.col("o_custkey")) % len(ADAPTER_DESCRIPTIONS)).alias("description"),
        amount_text.alias("amount"),
        F.when(F.col("o_orderstatus") == "O", F.lit("Credit")).otherwise(F.lit("Debit")).alias("type"),
        F.initcap(pick(ADAPTER_CATEGORIES, F.col("o_orderkey") % len(ADAPTER_CATEGORIES))).alias("category"),
    )


def messy_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_statements`` with statement-export damage, for cleaning / validation / recovery."""
    df = raw_statements(spark, sf_dir)
    k = F.col("txn_id") % 20
    d, de, a, t, c = (F.col(x) for x in ("date", "description", "amount", "type", "category"))
    null = F.lit(None).cast("string")
    date = (F.when(k == 1, F.lit("invalid-date"))
             .when(k == 5, F.lit("----------"))
             .when(k == 6, F.lit("Date"))
             .when(k == 7, null)
             .when(k == 12, F.date_format(F.date_add(F.to_date(F.lit("1970-01-01")), (F.col("txn_id") % 9000).cast("int")), "MM/dd/yy"))
             .when(k == 13, de)
             .otherwise(d))
    desc = (F.when(k == 2, F.lit(""))
             .when(k == 4, F.concat(F.lit('  "'), de, F.lit('"  ')))
             .when(k == 5, null).when(k == 6, F.lit("Description")).when(k == 7, null)
             .when(k == 8, F.lit("nan"))
             .when(k == 13, d)
             .otherwise(de))
    amt = (F.when(k == 3, F.lit("invalid-amount"))
            .when(k == 5, null).when(k == 6, F.lit("Amount")).when(k == 7, null)
            .when(k == 9, F.lit("0.00"))
            .when(k == 14, F.concat(F.lit("-"), a))
            .otherwise(a))
    typ = (F.when(k == 5, null).when(k == 6, F.lit("Type")).when(k == 7, null)
            .when(k == 11, null).otherwise(t))
    cat = (F.when(k == 5, null).when(k == 6, F.lit("Category")).when(k == 7, null)
            .when(k == 10, F.lit("")).otherwise(c))
    return df.select("txn_id", "account_id", date.alias("date"), desc.alias("description"),
                     amt.alias("amount"), typ.alias("type"), cat.alias("category"))


def split_amount_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement rows whose amount was exported as two numeric columns (whole, cents)."""
    raw = raw_statements(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txn_id"),
                                             F.col("o_totalprice").cast("decimal(15,2)").cast("string").alias("_num"))
    j = raw.join(o, "txn_id")
    return j.select("txn_id", "account_id", F.col("date").alias("Date"), F.col("description").alias("Description"),
                    F.split_part(F.col("_num"), F.lit("."), F.lit(1)).alias("Amount_Part1"),
                    F.split_part(F.col("_num"), F.lit("."), F.lit(2)).cast("int").cast("string").alias("Amount_Part2"),
                    F.col("type").alias("Type"))
