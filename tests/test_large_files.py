"""Lines of large files stay in their splits, and are parsed once."""

import os

from pyspark.sql import functions as F

from ledgerlake.operators import upload as U
from ledgerlake.sources import cascade
from ledgerlake.sources import statements as SRC


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _write(folder, name, text):
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write(text)


def test_lines_are_not_dealt_by_file(spark, tmpdir_path):
    _write(tmpdir_path, "plain.csv", "Trans_Date,Payee,Total\n2024-01-01,Tea,4.5\n2024-01-02,,3\n")
    _write(tmpdir_path, "quoted.csv", 'date;description;amount\n2024-01-01;"Tea\n2 cups";4.5\n')
    records = SRC.read_records(spark, tmpdir_path)
    assert "AS utf8" not in _plan(records)   # the profile is not computed again
    assert "strategy=broadcast" in _plan(records)
    names = {"date": ["date"], "description": ["payee"], "amount": ["total"], "type": ["type"]}
    rows = SRC.statement_columns(records, names)
    assert sorted((r["date"], r["description"] or "", r["amount"], r["type"]) for r in rows.collect()) == [
        ("2024-01-01", "Tea", "4.5", None), ("2024-01-01", "Tea\n2 cups", "4.5", None), ("2024-01-02", "", "3", None)]


def test_cascade_judges_once(spark, tmpdir_path):
    _write(tmpdir_path, "plain.csv", "date,description,amount\n2024-01-01,Tea,4.5\n2024-01-02,Cake,3\n")
    rows, verdicts = cascade.read_cascade(spark, tmpdir_path)
    assert "Aggregate" not in _plan(verdicts) and "strategy=broadcast" in _plan(rows)
    assert rows.count() == 2 and verdicts.first()["strategy"] == "standard"


def test_upload_parses_once(spark):
    rows = spark.range(6).select(F.col("id").alias("txn_id"), F.lit("a").alias("account_id"), F.when(F.col("id") != 3, F.lit("2024-01-15")).alias("date"), F.lit("Soup").alias("description"),
                                 F.lit("7.00").alias("amount"), F.lit("Debit").alias("type"), F.lit("").alias("category"))
    good, lost = U.process(rows, "2024-06-30")
    assert "Range" not in _plan(good) and "Range" not in _plan(lost)
    assert good.count() + lost.count() == 6
