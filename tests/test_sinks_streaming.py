"""Table maintenance and streaming ingest."""

import os

from pyspark.sql import functions as F

from ledgerlake.sinks import tables as K
from ledgerlake.streaming import ingest as XS


def _tx(spark):
    rows = [(i, f"a{i % 3}", "2024-01-0%d" % (1 + i % 9), f"shop {i}", -10.0 * i, "USD", "debit", "food", 0.7,
             f"h{i % 2}") for i in range(1, 13)]
    return (spark.createDataFrame(rows, "txn_id long, account_id string, date string, description string, "
                                        "amount double, currency string, type string, category string, "
                                        "confidence_score double, file_hash string")
            .withColumn("date", F.to_date("date")).withColumn("created_at", F.current_timestamp()))


def test_replace_by_hash_is_idempotent(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "tx")
    t = _tx(spark)
    K.save_transactions(t, path)
    K.save_transactions(t, path)
    assert spark.read.parquet(path).count() == 12
    # replacing one (account, file) keeps every other pair
    K.save_transactions(t.filter("account_id = 'a0' AND file_hash = 'h0'").limit(1), path)
    assert spark.read.parquet(path).count() == 12 - 2 + 1


def test_upsert(spark):
    old = spark.createDataFrame([("1", "x"), ("2", "y")], "k string, v string")
    new = spark.createDataFrame([("2", "z"), ("3", "w")], "k string, v string")
    assert sorted(tuple(r) for r in K.upsert(old, new, ["k"]).collect()) == [("1", "x"), ("2", "z"), ("3", "w")]


def test_ingest_stream_exactly_once(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "drops")
    table = os.path.join(tmpdir_path, "table")
    acct = os.path.join(src, "account=42")
    os.makedirs(acct)
    with open(os.path.join(acct, "jan.csv"), "w") as f:
        f.write("date,description,amount,type,category\n2024-01-15,Tea Room,$4.50,Debit,\n"
                "2024-01-16,Salary,3000.00,Credit,income\nbad-date,Oops,1.00,Debit,\n")
    q = XS.ingest_statements(spark, src, table, "2024-06-30", name=f"ingest-{os.path.basename(tmpdir_path)}")
    q.awaitTermination()
    q2 = XS.ingest_statements(spark, src, table, "2024-06-30", name=f"ingest-{os.path.basename(tmpdir_path)}")
    q2.awaitTermination()     # same checkpoint: nothing new, nothing duplicated
    got = spark.read.parquet(table)
    assert got.count() == 2
    assert sorted(r.amount for r in got.collect()) == [-4.5, 3000.0]
    assert spark.read.parquet(table + "_quarantine").count() == 1


def test_same_statement_under_another_name_counts_once(spark, tmpdir_path):
    src, table = os.path.join(tmpdir_path, "drops"), os.path.join(tmpdir_path, "table")
    acct = os.path.join(src, "account=7")
    os.makedirs(acct)
    text = "date,description,amount,type,category\n2024-02-01,Pie,$3.00,Debit,\n2024-02-02,Pie,$3.00,Debit,\nbad,Oops,1,Debit,\n"
    name = f"again-{os.path.basename(tmpdir_path)}"
    for file in ("a.csv", "copy of a.csv"):
        with open(os.path.join(acct, file), "w") as f:
            f.write(text)
        XS.ingest_statements(spark, src, table, "2024-06-30", name=name).awaitTermination()
    assert spark.read.parquet(table).count() == 2


def test_retention_rewrites_every_table_and_types_hold(spark, tmpdir_path):
    paths = [os.path.join(tmpdir_path, x) for x in ("one", "two")]
    for p in paths:
        rows = spark.createDataFrame([("s1", "2024-01-01 00:00:00"), ("s2", "2024-03-01 00:00:00")], "session_id string, created_at string")
        K.typed(rows, K.SESSIONS_SCHEMA).write.parquet(p)
    K.apply_retention(spark, paths, "2024-03-05", 30)
    for p in paths:
        back = spark.read.parquet(p)
        assert [r["session_id"] for r in back.collect()] == ["s2"] and [f.name for f in back.schema] == K.SESSIONS_SCHEMA.names
    K.append_custom_categories(spark.createDataFrame([("s", "hobby", ["kite"])], "session_id string, category_name string, keywords array<string>"), paths[0] + "-c")
    assert K.read_custom_categories(spark.read.parquet(paths[0] + "-c")).first()["keywords"] == ["kite"]


def test_replace_reads_only_touched_buckets(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "pruned")
    K.save_transactions(_tx(spark), path)
    bucket = K.with_account_bucket(_tx(spark).filter("account_id = 'a0'")).first()["account_bucket"]
    plan = spark.read.parquet(path).filter(F.col("account_bucket").isin([bucket]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [(account_bucket" in plan or "PartitionFilters: [isnotnull(account_bucket" in plan
