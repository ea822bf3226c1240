"""Versioned tables: replacing and expiring rewrite only the files concerned, and a crash loses nothing."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlake.sinks import constraints as KC
from ledgerlake.sinks import versions as V


def _rows(spark, n=4000):
    return spark.range(n).select(
        F.col("id").alias("txn_id"), F.format_string("a%03d", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 90)).alias("account_id"),
        F.when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("h"), (F.col("id") % 4).cast("string"))).alias("file_hash"),
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 60 AS int))").alias("created_at"))


def _set(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def narrow(spark):
    """Small files: as many ranges as shuffle partitions, none joined."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_replace_rewrites_the_files_of_its_keys_only(spark, tmpdir_path, narrow):
    path, t = os.path.join(tmpdir_path, "t"), _rows(spark)
    first = V.replace(t, path)
    assert first["removed"] == 0 and first["added"] == 8 and V.files(spark, path).agg(F.sum("n_rows")).first()[0] == 4000
    one = t.filter("account_id = 'a050' AND file_hash = 'h2'").limit(1)
    again = V.replace(one, path)
    assert again["removed"] <= 2 and again["kept"] >= 6
    expected = t.join(one.select("account_id", "file_hash"), ["account_id", "file_hash"], "left_anti").select(*t.columns).unionByName(one)
    assert _set(V.read(spark, path).select(*t.columns)) == _set(expected)
    assert V.replace(one, path)["removed"] >= 1 and _set(V.read(spark, path).select(*t.columns)) == _set(expected)   # repeated
    new = one.withColumn("file_hash", F.lit("never seen"))
    assert V.replace(new, path)["removed"] == 0   # a new upload reads keys and rewrites nothing
    nulls = t.filter("account_id = 'a007' AND file_hash IS NULL")
    V.replace(nulls.limit(1), path)
    assert V.read(spark, path).filter("account_id = 'a007' AND file_hash IS NULL").count() == 1


def test_large_account_spreads_over_files(spark, tmpdir_path, narrow):
    path = os.path.join(tmpdir_path, "t")
    V.replace(_rows(spark).withColumn("account_id", F.lit("one")).withColumn("file_hash", F.lit("same")), path)
    assert V.files(spark, path).agg(F.max("n_rows")).first()[0] < 1000


def test_retention_drops_files_and_a_crash_loses_nothing(spark, tmpdir_path):
    path, t = os.path.join(tmpdir_path, "t"), _rows(spark, 600)
    days = t.withColumn("file_hash", F.date_format("created_at", "yyyyMMdd"))
    for lo in ("2024-01-01", "2024-02-01"):   # two uploads, one per month
        V.replace(days.filter(F.trunc("created_at", "month") == F.to_date(F.lit(lo))), path)
    before = _set(V.read(spark, path))
    os.makedirs(os.path.join(path, "log", "3"))   # a job died before its list was complete
    assert _set(V.read(spark, path)) == before
    got = V.expire(spark, path, "2024-03-02", 30)   # on and after February 1st
    assert got["version"] == 4 and got["added"] == 0 and got["removed"] >= 1
    assert _set(V.read(spark, path)) == _set(days.filter("created_at >= '2024-02-01'").select(*V.read(spark, path).columns))
    assert _set(V.read(spark, path, 2)) == before   # the version before is whole
    assert V.expire(spark, path, "2024-03-12", 30)["added"] >= 1   # February 11th: a file with both
    assert V.sweep(spark, path) >= 2 and V.versions(spark, path) == [5]
    assert V.read(spark, path).agg(F.min("created_at")).first()[0].isoformat() == "2024-02-11T00:00:00"
    V.expire(spark, path, "2025-01-01", 1)
    assert V.read(spark, path).count() == 0 and V.read(spark, path).columns == days.columns
    with pytest.raises(ValueError):
        V.read(spark, os.path.join(tmpdir_path, "nothing"))


def test_rows_without_a_time_expire(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "t")
    rows = spark.createDataFrame([(1, "a", "h", "2024-05-01"), (2, "a", "h", None), (3, "b", "h", "2024-01-01")],
                                 "txn_id long, account_id string, file_hash string, t string")
    V.replace(rows.selectExpr("txn_id", "account_id", "file_hash", "CAST(t AS TIMESTAMP) AS created_at"), path)
    V.expire(spark, path, "2024-05-02", 30)
    assert [r["txn_id"] for r in V.read(spark, path).collect()] == [1]


def test_constraints(spark):
    rows = spark.createDataFrame([("s1", None), ("s1", "b"), (None, "c"), ("s9", "d"), ("s9", "e")], "session_id string, settings string")
    rules = KC.Rules(not_null=("session_id", "settings"), unique=("session_id",), references=(("session_id", "id"),))
    parent = spark.createDataFrame([("s1",), ("s1",), (None,)], "id string")
    got = {(r["constraint"], r["column"], r["key"]): r["n_rows"] for r in KC.violations(rows, rules, parent).collect()}
    assert got == {("not null", "session_id", None): 1, ("not null", "settings", None): 1, ("unique", "session_id", "s1"): 2,
                   ("unique", "session_id", "s9"): 2, ("foreign key", "session_id", "s9"): 2}
    good, bad = KC.admit(rows, rules, parent, ("settings",))
    assert good.count() == 0 and good.columns == rows.columns
    assert {(r["session_id"], r["settings"]): r["broken"] for r in bad.collect()} == {
        ("s1", None): ["not null settings"], ("s1", "b"): ["unique session_id"], (None, "c"): ["not null session_id"],
        ("s9", "d"): ["foreign key session_id"], ("s9", "e"): ["foreign key session_id", "unique session_id"]}
    assert KC.violations(rows.limit(0), rules, parent).count() == 0
