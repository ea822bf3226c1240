"""Rates by date against a search through all rates; monthly alerts against a fold over all rows."""

import datetime as dt
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import dated_rates as DR
from ledgerlake.streaming import budgets as MB

EPOCH = dt.datetime(2024, 1, 1)


def test_last_rate_that_holds(spark):
    rnd = random.Random(5)
    rates = [(rnd.choice(["EUR", "gbp", "JPY"]), round(rnd.uniform(0.5, 2), 4), EPOCH + dt.timedelta(seconds=rnd.randrange(0, 40_000))) for _ in range(60)]
    rates += [("EUR", None, EPOCH), (None, 1.0, EPOCH), ("EUR", 9.0, None), ("EUR", 1.5, EPOCH + dt.timedelta(seconds=100)), ("EUR", 1.6, EPOCH + dt.timedelta(seconds=100))]
    txns = [(i, rnd.choice(["eur", "GBP", "JPY", "USD", "XXX"]), 10.0, EPOCH + dt.timedelta(seconds=rnd.randrange(-5000, 60_000))) for i in range(300)]
    txns += [(900, "EUR", 1.0, EPOCH + dt.timedelta(seconds=100)), (901, None, 1.0, EPOCH), (902, "EUR", 1.0, None)]
    txns += [(903 + i, "EUR", 1.0, t + dt.timedelta(seconds=s)) for i, (t, s) in enumerate((r[2], s) for r in rates[:5] if r[0] == "EUR" for s in (0, 3599, 3600))]
    fallback = [("EUR", 0.9), ("GBP", 0.8), ("JPY", 150.0), ("USD", 1.0)]
    df = spark.createDataFrame(txns, "id long, currency string, amount double, ts timestamp")
    live = spark.createDataFrame(rates, "currency string, per_usd double, as_of timestamp")
    base = spark.createDataFrame(fallback, "currency string, per_usd double")
    got = {r["id"]: r for r in DR.convert_dated(df, "GBP", live, fallback=base).collect()}
    assert len(got) == len(txns)

    def per_usd(code, ts):
        held = [(r[2], r[1]) for r in rates if r[0] and r[0].upper() == code and r[1] is not None and r[2] is not None and ts and r[2] <= ts < r[2] + dt.timedelta(hours=1)]
        return (max(held)[1], "live") if held else (dict(fallback).get(code), "fallback" if code in dict(fallback) else "missing")
    for i, cur, amount, ts in txns:
        code = cur and cur.upper()
        (f, fs), (t, tsrc) = per_usd(code, ts), per_usd("GBP", ts)
        rate = 1.0 if code == "GBP" else t if code == "USD" else (1.0 / (f if f is not None else 1.0)) * t
        assert got[i]["converted"] == pytest.approx(amount * rate)
        fs = "live" if code == "USD" else fs
        assert got[i]["rate_source"] == ("same" if code == "GBP" else min(fs, tsrc, key=["missing", "fallback", "live"].index))


def drop(spark, rows, path, parts=2):
    spark.createDataFrame(rows, MB.ROWS).repartition(parts).write.mode("append").parquet(path)


def brute(rows, income):
    spend = defaultdict(int)
    for r in set(rows):
        if r[4] < 0 and r[2]:
            spend[(r[1], r[2].strftime("%Y-%m"), r[5] or "other")] += round(-r[4] * 100)
    limits = dict(MB.BUDGET_SHARES)
    return spend, Counter((a, m, c, kind) for (a, m, c), x in spend.items() for kind, share in MB.LEVELS if c in limits and x > round(limits[c] * income * share * 100))


def test_alerts_once_over_batches_copies_and_a_crash(spark, tmpdir_path):
    rnd = random.Random(7)
    rows = [(i, rnd.randrange(6), dt.date(2024, 1, 1) + dt.timedelta(days=i // 5), f"shop {i % 7}", -rnd.uniform(1, 400), rnd.choice(["food", "travel", "hobby", None, "shopping"]))
            for i in range(600)] + [(1000, 1, dt.date(2024, 2, 2), "pay", 4000.0, "income"), (1001, 1, None, "undated", -5.0, "food")]
    rows.sort(key=lambda r: r[2] or dt.date(2024, 1, 1))
    source, out = os.path.join(tmpdir_path, "drops"), os.path.join(tmpdir_path, f"alerts-{os.path.basename(tmpdir_path)}")
    for lo in range(0, len(rows), 150):
        drop(spark, rows[lo:lo + 150], source)
        drop(spark, rows[max(0, lo - 60):lo + 90], source)      # the same rows under other names, and again within a batch
    with pytest.raises(Exception, match="killed"):
        MB.run_monthly_alerts(spark, source, out, 3000.0, files=2, fail_in=1)
    MB.run_monthly_alerts(spark, source, out, 3000.0, files=2)
    got = MB.alerts(spark, out).collect()
    spend, want = brute(rows, 3000.0)
    assert Counter((r["account_id"], r["month"], r["category"], r["kind"]) for r in got if r["kind"] in ("medium", "high")) == want
    assert len(want) > 10 and len({r["batch_id"] for r in got}) > 2
    closed = {(r["account_id"], r["month"], r["category"]): round(r["spend"] * 100) for r in got if r["kind"] == "closed"}
    assert closed and all(spend[k] == v for k, v in closed.items())
    # a row for a month that is closed is counted, and nothing changes
    drop(spark, [(5000, 2, dt.date(2024, 1, 3), "late", -900.0, "food")], source, 1)
    query = MB.run_monthly_alerts(spark, source, out, 3000.0, files=2)
    assert MB.late_rows(query) == 1
    assert Counter(MB.alerts(spark, out).drop("batch_id").collect()) == Counter(r[:-1] for r in got)


def test_months_are_not_visited_account_by_account(spark, tmpdir_path):
    source, out = os.path.join(tmpdir_path, "drops"), os.path.join(tmpdir_path, f"wide-{os.path.basename(tmpdir_path)}")
    spark.range(3000).select(F.col("id").alias("txn_id"), F.when(F.col("id") > 0, F.col("id")).alias("account_id"), F.lit(dt.date(1999, 12, 5)).alias("date"), F.lit("x").alias("description"),
                             F.lit(-1e6).alias("amount"), F.lit("food").alias("category")).write.parquet(source)
    query = MB.run_monthly_alerts(spark, source, out, 3000.0, files=2)
    got = MB.alerts(spark, out)
    assert {(r["month"], r["kind"]): r["count"] for r in got.groupBy("month", "kind").count().collect()} == {("1999-12", "medium"): 3000, ("1999-12", "high"): 3000}
    assert got.filter("account_id IS NULL").count() == 2
    assert not any(op["operatorName"].startswith("applyInPandas") for p in query.recentProgress for op in p["stateOperators"])
