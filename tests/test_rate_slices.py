"""Rates by date where one slice of time holds many of them."""

from pyspark.sql import functions as F

from ledgerlake.operators import dated_rates as DR


def test_rates_of_a_slice_are_not_gathered(spark):
    """Many rates of one hour and the last one of the hour before; no row holds a list of them."""
    live = spark.range(5000).select(F.lit("EUR").alias("currency"), (F.col("id") + 1).cast("double").alias("per_usd"),
                                    (F.lit(3_600_000_000) - 2_000_000 + F.col("id") * 1000).alias("us")).withColumn("as_of", F.timestamp_micros("us"))
    df = spark.createDataFrame([(1, 3_599_000_500), (2, 3_600_000_000), (3, 3_602_000_999), (4, 7_202_998_999), (5, 7_202_999_000)], "id long, us long").select(
        "id", F.timestamp_micros("us").alias("ts"), F.lit("eur").alias("currency"), F.lit(1.0).alias("amount"))
    out = DR.with_dated_rate(df, live, F.col("currency"), "ts", "rate", fallback=spark.createDataFrame([("EUR", -1.0)], "currency string, per_usd double"))
    assert {r["id"]: r["rate"] for r in out.collect()} == {1: 1001.0, 2: 2001.0, 3: 4001.0, 4: 5000.0, 5: -1.0}
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
