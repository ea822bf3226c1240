"""Rates by date (J2): the last rate seen on or before a transaction, if it still holds.

A live rate holds for ``validity`` seconds (one hour); beyond that, and before the first one, the
fallback rate of the currency counts. This is an as-of join with a bounded look-back: the different
(currency, time) pairs that transactions ask for are put among the rates, in groups of a currency and a slice of time
of the validity's length, and one sorted pass over a group carries the last rate along. Of the slice
before only its last rate can hold, so each slice begins with that one. The answers return to
the transactions by an equi-join on currency and time, where ordinary skew handling applies: a moment that many
transactions share is asked for once. No list of rates is built, so a slice may hold any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.dims import fx_rates_dim
from ledgerlake.operators.fx import pair_rate

VALIDITY = 3600


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def held_rates(asked: DataFrame, rates: DataFrame, validity: int = VALIDITY) -> DataFrame:
    """``asked`` (code, at: different pairs, at in microseconds) that a live rate holds for, with ``held``, the last one.

    Of several rates of one moment the highest counts; rates without a code, a time or a value do not."""
    span = validity * 1_000_000
    one = (rates.filter(F.col("per_usd").isNotNull() & F.col("as_of").isNotNull() & F.col("currency").isNotNull())
           .select(F.upper("currency").alias("code"), _seconds(F.col("as_of")).alias("at"), F.col("per_usd").cast("double").alias("rate"))
           .withColumn("slice", F.floor(F.col("at") / span)))
    # numbers only, so that the aggregate stays in a hash table: the last moment, then its highest rate
    ends = one.groupBy("code", "slice").agg(F.max("at").alias("at"))
    carried = one.join(ends, ["code", "slice", "at"], "left_semi").withColumn("slice", F.col("slice") + 1)
    line = (one.unionByName(carried).withColumn("asks", F.lit(False))
            .unionByName(asked.select("code", "at", F.lit(None).cast("double").alias("rate"), F.floor(F.col("at") / span).alias("slice"), F.lit(True).alias("asks"))))
    # rates before what is asked at the same moment, the highest last
    past = Window.partitionBy("code", "slice").orderBy("at", "asks", "rate").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(~F.col("asks"), F.struct("at", "rate")), ignorenulls=True).over(past)
    return (line.withColumn("last", last).filter(F.col("asks") & (F.col("at") - F.col("last.at") < span))
            .select("code", "at", F.col("last.rate").alias("held")))


def with_dated_rate(df: DataFrame, rates: DataFrame, currency: Column, ts: str, name: str, validity: int = VALIDITY, fallback: DataFrame | None = None) -> DataFrame:
    """``df`` with ``name`` (units per USD at the row's time, null if the currency is unknown) and
    ``<name>_source``: 'live' or 'fallback'."""
    default = fx_rates_dim(df.sparkSession) if fallback is None else fallback
    default = default.groupBy(F.upper("currency").alias("_default_currency")).agg(F.max("per_usd").alias("_default"))
    keyed = df.withColumn("_code", F.upper(currency)).withColumn("_at", _seconds(F.col(ts)))
    asked = keyed.select(F.col("_code").alias("code"), F.col("_at").alias("at")).filter(F.col("code").isNotNull() & F.col("at").isNotNull()).distinct()
    found = held_rates(asked, rates, validity).toDF("_held_code", "_held_at", "_held")
    joined = (keyed.join(found, (F.col("_code") == F.col("_held_code")) & (F.col("_at") == F.col("_held_at")), "left")
              .join(default, F.col("_code") == F.col("_default_currency"), "left"))
    return (joined.withColumn(name, F.coalesce("_held", "_default"))
            .withColumn(f"{name}_source", F.when(F.col("_held").isNotNull(), "live").when(F.col("_default").isNotNull(), "fallback"))
            .drop("_code", "_at", "_held_code", "_held_at", "_held", "_default_currency", "_default"))


def convert_dated(df: DataFrame, target: str, rates: DataFrame, ts: str = "ts", amount: str = "amount", currency: str = "currency",
                  validity: int = VALIDITY, fallback: DataFrame | None = None) -> DataFrame:
    """J4 with rates of the transaction's own time: adds conversion_rate, converted and rate_source.

    ``rate_source`` is 'same' without a conversion, 'live' if every rate used was live, else 'fallback'; a currency that is in
    no table counts as 1.0, as in :func:`fx.convert_transactions`, and is 'missing'."""
    out = with_dated_rate(df, rates, F.col(currency), ts, "_from", validity, fallback)
    out = with_dated_rate(out, rates.filter(F.upper("currency") == target.upper()), F.lit(target), ts, "_to", validity, fallback)
    code, to = F.upper(F.col(currency)), F.lit(target.upper())
    used = [F.when(code == "USD", "live").otherwise(F.coalesce("_from_source", F.lit("missing"))),
            F.when(to == "USD", "live").otherwise(F.coalesce("_to_source", F.lit("missing")))]
    # the least sure of the two: missing, fallback, live, in the order of the alphabet reversed
    order = F.array_contains(F.array(*used), "missing"), F.array_contains(F.array(*used), "fallback")
    source = F.when(code == to, "same").when(order[0], "missing").when(order[1], "fallback").otherwise("live")
    return (out.withColumn("conversion_rate", pair_rate(F.col("_from"), F.col("_to"), F.col(currency), F.lit(target)))
            .withColumn("converted", F.col(amount) * F.col("conversion_rate")).withColumn("rate_source", source)
            .drop("_from", "_from_source", "_to", "_to_source"))
