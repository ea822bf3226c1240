"""Currency conversion through a broadcast rate table.

Rates are an input table ``fx_rates(currency, per_usd, as_of, source)`` — units per 1 USD.
The default is the static fallback table (129 rows, see ``ledgerlake.dims``); a live feed is
just another table with the same schema, combined with :func:`resolve_rates`.
A pair rate is (1 / from.per_usd) · to.per_usd; a currency missing from the table counts as
1.0 and is flagged ``rate_missing``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.dims import fx_rates_dim, MAX_DIM_ROWS
from ledgerlake.operators.spending import msum

# converted amounts are not whole cents: sum them exactly at 10 decimals
CONVERTED = "decimal(28,10)"


def resolve_rates(live: DataFrame | None, fallback: DataFrame) -> DataFrame:
    """A live rate wins over the fallback for the same currency (``coalesce``)."""
    if live is None:
        return fallback
    l = live.select(F.upper("currency").alias("currency"), F.col("per_usd").alias("_live"),
                    F.col("as_of").alias("_las"), F.col("source").alias("_lsrc"))
    return (fallback.join(l, "currency", "full_outer")
            .select("currency",
                    F.coalesce("_live", "per_usd").alias("per_usd"),
                    F.coalesce("_las", "as_of").alias("as_of"),
                    F.coalesce("_lsrc", "source").alias("source")))


def one_rate(rates: DataFrame) -> DataFrame:
    """(currency, per_usd): one row per upper-cased code, of several the latest ``as_of`` (then the highest)."""
    order = F.struct(*[c for c in ("as_of", "per_usd") if c in rates.columns])
    return (rates.filter(F.col("per_usd").isNotNull()).groupBy(F.upper("currency").alias("currency"))
            .agg(F.max_by("per_usd", order).alias("per_usd")))


def pair_rate(from_rate: Column, to_rate: Column, from_cur: Column, to_cur: Column) -> Column:
    """Rate from → to via USD; identical codes give exactly 1.0."""
    fr = F.coalesce(from_rate, F.lit(1.0))
    tr = F.coalesce(to_rate, F.lit(1.0))
    return (F.when(F.upper(from_cur) == F.upper(to_cur), F.lit(1.0))
             .when(F.upper(from_cur) == "USD", tr)
             .when(F.upper(to_cur) == "USD", F.lit(1.0) / fr)
             .otherwise(F.lit(1.0) / fr * tr))


def with_rate(df: DataFrame, target: str, rates: DataFrame | None = None,
              currency_column: str = "currency") -> DataFrame:
    """Add ``conversion_rate`` (and ``rate_missing``) for converting ``currency_column`` to
    ``target``. The default table has 129 rows and is broadcast; a caller's table is reduced to one
    row per code and joined as Spark sees fit by its size. The target's own rate is a scalar
    subquery over the same table, so no second join is needed."""
    spark = df.sparkSession
    if rates is None:
        rates = fx_rates_dim(spark)                      # fixed 129 rows, one per code
        r = F.broadcast(rates.select(F.upper("currency").alias("_rc"), F.col("per_usd").alias("_from")))
    else:
        rates = one_rate(rates)
        r = rates.select(F.col("currency").alias("_rc"), F.col("per_usd").alias("_from"))
    to_rate = (rates.filter(F.upper("currency") == target.upper())
               .agg(F.max("per_usd").alias("per_usd")).scalar())
    joined = df.join(r, F.upper(F.col(currency_column)) == F.col("_rc"), "left")
    rate = pair_rate(F.col("_from"), to_rate, F.col(currency_column), F.lit(target))
    return (joined.withColumn("conversion_rate", rate)
            .withColumn("rate_missing", (F.col("_from").isNull() &
                                         (F.upper(F.col(currency_column)) != target.upper())))
            .drop("_rc", "_from"))


def convert_transactions(df: DataFrame, target: str = "USD", rates: DataFrame | None = None) -> DataFrame:
    """J4 with the fixes Q2/Q7: every row gets original_amount, original_currency,
    conversion_rate and display_currency; ``amount`` is in the target and ``currency`` becomes
    the target, so converting twice does not multiply twice (re-convert from original_*)."""
    src_amount = F.col("original_amount") if "original_amount" in df.columns else F.col("amount")
    src_cur = F.col("original_currency") if "original_currency" in df.columns else F.col("currency")
    base = (df.withColumn("original_amount", src_amount)
              .withColumn("original_currency", F.coalesce(src_cur, F.lit("USD"))))
    conv = with_rate(base, target, rates, currency_column="original_currency")
    return (conv.withColumn("amount", F.col("original_amount") * F.col("conversion_rate"))
                .withColumn("currency", F.lit(target))
                .withColumn("display_currency", F.lit(target)))


def convert_dataframe(df: DataFrame, target: str = "USD", amount_column: str = "amount",
                      currency_column: str = "currency", rates: DataFrame | None = None) -> DataFrame:
    """Parametrised column names; keeps the currency column, always sets original_*."""
    base = (df.withColumn("original_amount", F.col(amount_column))
              .withColumn("original_currency", F.col(currency_column))
              .withColumn("display_currency", F.lit(target)))
    conv = with_rate(base, target, rates, currency_column=currency_column)
    return conv.withColumn(amount_column, F.col(amount_column) * F.col("conversion_rate"))


def convert_amount(amount: Column, from_cur: Column, to_cur: str, rates_map: Column | None = None) -> Column:
    """J3 as a column expression over a literal rate map (no join): amount · rate."""
    from ledgerlake.dims import fallback_rates
    m = rates_map if rates_map is not None else F.create_map(
        *[x for c, r in fallback_rates() for x in (F.lit(c), F.lit(r))])
    rate = pair_rate(F.element_at(m, F.upper(from_cur)), F.lit(dict(fallback_rates()).get(to_cur.upper())),
                     from_cur, F.lit(to_cur))
    return amount * rate


def supported_currencies(spark) -> DataFrame:
    """J6."""
    return fx_rates_dim(spark).select("currency")


def conversion_summary(df: DataFrame, target: str = "USD", keys=None,
                       rates: DataFrame | None = None) -> DataFrame:
    """Per (keys, original currency) count, Σ|amount| and the rate to ``target``.
    Summarises from ``original_currency`` when present (fix of Q16)."""
    k = list(keys or [])
    cur = "original_currency" if "original_currency" in df.columns else "currency"
    amt = "original_amount" if "original_amount" in df.columns else "amount"
    per = (df.groupBy(*k, F.col(cur).alias("currency"))
             .agg(F.count(F.lit(1)).alias("count"),
                  msum(F.abs(amt)).alias("_total")))
    rated = with_rate(per, target, rates)
    return rated.select(*k, "currency", "count", F.round("_total", 2).alias("total"),
                        F.round("conversion_rate", 6).alias("rate_to_target"),
                        F.lit(target).alias("target_currency"))


def conversion_stats(converted: DataFrame, keys=None) -> DataFrame:
    """Per (original_currency, display_currency) count, Σ|original|, Σ|converted|."""
    k = list(keys or [])
    return (converted.groupBy(*k, "original_currency", "display_currency")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.round(msum(F.abs("original_amount")), 2).alias("total_original"),
                 F.round(F.sum(F.abs("amount").cast(CONVERTED)).cast("double"), 2).alias("total_converted")))


assert MAX_DIM_ROWS >= 129
