"""Spending aggregates over a ``transactions`` DataFrame (income > 0, expense < 0).

Every operator takes ``keys`` (grouping columns prefixed to every group-by, e.g.
``["account_id"]``) and returns a tidy DataFrame; nothing is collected. Aggregations run as
partial + final HashAggregate, so a hot account is pre-aggregated on the map side before the
shuffle. Where a second step needs the per-key total, it runs over the already aggregated rows
(at most one row per category/currency/weekday per key), never over raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.dims import WEEKDAY_NAMES

Keys = list[str] | tuple[str, ...] | None


def _k(keys: Keys) -> list[str]:
    return list(keys or [])


def round2(c: Column) -> Column:
    return F.round(c, 2)


MONEY = "decimal(18,2)"


def msum(c: Column | str) -> Column:
    """Exact money sum: cents are summed as DECIMAL (order- and partitioning-independent,
    compact-long fast path) and reported as DOUBLE."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast(MONEY)).cast("double")


def mavg(c: Column | str) -> Column:
    """Mean of money values = exact sum / count."""
    c = F.col(c) if isinstance(c, str) else c
    return msum(c) / F.count(c)


def iso_date(c: Column) -> Column:
    """DATE -> 'yyyy-MM-dd' text, the format results are reported in."""
    return F.date_format(c, "yyyy-MM-dd")


def month_label(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def weekday_index(c: Column) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(c)


def weekday_name(idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), (idx + 1).cast("int"))


# ---------------------------------------------------------------------------------------
# V4 / V5 filters
# ---------------------------------------------------------------------------------------

def expenses(df: DataFrame) -> DataFrame:
    """Rows with amount < 0, amount made positive."""
    return df.filter(F.col("amount") < 0).withColumn("amount", F.abs(F.col("amount")))


def income(df: DataFrame) -> DataFrame:
    return df.filter(F.col("amount") > 0)


# ---------------------------------------------------------------------------------------
# A2, A9 totals; A3 average daily expense; A8 analysis period
# ---------------------------------------------------------------------------------------

def spending_totals(df: DataFrame, keys: Keys = None) -> DataFrame:
    """Total and count of expenses, plus the currencies seen in all rows (A2 + A9).

    Keys without any expense are dropped (the reference reports "no expenses" for them).
    """
    k = _k(keys)
    is_exp = F.col("amount") < 0
    return (df.groupBy(*k)
              .agg(msum(F.when(is_exp, -F.col("amount"))).alias("_total"),
                   F.count(F.when(is_exp, 1)).alias("total_transactions"),
                   F.count_distinct("currency").alias("n_currencies"),
                   F.array_join(F.array_sort(F.collect_set("currency")), ",").alias("currencies"))
              .filter(F.col("total_transactions") > 0)
              .select(*k, round2(F.col("_total")).alias("total_expenses"),
                      "total_transactions", "n_currencies", "currencies"))


def avg_daily_expense(df: DataFrame, keys: Keys = None) -> DataFrame:
    """Mean over days that have expenses of the daily expense sum (A3)."""
    k = _k(keys)
    daily = expenses(df).groupBy(*k, "date").agg(msum("amount").alias("day_total"))
    return (daily.groupBy(*k)
                 .agg(round2(mavg("day_total")).alias("avg_daily_expense"),
                      F.count(F.lit(1)).alias("expense_days")))


def analysis_period(df: DataFrame, keys: Keys = None) -> DataFrame:
    """First and last expense date and the days between them."""
    k = _k(keys)
    return (expenses(df).groupBy(*k)
            .agg(F.min("date").alias("_s"), F.max("date").alias("_e"))
            .select(*k, iso_date(F.col("_s")).alias("start_date"),
                    iso_date(F.col("_e")).alias("end_date"),
                    F.datediff(F.col("_e"), F.col("_s")).cast("bigint").alias("days")))


# ---------------------------------------------------------------------------------------
# A4 category breakdown, A19/A22 category series, A13 category summary
# ---------------------------------------------------------------------------------------

def category_breakdown(df: DataFrame, keys: Keys = None) -> DataFrame:
    """Per category: sum, count, mean (rounded 2) and % of the key's total expense (A4).

    The percentage uses the rounded category sum over the unrounded total, as the reference.
    The total comes from a window over the aggregated rows (≤ one row per category per key).
    """
    k = _k(keys)
    per_cat = (expenses(df).groupBy(*k, "category")
               .agg(msum("amount").alias("_sum"),
                    F.count(F.lit(1)).alias("count"),
                    mavg("amount").alias("_mean")))
    total = F.sum(F.col("_sum").cast(MONEY)).over(Window.partitionBy(*k)).cast("double")
    return (per_cat.withColumn("_total", total)
            .select(*k, "category",
                    round2(F.col("_sum")).alias("sum"),
                    F.col("count"),
                    round2(F.col("_mean")).alias("mean"),
                    round2(round2(F.col("_sum")) / F.col("_total") * 100).alias("percentage")))


def category_share(df: DataFrame, keys: Keys = None) -> DataFrame:
    """All-time expense per category and its share of the key's expenses."""
    k = _k(keys)
    per_cat = expenses(df).groupBy(*k, "category").agg(msum("amount").alias("_sum"))
    total = F.sum(F.col("_sum").cast(MONEY)).over(Window.partitionBy(*k)).cast("double")
    return per_cat.select(*k, "category", round2(F.col("_sum")).alias("amount"),
                          round2(F.col("_sum") / total * 100).alias("share_pct"))


def category_summary(df: DataFrame, keys: Keys = None) -> DataFrame:
    """Count and sum of |amount| per category over all rows."""
    k = _k(keys)
    return (df.groupBy(*k, "category")
            .agg(F.count(F.lit(1)).alias("count"),
                 round2(msum(F.abs("amount"))).alias("total")))


# ---------------------------------------------------------------------------------------
# A5/A21 monthly series, A18 mean monthly income
# ---------------------------------------------------------------------------------------

def monthly_spending(df: DataFrame, keys: Keys = None) -> DataFrame:
    k = _k(keys)
    return (expenses(df).groupBy(*k, month_label(F.col("date")).alias("month"))
            .agg(round2(msum("amount")).alias("amount")))


def monthly_income(df: DataFrame, keys: Keys = None) -> DataFrame:
    """Mean over months that have income of the monthly income sum (A18); unrounded value kept
    as ``_monthly_income`` for downstream budget maths."""
    k = _k(keys)
    per_month = (income(df).groupBy(*k, month_label(F.col("date")).alias("month"))
                 .agg(msum("amount").alias("m")))
    return per_month.groupBy(*k).agg(mavg("m").alias("_monthly_income"),
                                     F.count(F.lit(1)).alias("income_months"))


# ---------------------------------------------------------------------------------------
# A6 weekday pattern (sum, all 7 days), A20 weekday mean (days present)
# ---------------------------------------------------------------------------------------

def weekday_pattern(df: DataFrame, keys: Keys = None) -> DataFrame:
    """Expense sum per weekday, 7 rows per key with 0.0 for days without expenses.

    One conditional aggregation (7 sums) followed by an unpivot: no join against a weekday
    dimension and no second shuffle.
    """
    k = _k(keys)
    wd = weekday_index(F.col("date"))
    sums = (expenses(df).groupBy(*k)
            .agg(*[F.coalesce(msum(F.when(wd == i, F.col("amount"))), F.lit(0.0)).alias(f"d{i}")
                   for i in range(7)]))
    long = sums.unpivot(k, [f"d{i}" for i in range(7)], "_d", "_amt") if k else \
        sums.unpivot([], [f"d{i}" for i in range(7)], "_d", "_amt")
    idx = F.substring(F.col("_d"), 2, 1).cast("int")
    return long.select(*k, idx.alias("weekday"), weekday_name(idx).alias("day_name"),
                       round2(F.col("_amt")).alias("amount"))


def weekday_mean(df: DataFrame, keys: Keys = None) -> DataFrame:
    """Mean expense per transaction for each weekday that has expenses."""
    k = _k(keys)
    wd = weekday_index(F.col("date"))
    return (expenses(df).groupBy(*k, wd.alias("weekday"))
            .agg(round2(mavg("amount")).alias("amount"))
            .withColumn("day_name", weekday_name(F.col("weekday"))))


# ---------------------------------------------------------------------------------------
# A7 / T1 top merchants
# ---------------------------------------------------------------------------------------

def top_k_per_key(df: DataFrame, keys: Keys, order: list[Column], k_top: int,
                  item: str, salt_buckets: int = 64) -> DataFrame:
    """Exact top-``k_top`` rows per key by ``order``, skew-safe.

    Stage 1 ranks inside (key, hash(item) mod salt_buckets) and keeps k_top per bucket; stage 2
    ranks the ≤ k_top·salt_buckets survivors per key. A key holding a third of all rows is thus
    spread over ``salt_buckets`` tasks, and no task ever holds more than its bucket.
    """
    k = _k(keys)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(item)), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*k, "_salt").orderBy(*order)
    stage1 = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k_top)
    w2 = Window.partitionBy(*k).orderBy(*order) if k else Window.orderBy(*order)
    return (stage1.withColumn("rank", F.row_number().over(w2))
            .filter(F.col("rank") <= k_top)
            .drop("_salt", "_r"))


def top_merchants(df: DataFrame, keys: Keys = None, n: int = 10) -> DataFrame:
    """Top ``n`` descriptions by expense sum (A7); ties broken by description ascending."""
    k = _k(keys)
    per_desc = expenses(df).groupBy(*k, "description").agg(msum("amount").alias("_sum"))
    order = [F.col("_sum").desc(), F.col("description").asc()]
    if not k:
        # Global top-k: TakeOrderedAndProject keeps n rows per partition, then merges.
        ranked = per_desc.orderBy(*order).limit(n)
        ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    else:
        ranked = top_k_per_key(per_desc, k, order, n, "description")
    return ranked.select(*k, "rank", "description", round2(F.col("_sum")).alias("amount"))


# ---------------------------------------------------------------------------------------
# A10–A12 primary currency
# ---------------------------------------------------------------------------------------

def _argmax(per: DataFrame, keys: list[str], score: str, item: str, out: str) -> DataFrame:
    """Per key, the ``item`` with the largest ``score``; ties go to the smallest item.
    ``min_by`` over (−score, item) is an ordinary aggregate: partial + final, no window."""
    return per.groupBy(*keys).agg(
        F.min_by(F.col(item), F.struct((-F.col(score)).alias("s"), F.col(item).alias("i"))).alias(out))


def primary_currency_volume(df: DataFrame, keys: Keys = None) -> DataFrame:
    """Currency with the largest Σ|amount| (A10)."""
    k = _k(keys)
    per = df.groupBy(*k, "currency").agg(msum(F.abs("amount")).alias("volume"))
    return _argmax(per, k, "volume", "currency", "primary_currency")


def primary_currency_frequency(df: DataFrame, keys: Keys = None) -> DataFrame:
    """Most frequent currency."""
    k = _k(keys)
    per = df.groupBy(*k, "currency").agg(F.count(F.lit(1)).alias("n"))
    return _argmax(per, k, "n", "currency", "primary_currency")


def primary_currency_blended(df: DataFrame, keys: Keys = None) -> DataFrame:
    """0.7 × share of rows + 0.3 × share of Σ|amount| (A11); a zero total value gives 0."""
    k = _k(keys)
    per = df.groupBy(*k, "currency").agg(F.count(F.lit(1)).alias("n"),
                                          msum(F.abs("amount")).alias("v"))
    w = Window.partitionBy(*k)
    scored = per.withColumn(
        "score",
        F.lit(0.7) * F.col("n") / F.sum("n").over(w)
        + F.lit(0.3) * F.coalesce(F.try_divide(
            F.col("v"), F.sum(F.col("v").cast(MONEY)).over(w).cast("double")), F.lit(0.0)))
    return _argmax(scored, k, "score", "currency", "primary_currency")


# ---------------------------------------------------------------------------------------
# A16 simple analysis, A17 headline metrics, currency breakdown
# ---------------------------------------------------------------------------------------

def simple_analysis(df: DataFrame, keys: Keys = None) -> DataFrame:
    k = _k(keys)
    a = F.col("amount")
    return (df.groupBy(*k)
            .agg(F.count(F.lit(1)).alias("total_transactions"),
                 msum(F.abs(a)).alias("_tot"),
                 F.coalesce(msum(F.when(a < 0, -a)), F.lit(0.0)).alias("_exp"),
                 F.coalesce(msum(F.when(a > 0, a)), F.lit(0.0)).alias("_inc"))
            .select(*k, "total_transactions",
                    round2(F.col("_tot")).alias("total_amount"),
                    round2(F.col("_exp")).alias("total_expenses"),
                    round2(F.col("_inc")).alias("total_income"),
                    round2(F.col("_tot") / F.col("total_transactions")).alias("average_transaction")))


def currency_breakdown(df: DataFrame, keys: Keys = None) -> DataFrame:
    """Σ|amount| per currency over all rows, income included (A16 currency part, T2)."""
    k = _k(keys)
    return (df.groupBy(*k, "currency")
            .agg(round2(msum(F.abs("amount"))).alias("amount"),
                 F.count(F.lit(1)).alias("count")))


def headline_metrics(df: DataFrame, keys: Keys = None) -> DataFrame:
    """Row count, Σ|amount|, signed sum, distinct categories and currencies.

    Rows are reduced to one per (keys, category, currency) first; the distinct counts then count the
    first row of each category and of each currency, so nothing is expanded."""
    k = _k(keys)
    m = F.col("amount").cast(MONEY)
    per = df.groupBy(*k, "category", "currency").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.abs(m)).alias("_abs"), F.sum(m).alias("_net"))

    def first(of: str, other: str):
        row = F.row_number().over(Window.partitionBy(*k, of).orderBy(other))
        return F.when(F.col(of).isNotNull() & (row == 1), 1)
    per = per.withColumn("_c", first("category", "currency")).withColumn("_u", first("currency", "category"))
    return (per.groupBy(*k)
            .agg(F.sum("_n").alias("total_rows"),
                 round2(F.sum("_abs").cast("double")).alias("total_amount"),
                 round2(F.sum("_net").cast("double")).alias("net_amount"),
                 F.count("_c").alias("n_categories"), F.count("_u").alias("n_currencies")))


def currency_ranking(df: DataFrame, keys: Keys = None) -> DataFrame:
    """Currencies by descending Σ|amount| (ties by code), with their place."""
    k = _k(keys)
    w = Window.partitionBy(*k).orderBy(F.col("amount").desc(), "currency")
    return currency_breakdown(df, k).withColumn("place", F.row_number().over(w)).orderBy(*k, "place")


def null_cell_counts(df: DataFrame, keys: Keys = None) -> DataFrame:
    """Null cells per column, one row per key."""
    k = _k(keys)
    cols = [c for c in df.columns if c not in k]
    return df.groupBy(*k).agg(
        *[F.sum(F.col(c).isNull().cast("bigint")).alias(f"nulls_{c}") for c in cols])


# ---------------------------------------------------------------------------------------
# A1 analysis bundle in one scan (GROUPING SETS)
# ---------------------------------------------------------------------------------------

def spending_facets(df: DataFrame, keys: Keys = None) -> DataFrame:
    """Totals, per-category, per-month and per-weekday expense sums in ONE aggregation pass.

    ``GROUPING SETS((keys), (keys, category), (keys, month), (keys, weekday))`` — Spark expands
    each row four times before the partial aggregate, so the shuffle carries pre-aggregated
    rows only. ``facet`` names which set a row belongs to.
    """
    k = _k(keys)
    e = (expenses(df)
         .withColumn("month", month_label(F.col("date")))
         .withColumn("weekday", weekday_index(F.col("date"))))
    g = e.groupingSets(
        [[*k], [*k, "category"], [*k, "month"], [*k, "weekday"]],
        *k, "category", "month", "weekday")
    res = g.agg(msum("amount").alias("_sum"), F.count(F.lit(1)).alias("count"),
                F.grouping_id().alias("_gid"))
    # grouping_id bits (category, month, weekday): 1 = rolled up.
    gid = F.col("_gid")
    facet = (F.when(gid == 3, F.lit("category")).when(gid == 5, F.lit("month"))
             .when(gid == 6, F.lit("weekday")).otherwise(F.lit("total")))
    label = (F.when(gid == 3, F.col("category")).when(gid == 5, F.col("month"))
             .when(gid == 6, weekday_name(F.col("weekday"))).otherwise(F.lit("all")))
    return res.select(*k, facet.alias("facet"), label.alias("label"),
                      round2(F.col("_sum")).alias("amount"), F.col("count"))
