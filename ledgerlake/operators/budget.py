"""Budget recommendations and alerts.

Plan shape (per key, e.g. account):
  1. An aggregation by (keys, month) followed by one by keys computes the mean monthly
     income (mean over months with income of the monthly sum), the all-time expense of each
     of the 11 budget categories and the total expense — partial aggregation throughout.
  2. The 11 recommendation rows per key are produced by a generator (``inline`` over a fixed
     array of (category, share) structs) — no join against a budget table, no cross join.
  3. The primary currency (for the formatted strings) is a second per-key aggregate; both
     sides are hash-partitioned on ``keys`` so the join adds no exchange.
Keys without income get no recommendations (reference quirk Q9 fixed: no NaN rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.dims import BUDGET_SHARES
from ledgerlake.functions.formatting import format_currency_report, percent_text, report_format_info
from ledgerlake.operators.spending import MONEY, _k, month_label, msum, primary_currency_volume

SAVINGS_TARGET = 0.8     # total expenses should stay under 80 % of income
MIN_SAVINGS_RATE = 0.2
ALERT_OVER = 0.2         # category alert when savings potential > 20 % of recommended
ALERT_HIGH = 0.5         # ... severity high above 50 %


def budget_inputs(df: DataFrame, keys=None) -> DataFrame:
    """Per key: mean monthly income, current spend per budget category, total expense.

    Two aggregations: (keys, month) then (keys). The second runs over at most one row per
    month per key, and the mean is taken over months that have income (``avg`` skips NULL).
    """
    k = _k(keys)
    a = F.col("amount")
    m = a.cast(MONEY)   # exact cents; summed as DECIMAL, reported as DOUBLE
    aggs = [F.sum(F.when(a > 0, m)).alias("_inc"), F.sum(F.when(a < 0, -m)).alias("_tot")]
    for i, (cat, _) in enumerate(BUDGET_SHARES):
        aggs.append(F.sum(F.when((a < 0) & (F.col("category") == cat), -m)).alias(f"_c{i}"))
    per_month = df.groupBy(*k, month_label(F.col("date")).alias("_month")).agg(*aggs)
    def dsum(c):
        return F.sum(c).cast("double")
    outs = [(dsum("_inc") / F.count("_inc")).alias("monthly_income"),
            F.count("_inc").alias("income_months"), F.count("_tot").alias("expense_months"),
            F.coalesce(dsum("_tot"), F.lit(0.0)).alias("total_current")]
    outs += [F.coalesce(dsum(f"_c{i}"), F.lit(0.0)).alias(f"_c{i}") for i in range(len(BUDGET_SHARES))]
    return per_month.groupBy(*k).agg(*outs)


def _with_currency(inputs: DataFrame, df: DataFrame, k: list[str], primary_currency: str | None) -> DataFrame:
    if primary_currency is not None:
        return inputs.withColumn("currency", F.lit(primary_currency))
    pc = primary_currency_volume(df, k).withColumnRenamed("primary_currency", "currency")
    if k:
        return inputs.join(pc, k, "left")
    # no keys: the primary currency is a single value -> scalar subquery, not a join
    return inputs.withColumn("currency", pc.select("currency").scalar())


def recommendations(df: DataFrame, keys=None, primary_currency: str | None = None, current_basis: str = "total") -> DataFrame:
    """B1: one row per (key, budget category).

    ``current_basis`` (Q11): "total" holds all-time spend against a month's recommendation, as the
    reference application does; "monthly_avg" holds the mean over months that have expenses."""
    if current_basis not in ("total", "monthly_avg"):
        raise ValueError(f"current_basis is 'total' or 'monthly_avg', not {current_basis!r}")
    k = _k(keys)
    inp = budget_inputs(df, k).filter(F.col("monthly_income").isNotNull())
    if current_basis == "monthly_avg":
        months = F.greatest("expense_months", F.lit(1))   # no expenses: 0 a month
        inp = inp.withColumns({c: F.col(c) / months for c in ("total_current", *(f"_c{i}" for i in range(len(BUDGET_SHARES))))})
    inp = _with_currency(inp, df, k, primary_currency)
    entries = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(i).alias("category_ord"),
                                 F.lit(s).alias("share"), F.col(f"_c{i}").alias("current"))
                        for i, (c, s) in enumerate(BUDGET_SHARES)])
    rows = inp.select(*k, "monthly_income", "total_current", "currency",
                      report_format_info(F.col("currency")).alias("_fmt"), F.inline(entries))
    rec = F.col("monthly_income") * F.col("share")
    cur = F.col("current")
    return rows.select(
        *k, "category", "category_ord",
        F.round(rec, 2).alias("recommended"),
        F.round(cur, 2).alias("current"),
        F.round(rec - cur, 2).alias("difference"),
        F.round(F.col("share") * 100, 1).alias("percentage_of_income"),
        format_currency_report(rec, F.col("currency"), F.col("_fmt")).alias("formatted_recommended"),
        format_currency_report(cur, F.col("currency"), F.col("_fmt")).alias("formatted_current"),
        format_currency_report(rec - cur, F.col("currency"), F.col("_fmt")).alias("formatted_difference"),
        F.col("currency"),
        F.when(cur <= rec, F.lit("Under Budget")).otherwise(F.lit("Over Budget")).alias("status"),
        (rec).alias("_rec"), (cur).alias("_cur"),
        F.col("monthly_income").alias("_income"), F.col("total_current").alias("_total"),
        F.col("_fmt"),
    )


def _public(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def savings_potential(rec: DataFrame, keys=None) -> DataFrame:
    """B2: current − recommended where positive."""
    k = _k(keys)
    return (rec.filter(F.col("_cur") > F.col("_rec"))
            .select(*k, "category", F.round(F.col("_cur") - F.col("_rec"), 2).alias("savings")))


def alerts(rec: DataFrame, keys=None) -> DataFrame:
    """Category alerts, overall alert, savings-rate alert; one tidy table.

    Each recommendation row carries its alerts (the first category's row those of the whole
    budget too) and is unfolded once, so the recommendations are computed once."""
    k = _k(keys)
    sav = F.col("_cur") - F.col("_rec")
    money = lambda c: format_currency_report(c, F.col("currency"), F.col("_fmt"))
    first = F.col("category_ord") == 0
    rate = (F.col("_income") - F.col("_total")) / F.col("_income")

    def alert(cond, category, message, severity):
        return F.when(cond, F.struct(category.alias("category"), message.alias("message"), severity.alias("severity")))
    found = F.array(
        alert((F.col("_cur") > F.col("_rec")) & (sav > F.col("_rec") * ALERT_OVER), F.col("category"),
              F.concat(F.lit("You are spending "), money(sav), F.lit(" more than recommended in "), F.col("category")),
              F.when(sav > F.col("_rec") * ALERT_HIGH, F.lit("high")).otherwise(F.lit("medium"))),
        alert(first & (F.col("_total") > F.col("_income") * SAVINGS_TARGET), F.lit("overall"),
              F.concat(F.lit("Your total spending ("), money(F.col("_total")), F.lit(") exceeds the recommended budget ("),
                       money(F.col("_income") * SAVINGS_TARGET), F.lit(")")), F.lit("high")),
        alert(first & (F.col("_income") > 0) & (rate < MIN_SAVINGS_RATE), F.lit("savings"),
              F.concat(F.lit("Your savings rate is "), percent_text(rate),
                       F.lit(". Consider increasing it to at least 20%")), F.lit("medium")))
    return rec.select(*k, F.inline(F.filter(found, lambda x: x.isNotNull())))


def budget_vs_actual(rec: DataFrame, keys=None) -> DataFrame:
    """difference = actual − recommended (opposite sign to B1)."""
    k = _k(keys)
    return rec.select(*k, "category", F.round("_rec", 2).alias("recommended"),
                      F.round("_cur", 2).alias("actual"),
                      F.round(F.col("_cur") - F.col("_rec"), 2).alias("difference"))


def budget_totals(rec: DataFrame, keys=None) -> DataFrame:
    """Totals of the (rounded) recommended and current amounts per key."""
    k = _k(keys)
    # the UI sums the already rounded per-category values: exact cents
    return rec.groupBy(*k).agg(
        F.round(msum(F.round("_rec", 2)), 2).alias("total_recommended"),
        F.round(msum(F.round("_cur", 2)), 2).alias("total_current"))


def budget_long(rec: DataFrame, keys=None) -> DataFrame:
    """B8 + V7: long format (category, type, amount) for categories with recommended > 0."""
    k = _k(keys)
    wide = (rec.filter(F.col("_rec") > 0)
            .select(*k, "category", F.round("_rec", 2).alias("Recommended"),
                    F.round("_cur", 2).alias("Current")))
    return wide.unpivot([*k, "category"], ["Recommended", "Current"], "type", "amount")


def public(rec: DataFrame) -> DataFrame:
    return _public(rec)
