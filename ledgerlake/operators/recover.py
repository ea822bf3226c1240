"""Five-strategy row recovery for damaged statement rows (P1–P7), as column expressions.

Stage 1 picks, for every strategy, the candidate date / amount / description texts of a row
(per-cell kinds, the content fold unrolled over the statement's columns, the joined row text);
stage 2 parses the candidate dates, stage 3 the candidate amounts (staged so each parse reads a
plain column); stage 4 assembles one nullable STRUCT per strategy and ``coalesce`` returns the
first success in strategy order (P6). Two narrow projection chains without a shuffle, UDF or
higher-order function: the standard parse for the rows it accepts, strategies 2–5 for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.dims import EMERGENCY_AMOUNT, EMERGENCY_DATE, EXTRACT_AMOUNT, LOOKS_LIKE_DATE
from ledgerlake.session import keep_where
from ledgerlake.functions.parsing import (looks_like_amount, looks_like_date, looks_like_description,
                                          with_amounts, with_dates)

STATEMENT_COLUMNS = ["date", "description", "amount", "type", "category"]
UNKNOWN = "Unknown transaction"
DEBIT_WORDS = ["debit", "expense", "withdrawal"]


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def recover_rows(raw: DataFrame, as_of: str, columns: list[str] | None = None) -> DataFrame:
    """Returns lineage columns + success, strategy_used, confidence, date (yyyy-MM-dd text),
    description, amount, currency, type, category."""
    cols = columns or [c for c in STATEMENT_COLUMNS if c in raw.columns]
    lineage = [c for c in raw.columns if c not in cols]
    col = {c: (F.col(c).cast("string") if c in raw.columns else F.lit(None).cast("string"))
           for c in STATEMENT_COLUMNS}
    row_text = F.concat_ws(" ", *[F.col(c).cast("string") for c in cols])
    p3_desc = F.trim(F.regexp_replace(F.regexp_replace(row_text, LOOKS_LIKE_DATE, ""), EXTRACT_AMOUNT, ""))

    # --- stage 1: P1, then candidates of the other strategies ---------------------------
    s0 = raw.select(*lineage, *[F.col(c) for c in cols],
                    F.trim(col["date"]).alias("_d1"), col["amount"].alias("_a1"),
                    F.trim(col["description"]).alias("_s1"))
    s0 = with_dates(s0, {"_pd1": "_d1"}, defensive=True)
    s0 = with_amounts(s0, {"_pa1": "_a1"}, defensive=True)
    ok1 = (_present(F.col("_d1")) & _present(F.col("_s1")) & _present(F.col("_a1"))
           & F.col("_pd1").isNotNull() & F.col("_pa1.amount").isNotNull())
    s0 = s0.withColumn("_ok1", ok1)
    # well-formed rows end here; the other strategies are planned for the rejected rows alone,
    # so neither branch carries the other's code
    good = keep_where(s0, F.col("_ok1"))
    s0 = keep_where(s0, ~F.coalesce(F.col("_ok1"), F.lit(False)))
    lazy = lambda e: e
    # cell kinds once per cell (a statement has a fixed, small set of columns)
    kinds = []
    for i, c in enumerate(cols):
        v = F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
        kinds += [lazy(v).alias(f"_v{i}"), lazy(looks_like_date(v)).alias(f"_isd{i}"),
                  lazy(looks_like_amount(v)).alias(f"_isa{i}"), lazy(looks_like_description(v)).alias(f"_iss{i}")]
    s1 = s0.select("*", *kinds, lazy(row_text).alias("_row"), lazy(p3_desc).alias("_p3"))
    # The content fold unrolled over the cells; state (date, amount, description) and the
    # elif order of the tests per cell (a second date-like cell falls through to the amount test)
    d = a = t = F.lit(None).cast("string")
    for i in range(len(cols)):
        v, isd, isa, iss = (F.col(f"_{k}{i}") for k in ("v", "isd", "isa", "iss"))
        take_d = isd & d.isNull()
        take_a = ~take_d & isa & a.isNull()
        take_s = ~take_d & ~take_a & iss & t.isNull()
        s1 = s1.select("*", F.when(take_d, v).otherwise(d).alias(f"_fd{i}"),
                       F.when(take_a, v).otherwise(a).alias(f"_fa{i}"),
                       F.when(take_s, v).otherwise(t).alias(f"_fs{i}"))
        d, a, t = F.col(f"_fd{i}"), F.col(f"_fa{i}"), F.col(f"_fs{i}")
    # First cell of each kind in the same elif order
    first = lambda cond: F.coalesce(*[F.when(cond(i), F.col(f"_v{i}")) for i in range(len(cols))])
    s1 = s1.select(
        "*",
        d.alias("_d2"), a.alias("_a2"), t.alias("_s2"),
        F.nullif(F.regexp_extract(F.col("_row"), f"({LOOKS_LIKE_DATE})", 1), F.lit("")).alias("_d3"),
        F.nullif(F.regexp_extract(F.col("_row"), f"({EXTRACT_AMOUNT})", 1), F.lit("")).alias("_a3"),
        F.when(F.col("_p3") == "", F.lit(UNKNOWN)).otherwise(F.col("_p3")).alias("_s3"),
        first(lambda i: F.col(f"_isd{i}")).alias("_d4"),
        first(lambda i: ~F.col(f"_isd{i}") & F.col(f"_isa{i}")).alias("_a4"),
        F.coalesce(first(lambda i: ~F.col(f"_isd{i}") & ~F.col(f"_isa{i}") & F.col(f"_iss{i}")),
                   F.lit(UNKNOWN)).alias("_s4"),
        F.coalesce(F.nullif(F.regexp_extract(F.col("_row"), f"({EMERGENCY_DATE})", 1), F.lit("")),
                   F.lit(as_of)).alias("_d5"),
        F.nullif(F.regexp_extract(F.col("_row"), f"({EMERGENCY_AMOUNT})", 1), F.lit("")).alias("_a5"),
    )
    # --- stage 2 / 3: parse the remaining candidates (NULL for rows P1 already parsed) -------
    s1 = with_dates(s1, {f"_pd{i}": f"_d{i}" for i in (2, 3, 4)}, defensive=True)
    s1 = with_amounts(s1, {f"_pa{i}": f"_a{i}" for i in (2, 3, 4, 5)}, defensive=True)

    # --- stage 4: one struct per strategy, first success wins ----------------------------
    def result(name, conf, date_c, desc, amt_struct, typ, cat, ok):
        return F.when(ok, F.struct(
            F.lit(True).alias("success"), F.lit(name).alias("strategy_used"), F.lit(conf).alias("confidence"),
            date_c.alias("date"), desc.alias("description"), amt_struct["amount"].alias("amount"),
            amt_struct["currency"].alias("currency"), typ.alias("type"), cat.alias("category")))

    def by_sign(s):
        return F.when(s["amount"] < 0, F.lit("debit")).otherwise(F.lit("credit"))

    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    pa = {i: F.col(f"_pa{i}") for i in range(1, 6)}
    t1 = F.when(col["type"].isNull(), by_sign(pa[1])).when(
        F.lower(col["type"]).isin(*DEBIT_WORDS), F.lit("debit")).otherwise(F.lit("credit"))
    c1 = F.coalesce(F.nullif(F.lower(F.trim(col["category"])), F.lit("")), F.lit("other"))
    other = F.lit("other")
    standard = result("standard_parsing", 0.9, iso(F.col("_pd1")), F.col("_s1"), pa[1], t1, c1, F.col("_ok1"))
    cands = [
        result("fuzzy_column_matching", 0.7, iso(F.col("_pd2")), F.col("_s2"), pa[2], by_sign(pa[2]), other,
               F.col("_d2").isNotNull() & F.col("_a2").isNotNull() & F.col("_s2").isNotNull()
               & F.col("_pd2").isNotNull() & pa[2]["amount"].isNotNull()),
        result("pattern_based_extraction", 0.6, iso(F.col("_pd3")), F.col("_s3"), pa[3], by_sign(pa[3]), other,
               F.col("_pd3").isNotNull() & pa[3]["amount"].isNotNull()),
        result("manual_field_detection", 0.5, iso(F.col("_pd4")), F.col("_s4"), pa[4], by_sign(pa[4]), other,
               F.col("_pd4").isNotNull() & pa[4]["amount"].isNotNull()),
        result("emergency_fallback", 0.2, F.col("_d5"), F.lit(UNKNOWN), pa[5], by_sign(pa[5]), other,
               pa[5]["amount"].isNotNull()),
    ]
    failed = F.struct(F.lit(False).alias("success"), F.lit("all_failed").alias("strategy_used"),
                      F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("date"),
                      F.lit(None).cast("string").alias("description"), F.lit(None).cast("double").alias("amount"),
                      F.lit(None).cast("string").alias("currency"), F.lit(None).cast("string").alias("type"),
                      F.lit(None).cast("string").alias("category"))
    out = good.select(*lineage, standard.alias("r")).unionByName(s1.select(*lineage, F.coalesce(*cands, failed).alias("r")))
    return out.select(*lineage, "r.*")


def is_valid_recovered(df: DataFrame) -> Column:
    """Date, description, amount (0 counts as missing) and currency present; ISO date."""
    return (F.coalesce(F.col("description"), F.lit("")) != "") & F.col("amount").isNotNull() \
        & (F.col("amount") != 0) & (F.coalesce(F.col("currency"), F.lit("")) != "") \
        & F.col("date").rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") \
        & F.try_to_timestamp(F.col("date"), F.lit("yyyy-M-d")).isNotNull()
