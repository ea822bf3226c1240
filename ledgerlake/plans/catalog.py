"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator group.

Each query reads the driver's tables (through the adapter in ``ledgerlake.sources.testdata``)
and runs over all rows; per-account results use ``keys=["account_id"]``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.dims import fx_rates_dim
from ledgerlake.operators import budget as B
from ledgerlake.operators import fx as X
from ledgerlake.operators import spending as S
from ledgerlake.session import keep_where
from ledgerlake.sources.testdata import transactions

KEYS = ["account_id"]
TARGET = "EUR"

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def _tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir)


# ---- spending aggregates ---------------------------------------------------------------

@query("category_breakdown")
def q_category_breakdown(spark, sf_dir):
    return S.category_breakdown(_tx(spark, sf_dir), KEYS)


@query("spending_totals")
def q_spending_totals(spark, sf_dir):
    return S.spending_totals(_tx(spark, sf_dir), KEYS)


@query("avg_daily_expense")
def q_avg_daily_expense(spark, sf_dir):
    return S.avg_daily_expense(_tx(spark, sf_dir), KEYS)


@query("monthly_spending")
def q_monthly_spending(spark, sf_dir):
    return S.monthly_spending(_tx(spark, sf_dir), KEYS)


@query("weekday_pattern")
def q_weekday_pattern(spark, sf_dir):
    return S.weekday_pattern(_tx(spark, sf_dir), KEYS)


@query("weekday_mean")
def q_weekday_mean(spark, sf_dir):
    return S.weekday_mean(_tx(spark, sf_dir), KEYS)


@query("top_merchants")
def q_top_merchants(spark, sf_dir):
    return S.top_merchants(_tx(spark, sf_dir), None, 10)


@query("top_merchants_per_account")
def q_top_merchants_per_account(spark, sf_dir):
    return S.top_merchants(_tx(spark, sf_dir), KEYS, 10)


@query("analysis_period")
def q_analysis_period(spark, sf_dir):
    return S.analysis_period(_tx(spark, sf_dir), KEYS)


@query("category_share")
def q_category_share(spark, sf_dir):
    return S.category_share(_tx(spark, sf_dir), KEYS)


@query("primary_currency_volume")
def q_primary_currency_volume(spark, sf_dir):
    return S.primary_currency_volume(_tx(spark, sf_dir), KEYS)


@query("primary_currency_blended")
def q_primary_currency_blended(spark, sf_dir):
    return S.primary_currency_blended(_tx(spark, sf_dir), KEYS)


@query("primary_currency_frequency")
def q_primary_currency_frequency(spark, sf_dir):
    return S.primary_currency_frequency(_tx(spark, sf_dir), KEYS)


@query("category_summary")
def q_category_summary(spark, sf_dir):
    return S.category_summary(_tx(spark, sf_dir), KEYS)


@query("simple_analysis")
def q_simple_analysis(spark, sf_dir):
    return S.simple_analysis(_tx(spark, sf_dir), KEYS)


@query("currency_breakdown")
def q_currency_breakdown(spark, sf_dir):
    return S.currency_breakdown(_tx(spark, sf_dir), KEYS)


@query("headline_metrics")
def q_headline_metrics(spark, sf_dir):
    return S.headline_metrics(_tx(spark, sf_dir), KEYS)


@query("monthly_income")
def q_monthly_income(spark, sf_dir):
    m = S.monthly_income(_tx(spark, sf_dir), KEYS)
    return m.select(*KEYS, F.round("_monthly_income", 2).alias("monthly_income"), "income_months")


@query("spending_facets")
def q_spending_facets(spark, sf_dir):
    return S.spending_facets(_tx(spark, sf_dir), KEYS)


# ---- currency conversion -------------------------------------------------------------

@query("convert_currency")
def q_convert_currency(spark, sf_dir):
    c = X.convert_transactions(_tx(spark, sf_dir), TARGET)
    return c.select("txn_id", "account_id", F.round("original_amount", 2).alias("original_amount"),
                    "original_currency", F.round("conversion_rate", 8).alias("conversion_rate"),
                    F.round("amount", 2).alias("amount"), "currency", "display_currency",
                    "rate_missing")


@query("conversion_summary")
def q_conversion_summary(spark, sf_dir):
    return X.conversion_summary(_tx(spark, sf_dir), "USD", KEYS)


@query("conversion_stats")
def q_conversion_stats(spark, sf_dir):
    return X.conversion_stats(X.convert_transactions(_tx(spark, sf_dir), "USD"))


# ---- budgets -------------------------------------------------------------------------

def _rec(spark, sf_dir):
    return B.recommendations(_tx(spark, sf_dir), KEYS)


@query("budget_recommendations")
def q_budget_recommendations(spark, sf_dir):
    return B.public(_rec(spark, sf_dir))


@query("savings_potential")
def q_savings_potential(spark, sf_dir):
    return B.savings_potential(_rec(spark, sf_dir), KEYS)


@query("budget_alerts")
def q_budget_alerts(spark, sf_dir):
    return B.alerts(_rec(spark, sf_dir), KEYS)


@query("budget_vs_actual")
def q_budget_vs_actual(spark, sf_dir):
    return B.budget_vs_actual(_rec(spark, sf_dir), KEYS)


@query("budget_totals")
def q_budget_totals(spark, sf_dir):
    return B.budget_totals(_rec(spark, sf_dir), KEYS)


@query("budget_unpivot")
def q_budget_unpivot(spark, sf_dir):
    return B.budget_long(_rec(spark, sf_dir), KEYS)


# ---- statement parsing, validation ---------------------------------------------------

from ledgerlake.functions import formatting as FM  # noqa: E402
from ledgerlake.functions import parsing as P  # noqa: E402
from ledgerlake.operators import statements as ST  # noqa: E402
from ledgerlake.sources.testdata import messy_statements, raw_statements  # noqa: E402

AS_OF = "2024-06-30"


def _messy(spark, sf_dir):
    return messy_statements(spark, sf_dir)


@query("parse_dates")
def q_parse_dates(spark, sf_dir):
    m = _messy(spark, sf_dir).select("txn_id", F.col("date").alias("date_text"))
    m = P.with_date(m, "date_text", "_p", F.to_date(F.lit(AS_OF)))
    m = P.with_date(m, "date_text", "_d", defensive=True)
    return m.select("txn_id", "date_text", S.iso_date(F.col("_p")).alias("parsed_date"),
                    S.iso_date(F.col("_d")).alias("defensive_date"))


@query("detect_currency")
def q_detect_currency(spark, sf_dir):
    m = _messy(spark, sf_dir)
    return m.select("txn_id", F.col("amount").alias("amount_text"),
                    P.detect_currency(F.col("amount")).alias("currency"))


@query("parse_amounts")
def q_parse_amounts(spark, sf_dir):
    m = _messy(spark, sf_dir).select("txn_id", F.col("amount").alias("amount_text"))
    m = P.with_amount(m, "amount_text", "_a")
    m = P.with_amount(m, "amount_text", "_d", defensive=True)
    return m.select("txn_id", "amount_text", F.col("_a.amount").alias("amount"),
                    F.col("_a.currency").alias("currency"), F.col("_d.amount").alias("defensive_amount"),
                    F.col("_d.currency").alias("defensive_currency"))


@query("parse_transactions")
def q_parse_transactions(spark, sf_dir):
    p = ST.parse_statements(_messy(spark, sf_dir), AS_OF)
    return p.select("txn_id", "account_id", S.iso_date(F.col("date")).alias("date"), "description",
                    "amount", "currency", "type", "category", "confidence_score", "reject_reason")


@query("sign_from_type")
def q_sign_from_type(spark, sf_dir):
    r = P.with_amount(raw_statements(spark, sf_dir), "amount", "_a")
    a = F.col("_a.amount")
    return r.select("txn_id", F.col("type"), P.debit_credit(F.col("type")).alias("flag"),
                    P.signed_amount(a, F.col("type")).alias("signed_amount"))


@query("validate_rejects")
def q_validate_rejects(spark, sf_dir):
    return ST.reject_stats(ST.parse_statements(_messy(spark, sf_dir), AS_OF))


@query("dataset_check")
def q_dataset_check(spark, sf_dir):
    good, _ = ST.split(ST.parse_statements(_messy(spark, sf_dir), AS_OF))
    return ST.dataset_check(good, KEYS).select(*KEYS, "n_rows", "valid", "error", "first_bad_txn_id")


@query("clean_chart_rows")
def q_clean_chart_rows(spark, sf_dir):
    good, _ = ST.split(ST.parse_statements(_messy(spark, sf_dir), AS_OF))
    return ST.clean_chart_rows(good).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows"),
                                                      F.round(S.msum("amount"), 2).alias("amount"))


@query("format_currency_report")
def q_format_currency_report(spark, sf_dir):
    t = _tx(spark, sf_dir)
    return t.select("txn_id", FM.format_currency_report(F.col("amount"), F.col("currency")).alias("report_text"),
                    FM.format_currency_ui(F.col("amount"), F.col("currency")).alias("ui_text"))


@query("format_currency_locale")
def q_format_currency_locale(spark, sf_dir):
    t = _tx(spark, sf_dir)
    return t.select("txn_id", FM.format_currency_locale(F.col("amount"), F.col("currency")).alias("locale_text"))


# ---- categorisation (rows-only checks; the fixture table is tested in tests/) ----------

from ledgerlake.operators import categorize as G  # noqa: E402


def _texts(spark, sf_dir):
    """Distinct lower-cased descriptions of all transactions (the classifier's unit of work)."""
    return _tx(spark, sf_dir).select(F.lower(F.trim("description")).alias("desc")).distinct()


@query("rule_categorize")
def q_rule_categorize(spark, sf_dir):
    return G.rule_scores(_texts(spark, sf_dir), "desc")


@query("ml_categorize")
def q_ml_categorize(spark, sf_dir):
    m = G.ml_scores(_texts(spark, sf_dir), G.default_model(spark), "desc")
    return m.select("desc", "ml_category", F.round("ml_confidence", 6).alias("ml_confidence"))


@query("hybrid_categorize")
def q_hybrid_categorize(spark, sf_dir):
    parsed = ST.parse_statements(_messy(spark, sf_dir), AS_OF)
    good, _ = ST.split(parsed)
    c = G.categorize(good, G.default_model(spark), texts_from=parsed)
    return c.select("txn_id", "account_id", "description", "category", F.round("confidence_score", 3).alias("confidence"))


# ---- cleaning, schema repair, recovery --------------------------------------------------

from ledgerlake.operators import clean as C  # noqa: E402
from ledgerlake.operators import recover as R  # noqa: E402
from ledgerlake.sources.testdata import split_amount_statements  # noqa: E402

STMT_COLS = ["date", "description", "amount", "type", "category"]
LINEAGE = ["txn_id", "account_id"]


@query("sanitize_text")
def q_sanitize_text(spark, sf_dir):
    return C.sanitize(_messy(spark, sf_dir), STMT_COLS, lineage=LINEAGE)


@query("merge_split_currency")
def q_merge_split_currency(spark, sf_dir):
    return C.merge_split_currency(split_amount_statements(spark, sf_dir), exclude=LINEAGE)


@query("drop_artifacts")
def q_drop_artifacts(spark, sf_dir):
    m = C.flag_shifted_rows(_messy(spark, sf_dir), STMT_COLS)
    return C.drop_artifacts(m, STMT_COLS).groupBy("is_shifted").agg(F.count(F.lit(1)).alias("rows"))


@query("sanitize_report")
def q_sanitize_report(spark, sf_dir):
    before = _messy(spark, sf_dir)
    after = C.sanitize(before, STMT_COLS, lineage=LINEAGE).drop("is_shifted")
    return C.sanitize_report(before, after, STMT_COLS, STMT_COLS, KEYS)


@query("column_profile")
def q_column_profile(spark, sf_dir):
    return C.content_profile(_messy(spark, sf_dir), STMT_COLS)


@query("recover_rows")
def q_recover_rows(spark, sf_dir):
    return R.recover_rows(_messy(spark, sf_dir), AS_OF, STMT_COLS)


@query("normalize_table")
def q_normalize_table(spark, sf_dir):
    r = raw_statements(spark, sf_dir).select(
        "txn_id", F.col("date").alias(" Date "), F.col("amount").alias("AMOUNT"), F.col("type").alias("Type"))
    r = r.withColumn("AMOUNT", F.regexp_replace(F.replace(F.col("AMOUNT"), F.lit(","), F.lit(".")), r"[^0-9.]", ""))
    return C.normalize_table(r)


# ---- sources, sinks, table maintenance ------------------------------------------------

from ledgerlake.sinks import tables as K  # noqa: E402
from ledgerlake.sources import statements as SRC  # noqa: E402
from ledgerlake.sources.testdata import table as _table  # noqa: E402

RETENTION_AS_OF = "2001-08-01"


@query("latest_transactions")
def q_latest_transactions(spark, sf_dir):
    t = _tx(spark, sf_dir)
    top = S.top_k_per_key(t, KEYS, [F.col("date").desc(), F.col("txn_id").desc()], 5, "txn_id")
    return top.select(*KEYS, "rank", "txn_id", S.iso_date(F.col("date")).alias("date"), "amount")


@query("account_statistics")
def q_account_statistics(spark, sf_dir):
    t = _tx(spark, sf_dir)
    tx = t.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("transaction_count"),
                              F.min("date").alias("_first"), F.max("date").alias("_last"))
    # saved analyses (K5): one monthly-spending JSON document per (account, month)
    path = K.scratch_path(spark, "analysis_results")
    K.save_analysis_result(S.monthly_spending(t, KEYS), path, "monthly_spending", created_at="2024-06-30 00:00:00")
    an = (spark.read.parquet(path).groupBy(F.col("session_id").cast("bigint").alias("account_id"))
          .agg(F.count(F.lit(1)).alias("analysis_count")))
    j = tx.join(an, KEYS, "full_outer")
    return j.select(*KEYS, F.coalesce("transaction_count", F.lit(0)).alias("transaction_count"),
                    F.coalesce("analysis_count", F.lit(0)).alias("analysis_count"),
                    S.iso_date(F.col("_first")).alias("first_activity"),
                    S.iso_date(F.col("_last")).alias("last_activity"))


@query("retention_filter")
def q_retention_filter(spark, sf_dir):
    t = _tx(spark, sf_dir).withColumn("created_at", F.col("date").cast("timestamp"))
    return K.retention_filter(t, RETENTION_AS_OF, 365).select("txn_id", *KEYS, S.iso_date(F.col("date")).alias("date"))


def _sessions(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("session_id"),
                    F.to_json(F.struct(F.col("c_mktsegment").alias("segment"))).alias("settings"),
                    F.lit(None).cast("string").alias("last_active"))


@query("upsert_sessions")
def q_upsert_sessions(spark, sf_dir):
    old = _sessions(spark, sf_dir)
    recent = (_tx(spark, sf_dir).filter(F.col("date") >= F.lit("2000-08-01").cast("date"))
              .groupBy(*KEYS).agg(F.max("date").alias("_d"), F.count(F.lit(1)).alias("_n")))
    new = recent.select(F.col("account_id").cast("string").alias("session_id"),
                        F.to_json(F.struct(F.col("_n").alias("recent_orders"))).alias("settings"),
                        S.iso_date(F.col("_d")).alias("last_active"))
    return K.upsert(old, new, ["session_id"])


@query("custom_categories")
def q_custom_categories(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    src = c.select(F.col("c_custkey").alias("session_id"), F.lower("c_mktsegment").alias("category_name"),
                   F.split(F.lower("c_name"), "#").alias("keywords"))
    stored = K.custom_category_rows(src)
    back = K.read_custom_categories(stored)
    return back.select(F.col("session_id").cast("bigint").alias("session_id"), "category_name",
                       F.size("keywords").alias("n_keywords"),
                       F.array_join("keywords", " ").alias("keywords_text"))


def _with_file_hash(t):
    return t.withColumn("file_hash", F.sha2(F.concat(F.lit("statement-"), F.col("account_id").cast("string"),
                                                     F.lit("-"), F.year("date").cast("string")), 256))


@query("replace_by_hash")
def q_replace_by_hash(spark, sf_dir):
    t = _with_file_hash(_tx(spark, sf_dir)).withColumn("account_id", F.col("account_id").cast("string")) \
        .withColumn("confidence_score", F.lit(0.7)).withColumn("created_at", F.col("date").cast("timestamp"))
    path = K.scratch_path(spark, "transactions")
    K.save_transactions(t, path)
    K.save_transactions(t, path)          # same files again: rows are replaced, not duplicated
    back = spark.read.parquet(path)
    return back.select("txn_id", F.col("account_id").cast("bigint").alias("account_id"), "file_hash")


def _written_statements(spark, sf_dir):
    m = _messy(spark, sf_dir)
    root = K.scratch_path(spark, "statements")
    cols = ["date", "description", "amount", "type", "category"]
    # the rows' own partitions: as many files as the data needs; doubled quotes as in other CSV tools
    write = lambda df: df.write.option("header", True).option("escape", '"')
    write(m.select(*cols)).csv(f"{root}/comma")
    write(m.select("category", "amount", "description", "type", "date").withColumnRenamed("description", "Merchant Details")
          .withColumnRenamed("date", "posted_date")).option("sep", ";").csv(f"{root}/semicolon")
    return root


@query("profile_files")
def q_profile_files(spark, sf_dir):
    root = _written_statements(spark, sf_dir)
    p = SRC.profile_lines(SRC.read_lines(spark, root))
    return p.groupBy("delimiter", "encoding", "has_header", "column_count", "strategy", F.array_join("header", "/").alias("header")) \
            .agg(F.sum(F.col("n_lines") - 1).alias("rows"))


STATEMENT_ALIASES = {"date": C.CHUNK_ALIASES["date"], "description": C.CHUNK_ALIASES["description"],
                     "amount": C.CHUNK_ALIASES["amount"], "type": C.CHUNK_ALIASES["type"], "category": ["category"]}


@query("read_statements")
def q_read_statements(spark, sf_dir):
    """Two layouts of the same statements (other separator, column order and names) come back whole."""
    root = _written_statements(spark, sf_dir)
    rows = SRC.statement_columns(SRC.read_records(spark, root), STATEMENT_ALIASES)
    return rows.select("parse_strategy", *[F.coalesce(c, F.lit("")).alias(c) for c in STATEMENT_ALIASES])


@query("normalize_and_convert")
def q_normalize_and_convert(spark, sf_dir):
    r = P.with_amount(raw_statements(spark, sf_dir), "amount", "_a")
    r = r.select("txn_id", "account_id", F.col("date").alias("Date"), F.col("description").alias("Description"),
                 F.col("_a.amount").cast("string").alias("Amount"), F.col("_a.currency").alias("Currency"),
                 F.col("type").alias("Type"), F.lower("category").alias("Category"))
    n = C.normalize_table(r)
    conv = X.convert_dataframe(n, "EUR")
    out = conv.select("txn_id", "account_id", "description", F.round("amount", 2).alias("amount"),
                      "original_currency", "display_currency", F.coalesce("category", F.lit("other")).alias("category"),
                      F.when(F.col("amount") < 0, F.lit("expense")).otherwise(F.lit("income")).alias("type"))
    path = K.scratch_path(spark, "converted")
    out.write.parquet(path)                    # converted once; the export and the result read this
    done = spark.read.schema(out.schema).parquet(path)
    K.save_converted_csv(done, K.scratch_path(spark, "statement.csv"), "EUR")
    return done


# ---- streaming (X1–X3) -----------------------------------------------------------------

from ledgerlake.streaming import ingest as XS  # noqa: E402


@query("stream_daily_spend")
def q_stream_daily_spend(spark, sf_dir):
    out = K.scratch_path(spark, "daily_spend")
    XS.run_daily_spend(spark, sf_dir, out, glob="events.parquet")
    r = XS.latest_daily_spend(spark, out)
    return r.select("account_id", "day", F.round("spend", 2).alias("spend"),
                    F.round("income", 2).alias("income"), "n")


@query("minimal_scan")
def q_minimal_scan(spark, sf_dir):
    root = _written_statements(spark, sf_dir)
    m = SRC.read_text_minimal(spark, f"{root}/comma", ["date", "description", "amount", "type", "category"])
    return m.groupBy(F.col("amount").isNull().alias("amount_missing"), "currency") \
            .agg(F.count(F.lit(1)).alias("rows"))


@query("corrupted_column_scan")
def q_corrupted_column_scan(spark, sf_dir):
    root = _written_statements(spark, sf_dir)
    r = SRC.read_corrupted_columns(spark, f"{root}/comma")
    return r.select(F.col("fields")["date"].alias("date"), F.col("fields")["amount"].alias("amount"),
                    F.col("fields")["description"].alias("description"))


@query("custom_categorize")
def q_custom_categorize(spark, sf_dir):
    """Per-account user categories (from the customer table) scored by the keyword rules."""
    c = _table(spark, sf_dir, "customer")
    custom = c.select(F.col("c_custkey").alias("account_id"), F.lower("c_mktsegment").alias("category"),
                      F.array(F.lit("coffee"), F.lit("grocery"), F.lower("c_mktsegment")).alias("keywords"))
    texts = _tx(spark, sf_dir).select("account_id", F.lower(F.trim("description")).alias("desc")).distinct()
    return G.custom_rule_scores(texts, custom, "desc")


@query("orphan_transactions")
def q_orphan_transactions(spark, sf_dir):
    """Transactions whose account has no open session (here: customers with a positive balance)."""
    sessions = _table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("account_id"))
    return K.orphans(_tx(spark, sf_dir), sessions, ["account_id"]).select("txn_id", "account_id")


@query("currency_ranking")
def q_currency_ranking(spark, sf_dir):
    return S.currency_ranking(_tx(spark, sf_dir), KEYS)


@query("valid_recovered")
def q_valid_recovered(spark, sf_dir):
    """Recovered rows that are complete."""
    r = R.recover_rows(_messy(spark, sf_dir), AS_OF)
    return keep_where(r, R.is_valid_recovered(r)).select("txn_id", "strategy_used", "date", F.round("amount", 2).alias("amount"))


@query("convert_amount_expression")
def q_convert_amount_expression(spark, sf_dir):
    """Conversion as a column expression, without a join."""
    t = _tx(spark, sf_dir)
    return t.select("txn_id", F.round(X.convert_amount(F.col("amount"), F.col("currency"), "EUR"), 2).alias("amount_eur"))


@query("live_rates")
def q_live_rates(spark, sf_dir):
    """A live rate table (here: the mean order value per currency) over the fallback, applied."""
    t = _tx(spark, sf_dir)
    live = t.filter("amount > 0").groupBy("currency").agg((F.sum(F.col("amount").cast("decimal(18,2)")).cast("double")
                                                           / F.count(F.lit(1)) / 100000).alias("per_usd"))
    live = live.filter("currency <> 'USD'").withColumn("as_of", F.lit("2024-01-01")).withColumn("source", F.lit("live"))
    rates = X.resolve_rates(live, fx_rates_dim(spark).withColumn("as_of", F.lit("")).withColumn("source", F.lit("static")))
    per = t.groupBy("currency").agg(F.count(F.lit(1)).alias("n"))
    out = X.with_rate(per, "USD", rates)
    return out.select("currency", "n", F.round("conversion_rate", 6).alias("rate"))


from ledgerlake.operators import upload as U  # noqa: E402


@query("upload_pipeline")
def q_upload_pipeline(spark, sf_dir):
    """An upload end to end: written as a file with its own names and separator, read, parsed, recovered."""
    root = K.scratch_path(spark, "upload")
    m = _messy(spark, sf_dir).select("account_id", "category", F.col("amount").alias("Total"), F.col("description").alias("Payee"),
                                     F.col("date").alias("Trans_Date"), "type", "txn_id")
    m.write.option("header", True).option("escape", '"').option("sep", ";").csv(root)
    names = {**STATEMENT_ALIASES, "txn_id": ["txn_id"], "account_id": ["account_id"]}
    rows = SRC.statement_columns(SRC.read_records(spark, root), names).select(
        F.col("txn_id").cast("bigint").alias("txn_id"), F.col("account_id").cast("bigint").alias("account_id"), *STATEMENT_ALIASES)
    good, _ = U.accept(rows, AS_OF)
    return good.select("txn_id", "account_id", "how", "date", "description", F.round("amount", 2).alias("amount"), "currency")


# ---- strategies, types, quoted records, dated rates, monthly alerts ---------------------

from ledgerlake.operators import dated_rates as DR  # noqa: E402
from ledgerlake.sources import cascade as CA  # noqa: E402
from ledgerlake.streaming import budgets as MB  # noqa: E402


def _files_of_each_kind(spark, sf_dir):
    """The tables' rows as statement files that need every strategy; folders name what they hold."""
    root = K.scratch_path(spark, "cascade")
    t = _tx(spark, sf_dir).select(S.iso_date(F.col("date")).alias("date"), "description", F.col("amount").cast("decimal(15,2)").cast("string").alias("amount"))
    write = lambda df, **kw: df.write.option("header", kw.pop("header", True)).option("escape", '"').options(**kw)
    write(t).csv(f"{root}/plain")
    write(t, sep="|").csv(f"{root}/bars")
    write(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_acctbal").cast("decimal(15,2)").alias("amount"))).csv(f"{root}/narrow")
    # a file of one record without a header; a file of words; a file whose records are wider than its header
    n = _table(spark, sf_dir, "nation")
    write(n.select("n_name", "n_nationkey", "n_regionkey"), header=False, maxRecordsPerFile=1).csv(f"{root}/single")
    words = F.translate("p_type", "0123456789", "xxxxxxxxxx")
    write(_table(spark, sf_dir, "part").select(words.alias("kind"), F.lit("of").alias("by"), words.alias("name"))).csv(f"{root}/words")
    s = _table(spark, sf_dir, "supplier")
    s.select(F.concat(F.lit("supplier,nation\n"), F.col("s_suppkey"), F.lit(","), F.col("s_nationkey"), F.lit(",more"))).write.text(f"{root}/ragged")
    return root


def _folder():
    return F.element_at(F.split("source_file", "/"), -2).alias("folder")


@query("strategy_cascade")
def q_strategy_cascade(spark, sf_dir):
    """Every file by the first strategy that is sound; all values, with what was tried before."""
    root = _files_of_each_kind(spark, sf_dir)
    rows, verdicts = CA.read_cascade(spark, root, "*")
    tried = verdicts.select("source_file", F.array_join(F.transform(F.filter("tried", lambda t: ~t["accepted"]), lambda t: F.concat(t["strategy"], F.lit(": "), t["reason"])), "; ").alias("rejected"))
    text = F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), "|")
    return (SRC.with_files(rows, tried).select(_folder(), "strategy", F.array_join("header", "|").alias("header"), text.alias("cells"), "rejected")
            .groupBy("folder", "strategy", "header", "cells", "rejected").agg(F.count(F.lit(1)).alias("n")))


@query("column_types")
def q_column_types(spark, sf_dir):
    """Type, filled cells and first records of every column of every file, put together by layout."""
    rows, _ = CA.read_cascade(spark, _files_of_each_kind(spark, sf_dir), "*")
    per = CA.describe_columns(rows.filter("strategy <> 'unreadable'"))
    return (per.groupBy(_folder(), "position", "name", "dtype")
            .agg(F.sum("records").alias("records"), F.sum("filled").alias("filled"), F.max(F.size("samples")).alias("most_samples")))


@query("quoted_records")
def q_quoted_records(spark, sf_dir):
    """Cells with line ends and quotes, in files of many splits, come back whole."""
    root = K.scratch_path(spark, "quoted")
    t = _tx(spark, sf_dir)
    note = F.when(F.col("txn_id") % 3 == 0, F.concat("description", F.lit("\nline \"two\", with a comma\n"), F.col("txn_id").cast("string"))).otherwise(F.col("description"))
    t.select("txn_id", note.alias("note"), F.col("amount").cast("decimal(15,2)").alias("amount")).write.option("header", True).option("escape", '"').csv(root)
    rows = SRC.read_records(spark, root)
    return rows.select(F.col("fields")["txn_id"].cast("bigint").alias("txn_id"), F.col("fields")["note"].alias("note"),
                       F.col("fields")["amount"].cast("double").alias("amount"), F.col("_corrupt_record").isNotNull().alias("corrupt"))


@query("dated_rates")
def q_dated_rates(spark, sf_dir):
    """Each event's value at the rate that held at its time, else at the fallback rate."""
    from ledgerlake.sources.testdata import ADAPTER_CURRENCIES, pick
    e = _table(spark, sf_dir, "events")
    e = e.withColumn("currency", pick(ADAPTER_CURRENCIES, F.col("event_id") % len(ADAPTER_CURRENCIES)))
    base = fx_rates_dim(spark).select("currency", F.col("per_usd").alias("_base"))
    live = (e.filter("event_type IN ('view', 'click')").join(F.broadcast(base), "currency")
            .select("currency", F.col("ts").alias("as_of"), (F.col("_base") * (1 + F.col("value") / 1000)).alias("per_usd")))
    paid = e.filter("event_type IN ('purchase', 'signup', 'error')").select("event_id", "ts", "currency", F.col("value").alias("amount"))
    out = DR.convert_dated(paid, "EUR", live)
    return out.select("event_id", "currency", F.round("converted", 8).alias("converted"), "rate_source")


ALERT_INCOME = 1_000_000.0


@query("monthly_alerts")
def q_monthly_alerts(spark, sf_dir):
    """Statements dropped year by year, each year's files also once more under other names; alerts of all batches."""
    drops, out = K.scratch_path(spark, "drops"), K.scratch_path(spark, "monthly-alerts")
    t = _tx(spark, sf_dir).select("txn_id", "account_id", "date", "description", "amount", "category")
    years = [r[0] for r in t.select(F.year("date")).distinct().orderBy(F.year("date")).collect()]   # a handful
    n = 0
    for y in years:
        one = t.filter(F.year("date") == y)
        for copy in range(2):
            one.repartition(2, "txn_id").write.mode("append").parquet(drops)
            n += 2
    MB.run_monthly_alerts(spark, drops, out, ALERT_INCOME, files=max(4, n // 3))
    return MB.alerts(spark, out).filter("kind IN ('medium', 'high')").select("account_id", "month", "category", "kind")


# ---- versioned tables, constraints, duplicate files, uploads as a stream ----------------

from ledgerlake.sinks import constraints as KC  # noqa: E402
from ledgerlake.sinks import versions as KV  # noqa: E402


def _versioned(spark, sf_dir, name):
    """The transactions as a versioned table, keyed by account and statement (a year)."""
    t = _with_file_hash(_tx(spark, sf_dir)).withColumn("created_at", F.col("date").cast("timestamp"))
    path = K.scratch_path(spark, name)
    KV.replace(t, path)
    return t, path


@query("replace_versions")
def q_replace_versions(spark, sf_dir):
    """Corrected statements of some accounts replace the old ones, with other amounts and fewer rows."""
    t, path = _versioned(spark, sf_dir, "versions")
    corrected = t.filter((F.col("account_id") % 7 == 0) & (F.year("date") == 1995) & (F.col("txn_id") % 2 == 0))
    KV.replace(corrected.withColumn("amount", F.col("amount") * 2), path)
    return KV.read(spark, path).select("txn_id", "account_id", F.round("amount", 2).alias("amount"))


@query("expire_versions")
def q_expire_versions(spark, sf_dir):
    """K7: the table after a clean-up and the removal of the files that no list names."""
    t, path = _versioned(spark, sf_dir, "expired")
    KV.expire(spark, path, RETENTION_AS_OF, 365)
    KV.sweep(spark, path)
    return KV.read(spark, path).select("txn_id", *KEYS, S.iso_date(F.col("date")).alias("date"))


@query("table_constraints")
def q_table_constraints(spark, sf_dir):
    """K8: what statement rows and sessions break of the declared constraints."""
    c = _table(spark, sf_dir, "customer")
    sessions = (c.select(F.col("c_custkey").alias("session_id"), "c_acctbal")
                .unionByName(c.filter("c_nationkey = 3").select(F.col("c_custkey").alias("session_id"), "c_acctbal")))
    opened = sessions.filter("c_acctbal > 0")
    of = lambda name, df, *rest: KC.violations(df, KC.TABLES[name], *rest).withColumn("table", F.lit(name))
    return of("transactions", _messy(spark, sf_dir), opened).unionByName(of("sessions", sessions))


@query("duplicate_files")
def q_duplicate_files(spark, sf_dir):
    """Statements written three times under other names; rows of the first files, with the number of copies."""
    root = K.scratch_path(spark, "duplicates")
    t = _tx(spark, sf_dir).select("txn_id", "description").repartition(4, "txn_id")
    for i, order in enumerate(("txn_id", "txn_id", "description")):   # the last in another order of lines
        t.sortWithinPartitions(order, "txn_id").write.option("escape", '"').csv(f"{root}/copy{i}")
    lines = SRC.read_lines(spark, root)
    verdicts = SRC.duplicate_files(lines)
    rows = SRC.without_duplicate_files(lines, verdicts).join(verdicts.select("source_file", "copies"), "source_file")
    return rows.select(F.split_part("line", F.lit(","), F.lit(1)).cast("bigint").alias("txn_id"), "copies")


@query("stream_uploads")
def q_stream_uploads(spark, sf_dir):
    """Damaged statements dropped as files, each once more under another name, through the whole upload chain."""
    drops, table = K.scratch_path(spark, "upload-drops"), K.scratch_path(spark, "uploads")
    m = _messy(spark, sf_dir).select(*XS.UPLOAD_SCHEMA.names)
    for _ in range(2):
        m.repartition(4, "txn_id").sortWithinPartitions("txn_id").write.mode("append").option("header", True).option("escape", '"').csv(drops)
    XS.ingest_uploads(spark, drops, table, AS_OF, name=table.rsplit("/", 1)[1], max_files_per_trigger=5).awaitTermination()
    done = KV.read(spark, table)
    return done.select("txn_id", F.col("account_id").cast("bigint").alias("account_id"), "how", "date", "description",
                       F.round("amount", 2).alias("amount"), "currency", (F.coalesce("category", F.lit("")) != "").alias("categorised"))


@query("budget_monthly_average")
def q_budget_monthly_average(spark, sf_dir):
    """B6 on the mean month (Q11): recommended against the spend of a mean month with expenses."""
    return B.budget_vs_actual(B.recommendations(_tx(spark, sf_dir), KEYS, current_basis="monthly_avg"), KEYS)


@query("low_confidence")
def q_low_confidence(spark, sf_dir):
    """Q23: rule categories of all transactions, counted by category and by whether they are to be checked."""
    texts = _tx(spark, sf_dir).groupBy(F.lower(F.trim("description")).alias("desc")).agg(F.count(F.lit(1)).alias("n"))
    scored = G.rule_scores(texts, "desc").withColumnRenamed("rule_confidence", "confidence_score")
    return G.with_low_confidence(scored).groupBy("rule_category", "low_confidence").agg(F.sum("n").alias("n"))


# ---- keyword rules of large dictionaries ------------------------------------------------

from ledgerlake.operators import keyword_index as KI  # noqa: E402


@query("rule_categorize_index")
def q_rule_categorize_index(spark, sf_dir):
    """G4/J8 by the gram index, on the built-in dictionary: the same categories as by the loop over keywords."""
    return KI.rule_scores(_texts(spark, sf_dir), KI.dictionary_rows(spark), "desc")


@query("keyword_dictionary")
def q_keyword_dictionary(spark, sf_dir):
    """G4/J8 with a dictionary of all words of eight letters or more of the documents, by language, on the benchmark texts."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{8,})"), 1))
    keys = (spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.col("lang").isNotNull())
            .select(F.col("lang").alias("category"), F.lit(0).alias("place"), words.alias("keyword")).distinct())
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.lower("text").alias("desc"))
    return KI.keyword_scores(items, keys, "desc", stop_words=[]).join(items, "desc").select("item_id", "category", "score")
