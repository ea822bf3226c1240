"""Cleaning and schema repair of raw statement tables.

Raw statement tables are all-STRING DataFrames with whatever columns the file had. Row-level
repairs are column expressions. Decisions about the *schema* (which columns are numeric, which
column is the date) need one aggregate pass over the whole table; that pass returns a single
row of counters per column, which the driver reads to choose the projection — the data itself
never leaves the executors.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.session import keep_where

# FIXED VALUES — patterns of the sanitiser and column detector.
SHIFT_LETTERS = r"[a-zA-Z]{3,}"
SHIFT_SYMBOLS = r"[€$₹£¥₽₱₩]"
SEPARATOR_ROW = r"^[-=_]+$"
HEADER_ROW = r"(?i)^(date|description|amount|type|category)"
COLUMN_NAME_PATTERNS = {
    "date": ["date", "transaction_date", "posted_date", "post_date", "trans_date", "effective_date",
             "settlement_date"],
    "description": ["description", "merchant", "payee", "transaction_description", "details", "memo",
                    "note", "payee_name", "narrative", "reference"],
    "amount": ["amount", "debit", "credit", "transaction_amount", "sum", "total", "value", "balance",
               "transaction_value"],
    "type": ["type", "transaction_type", "trans_type", "debit_credit", "dr_cr", "direction"],
    "currency": ["currency", "curr", "ccy"],
}
CHUNK_ALIASES = {
    "date": ["date", "transaction_date", "posted_date", "post_date", "trans_date"],
    "description": ["description", "merchant", "payee", "transaction_description", "details", "memo", "note"],
    "amount": ["amount", "debit", "credit", "transaction_amount", "sum", "total", "value"],
    "type": ["type", "transaction_type", "trans_type", "debit_credit"],
}
CONTENT_DATE_PATTERNS = [r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}"]
CONTENT_AMOUNT_PATTERNS = [r"[€$₹£¥₽₱₩]\d+", r"\d+\.\d{2}", r"\d+,\d{2}"]
NORMALIZE_DATE_COLUMNS = ["date", "transaction_date", "posted_date", "post_date", "trans_date"]
NORMALIZE_AMOUNT_COLUMNS = ["amount", "debit", "credit", "transaction_amount", "sum", "total", "value"]

# characters NFKC may change: anything but ASCII, Latin-1 letters (U+00C0–U+00FF) and symbols
NFKC_CANDIDATE = "[^\\x00-\\x7F\\u00C0-\\u00FF€₹£¥₽₱₩฿₿]"
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _string_cols(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


# ---- C2 / C3 -------------------------------------------------------------------------

def flag_shifted_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``is_shifted`` when the first column holds ≥3 letters in a row or a currency symbol
    (tables with < 3 columns are left alone). C3 realignment is a no-op in the reference, so
    only the flag is produced."""
    cols = columns or [c for c in df.columns]
    if len(cols) < 3:
        return df.withColumn("is_shifted", F.lit(False))
    first = F.coalesce(F.col(cols[0]).cast("string"), F.lit("nan"))
    return df.withColumn("is_shifted", first.rlike(SHIFT_LETTERS) | first.rlike(SHIFT_SYMBOLS))


# ---- C4 / C5 split currency ------------------------------------------------------------

def numeric_profile(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """One aggregate pass: per column non-null count, numeric count, min and max value."""
    aggs = []
    for c in cols:
        v = F.when(F.col(c).cast("string").rlike(NUMERIC_TEXT), F.col(c).cast("string").try_cast("double"))
        aggs += [F.count(c).alias(f"{c}__n"), F.count(v).alias(f"{c}__num"),
                 F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max")]
    row = df.agg(*aggs).first()
    return {c: {"n": row[f"{c}__n"], "num": row[f"{c}__num"], "min": row[f"{c}__min"], "max": row[f"{c}__max"]}
            for c in cols}


def _numeric_columns(df: DataFrame, exclude=(), profile: dict | None = None) -> tuple[list[str], dict]:
    cols = [c for c in df.columns if c not in exclude]
    prof = numeric_profile(df, cols) if profile is None else profile
    cols = [c for c in cols if c in prof]
    return [c for c in cols if prof[c]["n"] > 0 and prof[c]["n"] == prof[c]["num"]], prof


def _joined_amount(a: str, b: str) -> Column:
    whole = F.col(a).cast("string")
    cents = F.lpad(F.coalesce(F.col(b).cast("string"), F.lit("0")), 2, "0")   # missing cents are none
    return F.concat(whole, F.lit("."), cents)


def merge_split_currency(df: DataFrame, exclude=(), profile: dict | None = None) -> DataFrame:
    """C4: if the last two numeric columns look like whole + cents (second within 0..99 over
    the whole table), replace the first with 'a.bb' and drop the second.

    ``profile`` is a ``numeric_profile`` that the caller has; without one it is computed here in
    one pass. With one (``{}``: no numeric column) nothing runs, also on a stream."""
    numeric, prof = _numeric_columns(df, exclude, profile)
    if len(numeric) < 2:
        return df
    a, b = numeric[-2], numeric[-1]
    if prof[b]["max"] is not None and prof[b]["max"] <= 99 and prof[b]["min"] >= 0:
        return df.withColumn(a, _joined_amount(a, b)).drop(b)
    return df


def fix_split_currency_columns(df: DataFrame, exclude=(), profile: dict | None = None) -> DataFrame:
    """Only for tables with more than 5 columns and no column named like 'amount': add
    ``Amount`` = last two numeric columns joined; the parts are kept."""
    cols = [c for c in df.columns if c not in exclude]
    if len(cols) <= 5 or any("amount" in c.lower() for c in cols):
        return df
    numeric, _ = _numeric_columns(df, exclude, profile)
    if len(numeric) < 2:
        return df
    return df.withColumn("Amount", _joined_amount(numeric[-2], numeric[-1]))


# ---- C6 / C7 text ----------------------------------------------------------------------

@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    import unicodedata
    return s.map(lambda x: unicodedata.normalize("NFKC", x) if isinstance(x, str) else x)


def normalize_unicode(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NFKC normalisation (fullwidth digits/letters, compatibility symbols). There is no
    built-in for it, so an Arrow-batched pandas UDF runs — only for values holding a character
    outside ASCII, the Latin-1 letters À–ÿ and the currency symbols used here, all of which NFKC
    leaves unchanged; every other row stays in the JVM."""
    cols = cols if cols is not None else _string_cols(df)
    out = df
    for c in cols:
        out = out.withColumn(c, F.when(F.col(c).rlike(NFKC_CANDIDATE), _nfkc(F.col(c))).otherwise(F.col(c)))
    return out


def clean_text(c: Column) -> Column:
    """C7 for one column: strip (Unicode whitespace), drop one leading and one trailing quote,
    collapse whitespace runs to one space, '' → NULL."""
    s = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    s = F.regexp_replace(s, r"""^["']|["']$""", "")
    s = F.regexp_replace(s, r"(?U)\s+", " ")
    return F.nullif(s, F.lit(""))


def clean_whitespace_and_quotes(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols if cols is not None else _string_cols(df)
    return df.select(*[clean_text(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---- C8 artifacts ----------------------------------------------------------------------

def drop_artifacts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop all-NULL rows, separator rows ('-----') and repeated header rows."""
    cols = cols if cols is not None else list(df.columns)
    row_text = F.concat_ws(" ", *[F.col(c).cast("string") for c in cols])
    all_null = F.coalesce(*[F.col(c) for c in cols]).isNull() if cols else F.lit(False)
    return keep_where(df, ~all_null & ~row_text.rlike(SEPARATOR_ROW) & ~row_text.rlike(HEADER_ROW))


# ---- C1 / C9 ---------------------------------------------------------------------------

def sanitize(df: DataFrame, cols: list[str] | None = None, lineage=(), profile: dict | None = None) -> DataFrame:
    """C2 → C4 → C6 → C7 → C8 (statement columns only; lineage columns pass through).

    ``profile``: see ``merge_split_currency``; with it no action runs here."""
    cols = cols if cols is not None else [c for c in df.columns if c not in lineage]
    out = flag_shifted_rows(df, cols)
    out = merge_split_currency(out, exclude=(*lineage, "is_shifted"), profile=profile)
    cols = [c for c in cols if c in out.columns]
    out = normalize_unicode(out, [c for c in cols if c in _string_cols(out)])
    out = clean_whitespace_and_quotes(out, [c for c in cols if c in _string_cols(out)])
    return drop_artifacts(out, cols)


def sanitize_report(before: DataFrame, after: DataFrame, cols_before: list[str] | None = None,
                    cols_after: list[str] | None = None, keys=None) -> DataFrame:
    """C9 + A24: rows and null cells before/after (per key), columns removed — two aggregates
    unioned and folded by one group-by (no join)."""
    k = list(keys or [])
    cb = cols_before or [c for c in before.columns if c not in k]
    ca = cols_after or [c for c in after.columns if c not in k]

    def stats(df, cols, stage):
        nulls = sum((F.col(c).isNull().cast("bigint") for c in cols), F.lit(0).cast("bigint"))
        return df.groupBy(*k).agg(F.count(F.lit(1)).alias("rows"), F.sum(nulls).alias("nulls")) \
                 .withColumn("stage", F.lit(stage))

    u = stats(before, cb, "before").unionByName(stats(after, ca, "after"))
    b, a = F.col("stage") == "before", F.col("stage") == "after"
    return (u.groupBy(*k).agg(
        (F.coalesce(F.sum(F.when(b, F.col("rows"))), F.lit(0)) -
         F.coalesce(F.sum(F.when(a, F.col("rows"))), F.lit(0))).alias("rows_removed"),
        F.coalesce(F.sum(F.when(b, F.col("nulls"))), F.lit(0)).alias("empty_cells_before"),
        F.coalesce(F.sum(F.when(a, F.col("nulls"))), F.lit(0)).alias("empty_cells_after"))
        .withColumn("columns_removed", F.lit(len(cb) - len(ca))))


# ---- C10–C13 column names and detection ----------------------------------------------

def normalize_column_names(df: DataFrame) -> DataFrame:
    """Lower-case and strip names; refuse silent collisions."""
    new = [c.lower().strip() for c in df.columns]
    if len(set(new)) != len(new):
        raise ValueError(f"column names collide after normalisation: {df.columns}")
    return df.toDF(*new)


def detect_columns_by_name(columns: list[str]) -> dict[str, str]:
    """C11 (metadata only): each column is matched against the field patterns in order and
    takes the first field type that is still unassigned (the reference stops after the first
    mapped column; this is the intended rule, quirk Q5)."""
    detected: dict[str, str] = {}
    for col in columns:
        low = str(col).lower().strip()
        for field, pats in COLUMN_NAME_PATTERNS.items():
            if field in detected:
                continue
            if any(re.search(p, low) for p in pats):
                detected[field] = col
                break
    return detected


def chunk_alias_mapping(columns: list[str]) -> dict[str, str]:
    """First column whose lower-cased name contains any alias of the target."""
    out = {}
    for target, names in CHUNK_ALIASES.items():
        for col in columns:
            if any(n in col.lower() for n in names):
                out[target] = col
                break
    return out


def apply_column_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename detected columns to the canonical names (the reference computed this mapping and
    then ignored it; here it is applied)."""
    ren = {src: dst for dst, src in mapping.items() if src != dst and dst not in df.columns}
    return df.withColumnsRenamed(ren) if ren else df


def content_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """C12 / S12 data: one aggregate pass over the whole table → one row per column with the
    share of non-null values matching each date / amount pattern, mean length and share with
    letters (the reference looks at 10 sampled values; the whole table is exact)."""
    cols = cols if cols is not None else list(df.columns)
    rows = []
    for c in cols:
        v = F.col(c).cast("string")
        n = F.count(v)
        fr = lambda cond: F.try_divide(F.count(F.when(cond, 1)), n)
        rows.append(F.struct(
            F.lit(c).alias("column"), n.alias("non_null"),
            F.greatest(*[fr(v.rlike(p)) for p in CONTENT_DATE_PATTERNS]).alias("date_share"),
            F.greatest(*[fr(v.rlike(p)) for p in CONTENT_AMOUNT_PATTERNS]).alias("amount_share"),
            F.avg(F.length(v)).alias("mean_length"),
            fr(v.rlike("[a-zA-Z]")).alias("letter_share"),
            fr(v.rlike(r"\d+\.?\d*")).alias("numeric_share")))
    prof = df.agg(F.array(*rows).alias("p")).select(F.inline("p"))
    return prof.withColumn(
        "detected_as",
        F.when(F.col("date_share") >= 0.7, F.lit("date"))
         .when(F.col("amount_share") >= 0.5, F.lit("amount"))
         .when((F.col("mean_length") > 5) & (F.col("letter_share") >= 0.8), F.lit("description")))


def detect_columns_by_content(df: DataFrame, cols: list[str] | None = None) -> dict[str, str]:
    """C12 decision: later columns overwrite earlier ones for the same field (reference rule)."""
    detected = {}
    for r in content_profile(df, cols).collect():   # one row per column: bounded by the schema
        if r["detected_as"]:
            detected[r["detected_as"]] = r["column"]
    return detected


def has_valid_structure(df: DataFrame) -> bool:
    """Non-empty, ≥ 3 columns, some cell with a number."""
    if len(df.columns) < 3:
        return False
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.max(F.greatest(*[F.coalesce(F.col(c).cast("string").rlike(r"\d+\.?\d*"), F.lit(False))
                                    for c in df.columns])).alias("num")).first()
    return bool(row["n"]) and bool(row["num"])


# ---- C14 normalise ---------------------------------------------------------------------

def normalize_table(df: DataFrame, sign_words=("debit", "expense", "withdrawal", "payment")) -> DataFrame:
    """C14: lower-case names, coerce known date and amount columns (bad text → NULL), sign
    from ``type``; Q24: if only debit/credit columns exist, amount = credit − debit."""
    out = normalize_column_names(df)
    for c in NORMALIZE_DATE_COLUMNS:
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("string").try_cast("timestamp"),
                                               F.try_to_timestamp(F.col(c).cast("string"), F.lit("M/d/yyyy"))).cast("date"))
    for c in NORMALIZE_AMOUNT_COLUMNS:
        if c in out.columns:
            txt = F.col(c).cast("string")
            out = out.withColumn(c, F.when(txt.rlike(NUMERIC_TEXT), txt.try_cast("double")))
    if "amount" not in out.columns and ("debit" in out.columns or "credit" in out.columns):
        cr = F.coalesce(F.col("credit"), F.lit(0.0)) if "credit" in out.columns else F.lit(0.0)
        dr = F.coalesce(F.col("debit"), F.lit(0.0)) if "debit" in out.columns else F.lit(0.0)
        out = out.withColumn("amount", cr - dr)
    if "type" in out.columns and "amount" in out.columns:
        out = out.withColumn("amount", F.when(F.lower(F.col("type")).isin(*sign_words), -F.abs("amount"))
                             .otherwise(F.col("amount")))
    return out
