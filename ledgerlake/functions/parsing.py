"""Statement field parsing as native column expressions.

Everything here maps Column → Column and stays inside whole-stage codegen: ordered rule lists
become ``CASE WHEN`` chains, format priority lists become ``coalesce`` over ``try_*`` parsers
(Spark 4 runs ANSI, so a plain cast would raise on bad text).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.dims import (CURRENCY_PATTERNS, DATE_FORMATS, DEBIT_WORDS, DEFENSIVE_SYMBOLS,
                             LOOKS_LIKE_AMOUNT, LOOKS_LIKE_DATE, MONTH_ABBREVIATIONS,
                             SIGN_DEBIT_WORDS)

# Formats that carry a two-digit year (Spark maps yy to 2000-2099; Python's strptime maps
# 69-99 to the 1900s) and formats that carry no year (Python fills the current year).
_TWO_DIGIT = {"M/d/yy", "M-d-yy", "d/M/yy", "d-M-yy"}
_NO_YEAR = {"M/d", "M-d"}
# The defensive parser only knows the first nine formats.
DEFENSIVE_DATE_FORMATS = DATE_FORMATS[:9]


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "") | (F.lower(F.trim(c)) == "nan")


def replace_month_names(c: Column) -> Column:
    """'15-Jan-2024' -> '15-01-2024' (whole-word, case-insensitive). Texts without letters —
    nearly all dates — skip the twelve replacements."""
    r = c
    for i, m in enumerate(MONTH_ABBREVIATIONS, start=1):
        r = F.regexp_replace(r, rf"(?i)\b{m}\b", f"{i:02d}")
    return F.when(c.rlike("[A-Za-z]"), r).otherwise(c)


def format_regex(fmt: str) -> str:
    """Full-match guard for a format: yyyy = 4 digits, yy = 2, M d H m s = 1–2 (strptime's
    field widths; Spark's own parser is looser, e.g. it takes a 3-digit day)."""
    out, i = "", 0
    while i < len(fmt):
        if fmt.startswith("yyyy", i):
            out, i = out + r"\d{4}", i + 4
        elif fmt.startswith("yy", i):
            out, i = out + r"\d{2}", i + 2
        elif fmt[i] in "MdHms":
            out, i = out + r"\d{1,2}", i + 1
        else:
            out, i = out + ("\\" + fmt[i] if fmt[i] in ".^$*+?()[]{}|\\/" else fmt[i]), i + 1
    return "^" + out + "$"


def _try_format(s: Column, fmt: str, as_of: Column) -> Column:
    ts = F.when(s.rlike(format_regex(fmt)), F.try_to_timestamp(s, F.lit(fmt)))
    d = ts.cast("date")
    if fmt in _TWO_DIGIT:
        d = F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)
    if fmt in _NO_YEAR:
        d = F.make_date(F.year(as_of), F.month(d), F.dayofmonth(d))
    return d


def normalize_date_text(c: Column) -> Column:
    """Trimmed text with month names replaced; compute it once per row (see ``with_date``)."""
    return replace_month_names(F.trim(c))


def parse_date_normalized(s: Column, as_of: Column | None = None, formats=None) -> Column:
    """First format (in priority order) that parses the whole text wins; NULL if none."""
    as_of = as_of if as_of is not None else F.current_date()
    formats = formats or DATE_FORMATS
    out = F.coalesce(*[_try_format(s, f, as_of) for f in formats])
    return F.when(_blank(s), F.lit(None).cast("date")).otherwise(out)


def with_dates(df, pairs: dict[str, str], as_of: Column | None = None, defensive: bool = False):
    """Add one parsed DATE column per ``{out: src}`` in two projections: the normalised texts
    are columns of their own, so the format attempts read them instead of re-evaluating the
    month-name replacements (Catalyst keeps the projections apart because each text is
    referenced many times), and all columns share the same two projections (one analysis)."""
    fmts = DEFENSIVE_DATE_FORMATS if defensive else None
    tmp = {out: f"_{out}_txt" for out in pairs}
    staged = df.select("*", *[(F.trim(F.col(src)) if defensive else normalize_date_text(F.col(src))).alias(tmp[o])
                              for o, src in pairs.items()])
    staged = staged.select("*", *[parse_date_normalized(F.col(tmp[o]), as_of, fmts).alias(o) for o in pairs])
    return staged.drop(*tmp.values())


def with_date(df, src: str, out: str, as_of: Column | None = None, defensive: bool = False):
    """Single-column :func:`with_dates`."""
    return with_dates(df, {out: src}, as_of, defensive)


def _literal(pattern: str) -> str | None:
    """The text a regex matches if it is a plain literal (only '\\$' escapes), else None."""
    lit = pattern.replace("\\$", "$")
    return None if any(ch in lit for ch in "\\^[](){}*+?|.") else lit


def detect_currency(c: Column) -> Column:
    """ordered pattern list, first pattern found anywhere in the text wins; default USD.

    Same result as testing each regex in turn, with cheaper tests: literal patterns ('C$',
    'RM', '€', …) are substring tests, '^\\$' is a prefix test, and the 27 '\\bXXX\\b' code
    patterns are one ``regexp_extract_all`` whose matches are ranked by list position (the
    earliest pattern that matches anywhere is the smallest position among the matches)."""
    s = F.trim(c)
    out = None
    codes: list[str] = []
    for pat, code in CURRENCY_PATTERNS:
        m = re.fullmatch(r"\\b([A-Z]{3})\\b", pat)
        if m:
            codes.append(m.group(1))
            continue
        lit = _literal(pat)
        if lit is not None:
            cond = F.contains(s, F.lit(lit))
        elif pat == "^\\$":
            cond = s.startswith("$")
        else:
            cond = s.rlike(pat)
        if codes:
            raise ValueError("code patterns must come last in CURRENCY_PATTERNS")
        out = F.when(cond, F.lit(code)) if out is None else out.when(cond, F.lit(code))
    code_list = F.array(*[F.lit(x) for x in codes])
    found = F.regexp_extract_all(s, F.lit(r"\b(" + "|".join(codes) + r")\b"), 1)
    first = F.array_min(F.transform(found, lambda x: F.array_position(code_list, x)))
    out = out.when(F.size(found) > 0, F.element_at(code_list, first.cast("int")))
    return F.when(c.isNull() | (s == ""), F.lit("USD")).otherwise(out.otherwise(F.lit("USD")))


def _normalise_separators(cleaned: Column, zero_digits_is_decimal: bool) -> Column:
    """',' and '.' both present -> the last one is the decimal mark; only ',' -> decimal when
    1–2 digits follow (0–2 for the defensive parser), else thousands."""
    has_c = F.instr(cleaned, ",") > 0
    has_d = F.instr(cleaned, ".") > 0
    after_c = F.substring_index(cleaned, ",", -1)
    after_d = F.substring_index(cleaned, ".", -1)
    comma_last = F.length(after_c) < F.length(after_d)   # last ',' is right of the last '.'
    euro = F.replace(F.replace(cleaned, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    us = F.replace(cleaned, F.lit(","), F.lit(""))
    low = 0 if zero_digits_is_decimal else 1
    comma_dec = F.length(after_c).between(low, 2)
    return (F.when(has_c & has_d, F.when(comma_last, euro).otherwise(us))
             .when(has_c, F.when(comma_dec, F.replace(cleaned, F.lit(","), F.lit("."))).otherwise(us))
             .otherwise(cleaned))


_NUMBER = r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"
_SIGNED_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"


def with_amounts(df, pairs: dict[str, str], defensive: bool = False):
    """Add one STRUCT<amount, currency> per ``{out: src}`` (F5, or F6 if ``defensive``) in
    staged projections shared by all columns: cleaned text (+ detected currency) →
    separator-normalised text → value → struct. Each stage reads the previous one as a column,
    so the generated code stays linear in the rule count."""
    names = {o: {k: f"_{o}_{k}" for k in "cnvd"} for o in pairs}
    st1 = []
    for o, src in pairs.items():
        st1.append(F.regexp_replace(F.trim(F.col(src)), r"[^0-9.,+\-]", "").alias(names[o]["c"]))
        st1.append((defensive_currency(F.trim(F.col(src))) if defensive else detect_currency(F.col(src)))
                   .alias(names[o]["d"]))
    df = df.select("*", *st1)
    df = df.select("*", *[_normalise_separators(F.col(names[o]["c"]), zero_digits_is_decimal=defensive)
                          .alias(names[o]["n"]) for o in pairs])
    st3 = []
    for o, src in pairs.items():
        n = F.col(names[o]["n"])
        if defensive:
            st3.append(F.when(~_blank(F.col(src)) & n.rlike(_SIGNED_NUMBER), n.try_cast("double")).alias(names[o]["v"]))
        else:
            digits = F.regexp_replace(n, r"[+\-]", "")
            st3.append(F.when(digits.rlike(_NUMBER), digits.try_cast("double")).alias(names[o]["v"]))
    df = df.select("*", *st3)
    outs = []
    for o, src in pairs.items():
        c, n, v, d = (F.col(names[o][k]) for k in "cnvd")
        blank = _blank(F.col(src))
        if defensive:
            outs.append(F.struct(v.alias("amount"), d.alias("currency")).alias(o))
            continue
        signed = F.when(n.startswith("-"), -v).otherwise(v)
        in_range = ~((F.abs(signed) > 1e9) | ((F.abs(signed) < 1e-6) & (signed != 0)))
        amount = F.when(~blank & in_range, signed)
        currency = (F.when(blank, F.lit("USD")).when(c == "", d).when(v.isNull(), F.lit("USD")).otherwise(d))
        outs.append(F.struct(amount.alias("amount"), currency.alias("currency")).alias(o))
    df = df.select("*", *outs)
    return df.drop(*[x for o in pairs for x in names[o].values()])


def with_amount(df, src: str, out: str, defensive: bool = False):
    """Single-column :func:`with_amounts`."""
    return with_amounts(df, {out: src}, defensive)


def defensive_currency(c: Column) -> Column:
    """F6 symbol lookup: first symbol of the dictionary contained in the text."""
    out = None
    for sym, code in DEFENSIVE_SYMBOLS:
        cond = F.instr(c, sym) > 0
        out = F.when(cond, F.lit(code)) if out is None else out.when(cond, F.lit(code))
    return out.otherwise(F.lit("USD"))


# ---- content predicates (F7), prefix match like re.match -------------------------------

def looks_like_date(c: Column) -> Column:
    return F.coalesce(c.rlike(f"^({LOOKS_LIKE_DATE})"), F.lit(False))


def looks_like_amount(c: Column) -> Column:
    return F.coalesce(c.rlike(f"^({LOOKS_LIKE_AMOUNT})"), F.lit(False))


def looks_like_description(c: Column) -> Column:
    return F.coalesce((F.length(c) > 3) & c.rlike("[a-zA-Z]") & ~c.rlike(r"^\d+$"), F.lit(False))


# ---- type / sign (F8, F9) ----------------------------------------------------------------

def debit_credit(type_col: Column) -> Column:
    """F8: 'debit' for debit/expense/withdrawal (any case), else 'credit'."""
    return F.when(F.lower(F.trim(type_col)).isin(*DEBIT_WORDS), F.lit("debit")).otherwise(F.lit("credit"))


def signed_amount(amount: Column, type_col: Column) -> Column:
    """−|amount| when the type says debit/expense/withdrawal/payment."""
    return F.when(F.lower(F.trim(type_col)).isin(*SIGN_DEBIT_WORDS), -F.abs(amount)).otherwise(amount)
