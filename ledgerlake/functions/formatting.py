"""Currency and number formatting as column expressions.

``format_number`` rounds HALF_EVEN on the exact binary value and groups with ','; that is what
Python's ``f"{x:,.2f}"`` does, so the report style needs no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.dims import LOCALE_FORMATS, report_formats
from ledgerlake.functions.literals import map_of_structs


def _map(pairs) -> Column:
    return F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.lit(v))])


def _fmt_number_var(x: Column, decimals: Column, choices=(0, 2, 3, 6, 8)) -> Column:
    """format_number with a per-row number of decimals (a CASE over the few values used)."""
    out = None
    for d in choices:
        out = (F.when(decimals == d, F.format_number(x, d)) if out is None
               else out.when(decimals == d, F.format_number(x, d)))
    return out.otherwise(F.format_number(x, 2))


def _info_map(rows, fields) -> Column:
    """One literal MAP<code, STRUCT<fields>> (a single lookup per row for all attributes)."""
    return map_of_structs(rows, fields)


def report_format_info(currency: Column) -> Column:
    """STRUCT<symbol, position, decimals> of the report style, NULL for unknown codes. Compute
    it once per row (as a column) when several amounts of the row are formatted."""
    return F.element_at(_info_map(report_formats(), ("symbol", "position", "decimals")), currency)


def format_currency_report(amount: Column, currency: Column, info: Column | None = None) -> Column:
    """Report style (F11): ',' grouping, the sign stays after a leading symbol ('$-5.00');
    unknown codes print as '1,234.50 XYZ'. ``info``: a precomputed :func:`report_format_info`."""
    info = info if info is not None else report_format_info(currency)
    num = _fmt_number_var(amount, info["decimals"])
    return (F.when(info.isNull(), F.concat(F.format_number(amount, 2), F.lit(" "), currency))
             .when(info["position"] == "before", F.concat(info["symbol"], num))
             .otherwise(F.concat(num, F.lit(" "), info["symbol"])))


def format_currency_locale(amount: Column, currency: Column) -> Column:
    """Locale style (F10): absolute value, the currency's own separators; unknown → USD.

    Quirk kept: with decimals > 0 and ',' as thousands separator no grouping is applied;
    zero-decimal currencies are truncated (int()) and grouped.
    """
    m = _info_map(LOCALE_FORMATS, ("symbol", "position", "decimals", "tsep", "dsep"))
    info = F.coalesce(F.element_at(m, currency), F.element_at(m, F.lit("USD")))
    sym, pos, dec, tsep, dsep = (info[k] for k in ("symbol", "position", "decimals", "tsep", "dsep"))
    a = F.abs(amount)
    # zero decimals: int(abs) grouped with ',' then ',' -> thousands separator
    zero_dec = F.replace(F.format_number(F.floor(a), 0), F.lit(","), tsep)
    # fixed decimals without grouping: format_number groups, so strip its commas again
    plain = (F.when(dec == 8, F.replace(F.format_number(a, 8), F.lit(","), F.lit("")))
              .otherwise(F.replace(F.format_number(a, 2), F.lit(","), F.lit(""))))
    int_part = F.substring_index(plain, ".", 1)
    frac_part = F.substring_index(plain, ".", -1)
    grouped_int = F.replace(F.format_number(int_part.cast("decimal(38,0)"), 0), F.lit(","), tsep)
    with_dec = (F.when(tsep == ",", F.concat(int_part, dsep, frac_part))
                 .otherwise(F.concat(grouped_int, dsep, frac_part)))
    body = F.when(dec == 0, zero_dec).otherwise(with_dec)
    return (F.when(pos == "before", F.concat(sym, body))
             .otherwise(F.concat(body, F.lit(" "), sym)))


def format_currency_ui(amount: Column, currency: Column) -> Column:
    """UI style (F12): '$1,234.50' for USD, '1,234.50 EUR' otherwise."""
    return (F.when(currency == "USD", F.concat(F.lit("$"), F.format_number(amount, 2)))
             .otherwise(F.concat(F.format_number(amount, 2), F.lit(" "), currency)))


def percent_text(x: Column, decimals: int = 1) -> Column:
    """Python's '{:.1%}': x·100 rounded HALF_EVEN, no grouping, then '%'."""
    return F.concat(F.replace(F.format_number(x * 100, decimals), F.lit(","), F.lit("")), F.lit("%"))
