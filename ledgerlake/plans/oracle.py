"""DuckDB oracle SQL for the registered queries, written independently of the Spark code.

The ``transactions`` derivation is restated in SQL (same adapter lists). Money is rounded through
the shortest decimal text of the double (VARCHAR → DECIMAL) because Spark's ``round`` on a
DOUBLE rounds that text (1.005 → 1.01, 49583.954999999994 → 49583.95) while DuckDB's ``round``
on a DOUBLE rounds the scaled binary value.
"""

from __future__ import annotations

from ledgerlake.dims import BUDGET_SHARES, RULE_STOP_WORDS, WEEKDAY_NAMES, fallback_rates, report_formats
from ledgerlake.sources.testdata import ADAPTER_CATEGORIES, ADAPTER_CURRENCIES, ADAPTER_DESCRIPTIONS

ORACLES: dict[str, str] = {}


def r(x: str, d: int = 2) -> str:
    return f"CAST(ROUND(CAST(CAST(CAST(({x}) AS DOUBLE) AS VARCHAR) AS DECIMAL(38,17)), {d}) AS DOUBLE)"


def ms(x: str) -> str:
    """Exact money sum (cents as DECIMAL), reported as DOUBLE — same as the Spark side."""
    return f"CAST(sum(CAST(({x}) AS DECIMAL(18,2))) AS DOUBLE)"


def ma(x: str) -> str:
    return f"({ms(x)} / count({x}))"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(vals) -> str:
    return "[" + ", ".join(sql_str(v) for v in vals) + "]"


BASE = f"""
t0 AS (
  SELECT o_orderkey AS txn_id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS date,
         {sql_list(ADAPTER_DESCRIPTIONS)}[CAST((o_orderkey * 7 + o_custkey) % {len(ADAPTER_DESCRIPTIONS)} AS INTEGER) + 1] AS description,
         CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE -o_totalprice END AS amount,
         {sql_list(ADAPTER_CURRENCIES)}[CAST(o_orderkey % {len(ADAPTER_CURRENCIES)} AS INTEGER) + 1] AS currency,
         {sql_list(ADAPTER_CATEGORIES)}[CAST(o_orderkey % {len(ADAPTER_CATEGORIES)} AS INTEGER) + 1] AS category
  FROM orders),
t AS (SELECT *, CASE WHEN amount < 0 THEN 'debit' ELSE 'credit' END AS type FROM t0),
e AS (SELECT account_id, date, description, currency, category, -amount AS amount FROM t WHERE amount < 0)
"""

WEEKDAYS = "(VALUES " + ", ".join(f"({i}, {sql_str(n)})" for i, n in enumerate(WEEKDAY_NAMES)) + ") wd(weekday, day_name)"
DAYNAME = sql_list(WEEKDAY_NAMES)
RATES = "(VALUES " + ", ".join(f"({sql_str(c)}, CAST({v!r} AS DOUBLE))" for c, v in fallback_rates()) + ") fx(currency, per_usd)"
FORMATS = ("(VALUES " + ", ".join(f"({sql_str(c)}, {sql_str(s)}, {sql_str(p)}, {d})"
                                   for c, s, p, d in report_formats())
           + ") rf(currency, symbol, position, decimals)")
BUDGETS = "(VALUES " + ", ".join(f"({sql_str(c)}, {i}, CAST({s!r} AS DOUBLE))" for i, (c, s) in enumerate(BUDGET_SHARES)) + ") b(category, category_ord, share)"


def q(name: str, body: str, ctes: str = "") -> None:
    ORACLES[name] = f"WITH {BASE}{(', ' + ctes) if ctes else ''}\n{body}"


def fmt_report(amount: str, cur: str) -> str:
    """Report-style currency text over the rf (formats) relation joined as ``rf``."""
    num = (f"CASE rf.decimals WHEN 0 THEN format('{{:,.0f}}', {amount}) WHEN 3 THEN format('{{:,.3f}}', {amount}) "
           f"WHEN 6 THEN format('{{:,.6f}}', {amount}) WHEN 8 THEN format('{{:,.8f}}', {amount}) "
           f"ELSE format('{{:,.2f}}', {amount}) END")
    return (f"CASE WHEN rf.symbol IS NULL THEN format('{{:,.2f}}', {amount}) || ' ' || {cur} "
            f"WHEN rf.position = 'before' THEN rf.symbol || {num} ELSE {num} || ' ' || rf.symbol END")


# ---- spending aggregates ---------------------------------------------------------------

q("category_breakdown", f"""
SELECT account_id, category, {r('s')} AS sum, n AS count, {r('m')} AS mean,
       {r(r('s') + ' / CAST(sum(CAST(s AS DECIMAL(18,2))) OVER (PARTITION BY account_id) AS DOUBLE) * 100')} AS percentage
FROM c""", f"c AS (SELECT account_id, category, {ms('amount')} s, count(*) n, {ma('amount')} m FROM e GROUP BY 1, 2)")

q("spending_totals", f"""
SELECT account_id, {r(ms('CASE WHEN amount < 0 THEN -amount END'))} AS total_expenses,
       count(CASE WHEN amount < 0 THEN 1 END) AS total_transactions,
       count(DISTINCT currency) AS n_currencies,
       array_to_string(list_sort(list_distinct(list(currency))), ',') AS currencies
FROM t GROUP BY account_id HAVING count(CASE WHEN amount < 0 THEN 1 END) > 0""")

q("avg_daily_expense", f"""
SELECT account_id, {r(ma('s'))} AS avg_daily_expense, count(*) AS expense_days FROM d GROUP BY 1""",
  f"d AS (SELECT account_id, date, {ms('amount')} s FROM e GROUP BY 1, 2)")

q("monthly_spending", f"""
SELECT account_id, strftime(date, '%Y-%m') AS month, {r(ms('amount'))} AS amount FROM e GROUP BY 1, 2""")

q("weekday_pattern", f"""
SELECT a.account_id, CAST(wd.weekday AS INTEGER) AS weekday, wd.day_name, {r('coalesce(s.amt, 0.0)')} AS amount
FROM (SELECT DISTINCT account_id FROM e) a CROSS JOIN {WEEKDAYS}
LEFT JOIN s ON s.account_id = a.account_id AND s.weekday = wd.weekday""",
  f"s AS (SELECT account_id, isodow(date) - 1 AS weekday, {ms('amount')} amt FROM e GROUP BY 1, 2)")

q("weekday_mean", f"""
SELECT account_id, CAST(isodow(date) - 1 AS INTEGER) AS weekday, {r(ma('amount'))} AS amount,
       {DAYNAME}[CAST(isodow(date) AS INTEGER)] AS day_name
FROM e GROUP BY 1, 2, 4""")

q("top_merchants", f"""
SELECT CAST(row_number() OVER (ORDER BY s DESC, description) AS INTEGER) AS rank, description, {r('s')} AS amount
FROM p ORDER BY s DESC, description LIMIT 10""",
  f"p AS (SELECT description, {ms('amount')} s FROM e GROUP BY 1)")

q("top_merchants_per_account", f"""
SELECT account_id, CAST(rank AS INTEGER) AS rank, description, {r('s')} AS amount FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY s DESC, description) AS rank FROM p)
WHERE rank <= 10""", f"p AS (SELECT account_id, description, {ms('amount')} s FROM e GROUP BY 1, 2)")

q("analysis_period", """
SELECT account_id, strftime(min(date), '%Y-%m-%d') AS start_date, strftime(max(date), '%Y-%m-%d') AS end_date,
       CAST(datediff('day', min(date), max(date)) AS BIGINT) AS days
FROM e GROUP BY 1""")

q("category_share", f"""
SELECT account_id, category, {r('s')} AS amount, {r('s / CAST(sum(CAST(s AS DECIMAL(18,2))) OVER (PARTITION BY account_id) AS DOUBLE) * 100')} AS share_pct
FROM c""", f"c AS (SELECT account_id, category, {ms('amount')} s FROM e GROUP BY 1, 2)")

_ARGMAX = """
SELECT account_id, currency AS primary_currency FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY score DESC, currency) rn FROM p) WHERE rn = 1"""

q("primary_currency_volume", _ARGMAX,
  f"p AS (SELECT account_id, currency, {ms('abs(amount)')} score FROM t GROUP BY 1, 2)")
q("primary_currency_frequency", _ARGMAX,
  "p AS (SELECT account_id, currency, count(*) score FROM t GROUP BY 1, 2)")
q("primary_currency_blended", _ARGMAX,
  f"""p0 AS (SELECT account_id, currency, count(*) n, {ms('abs(amount)')} v FROM t GROUP BY 1, 2),
p AS (SELECT account_id, currency,
             CAST(0.7 AS DOUBLE) * n / sum(n) OVER (PARTITION BY account_id)
           + CAST(0.3 AS DOUBLE) * coalesce(v / nullif(CAST(sum(CAST(v AS DECIMAL(18,2))) OVER (PARTITION BY account_id) AS DOUBLE), 0), 0.0) AS score FROM p0)""")

q("category_summary", f"""
SELECT account_id, category, count(*) AS count, {r(ms('abs(amount)'))} AS total FROM t GROUP BY 1, 2""")

q("simple_analysis", f"""
SELECT account_id, count(*) AS total_transactions, {r(ms('abs(amount)'))} AS total_amount,
       {r('coalesce(' + ms('CASE WHEN amount < 0 THEN -amount END') + ', 0.0)')} AS total_expenses,
       {r('coalesce(' + ms('CASE WHEN amount > 0 THEN amount END') + ', 0.0)')} AS total_income,
       {r(ms('abs(amount)') + ' / count(*)')} AS average_transaction
FROM t GROUP BY 1""")

q("currency_breakdown", f"""
SELECT account_id, currency, {r(ms('abs(amount)'))} AS amount, count(*) AS count FROM t GROUP BY 1, 2""")

q("headline_metrics", f"""
SELECT account_id, count(*) AS total_rows, {r(ms('abs(amount)'))} AS total_amount, {r(ms('amount'))} AS net_amount,
       count(DISTINCT category) AS n_categories, count(DISTINCT currency) AS n_currencies
FROM t GROUP BY 1""")

q("monthly_income", f"""
SELECT account_id, {r(ma('m'))} AS monthly_income, count(*) AS income_months FROM mi GROUP BY 1""",
  f"mi AS (SELECT account_id, strftime(date, '%Y-%m') AS month, {ms('amount')} m FROM t WHERE amount > 0 GROUP BY 1, 2)")

q("spending_facets", f"""
SELECT account_id, 'total' AS facet, 'all' AS label, {r(ms('amount'))} AS amount, count(*) AS count FROM e GROUP BY 1
UNION ALL
SELECT account_id, 'category', category, {r(ms('amount'))}, count(*) FROM e GROUP BY 1, 3
UNION ALL
SELECT account_id, 'month', strftime(date, '%Y-%m'), {r(ms('amount'))}, count(*) FROM e GROUP BY 1, 3
UNION ALL
SELECT account_id, 'weekday', {DAYNAME}[CAST(isodow(date) AS INTEGER)], {r(ms('amount'))}, count(*) FROM e GROUP BY 1, 3""")


# ---- currency conversion -------------------------------------------------------------

def _rate(from_cur: str, target: str) -> str:
    to = dict(fallback_rates()).get(target)
    one, tov = "CAST(1.0 AS DOUBLE)", f"CAST({to!r} AS DOUBLE)"
    return (f"CASE WHEN upper({from_cur}) = '{target}' THEN {one} "
            f"WHEN upper({from_cur}) = 'USD' THEN {tov} "
            f"WHEN '{target}' = 'USD' THEN {one} / coalesce(fx.per_usd, {one}) "
            f"ELSE {one} / coalesce(fx.per_usd, {one}) * {tov} END")


q("convert_currency", f"""
SELECT t.txn_id, t.account_id, {r('t.amount')} AS original_amount, t.currency AS original_currency,
       {r(_rate('t.currency', 'EUR'), 8)} AS conversion_rate,
       {r('t.amount * (' + _rate('t.currency', 'EUR') + ')')} AS amount,
       'EUR' AS currency, 'EUR' AS display_currency,
       (fx.per_usd IS NULL AND upper(t.currency) <> 'EUR') AS rate_missing
FROM t LEFT JOIN {RATES} ON upper(t.currency) = fx.currency""")

q("conversion_summary", f"""
SELECT p.account_id, p.currency, p.count, {r('p.total')} AS total, {r(_rate('p.currency', 'USD'), 6)} AS rate_to_target,
       'USD' AS target_currency
FROM p LEFT JOIN {RATES} ON upper(p.currency) = fx.currency""",
  f"p AS (SELECT account_id, currency, count(*) AS count, {ms('abs(amount)')} AS total FROM t GROUP BY 1, 2)")

q("conversion_stats", f"""
SELECT t.currency AS original_currency, 'USD' AS display_currency, count(*) AS count,
       {r(ms('abs(t.amount)'))} AS total_original,
       {r('CAST(sum(CAST(abs(t.amount * (' + _rate('t.currency', 'USD') + ')) AS DECIMAL(28,10))) AS DOUBLE)')} AS total_converted
FROM t LEFT JOIN {RATES} ON upper(t.currency) = fx.currency GROUP BY 1, 2""")


# ---- budgets -------------------------------------------------------------------------

_REC_CTES = f"""
mi AS (SELECT account_id, CAST(sum(CAST(m AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS income FROM (
         SELECT account_id, strftime(date, '%Y-%m') AS month, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) m
         FROM t WHERE amount > 0 GROUP BY 1, 2) GROUP BY 1),
cur AS (SELECT account_id, category, {ms('amount')} AS spent FROM e GROUP BY 1, 2),
tot AS (SELECT account_id, {ms('amount')} AS total FROM e GROUP BY 1),
pcv AS (SELECT account_id, currency FROM (
          SELECT account_id, currency, row_number() OVER (PARTITION BY account_id ORDER BY v DESC, currency) rn
          FROM (SELECT account_id, currency, {ms('abs(amount)')} v FROM t GROUP BY 1, 2)) WHERE rn = 1),
rec AS (
  SELECT mi.account_id, b.category, b.category_ord, b.share, mi.income,
         mi.income * b.share AS rec_amt, coalesce(cur.spent, 0.0) AS cur_amt,
         coalesce(tot.total, 0.0) AS total, pcv.currency
  FROM mi CROSS JOIN {BUDGETS}
  LEFT JOIN cur ON cur.account_id = mi.account_id AND cur.category = b.category
  LEFT JOIN tot ON tot.account_id = mi.account_id
  LEFT JOIN pcv ON pcv.account_id = mi.account_id),
recf AS (SELECT rec.*, rf.symbol, rf.position, rf.decimals FROM rec LEFT JOIN {FORMATS} ON rf.currency = rec.currency)"""

q("budget_recommendations", f"""
SELECT account_id, category, CAST(category_ord AS INTEGER) AS category_ord, {r('rec_amt')} AS recommended,
       {r('cur_amt')} AS current, {r('rec_amt - cur_amt')} AS difference, {r('share * 100', 1)} AS percentage_of_income,
       {fmt_report('rec_amt', 'currency')} AS formatted_recommended,
       {fmt_report('cur_amt', 'currency')} AS formatted_current,
       {fmt_report('rec_amt - cur_amt', 'currency')} AS formatted_difference,
       currency, CASE WHEN cur_amt <= rec_amt THEN 'Under Budget' ELSE 'Over Budget' END AS status
FROM recf rf""", _REC_CTES)

q("savings_potential", f"""
SELECT account_id, category, {r('cur_amt - rec_amt')} AS savings FROM rec WHERE cur_amt > rec_amt""", _REC_CTES)

q("budget_alerts", f"""
SELECT account_id, category,
       'You are spending ' || {fmt_report('cur_amt - rec_amt', 'currency')} || ' more than recommended in ' || category AS message,
       CASE WHEN cur_amt - rec_amt > rec_amt * 0.5 THEN 'high' ELSE 'medium' END AS severity
FROM recf rf WHERE cur_amt > rec_amt AND cur_amt - rec_amt > rec_amt * 0.2
UNION ALL
SELECT account_id, 'overall',
       'Your total spending (' || {fmt_report('total', 'currency')} || ') exceeds the recommended budget ('
         || {fmt_report('income * 0.8', 'currency')} || ')', 'high'
FROM recf rf WHERE category_ord = 0 AND total > income * 0.8
UNION ALL
SELECT account_id, 'savings',
       'Your savings rate is ' || format('{{:.1f}}', (income - total) / income * 100) || '%. Consider increasing it to at least 20%',
       'medium'
FROM recf rf WHERE category_ord = 0 AND income > 0 AND (income - total) / income < 0.2""", _REC_CTES)

q("budget_vs_actual", f"""
SELECT account_id, category, {r('rec_amt')} AS recommended, {r('cur_amt')} AS actual,
       {r('cur_amt - rec_amt')} AS difference FROM rec""", _REC_CTES)

q("budget_totals", f"""
SELECT account_id, {r(ms(r('rec_amt')))} AS total_recommended, {r(ms(r('cur_amt')))} AS total_current
FROM rec GROUP BY 1""", _REC_CTES)

q("budget_unpivot", f"""
SELECT account_id, category, 'Recommended' AS type, {r('rec_amt')} AS amount FROM rec WHERE rec_amt > 0
UNION ALL
SELECT account_id, category, 'Current' AS type, {r('cur_amt')} AS amount FROM rec WHERE rec_amt > 0""", _REC_CTES)


# ---- statement text, parsing, validation ----------------------------------------------

from ledgerlake.dims import (CURRENCY_PATTERNS, DATE_FORMATS, DEFENSIVE_SYMBOLS,  # noqa: E402
                             LOCALE_FORMATS, MONTH_ABBREVIATIONS)
from ledgerlake.sources.testdata import RAW_AMOUNT_STYLE  # noqa: E402

_PY = [("yyyy", "%Y"), ("yy", "%y"), ("M", "%m"), ("d", "%d"), ("H", "%H"), ("m", "%M"), ("s", "%S")]


def _strptime_format(fmt: str) -> str:
    out, i = "", 0
    while i < len(fmt):
        for tok, py in _PY:
            if fmt.startswith(tok, i):
                out, i = out + py, i + len(tok)
                break
        else:
            out, i = out + fmt[i], i + 1
    return out


def _guard(fmt: str) -> str:
    out, i = "", 0
    while i < len(fmt):
        if fmt.startswith("yyyy", i):
            out, i = out + r"\d{4}", i + 4
        elif fmt.startswith("yy", i):
            out, i = out + r"\d{2}", i + 2
        elif fmt[i] in "MdHms":
            out, i = out + r"\d{1,2}", i + 1
        else:
            out, i = out + (("\\" + fmt[i]) if fmt[i] in "./" else fmt[i]), i + 1
    return out


def _date_sql(s: str, formats) -> str:
    parts = []
    for f in formats:
        d = f"CAST(try_strptime({s}, '{_strptime_format(f)}') AS DATE)"
        if f in ("M/d", "M-d"):
            d = f"make_date(2024, month({d}), day({d}))"
        parts.append(f"CASE WHEN regexp_full_match({s}, '{_guard(f)}') THEN {d} END")
    return (f"CASE WHEN {s} IS NULL OR {s} = '' OR lower({s}) = 'nan' THEN NULL "
            f"ELSE COALESCE({', '.join(parts)}) END")


def _months_sql(s: str) -> str:
    for i, m in enumerate(MONTH_ABBREVIATIONS, start=1):
        s = f"regexp_replace({s}, '(?i)\\b{m}\\b', '{i:02d}', 'g')"
    return s


def _currency_sql(t: str) -> str:
    arms = " ".join(f"WHEN regexp_matches({t}, {sql_str(p)}) THEN '{c}'" for p, c in CURRENCY_PATTERNS)
    return f"CASE WHEN {t} IS NULL OR {t} = '' THEN 'USD' {arms} ELSE 'USD' END"


def _defensive_currency_sql(t: str) -> str:
    arms = " ".join(f"WHEN strpos({t}, {sql_str(s)}) > 0 THEN '{c}'" for s, c in DEFENSIVE_SYMBOLS)
    return f"CASE {arms} ELSE 'USD' END"


def _norm_sql(c: str, low: int) -> str:
    ac, ad = f"regexp_extract({c}, '[^,]*$')", f"regexp_extract({c}, '[^.]*$')"
    return (f"CASE WHEN strpos({c}, ',') > 0 AND strpos({c}, '.') > 0 THEN "
            f"(CASE WHEN length({ac}) < length({ad}) THEN replace(replace({c}, '.', ''), ',', '.') ELSE replace({c}, ',', '') END) "
            f"WHEN strpos({c}, ',') > 0 THEN (CASE WHEN length({ac}) BETWEEN {low} AND 2 THEN replace({c}, ',', '.') ELSE replace({c}, ',', '') END) "
            f"ELSE {c} END")


_raw_amount = "CASE cur " + " ".join(
    f"WHEN '{code}' THEN {sql_str(pre)} || {('num' if dec == '.' else "replace(num, '.', " + sql_str(dec) + ")")} || {sql_str(suf)}"
    for code, (pre, dec, suf) in RAW_AMOUNT_STYLE.items()) + " END"

RAW = f"""
r0 AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus,
              CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS num,
              {sql_list(ADAPTER_CURRENCIES)}[CAST(o_orderkey % {len(ADAPTER_CURRENCIES)} AS INTEGER) + 1] AS cur,
              {sql_list(ADAPTER_CATEGORIES)}[CAST(o_orderkey % {len(ADAPTER_CATEGORIES)} AS INTEGER) + 1] AS cat
       FROM orders),
raw AS (SELECT o_orderkey AS txn_id, o_custkey AS account_id,
          CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y')
               WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d')
               WHEN 4 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE strftime(o_orderdate, '%d-%b-%Y') END AS date,
          {sql_list(ADAPTER_DESCRIPTIONS)}[CAST((o_orderkey * 7 + o_custkey) % {len(ADAPTER_DESCRIPTIONS)} AS INTEGER) + 1] AS description,
          {_raw_amount} AS amount,
          CASE WHEN o_orderstatus = 'O' THEN 'Credit' ELSE 'Debit' END AS type,
          upper(substr(cat, 1, 1)) || substr(cat, 2) AS category
        FROM r0),
messy AS (SELECT txn_id, account_id,
          CASE txn_id % 20 WHEN 1 THEN 'invalid-date' WHEN 5 THEN '----------' WHEN 6 THEN 'Date' WHEN 7 THEN NULL
               WHEN 12 THEN strftime(DATE '1970-01-01' + CAST(txn_id % 9000 AS INTEGER), '%m/%d/%y')
               WHEN 13 THEN description ELSE date END AS date,
          CASE txn_id % 20 WHEN 2 THEN '' WHEN 4 THEN '  "' || description || '"  ' WHEN 5 THEN NULL
               WHEN 6 THEN 'Description' WHEN 7 THEN NULL WHEN 8 THEN 'nan' WHEN 13 THEN date ELSE description END AS description,
          CASE txn_id % 20 WHEN 3 THEN 'invalid-amount' WHEN 5 THEN NULL WHEN 6 THEN 'Amount' WHEN 7 THEN NULL
               WHEN 9 THEN '0.00' WHEN 14 THEN '-' || amount ELSE amount END AS amount,
          CASE txn_id % 20 WHEN 5 THEN NULL WHEN 6 THEN 'Type' WHEN 7 THEN NULL WHEN 11 THEN NULL ELSE type END AS type,
          CASE txn_id % 20 WHEN 5 THEN NULL WHEN 6 THEN 'Category' WHEN 7 THEN NULL WHEN 10 THEN '' ELSE category END AS category
        FROM raw),
pa AS (SELECT *, trim(date) AS dt, trim(amount) AS atx,
              regexp_replace(trim(amount), '[^0-9.,+\\-]', '', 'g') AS ac FROM messy),
pb AS (SELECT *, {_months_sql('dt')} AS dn, {_currency_sql('atx')} AS cur, {_defensive_currency_sql('atx')} AS dcur,
              {_norm_sql('ac', 1)} AS an, {_norm_sql('ac', 0)} AS dn_amt FROM pa),
pc AS (SELECT *, {_date_sql('dn', DATE_FORMATS)} AS pdate, {_date_sql('dt', DATE_FORMATS[:9])} AS ddate,
              regexp_replace(an, '[+\\-]', '', 'g') AS digits FROM pb),
pd AS (SELECT *,
          CASE WHEN regexp_full_match(digits, '[0-9]+\\.?[0-9]*|\\.[0-9]+') THEN TRY_CAST(digits AS DOUBLE) END AS av,
          CASE WHEN atx IS NULL OR atx = '' OR lower(atx) = 'nan' THEN NULL
               WHEN regexp_full_match(dn_amt, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN TRY_CAST(dn_amt AS DOUBLE) END AS damount
        FROM pc),
pe AS (SELECT *, CASE WHEN starts_with(an, '-') THEN -av ELSE av END AS sv FROM pd),
parsed AS (SELECT *,
          CASE WHEN atx IS NULL OR atx = '' OR lower(atx) = 'nan' THEN NULL
               WHEN abs(sv) > 1e9 OR (abs(sv) < 1e-6 AND sv <> 0) THEN NULL ELSE sv END AS amt,
          CASE WHEN atx IS NULL OR atx = '' OR lower(atx) = 'nan' THEN 'USD' WHEN ac = '' THEN cur
               WHEN av IS NULL THEN 'USD' ELSE cur END AS amt_cur
        FROM pe),
st AS (SELECT *,
          CASE WHEN lower(trim(type)) IN ('debit', 'expense', 'withdrawal', 'payment') THEN -abs(amt) ELSE amt END AS samt
        FROM parsed),
stmt AS (SELECT txn_id, account_id, pdate AS date, trim(description) AS description, samt AS amount, amt_cur AS currency,
          CASE WHEN type IS NULL THEN (CASE WHEN samt < 0 THEN 'debit' ELSE 'credit' END)
               WHEN lower(trim(type)) IN ('debit', 'expense', 'withdrawal') THEN 'debit' ELSE 'credit' END AS type,
          coalesce(lower(trim(category)), '') AS category, 0.7 AS confidence_score,
          CASE WHEN pdate IS NULL THEN 'invalid_date'
               WHEN atx IS NULL OR atx = '' OR lower(atx) IN ('nan', 'none') THEN 'missing_amount'
               WHEN amt IS NULL THEN 'invalid_amount'
               WHEN trim(description) IS NULL OR trim(description) = '' THEN 'missing_description'
               WHEN amt = 0 THEN 'missing_amount'
               WHEN lower(trim(description)) IN ('nan', 'null') THEN 'invalid_description' END AS reject_reason
        FROM st),
good AS (SELECT * FROM stmt WHERE reject_reason IS NULL)
"""

q("parse_dates", """
SELECT txn_id, date AS date_text, strftime(pdate, '%Y-%m-%d') AS parsed_date, strftime(ddate, '%Y-%m-%d') AS defensive_date
FROM parsed""", RAW)

q("detect_currency", "SELECT txn_id, amount AS amount_text, cur AS currency FROM parsed", RAW)

q("parse_amounts", """
SELECT txn_id, amount AS amount_text, amt AS amount, amt_cur AS currency, damount AS defensive_amount,
       dcur AS defensive_currency FROM parsed""", RAW)

q("parse_transactions", """
SELECT txn_id, account_id, strftime(date, '%Y-%m-%d') AS date, description, amount, currency, type, category,
       CAST(confidence_score AS DOUBLE) AS confidence_score, reject_reason FROM stmt""", RAW)

q("validate_rejects", """
SELECT coalesce(reject_reason, 'accepted') AS reason, count(*) AS count, min(txn_id) AS first_txn_id
FROM stmt GROUP BY 1""", RAW)

q("dataset_check", """
SELECT account_id, count(*) AS n_rows, min(CASE WHEN bad THEN txn_id END) IS NULL AS valid,
       CASE WHEN min(CASE WHEN bad THEN txn_id END) IS NULL THEN NULL ELSE 'category cannot be empty' END AS error,
       min(CASE WHEN bad THEN txn_id END) AS first_bad_txn_id
FROM (SELECT *, coalesce(trim(category), '') = '' AS bad FROM good) GROUP BY 1""", RAW)

q("clean_chart_rows", f"""
SELECT account_id, count(*) AS rows, {r(ms('amount'))} AS amount FROM good
WHERE coalesce(trim(category), '') <> '' AND amount IS NOT NULL AND NOT isnan(amount) GROUP BY 1""", RAW)

q("sign_from_type", """
SELECT txn_id, type, CASE WHEN lower(trim(type)) IN ('debit', 'expense', 'withdrawal') THEN 'debit' ELSE 'credit' END AS flag,
       CASE WHEN lower(trim(type)) IN ('debit', 'expense', 'withdrawal', 'payment') THEN -abs(a) ELSE a END AS signed_amount
FROM (SELECT txn_id, type, CAST(replace(regexp_replace(amount, '[^0-9.,]', '', 'g'), ',', '.') AS DOUBLE) AS a FROM raw)""", RAW)

q("format_currency_report", f"""
SELECT t.txn_id, {fmt_report('t.amount', 't.currency')} AS report_text,
       CASE WHEN t.currency = 'USD' THEN '$' || format('{{:,.2f}}', t.amount) ELSE format('{{:,.2f}}', t.amount) || ' ' || t.currency END AS ui_text
FROM t LEFT JOIN {FORMATS} ON rf.currency = t.currency""")

_LOCALE = ("(VALUES " + ", ".join(f"({sql_str(c)}, {sql_str(s)}, {sql_str(p)}, {d}, {sql_str(ts)}, {sql_str(ds)})"
                                   for c, s, p, d, ts, ds in LOCALE_FORMATS)
           + ") lf(currency, symbol, position, decimals, tsep, dsep)")

q("format_currency_locale", f"""
SELECT txn_id, CASE WHEN position = 'before' THEN symbol || body ELSE body || ' ' || symbol END AS locale_text FROM (
  SELECT txn_id, symbol, position,
         CASE WHEN decimals = 0 THEN replace(format('{{:,}}', CAST(floor(a) AS BIGINT)), ',', tsep)
              WHEN tsep = ',' THEN replace(plain, '.', dsep)
              ELSE replace(format('{{:,}}', CAST(split_part(plain, '.', 1) AS BIGINT)), ',', tsep) || dsep || split_part(plain, '.', 2)
         END AS body
  FROM (SELECT t.txn_id, lf.*, abs(t.amount) AS a,
               CASE lf.decimals WHEN 8 THEN format('{{:.8f}}', abs(t.amount)) ELSE format('{{:.2f}}', abs(t.amount)) END AS plain
        FROM t JOIN {_LOCALE} ON lf.currency = CASE WHEN t.currency IN ({', '.join(sql_str(x[0]) for x in LOCALE_FORMATS)}) THEN t.currency ELSE 'USD' END))""")


# ---- cleaning, schema repair -----------------------------------------------------------

def _c7(x: str) -> str:
    s = f"regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '^[\"'']|[\"'']$', '', 'g')"
    return f"nullif(regexp_replace({s}, '\\s+', ' ', 'g'), '')"


_STMT = ["date", "description", "amount", "type", "category"]
_ROW = "concat_ws(' ', " + ", ".join(_STMT) + ")"
_SHIFT = ("(regexp_matches(coalesce(m.date, 'nan'), '[a-zA-Z]{3,}') OR "
          "regexp_matches(coalesce(m.date, 'nan'), '[€$₹£¥₽₱₩]'))")
_SAN = (f"san0 AS (SELECT m.txn_id, m.account_id, {', '.join(_c7('m.' + c) + ' AS ' + c for c in _STMT)}, "
        f"{_SHIFT} AS is_shifted FROM messy m), "
        f"san AS (SELECT * FROM san0 WHERE coalesce({', '.join(_STMT)}) IS NOT NULL "
        f"AND NOT regexp_full_match({_ROW}, '[-=_]+') AND NOT regexp_matches({_ROW}, '^(?i)(date|description|amount|type|category)'))")

q("sanitize_text", "SELECT * FROM san", RAW + ", " + _SAN)

q("drop_artifacts", f"""
SELECT is_shifted, count(*) AS rows FROM (
  SELECT m.*, {_SHIFT} AS is_shifted FROM messy m) m
WHERE coalesce({', '.join(_STMT)}) IS NOT NULL AND NOT regexp_full_match({_ROW}, '[-=_]+')
  AND NOT regexp_matches({_ROW}, '^(?i)(date|description|amount|type|category)')
GROUP BY 1""", RAW)

_NULLS = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in _STMT)
q("sanitize_report", f"""
SELECT b.account_id, b.rows - coalesce(a.rows, 0) AS rows_removed, b.nulls AS empty_cells_before,
       coalesce(a.nulls, 0) AS empty_cells_after, 0 AS columns_removed
FROM (SELECT account_id, count(*) AS rows, sum({_NULLS}) AS nulls FROM messy GROUP BY 1) b
LEFT JOIN (SELECT account_id, count(*) AS rows, sum({_NULLS}) AS nulls FROM san GROUP BY 1) a
  ON a.account_id = b.account_id""", RAW + ", " + _SAN)

q("merge_split_currency", """
SELECT txn_id, account_id, date AS "Date", description AS "Description",
       split_part(num, '.', 1) || '.' || lpad(CAST(CAST(split_part(num, '.', 2) AS INTEGER) AS VARCHAR), 2, '0') AS "Amount_Part1",
       type AS "Type"
FROM raw JOIN (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS num FROM orders) n
  ON n.o_orderkey = raw.txn_id""", RAW)


def _profile(c: str) -> str:
    share = lambda cond: f"count(CASE WHEN {cond} THEN 1 END) / count({c})"
    dates = ", ".join(share(f"regexp_matches({c}, '{p}')") for p in (r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}"))
    amts = ", ".join(share(f"regexp_matches({c}, '{p}')") for p in (r"[€$₹£¥₽₱₩]\d+", r"\d+\.\d{2}", r"\d+,\d{2}"))
    return (f"SELECT '{c}' AS \"column\", count({c}) AS non_null, greatest({dates}) AS date_share, "
            f"greatest({amts}) AS amount_share, avg(length({c})) AS mean_length, "
            f"{share(f'regexp_matches({c}, ' + chr(39) + '[a-zA-Z]' + chr(39) + ')')} AS letter_share, "
            f"{share(f'regexp_matches({c}, ' + chr(39) + chr(92) + 'd+' + chr(92) + '.?' + chr(92) + 'd*' + chr(39) + ')')} AS numeric_share FROM messy")


q("column_profile", f"""
SELECT *, CASE WHEN date_share >= 0.7 THEN 'date' WHEN amount_share >= 0.5 THEN 'amount'
               WHEN mean_length > 5 AND letter_share >= 0.8 THEN 'description' END AS detected_as
FROM ({' UNION ALL '.join(_profile(c) for c in _STMT)})""", RAW)


# ---- sources, sinks, table maintenance ------------------------------------------------

q("latest_transactions", """
SELECT account_id, CAST(rank AS INTEGER) AS rank, txn_id, strftime(date, '%Y-%m-%d') AS date, amount FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY date DESC, txn_id DESC) AS rank FROM t)
WHERE rank <= 5""")

q("account_statistics", """
SELECT coalesce(a.account_id, b.account_id) AS account_id, coalesce(a.n, 0) AS transaction_count,
       coalesce(b.n, 0) AS analysis_count, strftime(a.f, '%Y-%m-%d') AS first_activity,
       strftime(a.l, '%Y-%m-%d') AS last_activity
FROM (SELECT account_id, count(*) n, min(date) f, max(date) l FROM t GROUP BY 1) a
FULL OUTER JOIN (SELECT account_id, count(*) n FROM (SELECT DISTINCT account_id, strftime(date, '%Y-%m') FROM e) GROUP BY 1) b
  ON a.account_id = b.account_id""")

q("retention_filter", """
SELECT txn_id, account_id, strftime(date, '%Y-%m-%d') AS date FROM t
WHERE CAST(date AS TIMESTAMP) >= CAST(DATE '2001-08-01' - INTERVAL 365 DAY AS TIMESTAMP)""")

q("upsert_sessions", """
SELECT * FROM (
  SELECT CAST(c_custkey AS VARCHAR) AS session_id, '{"segment":"' || c_mktsegment || '"}' AS settings,
         CAST(NULL AS VARCHAR) AS last_active
  FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT CAST(account_id AS VARCHAR) FROM t WHERE date >= DATE '2000-08-01')
  UNION ALL
  SELECT CAST(account_id AS VARCHAR), '{"recent_orders":' || count(*) || '}', strftime(max(date), '%Y-%m-%d')
  FROM t WHERE date >= DATE '2000-08-01' GROUP BY account_id)""")

q("custom_categories", """
SELECT c_custkey AS session_id, lower(c_mktsegment) AS category_name, len(string_split(lower(c_name), '#')) AS n_keywords,
       array_to_string(string_split(lower(c_name), '#'), ' ') AS keywords_text FROM customer""")

q("replace_by_hash", """
SELECT txn_id, account_id, sha256('statement-' || CAST(account_id AS VARCHAR) || '-' || CAST(year(date) AS VARCHAR)) AS file_hash
FROM t""")

q("stream_daily_spend", f"""
SELECT user_id AS account_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day,
       {r('coalesce(' + ms("CASE WHEN event_type = 'purchase' THEN value END") + ', 0.0)')} AS spend,
       {r('coalesce(' + ms("CASE WHEN event_type = 'signup' THEN value END") + ', 0.0)')} AS income,
       count(*) AS n
FROM (SELECT DISTINCT ON (event_id) * FROM events WHERE event_type IN ('purchase', 'signup'))
GROUP BY 1, 2""")

q("orphan_transactions", "SELECT txn_id, account_id FROM t WHERE account_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")


# ---- row recovery cascade (P1–P7) -----------------------------------------------------

_DATE_PAT = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}"
_AMT_PAT = r"[€$₹£¥₽₱₩]?\d+[.,]\d{2}"


def _is_date(v):
    return f"regexp_matches({v}, '^({_DATE_PAT})')"


def _is_amount(v):
    return f"regexp_matches({v}, '^([€$₹£¥₽₱₩]\\d+|\\d+\\.\\d{{2}}|\\d+,\\d{{2}}|\\d+)')"


def _is_desc(v):
    return f"(length({v}) > 3 AND regexp_matches({v}, '[a-zA-Z]') AND NOT regexp_matches({v}, '^\\d+$'))"


def _def_amount(src):
    blank = f"({src} IS NULL OR trim({src}) = '' OR lower(trim({src})) = 'nan')"
    clean = f"regexp_replace(trim({src}), '[^0-9.,+\\-]', '', 'g')"
    norm = _norm_sql(clean, 0)
    val = (f"CASE WHEN {blank} THEN NULL WHEN regexp_full_match({norm}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') "
           f"THEN TRY_CAST({norm} AS DOUBLE) END")
    return val, _defensive_currency_sql(f"trim({src})")


def _def_date(src):
    return _date_sql(f"trim({src})", DATE_FORMATS[:9])


_CELLS = ["date", "description", "amount", "type", "category"]
_fold = []
_d, _a, _s = "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)"
_prev = "rr0"
for _i, _c in enumerate(_CELLS):
    v = f"v{_i}"
    td = f"({_is_date(v)} AND {_d} IS NULL)"
    ta = f"(NOT {td} AND {_is_amount(v)} AND {_a} IS NULL)"
    ts = f"(NOT {td} AND NOT {ta} AND {_is_desc(v)} AND {_s} IS NULL)"
    _fold.append(f"rf{_i} AS (SELECT *, CASE WHEN {td} THEN {v} ELSE {_d} END AS fd{_i}, "
                 f"CASE WHEN {ta} THEN {v} ELSE {_a} END AS fa{_i}, "
                 f"CASE WHEN {ts} THEN {v} ELSE {_s} END AS fs{_i} FROM {_prev})")
    _d, _a, _s, _prev = f"fd{_i}", f"fa{_i}", f"fs{_i}", f"rf{_i}"


def _first(cond):
    return "COALESCE(" + ", ".join(f"CASE WHEN {cond(i)} THEN v{i} END" for i in range(len(_CELLS))) + ")"


_a_vals = {i: _def_amount(src) for i, src in
           [(1, "amount"), (2, "fa4"), (3, "a3"), (4, "a4"), (5, "a5")]}
_RECOVER = (RAW + ",\n" + "rr0 AS (SELECT txn_id, account_id, date, description, amount, type, category, "
            + ", ".join(f"coalesce(trim({c}), '') AS v{i}" for i, c in enumerate(_CELLS))
            + ", concat_ws(' ', date, description, amount, type, category) AS rowt FROM messy),\n"
            + ",\n".join(_fold) + ",\n"
            + f"""rc AS (SELECT *,
   nullif(regexp_extract(rowt, '({_DATE_PAT})', 1), '') AS d3,
   nullif(regexp_extract(rowt, '({_AMT_PAT})', 1), '') AS a3,
   trim(regexp_replace(regexp_replace(rowt, '{_DATE_PAT}', '', 'g'), '{_AMT_PAT}', '', 'g')) AS s3raw,
   {_first(lambda i: _is_date(f'v{i}'))} AS d4,
   {_first(lambda i: f"NOT {_is_date(f'v{i}')} AND {_is_amount(f'v{i}')}")} AS a4,
   {_first(lambda i: f"NOT {_is_date(f'v{i}')} AND NOT {_is_amount(f'v{i}')} AND {_is_desc(f'v{i}')}")} AS s4raw,
   coalesce(nullif(regexp_extract(rowt, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''), '2024-06-30') AS d5,
   nullif(regexp_extract(rowt, '(\\d+[.,]?\\d*)', 1), '') AS a5 FROM {_prev}),
rp AS (SELECT *,
   {_def_date('date')} AS pd1, {_def_date('fd4')} AS pd2, {_def_date('d3')} AS pd3, {_def_date('d4')} AS pd4,
   {', '.join(f'{v} AS pa{i}, {c} AS pc{i}' for i, (v, c) in _a_vals.items())} FROM rc),
rr AS (SELECT txn_id, account_id,
   (date IS NOT NULL AND trim(date) <> '' AND description IS NOT NULL AND trim(description) <> ''
    AND amount IS NOT NULL AND amount <> '' AND pd1 IS NOT NULL AND pa1 IS NOT NULL) AS ok1,
   (fd4 IS NOT NULL AND fa4 IS NOT NULL AND fs4 IS NOT NULL AND pd2 IS NOT NULL AND pa2 IS NOT NULL) AS ok2,
   (pd3 IS NOT NULL AND pa3 IS NOT NULL) AS ok3, (pd4 IS NOT NULL AND pa4 IS NOT NULL) AS ok4, (pa5 IS NOT NULL) AS ok5,
   * EXCLUDE (txn_id, account_id) FROM rp)""")

_BY_SIGN = lambda i: f"CASE WHEN pa{i} < 0 THEN 'debit' ELSE 'credit' END"
q("recover_rows", f"""
SELECT txn_id, account_id,
  (ok1 OR ok2 OR ok3 OR ok4 OR ok5) AS success,
  CASE WHEN ok1 THEN 'standard_parsing' WHEN ok2 THEN 'fuzzy_column_matching' WHEN ok3 THEN 'pattern_based_extraction'
       WHEN ok4 THEN 'manual_field_detection' WHEN ok5 THEN 'emergency_fallback' ELSE 'all_failed' END AS strategy_used,
  CASE WHEN ok1 THEN 0.9 WHEN ok2 THEN 0.7 WHEN ok3 THEN 0.6 WHEN ok4 THEN 0.5 WHEN ok5 THEN 0.2 ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN ok1 THEN strftime(pd1, '%Y-%m-%d') WHEN ok2 THEN strftime(pd2, '%Y-%m-%d') WHEN ok3 THEN strftime(pd3, '%Y-%m-%d')
       WHEN ok4 THEN strftime(pd4, '%Y-%m-%d') WHEN ok5 THEN d5 END AS date,
  CASE WHEN ok1 THEN trim(description) WHEN ok2 THEN fs4
       WHEN ok3 THEN (CASE WHEN s3raw = '' THEN 'Unknown transaction' ELSE s3raw END)
       WHEN ok4 THEN coalesce(s4raw, 'Unknown transaction') WHEN ok5 THEN 'Unknown transaction' END AS description,
  CASE WHEN ok1 THEN pa1 WHEN ok2 THEN pa2 WHEN ok3 THEN pa3 WHEN ok4 THEN pa4 WHEN ok5 THEN pa5 END AS amount,
  CASE WHEN ok1 THEN pc1 WHEN ok2 THEN pc2 WHEN ok3 THEN pc3 WHEN ok4 THEN pc4 WHEN ok5 THEN pc5 END AS currency,
  CASE WHEN ok1 THEN (CASE WHEN type IS NULL THEN {_BY_SIGN(1)}
                           WHEN lower(type) IN ('debit', 'expense', 'withdrawal') THEN 'debit' ELSE 'credit' END)
       WHEN ok2 THEN {_BY_SIGN(2)} WHEN ok3 THEN {_BY_SIGN(3)} WHEN ok4 THEN {_BY_SIGN(4)} WHEN ok5 THEN {_BY_SIGN(5)} END AS type,
  CASE WHEN ok1 THEN coalesce(nullif(lower(trim(category)), ''), 'other')
       WHEN ok2 OR ok3 OR ok4 OR ok5 THEN 'other' END AS category
FROM rr""", _RECOVER)


# ---- keyword-rule categoriser (G4, G5) -------------------------------------------------

def _rule_oracle(src: str = "t"):
    from ledgerlake.dims import CATEGORY_KEYWORDS, CATEGORY_PATTERNS
    stop = "[" + ", ".join(sql_str(w) for w in RULE_STOP_WORDS) + "]"
    cats = list(CATEGORY_KEYWORDS)
    kw = ("(VALUES " + ", ".join(f"({i}, {sql_str(c)}, {sql_str(k)}, {len(k.split())})"
                                 for i, c in enumerate(cats) for k in CATEGORY_KEYWORDS[c])
          + ") kw(cat_ord, category, k, n)")
    pats = ("(VALUES " + ", ".join(f"({i}, {sql_str(c)}, {sql_str('(?i)' + CATEGORY_PATTERNS[c])})"
                                   for i, c in enumerate(cats)) + ") pt(cat_ord, category, pattern)")
    return f"""
SELECT "desc", CASE WHEN best > 0 THEN category ELSE 'other' END AS rule_category,
       CASE WHEN best > 0 THEN least(best / 10.0, 1.0) ELSE 0.0 END AS rule_confidence
FROM (SELECT "desc", category, score, max(score) OVER (PARTITION BY "desc") AS best,
             row_number() OVER (PARTITION BY "desc" ORDER BY score DESC, cat_ord) AS rn
      FROM (SELECT d."desc", pt.category, pt.cat_ord,
                   coalesce(s.kw_score, 0.0) + CASE WHEN regexp_matches(d."desc", pt.pattern) THEN 2.0 ELSE 0.0 END AS score
            FROM d CROSS JOIN {pats}
            LEFT JOIN (SELECT d."desc", kw.cat_ord,
                              sum(CASE WHEN kw.k = d."desc" THEN 3.0 WHEN contains(d."desc", kw.k) THEN 1.5 * kw.n ELSE 0.0 END
                                  + coalesce(list_sum(list_transform(d.toks, lambda t: CASE WHEN kw.k = t THEN 2.0
                                        WHEN contains(t, kw.k) OR contains(kw.k, t) THEN 0.5 ELSE 0.0 END)), 0.0)) AS kw_score
                       FROM d CROSS JOIN {kw} GROUP BY 1, 2) s
              ON s."desc" = d."desc" AND s.cat_ord = pt.cat_ord))
WHERE rn = 1""", f"""d0 AS (SELECT DISTINCT lower(trim(description)) AS "desc" FROM {src}),
d AS (SELECT "desc", list_filter(string_split_regex(trim(regexp_replace("desc", '([,;:@#$%&?!"()\\[\\]{{}}<>])', ' \\1 ', 'g')), '\\s+'),
                               lambda x: length(x) > 2 AND NOT list_contains({stop}, x)) AS toks FROM d0)"""


_body, _ctes = _rule_oracle()
q("rule_categorize", _body, _ctes)


# ---- naive-Bayes categoriser (G1, G3) ---------------------------------------------------

def _nb_oracle(src: str = "t"):
    from ledgerlake.dims import CATEGORY_KEYWORDS, TFIDF_STOP_WORDS_IN_DICTIONARY
    docs = ("(VALUES " + ", ".join(f"({i}, {sql_str(c)}, {sql_str(k)})" for i, (c, k) in
                                   enumerate((c, k) for c in CATEGORY_KEYWORDS for k in CATEGORY_KEYWORDS[c]))
            + ") docs(doc_id, category, txt)")
    n_docs = sum(len(v) for v in CATEGORY_KEYWORDS.values())
    stop = "[" + ", ".join(sql_str(w) for w in TFIDF_STOP_WORDS_IN_DICTIONARY) + "]"
    ctes = f"""
occ AS (SELECT doc_id, category, unnest(regexp_extract_all(lower(txt), '\\b\\w\\w+\\b')) AS token FROM {docs}),
tf AS (SELECT doc_id, category, token, count(*) AS tf FROM occ WHERE NOT list_contains({stop}, token) GROUP BY 1, 2, 3),
vocab AS (SELECT token, ln((1 + {n_docs}) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
w AS (SELECT tf.doc_id, tf.category, tf.token, tf.tf * v.idf AS w FROM tf JOIN vocab v USING (token)),
x AS (SELECT category, token, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM w),
fc AS (SELECT category, token, sum(x) AS fc FROM x GROUP BY 1, 2),
cls AS (SELECT c.category, ln(c.n / {n_docs}) AS prior,
               ln(coalesce(s.s, 0) + (SELECT count(*) FROM vocab)) AS den
        FROM (SELECT category, count(*) AS n FROM {docs} GROUP BY 1) c
        LEFT JOIN (SELECT category, sum(fc) AS s FROM fc GROUP BY 1) s USING (category)),
dd AS (SELECT DISTINCT lower(trim(description)) AS "desc" FROM {src}),
qt AS (SELECT "desc", token, count(*) AS tf FROM
         (SELECT "desc", unnest(regexp_extract_all("desc", '\\b\\w\\w+\\b')) AS token FROM dd) GROUP BY 1, 2),
qw AS (SELECT qt."desc", qt.token, qt.tf * v.idf AS w FROM qt JOIN vocab v USING (token)),
qn AS (SELECT "desc", sqrt(sum(w * w)) AS norm, sum(w) AS wsum FROM qw GROUP BY 1),
num AS (SELECT qw."desc", fc.category, sum(qw.w * ln(fc.fc + 1)) AS num FROM qw JOIN fc USING (token) GROUP BY 1, 2),
jll AS (SELECT dd."desc", cls.category,
               coalesce(num.num, 0) / coalesce(nullif(qn.norm, 0), 1)
               - coalesce(qn.wsum, 0) / coalesce(nullif(qn.norm, 0), 1) * cls.den + cls.prior AS j
        FROM dd CROSS JOIN cls LEFT JOIN qn ON qn."desc" = dd."desc"
        LEFT JOIN num ON num."desc" = dd."desc" AND num.category = cls.category)"""
    body = f"""
SELECT "desc", category AS ml_category, {r('1.0 / z', 6)} AS ml_confidence FROM (
  SELECT "desc", category, sum(exp(j - m)) OVER (PARTITION BY "desc") AS z,
         row_number() OVER (PARTITION BY "desc" ORDER BY j DESC, category) AS rn
  FROM (SELECT *, max(j) OVER (PARTITION BY "desc") AS m FROM jll)) WHERE rn = 1"""
    return body, ctes


_nb_body, _nb_ctes = _nb_oracle()
q("ml_categorize", _nb_body, _nb_ctes)


# ---- user-defined categories (G8) ------------------------------------------------------

def _custom_oracle():
    stop = "[" + ", ".join(sql_str(w) for w in RULE_STOP_WORDS) + "]"
    ctes = f"""
cd0 AS (SELECT DISTINCT account_id, lower(trim(description)) AS "desc" FROM t),
cd AS (SELECT account_id, "desc",
              list_filter(string_split_regex(trim(regexp_replace("desc", '([,;:@#$%&?!"()\\[\\]{{}}<>])', ' \\1 ', 'g')), '\\s+'),
                          lambda x: length(x) > 2 AND NOT list_contains({stop}, x)) AS toks FROM cd0),
ck AS (SELECT c_custkey AS account_id, lower(c_mktsegment) AS category,
              unnest(['coffee', 'grocery', lower(c_mktsegment)]) AS k FROM customer),
cs AS (SELECT cd.account_id, cd."desc", ck.category,
              sum(CASE WHEN ck.k = cd."desc" THEN 3.0
                       WHEN contains(cd."desc", ck.k) THEN 1.5 * len(string_split(ck.k, ' ')) ELSE 0.0 END
                  + coalesce(list_sum(list_transform(cd.toks, lambda t: CASE WHEN ck.k = t THEN 2.0
                        WHEN contains(t, ck.k) OR contains(ck.k, t) THEN 0.5 ELSE 0.0 END)), 0.0)) AS score
       FROM cd JOIN ck ON ck.account_id = cd.account_id GROUP BY 1, 2, 3)"""
    body = """
SELECT account_id, "desc", category AS custom_category, score AS custom_score FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id, "desc" ORDER BY score DESC, category) AS rn
  FROM cs WHERE score > 0) WHERE rn = 1"""
    return body, ctes


_cb, _cc = _custom_oracle()
q("custom_categorize", _cb, _cc)



# ---- blended categoriser applied to parsed statements (G6, G7) --------------------------

def _hybrid_oracle():
    rule_body, rule_ctes = _rule_oracle("stmt")
    nb_body, nb_ctes = _nb_oracle("stmt")
    ctes = (RAW + ",\n" + rule_ctes + ",\n" + nb_ctes
            + f",\nrule_res AS ({rule_body}),\nml_res AS ({nb_body}),"
            + """
blend AS (SELECT r."desc",
    CASE WHEN trim(r."desc") = '' THEN 'other' WHEN m.ml_confidence >= 0.7 THEN m.ml_category
         WHEN r.rule_confidence >= 0.8 THEN r.rule_category WHEN m.ml_confidence >= 0.5 THEN m.ml_category
         WHEN r.rule_confidence >= 0.5 THEN r.rule_category
         WHEN m.ml_confidence >= r.rule_confidence THEN m.ml_category ELSE r.rule_category END AS category,
    CASE WHEN trim(r."desc") = '' THEN 0.0 WHEN m.ml_confidence >= 0.7 THEN m.ml_confidence
         WHEN r.rule_confidence >= 0.8 THEN r.rule_confidence WHEN m.ml_confidence >= 0.5 THEN m.ml_confidence
         WHEN r.rule_confidence >= 0.5 THEN r.rule_confidence
         WHEN m.ml_confidence >= r.rule_confidence THEN m.ml_confidence ELSE r.rule_confidence END AS confidence
  FROM rule_res r JOIN ml_res m ON m."desc" = r."desc")""")
    body = f"""
SELECT g.txn_id, g.account_id, g.description,
       CASE WHEN coalesce(g.category, '') IN ('', 'other') THEN b.category ELSE g.category END AS category,
       {r("CASE WHEN coalesce(g.category, '') IN ('', 'other') THEN b.confidence ELSE 0.7 END", 3)} AS confidence
FROM good g LEFT JOIN blend b ON b."desc" = lower(trim(g.description))"""
    return body, ctes


_hb, _hc = _hybrid_oracle()
q("hybrid_categorize", _hb, _hc)


# ---- normalise-and-convert chain (J12: F5 → C14 → J5 → F19) ----------------------------

_NC = RAW + f""",
na AS (SELECT txn_id, account_id, description, type, lower(category) AS category, trim(amount) AS atx,
              regexp_replace(trim(amount), '[^0-9.,+\\-]', '', 'g') AS ac FROM raw),
nb AS (SELECT *, {_currency_sql('atx')} AS cur, {_norm_sql('ac', 1)} AS an FROM na),
nc AS (SELECT *, regexp_replace(an, '[+\\-]', '', 'g') AS digits FROM nb),
nd AS (SELECT *, CASE WHEN regexp_full_match(digits, '[0-9]+\\.?[0-9]*|\\.[0-9]+') THEN TRY_CAST(digits AS DOUBLE) END AS av FROM nc),
ne AS (SELECT *, CASE WHEN starts_with(an, '-') THEN -av ELSE av END AS sv FROM nd),
nf AS (SELECT *,
          CASE WHEN atx IS NULL OR atx = '' OR lower(atx) = 'nan' THEN NULL
               WHEN abs(sv) > 1e9 OR (abs(sv) < 1e-6 AND sv <> 0) THEN NULL ELSE sv END AS amt,
          CASE WHEN atx IS NULL OR atx = '' OR lower(atx) = 'nan' THEN 'USD' WHEN ac = '' THEN cur
               WHEN av IS NULL THEN 'USD' ELSE cur END AS currency FROM ne),
ng AS (SELECT *, CASE WHEN lower(type) IN ('debit', 'expense', 'withdrawal', 'payment') THEN -abs(amt) ELSE amt END AS samt
       FROM nf),
nh AS (SELECT ng.*, ng.samt * ({_rate('ng.currency', 'EUR')}) AS conv
       FROM ng LEFT JOIN {RATES} ON upper(ng.currency) = fx.currency)"""

q("normalize_and_convert", f"""
SELECT txn_id, account_id, description, {r('conv')} AS amount, currency AS original_currency,
       'EUR' AS display_currency, coalesce(category, 'other') AS category,
       CASE WHEN conv < 0 THEN 'expense' ELSE 'income' END AS type
FROM nh""", _NC)


# ---- normalise table (C14) -------------------------------------------------------------
# date: ISO text casts (Spark's string→timestamp cast), else month-first M/d/yyyy, else NULL;
# amount: ',' → '.', keep digits and dots, numeric text → DOUBLE; sign from the type column.

q("normalize_table", r"""
SELECT txn_id,
       CASE WHEN regexp_full_match(date, '\d{4}-\d{1,2}-\d{1,2}') THEN TRY_CAST(date AS DATE)
            WHEN regexp_full_match(date, '\d{1,2}/\d{1,2}/\d{4}') THEN CAST(try_strptime(date, '%m/%d/%Y') AS DATE)
       END AS date,
       CASE WHEN lower(type) IN ('debit', 'expense', 'withdrawal', 'payment') THEN -abs(a) ELSE a END AS amount,
       type
FROM (SELECT txn_id, date, type,
             CASE WHEN regexp_full_match(x, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*') THEN TRY_CAST(x AS DOUBLE) END AS a
      FROM (SELECT txn_id, date, type, regexp_replace(replace(amount, ',', '.'), '[^0-9.]', '', 'g') AS x FROM raw))""", RAW)


# ---- corrupted-column scan (S9) over the statements the query writes -------------------
# The query writes the damaged statements as CSV (Spark's writer trims leading/trailing
# whitespace and writes NULL as an empty field) and reads them back headerless; every data
# line comes back, missing cells as ''.

q("corrupted_column_scan", """
SELECT coalesce(trim(date), '') AS date, coalesce(trim(amount), '') AS amount,
       coalesce(trim(description), '') AS description FROM messy""", RAW)


# ---- minimal scan (S15) over the statements the query writes ---------------------------
# Every data line of the written files comes back (the header is line 0 of each file); the
# amount survives only where the written (trimmed) text is a plain number.

q("minimal_scan", r"""
SELECT NOT regexp_full_match(coalesce(trim(amount), ''), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') AS amount_missing,
       'USD' AS currency, count(*) AS rows
FROM messy GROUP BY 1, 2""", RAW)


# ---- profile-routed reading (S7, S11) of the statements the query writes ---------------
# Two copies are written (',' and ';' separated); profiling routes them to the standard and
# the delimiter-detection scan, and parsing gives the reject reasons of the source rows.

q("read_statements", """
SELECT s.parse_strategy, coalesce(trim(date), '') AS date, coalesce(trim(description), '') AS description,
       coalesce(trim(amount), '') AS amount, coalesce(trim(type), '') AS type, coalesce(trim(category), '') AS category
FROM messy CROSS JOIN (VALUES ('standard'), ('delimiter_detection')) s(parse_strategy)""", RAW)

q("profile_files", """
SELECT ',' AS delimiter, 'utf-8' AS encoding, true AS has_header, 5 AS column_count, 'standard' AS strategy,
       'date/description/amount/type/category' AS header, count(*) AS rows FROM messy
UNION ALL SELECT ';', 'utf-8', true, 5, 'delimiter_detection', 'category/amount/Merchant Details/type/posted_date', count(*) FROM messy""", RAW)


# ---- ordering, completeness and rates as columns (T2, P7, J3, J2) ----------------------

q("currency_ranking", """
SELECT account_id, currency, round(a, 2) AS amount, n AS "count",
       row_number() OVER (PARTITION BY account_id ORDER BY round(a, 2) DESC, currency) AS place
FROM (SELECT account_id, currency, CAST(sum(CAST(abs(amount) AS DECIMAL(18,2))) AS DOUBLE) AS a, count(*) AS n FROM t GROUP BY 1, 2)""")

_VALID = ORACLES["recover_rows"].rstrip().rstrip(";")
ORACLES["valid_recovered"] = f"""
SELECT txn_id, strategy_used, date, round(amount, 2) AS amount FROM ({_VALID}) r
WHERE coalesce(description, '') <> '' AND amount IS NOT NULL AND amount <> 0 AND coalesce(currency, '') <> ''
  AND regexp_full_match(date, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') AND try_strptime(date, '%Y-%m-%d') IS NOT NULL"""

q("convert_amount_expression", f"""
SELECT txn_id, round(amount * CASE WHEN t.currency = 'EUR' THEN 1.0 WHEN t.currency = 'USD' THEN {dict(fallback_rates())['EUR']!r}
       ELSE 1.0 / coalesce(fx.per_usd, 1.0) * {dict(fallback_rates())['EUR']!r} END, 2) AS amount_eur
FROM t LEFT JOIN {RATES} ON fx.currency = t.currency""")

q("live_rates", """
SELECT currency, count(*) AS n, round(CASE WHEN currency = 'USD' THEN 1.0 ELSE 1.0 /
       (CAST(sum(CASE WHEN amount > 0 THEN CAST(amount AS DECIMAL(18,2)) END) AS DOUBLE) / count(CASE WHEN amount > 0 THEN 1 END) / 100000) END, 6) AS rate
FROM t GROUP BY currency""")

q("upload_pipeline", f"""
SELECT txn_id, account_id, 'parsed' AS how, strftime(date, '%Y-%m-%d') AS date, description, round(amount, 2) AS amount, currency FROM good
UNION ALL
SELECT r.txn_id, r.account_id, r.strategy_used, r.date, r.description, round(r.amount, 2), r.currency
FROM ({_VALID}) r JOIN stmt s ON s.txn_id = r.txn_id
WHERE s.reject_reason IS NOT NULL AND coalesce(r.description, '') <> '' AND r.amount IS NOT NULL AND r.amount <> 0
  AND coalesce(r.currency, '') <> '' AND regexp_full_match(r.date, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') AND try_strptime(r.date, '%Y-%m-%d') IS NOT NULL""", RAW)


# ---- strategies, types, quoted records, dated rates, monthly alerts ---------------------

_STD = "standard: fewer than three columns; delimiter_detection: no separator gives three columns; "
_KINDS = f"""
k AS (
  SELECT 'plain' AS folder, 'standard' AS strategy, ['date', 'description', 'amount'] AS header, [strftime(date, '%Y-%m-%d'), description, CAST(CAST(amount AS DECIMAL(15,2)) AS VARCHAR)] AS cells, '' AS rejected FROM t
  UNION ALL SELECT 'bars', 'delimiter_detection', ['date', 'description', 'amount'], [strftime(date, '%Y-%m-%d'), description, CAST(CAST(amount AS DECIMAL(15,2)) AS VARCHAR)], 'standard: fewer than three columns' FROM t
  UNION ALL SELECT 'narrow', 'manual_recovery', ['customer', 'amount'], [CAST(c_custkey AS VARCHAR), CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR)],
    '{_STD}corrupted_column: fewer than three columns; manual_mapping: fewer than three columns' FROM customer
  UNION ALL SELECT 'single', 'corrupted_column', ['_c0', '_c1', '_c2'], [n_name, CAST(n_nationkey AS VARCHAR), CAST(n_regionkey AS VARCHAR)], 'standard: no record; delimiter_detection: no record' FROM nation
  UNION ALL SELECT 'words', 'manual_recovery', ['kind', 'by', 'name'], [translate(p_type, '0123456789', 'xxxxxxxxxx'), 'of', translate(p_type, '0123456789', 'xxxxxxxxxx')],
    'standard: no numeric cell; delimiter_detection: no numeric cell; corrupted_column: no sign of damage; manual_mapping: no numeric cell' FROM part
  UNION ALL SELECT 'ragged', 'unreadable', ['_c0'], ['supplier,nation'], '' FROM supplier
  UNION ALL SELECT 'ragged', 'unreadable', ['_c0'], [s_suppkey || ',' || s_nationkey || ',more'], '' FROM supplier)"""

q("strategy_cascade", """
SELECT folder, strategy, array_to_string(header, '|') AS header, array_to_string(cells, '|') AS cells,
       CASE folder WHEN 'ragged' THEN 'standard: records wider than the header; delimiter_detection: no separator gives three columns; corrupted_column: records wider than the header; manual_mapping: records wider than the header; manual_recovery: records wider than the header'
       ELSE rejected END AS rejected, count(*) AS n
FROM k GROUP BY ALL""", _KINDS)

q("column_types", """
SELECT folder, CAST(position AS INTEGER) AS position, header[position + 1] AS name,
       CASE WHEN folder IN ('plain', 'bars') THEN ['object', 'object', 'float64'][position + 1] WHEN folder = 'narrow' THEN ['int64', 'float64'][position + 1]
            WHEN folder = 'single' THEN ['object', 'int64', 'int64'][position + 1] ELSE 'object' END AS dtype,
       count(*) AS records, count(*) AS filled, CASE WHEN folder = 'single' THEN 1 ELSE 3 END AS most_samples
FROM k, range(len(header)) p(position) WHERE folder <> 'ragged' GROUP BY ALL""", _KINDS)

q("quoted_records", """
SELECT txn_id, CASE WHEN txn_id % 3 = 0 THEN description || chr(10) || 'line "two", with a comma' || chr(10) || txn_id ELSE description END AS note,
       CAST(CAST(amount AS DECIMAL(15,2)) AS DOUBLE) AS amount, false AS corrupt FROM t""")

q("dated_rates", f"""
SELECT event_id, currency, round(value * CASE WHEN currency = 'EUR' THEN 1.0 WHEN currency = 'USD' THEN to_rate ELSE 1.0 / from_rate * to_rate END, 8) AS converted,
       CASE WHEN currency = 'EUR' THEN 'same' WHEN (currency = 'USD' OR from_live) AND to_live THEN 'live' ELSE 'fallback' END AS rate_source
FROM (SELECT e.event_id, e.currency, e.value, coalesce(a.rate, f.per_usd, 1.0) AS from_rate, a.rate IS NOT NULL AS from_live, coalesce(b.rate, {dict(fallback_rates())['EUR']!r}) AS to_rate, b.rate IS NOT NULL AS to_live
      FROM ev e LEFT JOIN {RATES.replace(' fx(', ' f(')} ON f.currency = e.currency
      LEFT JOIN (SELECT e.event_id, arg_max(l.rate, (l.ts, l.rate)) AS rate FROM ev e JOIN live l ON l.currency = e.currency AND l.ts <= e.ts AND l.ts > e.ts - INTERVAL 1 HOUR GROUP BY 1) a USING (event_id)
      LEFT JOIN (SELECT e.event_id, arg_max(l.rate, (l.ts, l.rate)) AS rate FROM ev e JOIN live l ON l.currency = 'EUR' AND l.ts <= e.ts AND l.ts > e.ts - INTERVAL 1 HOUR GROUP BY 1) b USING (event_id)
      WHERE event_type IN ('purchase', 'signup', 'error'))""", f"""
ev AS (SELECT *, {sql_list(ADAPTER_CURRENCIES)}[CAST(event_id % {len(ADAPTER_CURRENCIES)} AS INTEGER) + 1] AS currency FROM events),
live AS (SELECT ev.currency, ts, per_usd * (1 + value / 1000) AS rate FROM ev JOIN {RATES} ON fx.currency = ev.currency WHERE event_type IN ('view', 'click'))""")

q("monthly_alerts", f"""
SELECT account_id, month, category, kind
FROM (SELECT account_id, strftime(date, '%Y-%m') AS month, category, sum(CAST(round(amount * 100) AS BIGINT)) AS cents FROM e GROUP BY 1, 2, 3)
JOIN {BUDGETS} USING (category), (VALUES ('medium', 1.2), ('high', 1.5)) v(kind, level)
WHERE cents > round(1000000.0 * share * level * 100)""")


# ---- versioned tables, constraints, duplicate files, uploads as a stream ----------------

q("replace_versions", """
SELECT txn_id, account_id, round(amount, 2) AS amount FROM t WHERE (account_id, year(date)) NOT IN (SELECT account_id, year(date) FROM c)
UNION ALL SELECT txn_id, account_id, round(amount * 2, 2) FROM c""",
  "c AS (SELECT * FROM t WHERE account_id % 7 = 0 AND year(date) = 1995 AND txn_id % 2 = 0)")

ORACLES["expire_versions"] = ORACLES["retention_filter"]

_NOT_NULL = " UNION ALL ".join(
    f"SELECT 'transactions' AS \"table\", 'not null' AS \"constraint\", '{c}' AS \"column\", CAST(NULL AS VARCHAR) AS key, count(*) AS n_rows "
    f"FROM messy WHERE {c} IS NULL HAVING count(*) > 0" for c in ("account_id", "date", "description", "amount", "category", "type"))
q("table_constraints", f"""
{_NOT_NULL}
UNION ALL SELECT 'transactions', 'foreign key', 'account_id', CAST(account_id AS VARCHAR), count(*) FROM messy
WHERE account_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY account_id
UNION ALL SELECT 'sessions', 'unique', 'session_id', CAST(c_custkey AS VARCHAR), 2 FROM customer WHERE c_nationkey = 3""", RAW)

q("duplicate_files", "SELECT txn_id, 3 AS copies FROM t")

ORACLES["stream_uploads"] = f"SELECT *, true AS categorised FROM ({ORACLES['upload_pipeline']})"

q("budget_monthly_average", f"""
SELECT account_id, category, {r('rec')} AS recommended, {r('cur')} AS actual, {r('cur - rec')} AS difference
FROM (SELECT i.account_id, b.category, i.mean * b.share AS rec, coalesce(x.spent, 0.0) / greatest(coalesce(m.months, 0), 1) AS cur
      FROM (SELECT account_id, {ms('amount')} / count(DISTINCT strftime(date, '%Y-%m')) AS mean FROM t WHERE amount > 0 GROUP BY 1) i
      CROSS JOIN {BUDGETS}
      LEFT JOIN (SELECT account_id, category, {ms('amount')} AS spent FROM e GROUP BY 1, 2) x ON x.account_id = i.account_id AND x.category = b.category
      LEFT JOIN (SELECT account_id, count(DISTINCT strftime(date, '%Y-%m')) AS months FROM e GROUP BY 1) m ON m.account_id = i.account_id)""")

q("low_confidence", f"""
SELECT rule_category, coalesce(rule_confidence < 0.5, true) AS low_confidence, count(*) AS n
FROM t JOIN ({ORACLES['rule_categorize']}) r ON lower(trim(t.description)) = r."desc" GROUP BY 1, 2""")

ORACLES["rule_categorize_index"] = ORACLES["rule_categorize"]

ORACLES["keyword_dictionary"] = r"""
WITH keys AS (SELECT DISTINCT lang AS category, unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) AS keyword FROM documents WHERE lang IS NOT NULL),
items AS (SELECT item_id, lower(text) AS d FROM benchmark),
occ AS (SELECT item_id, token, count(*) AS n FROM (
  SELECT item_id, unnest(regexp_split_to_array(trim(regexp_replace(d, '([,;:@#$%&?!"()\[\]{}<>])', ' \1 ', 'g')), '\s+')) AS token FROM items)
  WHERE length(token) > 2 GROUP BY 1, 2),
earned AS (SELECT token, category, sum(CASE WHEN token = keyword THEN 2.0 ELSE 0.5 END) AS w
  FROM (SELECT DISTINCT token FROM occ) JOIN keys ON contains(token, keyword) OR contains(keyword, token) GROUP BY 1, 2),
scores AS (SELECT item_id, category, sum(s) AS s FROM (
  SELECT item_id, category, n * w AS s FROM occ JOIN earned USING (token)
  UNION ALL SELECT item_id, category, CASE WHEN d = keyword THEN 3.0 ELSE 1.5 END FROM items JOIN keys ON contains(d, keyword)) GROUP BY 1, 2)
SELECT item_id, category, CAST(s AS DOUBLE) AS score FROM scores"""
