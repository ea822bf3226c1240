"""Dimension tables: budget shares, exchange rates, currency formats, category dictionary.

Every table is small and of fixed size (the largest has 131 rows), so operators join them
with ``broadcast``; the size bound is asserted in :func:`checked_broadcast`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------
# FIXED VALUES — these must equal the behaviour being re-implemented, do not edit.
# ---------------------------------------------------------------------------------------

# Budget share of monthly income per category, in the order recommendations are listed.
BUDGET_SHARES = [
    ("food", 0.15),
    ("transport", 0.10),
    ("entertainment", 0.05),
    ("shopping", 0.10),
    ("utilities", 0.08),
    ("healthcare", 0.08),
    ("education", 0.05),
    ("travel", 0.05),
    ("insurance", 0.08),
    ("investment", 0.20),
    ("other", 0.06),
]

# Static exchange rates: units of the currency per 1 USD (129 currencies).
FALLBACK_RATES = [
    ("USD", 1.0), ("EUR", 0.85), ("GBP", 0.73), ("INR", 83.0), ("JPY", 110.0), ("CAD", 1.25),
    ("AUD", 1.35), ("CHF", 0.92), ("SEK", 8.5), ("NOK", 8.8), ("DKK", 6.3), ("PLN", 3.9),
    ("CZK", 21.5), ("HUF", 300.0), ("RUB", 95.0), ("BRL", 5.0), ("MXN", 20.0), ("ARS", 350.0),
    ("CLP", 800.0), ("COP", 4000.0), ("PEN", 3.7), ("UYU", 40.0), ("VES", 36.0), ("CNY", 7.2),
    ("KRW", 1300.0), ("THB", 35.0), ("VND", 24000.0), ("IDR", 15000.0), ("MYR", 4.2), ("SGD", 1.35),
    ("HKD", 7.8), ("TWD", 30.0), ("NZD", 1.45), ("PHP", 55.0), ("ZAR", 18.0), ("EGP", 30.0),
    ("MAD", 10.0), ("NGN", 750.0), ("KES", 130.0), ("GHS", 6.0), ("TZS", 2300.0), ("UGX", 3700.0),
    ("RWF", 1200.0), ("ETB", 55.0), ("TRY", 30.0), ("ILS", 3.7), ("AED", 3.67), ("SAR", 3.75),
    ("QAR", 3.64), ("KWD", 0.31), ("BHD", 0.38), ("OMR", 0.38), ("JOD", 0.71), ("LBP", 15000.0),
    ("PKR", 280.0), ("LKR", 320.0), ("NPR", 133.0), ("BDT", 110.0), ("MMK", 2100.0), ("LAK", 17000.0),
    ("KHR", 4100.0), ("MOP", 8.0), ("BND", 1.35), ("FJD", 2.2), ("PGK", 3.7), ("SBD", 8.3),
    ("TOP", 2.3), ("VUV", 120.0), ("WST", 2.7), ("XPF", 110.0), ("AOA", 830.0), ("BWP", 13.5),
    ("LSL", 18.0), ("SZL", 18.0), ("ZMW", 18.0), ("BIF", 2900.0), ("DJF", 178.0), ("ERN", 15.0),
    ("SOS", 570.0), ("SSP", 600.0), ("SYP", 13000.0), ("YER", 250.0), ("AFN", 70.0), ("AMD", 400.0),
    ("AZN", 1.7), ("GEL", 2.7), ("KGS", 89.0), ("KZT", 450.0), ("MDL", 18.0), ("TJS", 10.9),
    ("TMT", 3.5), ("UZS", 12000.0), ("UAH", 36.0), ("BYN", 3.2), ("MKD", 56.0), ("RSD", 108.0),
    ("BAM", 1.8), ("BGN", 1.8), ("HRK", 6.7), ("RON", 4.6), ("ALL", 95.0), ("ISK", 135.0),
    ("MGA", 4500.0), ("MUR", 45.0), ("SCR", 13.5), ("SLL", 18000.0), ("LRD", 190.0), ("CDF", 2500.0),
    ("XAF", 600.0), ("XOF", 600.0), ("KMF", 450.0), ("STN", 22.5), ("MZN", 64.0), ("NAD", 18.0),
    ("ZWL", 360.0), ("BMD", 1.0), ("BSD", 1.0), ("BBD", 2.0), ("BZD", 2.0), ("XCD", 2.7),
    ("DOP", 56.0), ("GTQ", 7.8), ("HNL", 24.7), ("JMD", 155.0), ("NIO", 36.8), ("PYG", 7200.0),
    ("SRD", 38.0), ("TTD", 6.8), ("XDR", 0.75),
]

# Report style currency formats: code, symbol, position, decimals; separator is always ','.
REPORT_FORMATS = [
    ("USD", "$", "before", 2), ("INR", "₹", "before", 2), ("EUR", "€", "after", 2), ("GBP", "£", "before", 2),
    ("JPY", "¥", "before", 0), ("CAD", "C$", "before", 2), ("AUD", "A$", "before", 2), ("CHF", "CHF", "after", 2),
    ("SEK", "kr", "after", 2), ("NOK", "kr", "after", 2), ("DKK", "kr", "after", 2), ("PLN", "zł", "after", 2),
    ("CZK", "Kč", "after", 2), ("HUF", "Ft", "after", 2), ("RUB", "₽", "after", 2), ("BRL", "R$", "before", 2),
    ("MXN", "$", "before", 2), ("ARS", "$", "before", 2), ("CLP", "$", "before", 2), ("COP", "$", "before", 2),
    ("PEN", "S/", "before", 2), ("UYU", "$U", "before", 2), ("VES", "Bs.S", "before", 2), ("CNY", "¥", "before", 2),
    ("KRW", "₩", "before", 0), ("THB", "฿", "before", 2), ("VND", "₫", "after", 0), ("IDR", "Rp", "before", 0),
    ("MYR", "RM", "before", 2), ("SGD", "S$", "before", 2), ("HKD", "HK$", "before", 2), ("TWD", "NT$", "before", 2),
    ("NZD", "NZ$", "before", 2), ("PHP", "₱", "before", 2), ("ZAR", "R", "before", 2), ("EGP", "£", "before", 2),
    ("MAD", "MAD", "after", 2), ("NGN", "₦", "before", 2), ("KES", "KSh", "before", 2), ("GHS", "₵", "before", 2),
    ("TZS", "TSh", "before", 2), ("UGX", "USh", "before", 2), ("RWF", "RF", "before", 2), ("ETB", "Br", "before", 2),
    ("TRY", "₺", "before", 2), ("ILS", "₪", "before", 2), ("AED", "د.إ", "before", 2), ("SAR", "ر.س", "before", 2),
    ("QAR", "ر.ق", "before", 2), ("KWD", "د.ك", "before", 3), ("BHD", "د.ب", "before", 3), ("OMR", "ر.ع.", "before", 3),
    ("JOD", "د.ا", "before", 3), ("LBP", "ل.ل", "before", 2), ("PKR", "₨", "before", 2), ("LKR", "₨", "before", 2),
    ("NPR", "₨", "before", 2), ("BDT", "৳", "before", 2), ("MMK", "K", "before", 2), ("LAK", "₭", "before", 2),
    ("KHR", "៛", "after", 2), ("MOP", "MOP$", "before", 2), ("BND", "B$", "before", 2), ("FJD", "FJ$", "before", 2),
    ("PGK", "K", "before", 2), ("SBD", "SI$", "before", 2), ("TOP", "T$", "before", 2), ("VUV", "VT", "after", 0),
    ("WST", "WS$", "before", 2), ("XPF", "₣", "after", 0), ("AOA", "Kz", "before", 2), ("BWP", "P", "before", 2),
    ("LSL", "L", "before", 2), ("SZL", "E", "before", 2), ("ZMW", "ZK", "before", 2), ("BIF", "FBu", "before", 2),
    ("DJF", "Fdj", "before", 2), ("ERN", "Nfk", "before", 2), ("SOS", "S", "before", 2), ("SSP", "£", "before", 2),
    ("SYP", "£", "before", 2), ("YER", "﷼", "before", 2), ("AFN", "؋", "before", 2), ("AMD", "֏", "before", 2),
    ("AZN", "₼", "before", 2), ("GEL", "₾", "before", 2), ("KGS", "лв", "after", 2), ("KZT", "₸", "before", 2),
    ("MDL", "L", "before", 2), ("TJS", "SM", "before", 2), ("TMT", "T", "before", 2), ("UZS", "лв", "after", 2),
    ("UAH", "₴", "before", 2), ("BYN", "Br", "before", 2), ("MKD", "ден", "after", 2), ("RSD", "дин.", "after", 2),
    ("BAM", "КМ", "after", 2), ("BGN", "лв", "after", 2), ("HRK", "kn", "after", 2), ("RON", "lei", "after", 2),
    ("ALL", "L", "before", 2), ("ISK", "kr", "after", 0), ("MGA", "Ar", "before", 2), ("MUR", "₨", "before", 2),
    ("SCR", "₨", "before", 2), ("SLL", "Le", "before", 2), ("LRD", "L$", "before", 2), ("CDF", "FC", "before", 2),
    ("XAF", "FCFA", "after", 0), ("XOF", "CFA", "after", 0), ("KMF", "CF", "before", 2), ("STN", "Db", "before", 2),
    ("MZN", "MT", "before", 2), ("NAD", "N$", "before", 2), ("ZWL", "Z$", "before", 2), ("BMD", "B$", "before", 2),
    ("BSD", "B$", "before", 2), ("BBD", "Bds$", "before", 2), ("BZD", "BZ$", "before", 2), ("XCD", "EC$", "before", 2),
    ("DOP", "RD$", "before", 2), ("GTQ", "Q", "before", 2), ("HNL", "L", "before", 2), ("JMD", "J$", "before", 2),
    ("NIO", "C$", "before", 2), ("PYG", "₲", "before", 2), ("SRD", "Sr$", "before", 2), ("TTD", "TT$", "before", 2),
    ("XDR", "XDR", "after", 2), ("BTC", "₿", "before", 8), ("ETH", "Ξ", "before", 6),
]

# Locale style currency formats: code|symbol|position|decimals|thousands|decimal (28 currencies).
LOCALE_FORMATS = [
    ("USD", "$", "before", 2, ",", "."),
    ("INR", "₹", "before", 2, ",", "."),
    ("EUR", "€", "after", 2, ".", ","),
    ("GBP", "£", "before", 2, ",", "."),
    ("JPY", "¥", "before", 0, ",", "."),
    ("BTC", "₿", "before", 8, ",", "."),
    ("CAD", "C$", "before", 2, ",", "."),
    ("AUD", "A$", "before", 2, ",", "."),
    ("CHF", "CHF", "after", 2, "'", "."),
    ("CNY", "¥", "before", 2, ",", "."),
    ("SEK", "kr", "after", 2, " ", ","),
    ("NOK", "kr", "after", 2, " ", ","),
    ("DKK", "kr", "after", 2, ".", ","),
    ("PLN", "zł", "after", 2, " ", ","),
    ("CZK", "Kč", "after", 2, " ", ","),
    ("HUF", "Ft", "after", 0, " ", ","),
    ("RUB", "₽", "after", 2, " ", ","),
    ("BRL", "R$", "before", 2, ".", ","),
    ("MXN", "$", "before", 2, ",", "."),
    ("ZAR", "R", "before", 2, ",", "."),
    ("KRW", "₩", "before", 0, ",", "."),
    ("SGD", "S$", "before", 2, ",", "."),
    ("HKD", "HK$", "before", 2, ",", "."),
    ("NZD", "NZ$", "before", 2, ",", "."),
    ("THB", "฿", "before", 2, ",", "."),
    ("MYR", "RM", "before", 2, ",", "."),
    ("IDR", "Rp", "before", 0, ".", ","),
    ("PHP", "₱", "before", 2, ",", "."),
]

# Currency detection: ordered (regex, code) list; the first pattern found anywhere wins.
CURRENCY_PATTERNS = [
    (r"C\$", "CAD"), (r"A\$", "AUD"), (r"R\$", "BRL"), (r"RM", "MYR"), (r"S\$", "SGD"),
    (r"HK\$", "HKD"), (r"NZ\$", "NZD"), (r"Rp", "IDR"),
    (r"₹", "INR"), (r"€", "EUR"), (r"£", "GBP"), (r"₱", "PHP"), (r"₽", "RUB"), (r"₩", "KRW"),
    (r"฿", "THB"), (r"₿", "BTC"),
    (r"^\$", "USD"),
    (r"¥", "JPY"), (r"￥", "CNY"),
    (r"\bUSD\b", "USD"), (r"\bINR\b", "INR"), (r"\bEUR\b", "EUR"), (r"\bGBP\b", "GBP"),
    (r"\bJPY\b", "JPY"), (r"\bCAD\b", "CAD"), (r"\bAUD\b", "AUD"), (r"\bCHF\b", "CHF"),
    (r"\bCNY\b", "CNY"), (r"\bSEK\b", "SEK"), (r"\bNOK\b", "NOK"), (r"\bDKK\b", "DKK"),
    (r"\bPLN\b", "PLN"), (r"\bCZK\b", "CZK"), (r"\bHUF\b", "HUF"), (r"\bRUB\b", "RUB"),
    (r"\bBRL\b", "BRL"), (r"\bMXN\b", "MXN"), (r"\bZAR\b", "ZAR"), (r"\bKRW\b", "KRW"),
    (r"\bSGD\b", "SGD"), (r"\bHKD\b", "HKD"), (r"\bNZD\b", "NZD"), (r"\bTHB\b", "THB"),
    (r"\bMYR\b", "MYR"), (r"\bIDR\b", "IDR"), (r"\bPHP\b", "PHP"),
]

# Defensive-parser symbol lookup, tested in this order ('$' before 'C$', so 'C$5' is USD).
DEFENSIVE_SYMBOLS = [
    ("€", "EUR"), ("$", "USD"), ("₹", "INR"), ("£", "GBP"), ("¥", "JPY"), ("₽", "RUB"),
    ("₱", "PHP"), ("₩", "KRW"), ("฿", "THB"), ("₿", "BTC"), ("C$", "CAD"), ("A$", "AUD"),
    ("R$", "BRL"), ("RM", "MYR"), ("S$", "SGD"), ("HK$", "HKD"), ("NZ$", "NZD"), ("Rp", "IDR"),
]

# Content patterns of the defensive parser (prefix match) and of the pattern extractor.
LOOKS_LIKE_DATE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}"
LOOKS_LIKE_AMOUNT = r"[€$₹£¥₽₱₩]\d+|\d+\.\d{2}|\d+,\d{2}|\d+"
EXTRACT_AMOUNT = r"[€$₹£¥₽₱₩]?\d+[.,]\d{2}"
EMERGENCY_DATE = r"\d{4}-\d{2}-\d{2}"
EMERGENCY_AMOUNT = r"\d+[.,]?\d*"

# Category dictionary: keywords and one pattern per category, in dictionary order.
CATEGORY_KEYWORDS = {
    "food": ["restaurant", "cafe", "grocery", "food", "meal", "dining", "takeout", "delivery",
             "coffee", "lunch", "dinner", "breakfast", "pizza", "burger", "sushi", "mcdonalds",
             "starbucks", "subway", "dominos", "chipotle", "panera", "taco bell", "wendys", "kfc",
             "burger king", "dairy queen", "tim hortons", "dunkin", "five guys", "in-n-out"],
    "transport": ["uber", "lyft", "taxi", "gas", "fuel", "parking", "metro", "bus", "train",
                  "subway", "transport", "commute", "shell", "exxon", "chevron", "bp", "valero",
                  "mobil", "citgo", "sunoco", "speedway", "wawa"],
    "entertainment": ["movie", "theater", "concert", "show", "game", "netflix", "spotify",
                      "amazon prime", "entertainment", "fun", "hulu", "disney+", "youtube",
                      "ticketmaster", "fandango", "cinema", "amc", "regal", "imax", "paramount",
                      "universal", "warner bros"],
    "shopping": ["amazon", "walmart", "target", "mall", "store", "shop", "retail", "clothing",
                 "electronics", "shopping", "best buy", "home depot", "lowes", "costco",
                 "sams club", "macys", "nordstrom", "kohls", "tj maxx", "marshalls", "ross",
                 "old navy", "gap"],
    "utilities": ["electric", "water", "gas", "internet", "phone", "cable", "utility", "bill",
                  "service", "verizon", "at&t", "comcast", "xfinity", "duke energy", "pg&e",
                  "spectrum", "cox", "directv", "dish"],
    "healthcare": ["doctor", "hospital", "pharmacy", "medical", "health", "dental", "vision",
                   "insurance", "cvs", "walgreens", "rite aid", "kroger pharmacy", "urgent care",
                   "clinic", "dentist", "optometrist"],
    "education": ["school", "university", "college", "course", "book", "tuition", "education",
                  "learning", "textbook", "library", "coursera", "udemy", "khan academy", "edx",
                  "skillshare"],
    "travel": ["hotel", "airline", "flight", "vacation", "trip", "travel", "booking",
               "reservation", "marriott", "hilton", "airbnb", "expedia", "booking.com",
               "priceline", "kayak", "travelocity", "orbitz"],
    "insurance": ["car insurance", "home insurance", "life insurance", "health insurance",
                  "insurance", "geico", "state farm", "allstate", "progressive", "usaa",
                  "liberty mutual", "farmers"],
    "investment": ["investment", "stock", "bond", "fund", "portfolio", "trading", "brokerage",
                   "fidelity", "vanguard", "schwab", "robinhood", "etrade", "td ameritrade",
                   "merrill lynch", "401k", "ira"],
}
CATEGORY_PATTERNS = {
    "food": r"\b(restaurant|cafe|bistro|diner|eatery|food|grocery|market)\b",
    "transport": r"\b(uber|lyft|taxi|gas|fuel|parking|metro|bus|train)\b",
    "entertainment": r"\b(movie|theater|cinema|concert|show|netflix|spotify)\b",
    "shopping": r"\b(amazon|walmart|target|shop|store|retail|mall)\b",
    "utilities": r"\b(electric|water|gas|internet|phone|cable|utility)\b",
    "healthcare": r"\b(doctor|hospital|pharmacy|medical|health|dental)\b",
    "education": r"\b(school|university|college|course|education|tuition)\b",
    "travel": r"\b(hotel|airline|flight|vacation|trip|travel|booking)\b",
    "insurance": r"\b(insurance|geico|state farm|allstate|progressive)\b",
    "investment": r"\b(investment|stock|bond|fund|portfolio|trading|brokerage)\b",
}

# Words of the dictionary that are on the TF-IDF English stop list (sklearn's list); only
# dictionary words matter because the vocabulary is built from the dictionary alone.
TFIDF_STOP_WORDS_IN_DICTIONARY = ["at", "bill", "five", "in", "out", "show"]

# Stop words of the keyword rules (the usual English list of natural-language toolkits).
RULE_STOP_WORDS = """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she
    she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these
    those am is are was were be been being have has had having do does did doing a an the and but if or because as until while
    of at by for with about against between into through during before after above below to from up down in out on off over
    under again further then once here there when where why how all any both each few more most other some such no nor not only
    own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't
    didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't
    shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# Month abbreviations replaced by numbers before date parsing.
MONTH_ABBREVIATIONS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct",
                       "nov", "dec"]

# Date formats tried in priority order (Spark pattern letters; two-digit-year and no-year
# formats are handled by the date parser).
DATE_FORMATS = ["yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "d-M-yyyy", "M-d-yyyy",
                "yyyy-M-d H:m:s", "M/d/yyyy H:m:s", "d/M/yyyy H:m:s",
                "M/d/yy", "M-d-yy", "d/M/yy", "d-M-yy", "M/d", "M-d"]

WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Text values that mean "expense" in a statement's type column.
DEBIT_WORDS = ["debit", "expense", "withdrawal"]
SIGN_DEBIT_WORDS = ["debit", "expense", "withdrawal", "payment"]

# ---------------------------------------------------------------------------------------
# Derived values (rules over the fixed values above)
# ---------------------------------------------------------------------------------------


def fallback_rates() -> list[tuple[str, float]]:
    return [(code, float(rate)) for code, rate in FALLBACK_RATES]


def report_formats() -> list[tuple[str, str, str, int]]:
    return list(REPORT_FORMATS)


def keyword_rows() -> list[tuple[str, int, str, int]]:
    """(category, category_ord, keyword, n_words) in dictionary order."""
    rows = []
    for ordinal, (cat, kws) in enumerate(CATEGORY_KEYWORDS.items()):
        for kw in kws:
            rows.append((cat, ordinal, kw, len(kw.split())))
    return rows


# ---------------------------------------------------------------------------------------
# DataFrame builders
# ---------------------------------------------------------------------------------------

# Upper bound for anything we broadcast from this module.
MAX_DIM_ROWS = 10_000


def checked_broadcast(df: DataFrame, max_rows: int = MAX_DIM_ROWS, known_rows: int | None = None):
    """Broadcast a dimension whose size is bounded; refuse otherwise.

    ``known_rows`` is the size the builder guarantees (literal tables); it is compared to the
    bound without running a job.
    """
    if known_rows is None:
        raise ValueError("broadcast needs a known row bound")
    if known_rows > max_rows:
        raise ValueError(f"dimension of {known_rows} rows exceeds broadcast bound {max_rows}")
    return F.broadcast(df)


def fx_rates_dim(spark: SparkSession, as_of: str = "1970-01-01", source: str = "fallback") -> DataFrame:
    rows = fallback_rates()
    df = (spark.createDataFrame(rows, "currency string, per_usd double")
          .withColumn("as_of", F.lit(as_of).cast("date"))
          .withColumn("source", F.lit(source)))
    return checked_broadcast(df, known_rows=len(rows))


def keyword_dim(spark: SparkSession) -> DataFrame:
    rows = keyword_rows()
    df = spark.createDataFrame(rows, "category string, category_ord int, keyword string, n_words int")
    return checked_broadcast(df, known_rows=len(rows))
