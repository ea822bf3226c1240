"""J8/G4 for dictionaries of any size: keyword rules as equi-joins over the grams of keywords and texts.

The scores are those of ``categorize.rule_scores``: a keyword equal to the text counts 3, one within it 1.5 for each of its
words; a token equal to a keyword counts 2, one that holds a keyword or lies in one 0.5. There every text meets every keyword;
here a string meets only those that share its rarest gram of three characters (two or one for shorter ones) and a built-in
``instr`` verifies the pair, so the work follows the matches. Strings are reduced to different ones first, and what a token
earns in a category is summed before it meets the texts, so frequent tokens and texts travel once.

Null and blank keywords score nothing, a keyword that a category lists twice counts twice; null texts get ('other', 0.0) as
texts without any match do; texts are expected once each, repeated ones are answered alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.dims import CATEGORY_KEYWORDS, CATEGORY_PATTERNS, RULE_STOP_WORDS
from ledgerlake.operators.categorize import rule_tokens

#: Characters of a gram.
GRAM = 3


def dictionary_rows(spark, dictionary: dict[str, list[str]] | None = None) -> DataFrame:
    """A dictionary held by the caller as rows (category, place, keyword); ``place`` is the category's rank in ties."""
    rows = [(c, i, k) for i, (c, ks) in enumerate((dictionary or CATEGORY_KEYWORDS).items()) for k in ks]
    return spark.createDataFrame(rows, "category string, place int, keyword string")


def _grams(s: str, sizes: list[int]):
    """The different grams of the column ``s`` of the given sizes."""
    def of(n):
        return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(F.col(s), i, F.lit(n)))).otherwise(
            F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def containments(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """All pairs (inner, outer) of different non-empty strings of two one-column frames where the first lies in the second.

    An inner string is filed under the rarest of its grams among the outer ones; one with a gram that no outer string has is left out.
    """
    a = inner.toDF("inner").filter(F.length("inner") > 0).distinct()
    b = outer.toDF("outer").filter(F.length("outer") > 0).distinct()
    sizes = [r[0] for r in a.select(F.least(F.length("inner"), F.lit(GRAM))).distinct().collect()]   # at most three numbers
    if not sizes:
        return a.select("inner", F.lit(None).cast("string").alias("outer")).limit(0)
    probes = b.select("outer", F.explode(_grams("outer", sizes)).alias("gram"))
    counts = probes.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.length("inner") >= GRAM, _grams("inner", [GRAM])).otherwise(F.array("inner"))
    filed = (a.withColumn("grams", own).select("inner", F.size("grams").alias("want"), F.explode("grams").alias("gram"))
             .join(counts, "gram").groupBy("inner", "want").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count(F.lit(1)).alias("have"))
             .filter(F.col("want") == F.col("have")).select("inner", "gram"))
    return filed.join(probes, "gram").filter(F.instr(F.col("outer"), F.col("inner")) > 0).select("inner", "outer")


def keyword_scores(texts: DataFrame, keywords: DataFrame, text: str = "desc", stop_words: list[str] | None = None) -> DataFrame:
    """Positive scores (text, category, place, score) of different texts; ``keywords``: (category, place, keyword)."""
    stop_words = RULE_STOP_WORDS if stop_words is None else stop_words
    t = texts.select(F.col(text).alias("_text")).filter(F.col("_text").isNotNull()).distinct()
    held = (keywords.filter(F.trim(F.coalesce("keyword", F.lit(""))) != "").groupBy("category", "place", "keyword").agg(F.count(F.lit(1)).alias("times")))
    words = held.select("keyword").distinct()
    occurs = t.select("_text", F.explode(rule_tokens(F.col("_text"), stop_words)).alias("_token")).groupBy("_text", "_token").agg(F.count(F.lit(1)).alias("n"))
    tokens = occurs.select("_token").distinct()

    pair = ("keyword", "_token")
    near = containments(words, tokens).toDF(*pair).union(containments(tokens, words).toDF("_token", "keyword").select(*pair)).distinct()
    earned = (near.join(held, "keyword").groupBy("_token", "category", "place")
              .agg(F.sum(F.col("times") * F.when(F.col("keyword") == F.col("_token"), 2.0).otherwise(0.5)).alias("w")))
    by_token = occurs.join(earned, "_token").select("_text", "category", "place", (F.col("n") * F.col("w")).alias("score"))

    n_words = F.size(F.split(F.trim("keyword"), r"\s+"))
    by_text = (containments(words, t).toDF("keyword", "_text").join(held, "keyword")
               .select("_text", "category", "place",
                       (F.col("times") * F.when(F.col("keyword") == F.col("_text"), 3.0).otherwise(n_words * 1.5)).alias("score")))
    return (by_token.union(by_text).groupBy("_text", "category", "place").agg(F.sum("score").alias("score"))
            .withColumnRenamed("_text", text))


def rule_scores(descs: DataFrame, keywords: DataFrame, text: str = "desc", stop_words: list[str] | None = None,
                patterns: dict[str, str] | None = None) -> DataFrame:
    """``descs`` with (rule_category, rule_confidence), as ``categorize.rule_scores`` has them, for a dictionary given as rows.

    ``patterns`` (category -> regular expression, 2 more where it matches) concern categories of ``keywords`` only.
    """
    patterns = CATEGORY_PATTERNS if patterns is None else patterns
    scores = keyword_scores(descs, keywords, text, stop_words)
    if patterns:
        hits = F.filter(F.array(*[F.when(F.col(text).rlike("(?i)" + p), F.lit(c)) for c, p in patterns.items()]), lambda c: c.isNotNull())
        matched = (descs.select(text).distinct().select(text, F.explode(hits).alias("category"))
                   .join(keywords.select("category", "place").distinct(), "category").select(text, "category", "place", F.lit(2.0).alias("score")))
        scores = scores.union(matched).groupBy(text, "category", "place").agg(F.sum("score").alias("score"))
    best = scores.groupBy(text).agg(F.min_by("category", F.struct(-F.col("score"), "place", "category")).alias("rule_category"), F.max("score").alias("_score"))
    return (descs.drop("rule_category", "rule_confidence", "_score").join(best, text, "left")
            .select(*[F.col(f"`{c}`") for c in descs.columns if c not in ("rule_category", "rule_confidence", "_score")],
                    F.coalesce("rule_category", F.lit("other")).alias("rule_category"),
                    F.least(F.coalesce("_score", F.lit(0.0)) / 10.0, F.lit(1.0)).alias("rule_confidence")))
