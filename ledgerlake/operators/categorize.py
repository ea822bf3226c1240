"""Transaction categorisation: TF-IDF + multinomial naive Bayes blended with keyword rules.

Plan (per call, all rows of all accounts):
  1. ``distinct`` lower-cased descriptions — the only shuffle. Real statements repeat the same
     merchant text, so everything below runs once per distinct text; a hot merchant holding a
     third of the rows is one row here (map-side partial dedupe before the shuffle).
  2. Naive Bayes (G3): explode the description's tokens, join the vocabulary model
     (broadcast by Spark when it is small), aggregate per description. The aggregation keys start with the
     description, so the partitioning left by step 1 already satisfies them: no new exchange.
  3. Keyword rules (G4): substring semantics ("keyword in description", "token in keyword")
     are not equi-joins, so the 192-keyword dictionary is evaluated as a higher-order-function
     expression over literal arrays on the same rows — no cross join with the dictionary.
  4. Blend (G6) and join back to the rows that need a category (G7); AQE splits a skewed
     description partition on that join.

The model is trained (G1) by a Spark job over the keyword dictionary and is a pair of small
tables (G2: write/read them as parquet).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.functions.literals import array_of, array_of_structs
from ledgerlake.dims import (CATEGORY_KEYWORDS, CATEGORY_PATTERNS, RULE_STOP_WORDS,
                             TFIDF_STOP_WORDS_IN_DICTIONARY, keyword_dim)

TOKEN_RE = r"(?U)\b\w\w+\b"          # TF-IDF tokens: 2+ word characters, lower-cased text
RULE_SPLIT = r"""([,;:@#$%&?!"()\[\]{}<>])"""  # punctuation split off as separate tokens
MIN_CONFIDENCE = 0.5   # below this a category is flagged, never dropped
ML_HIGH, RULE_HIGH, ML_MID, RULE_MID = 0.7, 0.8, 0.5, 0.5


# ---------------------------------------------------------------------------------------
# Training and persistence
# ---------------------------------------------------------------------------------------

@dataclass
class NBModel:
    vocab: DataFrame          # token, idf, lfc ARRAY<DOUBLE> (ln(feature_count + 1) per class)
    classes: list[tuple[str, float, float]]   # (class, log prior, ln(Σ feature_count + V)), sorted

    def save(self, path: str) -> None:
        spark = self.vocab.sparkSession
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        spark.createDataFrame(self.classes, "category string, log_prior double, log_denominator double") \
             .write.mode("overwrite").parquet(f"{path}/classes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "NBModel":
        classes = [tuple(r) for r in spark.read.parquet(f"{path}/classes").orderBy("category").collect()]
        return NBModel(spark.read.parquet(f"{path}/vocab"), classes)


def tfidf_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_RE), 0)


def train(spark: SparkSession, docs: DataFrame | None = None, stop_words: list[str] | None = None,
          max_features: int | None = None) -> NBModel:
    """Fit TF-IDF (smooth idf, L2 rows) + multinomial NB (alpha = 1) on (category, keyword).

    ``docs`` (category, text) defaults to the keyword dictionary. ``stop_words``: of the default
    dictionary those the vectoriser drops, of other documents the whole English list.
    ``max_features`` keeps the most frequent terms only (ties by token); no limit by default.

    idf = ln((1 + N) / (1 + df)) + 1; feature_count[c, t] = Σ over class docs of the L2-normed
    tf·idf weight; log P(t | c) = ln(fc + 1) − ln(Σ_t fc + V); prior = ln(n_c / N).
    The class table (one row per class, ≤ a few dozen) is collected to build expressions.
    """
    own = docs is not None
    docs = docs if own else keyword_dim(spark).select("category", F.col("keyword").alias("text"))
    # equal documents of a class are one row with its count, so the id stays the same in every job
    docs = (docs.groupBy("category", "text").agg(F.count(F.lit(1)).alias("copies"))
            .withColumn("doc_id", F.sha2(F.to_json(F.struct("category", "text")), 256)))
    stop = stop_words if stop_words is not None else [
        *TFIDF_STOP_WORDS_IN_DICTIONARY, *(RULE_STOP_WORDS if own else [])]
    occ = (docs.select("doc_id", "category", "copies", F.explode(tfidf_tokens(F.col("text"))).alias("token"))
               .filter(~F.col("token").isin(stop)))
    n_docs = docs.agg(F.sum("copies")).first()[0] or 0  # 192 for the default dictionary; a scalar needed for idf
    tf = occ.groupBy("doc_id", "category", "copies", "token").agg(F.count(F.lit(1)).alias("tf"))
    dfreq = tf.groupBy("token").agg(F.sum("copies").alias("df"), F.sum(F.col("tf") * F.col("copies")).alias("ctf"))
    if max_features is not None:  # a distributed top-k
        dfreq = dfreq.orderBy(F.col("ctf").desc(), "token").limit(max_features)
    dfreq = dfreq.withColumn("idf", F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1)
    w = tf.join(dfreq.select("token", "idf"), "token").withColumn("w", F.col("tf") * F.col("idf"))
    w = w.withColumn("x", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id"))))
    fc = w.groupBy("category", "token").agg(F.sum(F.col("x") * F.col("copies")).alias("fc"))
    classes_df = docs.groupBy("category").agg(F.sum("copies").alias("n"))
    n_vocab = dfreq.count()
    sums = {r["category"]: r["s"] for r in fc.groupBy("category").agg(F.sum("fc").alias("s")).collect()}
    classes = sorted((r["category"], math.log(r["n"] / n_docs), math.log(sums.get(r["category"], 0.0) + n_vocab))
                     for r in classes_df.collect())
    names = [c for c, _, _ in classes]
    pivot = fc.groupBy("token").pivot("category", names).agg(F.first("fc"))
    vocab = (dfreq.select("token", "idf").join(pivot, "token", "left")
             .select("token", "idf",
                     F.array(*[F.log1p(F.coalesce(F.col(f"`{c}`"), F.lit(0.0))) for c in names]).alias("lfc")))
    return NBModel(vocab, classes)


_DEFAULT_MODELS: dict[str, NBModel] = {}


def default_model(spark: SparkSession) -> NBModel:
    """The model of the built-in dictionary, trained once per application (the vocabulary is a
    cached table of 200 rows); like the reference's model file, it is reused by later calls."""
    key = spark.sparkContext.applicationId
    if key not in _DEFAULT_MODELS:
        m = train(spark)
        _DEFAULT_MODELS[key] = NBModel(m.vocab.cache(), m.classes)
    return _DEFAULT_MODELS[key]


# ---------------------------------------------------------------------------------------
# Naive Bayes scoring
# ---------------------------------------------------------------------------------------

def ml_scores(descs: DataFrame, model: NBModel, text: str = "desc") -> DataFrame:
    """Per distinct text: (ml_category, ml_confidence) = argmax / max of predict_proba."""
    names = [c for c, _, _ in model.classes]
    k = len(names)
    vocab = model.vocab   # Spark broadcasts it by its size, which a caller's model does not bound
    occ = descs.select(text, F.explode_outer(tfidf_tokens(F.col(text))).alias("token"))
    occ = occ.join(vocab, "token", "left")
    per_tok = (occ.groupBy(text, "token")
                  .agg(F.count("idf").alias("tf"), F.first("idf").alias("idf"), F.first("lfc").alias("lfc"))
                  .withColumn("w", F.col("tf") * F.col("idf")))
    agg = per_tok.groupBy(text).agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
        F.sum("w").alias("wsum"),
        *[F.sum(F.col("w") * F.col("lfc")[i]).alias(f"_n{i}") for i in range(k)])
    inv = F.when(F.col("norm") > 0, F.lit(1.0) / F.col("norm")).otherwise(F.lit(0.0))
    jll = [F.coalesce(F.col(f"_n{i}"), F.lit(0.0)) * inv - F.coalesce(F.col("wsum"), F.lit(0.0)) * inv * F.lit(den)
           + F.lit(prior) for i, (_, prior, den) in enumerate(model.classes)]
    scored = agg.select(text, *[j.alias(f"_j{i}") for i, j in enumerate(jll)])
    m = F.greatest(*[F.col(f"_j{i}") for i in range(k)])
    z = sum(F.exp(F.col(f"_j{i}") - m) for i in range(k))
    best = None
    for i, c in enumerate(names):          # classes are sorted: first maximum wins
        cond = F.col(f"_j{i}") == m
        best = F.when(cond, F.lit(c)) if best is None else best.when(cond, F.lit(c))
    return scored.select(text, best.alias("ml_category"), (F.lit(1.0) / z).alias("ml_confidence"))


# ---------------------------------------------------------------------------------------
# Keyword rules
# ---------------------------------------------------------------------------------------

def rule_tokens(text: Column, stop_words: list[str]) -> Column:
    """Word tokens with punctuation split off; stop words and tokens ≤ 2 chars removed."""
    spaced = F.regexp_replace(text, RULE_SPLIT, " $1 ")
    toks = F.split(F.trim(spaced), r"\s+")
    stop = array_of(stop_words)
    return F.filter(toks, lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def _category_score(d: Column, toks: Column, keywords: list[str], pattern: str | None) -> Column:
    kws = array_of_structs([(k, len(k.split())) for k in keywords], ("k", "n"))

    def per_kw(acc, kw):
        whole = (F.when(kw["k"] == d, F.lit(3.0))
                  .when(F.instr(d, kw["k"]) > 0, kw["n"] * F.lit(1.5)).otherwise(F.lit(0.0)))
        tok = F.aggregate(toks, F.lit(0.0), lambda a, t: a + F.when(kw["k"] == t, F.lit(2.0))
                          .when((F.instr(t, kw["k"]) > 0) | (F.instr(kw["k"], t) > 0), F.lit(0.5))
                          .otherwise(F.lit(0.0)))
        return acc + whole + tok

    score = F.aggregate(kws, F.lit(0.0), per_kw)
    if pattern:
        score = score + F.when(d.rlike("(?i)" + pattern), F.lit(2.0)).otherwise(F.lit(0.0))
    return score


def rule_scores(descs: DataFrame, text: str = "desc", stop_words: list[str] | None = None,
                dictionary: dict[str, list[str]] | None = None,
                patterns: dict[str, str] | None = None) -> DataFrame:
    """Per distinct text: (rule_category, rule_confidence); first category in dictionary order
    among the maxima; no positive score → ('other', 0.0)."""
    stop_words = stop_words if stop_words is not None else RULE_STOP_WORDS
    dictionary = dictionary or CATEGORY_KEYWORDS
    patterns = CATEGORY_PATTERNS if patterns is None else patterns
    d = F.col(text)
    staged = descs.withColumn("_tok", rule_tokens(d, stop_words))
    cats = list(dictionary)
    staged = staged.select("*", *[_category_score(d, F.col("_tok"), dictionary[c], patterns.get(c)).alias(f"_s{i}")
                                  for i, c in enumerate(cats)])
    m = F.greatest(*[F.col(f"_s{i}") for i in range(len(cats))])
    best = None
    for i, c in enumerate(cats):
        cond = F.col(f"_s{i}") == m
        best = F.when(cond, F.lit(c)) if best is None else best.when(cond, F.lit(c))
    return staged.select(*descs.columns, F.when(m > 0, best).otherwise(F.lit("other")).alias("rule_category"),
                         F.when(m > 0, F.least(m / 10.0, F.lit(1.0))).otherwise(F.lit(0.0)).alias("rule_confidence"))


# ---------------------------------------------------------------------------------------
# Blend and apply
# ---------------------------------------------------------------------------------------

def blend(ml_cat: Column, ml_conf: Column, rule_cat: Column, rule_conf: Column, text: Column) -> Column:
    """STRUCT<category, confidence> by the thresholds ml ≥ .7, rule ≥ .8, ml ≥ .5, rule ≥ .5,
    else the larger (ties to ml); blank text → ('other', 0.0)."""
    ml = F.struct(ml_cat.alias("category"), ml_conf.alias("confidence"))
    rule = F.struct(rule_cat.alias("category"), rule_conf.alias("confidence"))
    other = F.struct(F.lit("other").alias("category"), F.lit(0.0).alias("confidence"))
    return (F.when(F.coalesce(F.trim(text), F.lit("")) == "", other)
             .when(ml_conf >= ML_HIGH, ml).when(rule_conf >= RULE_HIGH, rule)
             .when(ml_conf >= ML_MID, ml).when(rule_conf >= RULE_MID, rule)
             .when(ml_conf >= rule_conf, ml).otherwise(rule))


def classify_texts(texts: DataFrame, model: NBModel | None = None, text: str = "desc") -> DataFrame:
    """Distinct texts → ml, rule and blended scores (one row per text)."""
    spark = texts.sparkSession
    model = model or default_model(spark)
    both = rule_scores(ml_scores(texts, model, text), text)   # the rules keep the columns they are given
    b = blend(F.col("ml_category"), F.col("ml_confidence"), F.col("rule_category"),
              F.col("rule_confidence"), F.col(text))
    return both.select(text, "ml_category", "ml_confidence", "rule_category", "rule_confidence",
                       b["category"].alias("category"), b["confidence"].alias("confidence"))


def with_low_confidence(df: DataFrame, threshold: float = MIN_CONFIDENCE) -> DataFrame:
    """Q23: ``low_confidence``, true where the category's confidence is below ``threshold`` or unknown."""
    return df.withColumn("low_confidence", F.coalesce(F.col("confidence_score") < threshold, F.lit(True)))


def categorize(df: DataFrame, model: NBModel | None = None, only_missing: bool = True,
               texts_from: DataFrame | None = None) -> DataFrame:
    """Rows whose category is empty / 'other' (or all rows) get the blended category and
    its confidence; other rows keep theirs. Classification runs on distinct descriptions.

    ``texts_from``: a cheaper frame with the same description/category columns to take the
    distinct texts from (e.g. the parsed statements before the quarantine split, so that branch
    prunes the date/amount parsing); classifying a superset of the texts is harmless."""
    key = F.lower(F.trim(F.col("description")))
    need = (F.coalesce(F.col("category"), F.lit("")).isin("", "other")) if only_missing else F.lit(True)
    marked = df.withColumn("_need", need).withColumn("_desc", key)
    src = texts_from if texts_from is not None else df
    texts = src.filter(need).select(key.alias("desc")).distinct()
    scored = classify_texts(texts, model, "desc").select(
        F.col("desc").alias("_desc"), F.col("category").alias("_cat"), F.col("confidence").alias("_conf"))
    joined = marked.join(scored, "_desc", "left")
    conf = F.col("confidence_score") if "confidence_score" in df.columns else F.lit(None).cast("double")
    return (joined.withColumn("category", F.when(F.col("_need"), F.col("_cat")).otherwise(F.col("category")))
                  .withColumn("confidence_score", F.when(F.col("_need"), F.col("_conf")).otherwise(conf))
                  .drop("_need", "_desc", "_cat", "_conf"))


def custom_rule_scores(descs: DataFrame, custom: DataFrame, text: str = "desc") -> DataFrame:
    """Per (account, text) the best user-defined category by the same keyword rules.

    ``custom``: (account_id, category, keywords ARRAY<STRING>) — a handful of rows per account,
    joined on the account (an equi-join), never broadcast blindly (it grows with accounts).
    """
    stop = RULE_STOP_WORDS
    d = F.col(text)
    j = descs.join(custom, "account_id").withColumn("_tok", rule_tokens(d, stop))

    def per_kw(acc, k):
        n = F.size(F.split(k, " "))
        whole = F.when(k == d, F.lit(3.0)).when(F.instr(d, k) > 0, n * F.lit(1.5)).otherwise(F.lit(0.0))
        tok = F.aggregate(F.col("_tok"), F.lit(0.0), lambda a, t: a + F.when(k == t, F.lit(2.0))
                          .when((F.instr(t, k) > 0) | (F.instr(k, t) > 0), F.lit(0.5)).otherwise(F.lit(0.0)))
        return acc + whole + tok

    scored = j.withColumn("_score", F.aggregate(F.transform("keywords", lambda x: F.lower(x)), F.lit(0.0), per_kw))
    return (scored.filter(F.col("_score") > 0)
            .groupBy("account_id", text)
            .agg(F.min_by(F.col("category"), F.struct((-F.col("_score")).alias("s"), F.col("category").alias("c")))
                  .alias("custom_category"),   # highest score, ties to the alphabetically first
                 F.max("_score").alias("custom_score")))
