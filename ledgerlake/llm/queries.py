"""Registered queries of the ``llm`` operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import (blocknames, bpe_lexicon, jaccard_rtree, kneser_ney, langid, licenses, merkle, mix, ranking, resample, tokenscan,
                            toxicity, wrappers)
from ledgerlake.llm.common import fold, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: 150 % of all words at source weights 3, 1, 2."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(mix.WORD)), F.lit(0)).cast("long").alias("mix_size"))
    return mix.mix(docs).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).cast("long").alias("taken"))


def op2_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with the last quarter taken from the next."""
    return merkle.against_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; fold 2 of 4 is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~held)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", held.alias("held_out"), F.col("tox_score").alias("score"),
                         (F.col("tox_score") >= 0.3).cast("int").alias("predicted"), F.size("tox_passages").alias("n_passages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenscan.count_documents(docs).select("doc_id", "file", "place", "start", "n_tokens")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicate groups of all documents."""
    return blocknames.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document; fold 0 of 10 is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold("doc_id", 10) == 0, F.lit(False))
    model = kneser_ney.fit(docs.filter(~held))
    return kneser_ney.score(docs, model).select(
        "doc_id", held.alias("held_out"), F.col("lm_tokens").alias("n_tokens"), F.col("lm_known").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), F.col("lm_base").alias("base_score"), F.col("lm_score").alias("score"))


def op7_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    _, slots = wrappers.infer(pages)
    return wrappers.extract(pages, slots).select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op8_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_lexicon.decode(bpe_lexicon.encode(docs).drop("text"))
    return coded.select(
        "doc_id", F.size("bpe_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("bpe_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("bpe_text").cast("binary"), 256).alias("decoded_sha256"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by 4-word shingles at a Jaccard similarity of 0.85 or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_rtree.near_groups(docs, width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; fold 0 of 5 is held out."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = langid.fit(langid.training_rows(docs, held))
    named = langid.predict(docs.select("doc_id", "text"), model)
    return named.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license notices in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = F.filter("lic_spans", lambda s: s["exact"])
    labels = [F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda s: s["label"]))), ",") for a in (base, F.col("lic_spans"))]
    return licenses.scan(docs).select(
        "doc_id", F.col("lic_words").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first_word"])).alias("last_word"),
        labels[0].alias("base_labels"), labels[1].alias("labels"), F.col("lic_score").alias("score"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranking.rank(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of 20 words or more, drawn towards the benchmark's distribution."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, table(spark, sf_dir, "benchmark").select("text")).select(
        "doc_id", F.col("res_features").alias("n_features"), F.col("res_weight").alias("weight"),
        F.col("res_score").alias("score"), F.col("res_rank").alias("rank"))


ORACLE_OP5 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

_TO_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_TO_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_words FROM d),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
v AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM t, g GROUP BY term, n_docs),
i AS (SELECT q, item_id, unnest(list_distinct(w)) AS term FROM (SELECT row_number() OVER () AS q, item_id,
      regexp_extract_all(translate(coalesce(text, ''), {_TO_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark)),
s AS (SELECT q, item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * n_docs) // n_words))))::BIGINT AS score
      FROM i JOIN t USING (term) JOIN v USING (term) JOIN d USING (r), g GROUP BY q, item_id, r),
o AS (SELECT q, item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""

#: crc32 of a string's UTF-8 bytes: a table of 256 steps, folded over the bytes.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(hex({x}))::BIGINT, 2), lambda k: ('0x' || substr(hex({x}), k + 1, 2))::BIGINT)),
                      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))"""

ORACLE_OP13 = rf"""
WITH RECURSIVE steps AS (
  SELECT i AS b, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS tab FROM steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_TO_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT regexp_extract_all(translate(coalesce(text, ''), {_TO_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
qf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM q),
h AS (SELECT f, xor({_CRC.format(x="f")}, 4294967295) % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM qf), crc),
s AS (SELECT bucket, count(*) AS s FROM df JOIN h USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM qf JOIN h USING (f) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM df) + 10000.0::DOUBLE AS s_all, (SELECT count(*) FROM qf) + 10000.0::DOUBLE AS t_all),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * s_all) / ((s + 1)::DOUBLE * t_all)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
w AS (SELECT r, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM df JOIN h USING (f) JOIN gain USING (bucket) GROUP BY r),
x AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM d LEFT JOIN w USING (r)),
o AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (ORDER BY n_words >= 20 DESC, score DESC, doc_id NULLS LAST) END AS place FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM x WHERE n_words >= 20) * 25 // 100 THEN place END AS rank FROM o
"""

REGISTRY = {
    "op1_mix_sources": op1_mix_sources,
    "op2_merkle_fingerprint": op2_merkle_fingerprint,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_html_wrappers": op7_html_wrappers,
    "op8_bpe_lexicon": op8_bpe_lexicon,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_language_id": op10_language_id,
    "op11_license_scan": op11_license_scan,
    "op12_ranked_search": op12_ranked_search,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLES = {"op5_exact_dedup": ORACLE_OP5, "op12_ranked_search": ORACLE_OP12, "op13_importance_resampling": ORACLE_OP13}
