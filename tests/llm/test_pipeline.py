"""The stages one after the other, each against brute force on its own input."""

from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlake.llm import bpe_lexicon
from ledgerlake.llm.common import materialize
from tests.llm.helpers import empty, odd, prose
from tests.llm.test_blocknames import brute as same
from tests.llm.test_jaccard_rtree import brute as near

D = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    extra = docs.limit(3).selectExpr("doc_id + 5000 AS doc_id", "concat(text, ' ') AS text", "lang", "source", "n_chars")
    extra = extra.unionByName(docs.limit(4).selectExpr("doc_id + 6000", "concat(text, ' tail word') AS text", "lang", "source", "n_chars").toDF(*docs.columns))
    junk = spark.createDataFrame([(9000, "123 456 %%%", None, "s", 11), (9001, None, None, "s", 0)], docs.schema)
    docs = materialize(docs.unionByName(extra).unionByName(junk), "input")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "encode"]

    kept = materialize(stages["language_id"](spark, docs, D), "one")
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()}
    assert {9000, 9001} <= gone and len(gone) <= 4 and kept.columns == docs.columns

    one = materialize(stages["exact_dedup"](spark, kept, D), "two")
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    keep = {k for _, k, *_ in same(rows)}
    assert rows_of(one) == rows_of(kept.filter(kept.doc_id.isin(list(keep))))

    two = materialize(stages["near_dedup"](spark, one, D), "three")
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert sorted(r["doc_id"] for r in two.collect()) == sorted({c for _, _, c in near(rows, 5, 80)}) and two.columns == docs.columns

    three = materialize(stages["mix_sources"](spark, two, D), "four")
    times, size = Counter(r["doc_id"] for r in three.collect()), {r["doc_id"]: len((r["text"] or "").split()) for r in two.collect()}
    assert set(times) <= set(size) and max(times.values()) <= 2 and three.columns == docs.columns
    words = sum(size[d] * n for d, n in times.items())
    assert abs(words - 1.5 * sum(size.values())) <= 0.2 * sum(size.values())

    four = stages["encode"](spark, three, D).collect()
    library = Tokenizer.from_file(bpe_lexicon.TOKENIZER)
    text = {r["doc_id"]: r["text"] for r in three.collect()}
    assert len(four) == three.count()
    assert all(r["bpe_ids"] == library.encode(text[r["doc_id"]], add_special_tokens=False).ids for r in four)


def test_odd_rows_and_no_rows(spark):
    for docs in (odd(spark).selectExpr("*", "1 AS mix_p", "'x' AS lang_pred", "2 AS near_key"), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, D), "stage")
        assert "bpe_ids" in docs.columns
        docs.count()


def test_near_copies_leave_one(spark):
    text = prose(1, 300)
    docs = spark.createDataFrame([(3, text, "en", "a", 1), (2, text + " more", "en", "a", 1), (1, prose(2, 300), "en", "a", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, D).collect()) == [1, 2]
