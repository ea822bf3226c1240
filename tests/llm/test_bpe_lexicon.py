import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerlake.llm import bpe_lexicon as bpe
from ledgerlake.llm.arrays import IntTable, map_arrays, save_arrays
from tests.llm.helpers import empty, odd, odd_rows


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.TOKENIZER)


def test_ids_and_text_equal_the_library(spark, library):
    rnd = random.Random(3)
    letters = "ab'sSΣσİıßé́ \t\x1c\x85\xa0　漢123½٣!?<|endoftext|>\0🙂ẞ llveＡΆ"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += [r[1] for r in odd_rows()] + ["<|endoftext|>", " <|startoftext|>x", "Don't I'LL we've", "ΑΣ ΑΣΑ Σ", "aaaaaaa" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(bpe.decode(bpe.encode(docs)).collect())
    for r, e in zip(got, library.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
        assert r["bpe_ids"] == e.ids
        assert r["bpe_text"] == library.decode(e.ids, skip_special_tokens=False)


def test_transducer_holds_exactly_its_words_and_shares_endings(tmp_path):
    words = sorted({"walked", "talked", "walks", "talks", "stalked", "a", "é", "漢字", "walk"}, key=str.encode)
    arrays = bpe.compile_words(words)
    save_arrays(str(tmp_path / "x"), arrays)
    machine = bpe.Transducer(map_arrays(str(tmp_path / "x")))
    assert machine.numbers(words).tolist() == list(range(len(words)))
    assert (machine.numbers(["wal", "walke", "walkedd", "b", "talk", ""]) == -1).all()
    states = {w.encode()[i:] for w in words for i in range(len(w.encode()) + 1)}
    assert len(arrays["final"]) < len(states) + 2


def test_int_table_finds_all_and_only_its_keys():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 60, 5000).astype(np.uint64))
    table = IntTable.build(keys)
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1 << 61)) == -1).all()
    assert (IntTable.build(np.zeros(0, np.uint64)).find(keys) == -1).all()


def test_decode_skips_unknown_ids(spark):
    df = spark.createDataFrame([(1, [320, None, -1, 999999, 320]), (2, []), (3, None)], "doc_id long, bpe_ids array<int>")
    got = {r["doc_id"]: r["bpe_text"] for r in bpe.decode(df).collect()}
    word = bpe.vocabulary(bpe.TOKENIZER).strings[320].as_py()
    assert got[1] == f"{word} {word}" and got[2] == "" and not got[3]


def test_odd_rows(spark):
    got = bpe.encode(odd(spark).selectExpr("*", "1 AS bpe_ids")).collect()
    assert Counter(r["text"] for r in got) == Counter(r[1] for r in odd_rows()) and all(r["bpe_ids"] == [] for r in got if not r["text"])
    assert bpe.decode(bpe.encode(empty(spark))).count() == 0
