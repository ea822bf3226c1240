import os

import numpy as np

from ledgerlake.llm import tokenscan as ts
from tests.llm.helpers import empty, odd, odd_rows


def test_counts_equal_the_encoder_for_any_block(spark):
    encode = ts.encoding(ts.TOKENIZER).encode_ordinary
    for block in (1, 7, 1000, 1 << 20):
        rows = [r for r in odd_rows() if block > 1 or len(r[1] or "") < 100]
        docs = odd(spark) if block > 1 else odd(spark).filter("text IS NULL OR length(text) < 100")
        got = ts.count_documents(docs, block=block).collect()
        assert sorted((r["n_tokens"], r["doc_id"] or 0) for r in got) == sorted((len(encode(r[1] or "")), r[0] or 0) for r in rows)
        assert all(r["closed"] for r in got)
    assert ts.count_documents(empty(spark)).count() == 0


def test_files_without_an_index(spark, tmp_path):
    rnd = np.random.default_rng(1)
    files, want = {}, []
    for name, tail in (("a.bin", 3), ("b.bin", 0), ("c.bin", 0)):
        lens = [0, 0, 5, 40, 1, *rnd.integers(0, 9, 30)] if name != "c.bin" else []
        ids = [np.append(rnd.integers(0, 50000, n), ts.END) for n in lens] + [rnd.integers(0, 50000, tail)]
        np.concatenate([np.zeros(0), *ids]).astype("<u2").tofile(os.path.join(tmp_path, name))
        want += [(name, i, int(n), True) for i, n in enumerate(lens)] + [(name, len(lens), tail, False)] * bool(tail)
    names = spark.createDataFrame([("a.bin",), ("b.bin",), ("c.bin",)], "file string")
    for block in (1, 4, 100):
        got = ts.scan(f"file://{tmp_path}", ts.blocks_of(spark, f"file://{tmp_path}", names, block)).collect()
        assert sorted((r["file"], r["place"], r["n_tokens"], r["closed"]) for r in got) == sorted(want)
