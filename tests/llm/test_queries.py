"""The registered queries over whole tables: columns, row counts, SQL where there is some."""

import duckdb
import pytest

from ledgerlake.llm.queries import ORACLES, REGISTRY

D = "/root/testdata/sf0.001"
COLUMNS = {
    1: {"doc_id", "size", "source_size", "target", "taken"}, 2: {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    3: {"doc_id", "held_out", "score", "predicted"}, 4: {"doc_id", "n_tokens"}, 5: {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    6: {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}, 7: {"page_id", "url", "text", "n_chars"},
    8: {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, 9: {"doc_id", "n_shingles", "component_id"}, 10: {"doc_id", "held_out", "lang_pred", "score"},
    11: {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}, 12: {"item_id", "rank", "doc_id", "score"},
    13: {"doc_id", "n_features", "weight", "score", "rank"}}


@pytest.mark.parametrize("name", REGISTRY)
def test_query(spark, name):
    n = int(name[2:].split("_")[0])
    got = REGISTRY[name](spark, D)
    assert COLUMNS[n] <= set(got.columns)
    rows = got.collect()
    table = "pages" if n == 7 else "documents"
    if n != 12:
        assert len(rows) == spark.read.parquet(f"{D}/{table}.parquet").count()
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
        want = con.sql(ORACLES[name])
        assert sorted(str([r[c] for c in want.columns]) for r in rows) == sorted(str(list(r)) for r in want.fetchall())
