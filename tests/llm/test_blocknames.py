import re
from collections import defaultdict
from hashlib import sha256

from pyspark.sql import functions as F

from ledgerlake.llm import blocknames
from tests.llm.helpers import empty, odd, odd_rows, prose


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = min(ids, key=lambda i: (i is None, i or 0))
        out += [(i, keep, len(ids), sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = blocknames.exact_groups(docs).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute(rows)
    per = defaultdict(int)
    for r in got:
        per[r["text_sha256"]] += r["kept"]
    assert set(per.values()) <= {1}  # one row of each group stays, of repeated rows too
    return got


def test_odd_rows(spark):
    check(spark, [(r[0], r[1]) for r in odd_rows()])
    assert blocknames.exact_groups(empty(spark)).count() == 0
    kept = blocknames.drop_copies(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == len({x[3] for x in brute([(r[0], r[1]) for r in odd_rows()])})
    assert blocknames.drop_copies(empty(spark)).count() == 0


def test_texts_that_differ_in_one_block(spark):
    base = prose(1, 4000)
    rows = [(i, base[:j] + "#" + base[j + 1:]) for i, j in enumerate(range(0, len(base), 997))]
    rows += [(1000 + i, t) for i, t in rows[:5]] + [(2000, base), (2001, base + " "), (2002, base + "  ")]
    check(spark, rows)


def test_hot_block_and_equal_hash(spark, monkeypatch):
    """A hot group is dealt over salts; blocks that share a hash keep different names."""
    monkeypatch.setattr(blocknames, "HOT_ROWS", 4)
    same = prose(2, 900)
    check(spark, [(i, same) for i in range(300)] + [(1000 + i, same[:4096] + str(i)) for i in range(100)])
    df = spark.createDataFrame([(i, bytes([65 + i % 3])) for i in range(60)], "rid long, key binary").withColumn("q", F.lit(7).cast("long"))
    named = blocknames.named(df.withColumn("letter", F.col("key")), df.select("q"), "key", ["rid"], "clash")
    names = {(r["n1"], r["n2"]): r["letter"] for r in named.collect()}
    assert len(names) == 3 and len(set(map(bytes, names.values()))) == 3
