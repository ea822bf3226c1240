import math
import random
import re
from collections import Counter

from ledgerlake.llm import ranking
from tests.llm.helpers import empty, odd, odd_rows, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [Counter(terms(t)) for _, t in docs]
    n_docs, n_words = sum(bool(b) for b in bags), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for (d, _), b in zip(docs, bags):
            m = 10 + 90 * sum(b.values()) * n_docs // max(1, n_words)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if t in b)
            if score > 0:
                found.append((-score, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def check(spark, docs, items, k=10):
    got = ranking.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, k)


def corpus(seed, n):
    rnd = random.Random(seed)
    common = ["the", "of", "and", "in"]
    docs = [(i, " ".join(w if rnd.random() < 0.6 else rnd.choice(common) for w in prose(i % 60, rnd.choice([1, 5, 40, 300]), 30).split())) for i in range(n)]
    return docs + [(1000 + i, docs[3][1]) for i in range(40)]      # copies: ties go to the smaller key


def test_against_all_scores(spark):
    docs = corpus(1, 200)
    items = [(i, " ".join(docs[i * 7][1].split()[:12]) + " the of") for i in range(20)] + [(50, "the of and"), (51, None), (52, "nowhere"), (53, docs[3][1]), (53, "the the the")]
    check(spark, docs, items)
    check(spark, docs, items, 1)


def test_small_blocks_bundles_and_runs(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BUNDLE", 3)
    monkeypatch.setattr(ranking, "MOST_TERMS", 60)
    docs = corpus(2, 120)
    items = [(i, " ".join(docs[i * 5][1].split()[:15])) for i in range(12)]
    check(spark, docs, items)


def test_odd_rows(spark):
    docs = [(r[0], r[1]) for r in odd_rows()]
    check(spark, docs, [(1, "one three"), (None, "Haus w1x1"), (2, "\x00 漢字 é"), (3, "")])
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert ranking.rank(empty(spark), items).count() == 0
    assert ranking.rank(odd(spark).selectExpr("*", "1 AS block", "2 AS term"), items.limit(0)).count() == 0
