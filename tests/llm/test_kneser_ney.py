import math
from collections import Counter

import numpy as np
import pytest

from ledgerlake.llm import kneser_ney as kn
from tests.llm.helpers import empty, odd, odd_rows, prose


def test_counts_beyond_32_bits_travel_in_parts():
    c = np.array([0, 5, kn.WIDEST, kn.WIDEST + 1, 3 * kn.WIDEST + 7, 2 ** 40], np.int64)
    at, part = kn.chunks(c)
    assert part.dtype == np.uint32 and (np.bincount(at, part.astype(np.float64)).astype(np.int64) == c).all() and len(at) == 1 + 1 + 1 + 2 + 4 + 257
    words = np.arange(6, dtype=np.uint64) * 7
    _, got = next(kn._shard_rows([kn._packed(np.zeros(6, np.int64), "u", 1, None, words, c)]))
    assert all((x == y).all() for x, y in zip(kn.summed(*got["u"][1:]), (words, c)))
    assert [len(x) for x in kn.chunks(c[:0])] == [0, 0]


def brute(train, texts):
    """The model's formulas over dictionaries: (base, score, tokens, known) per text."""
    cut = lambda t: [*kn.tokens(t), None]
    uni, big = Counter(), Counter()
    for t in train:
        w = cut(t)
        uni.update(w)
        big.update(zip([("start",), *w[:-1]], w))
    cc, n, total, types = Counter(big.values()), Counter(), Counter(), {k: Counter() for k in (1, 2, 3)}
    for (v, w), c in big.items():
        n[w] += 1
        total[v] += c
        types[min(c, 3)][v] += 1
    d = (0, *kn.discounts([cc[k] for k in (1, 2, 3, 4)]))
    nc = Counter(n.values())
    e = (0, *kn.discounts([nc[k] for k in (1, 2, 3, 4)]))
    size, all_ = len(uni), sum(uni.values())
    left = (e[1] * nc[1] + e[2] * nc[2] + e[3] * sum(x > 2 for x in n.values())) / len(big) if big else 1.0
    p1 = lambda w: left / (size + 1) + (max(n[w] - e[min(n[w], 3)], 0) / len(big) if big else 0)

    def p2(v, w):
        if not total[v]:
            return p1(w)
        c = big[v, w]
        return (max(c - d[min(c, 3)], 0) + sum(d[k] * types[k][v] for k in (1, 2, 3)) * p1(w)) / total[v]
    for v in list(total)[:3]:
        assert sum(p2(v, w) for w in uni) + p2(v, "never seen") == pytest.approx(1)
    for t in texts:
        w = cut(t)
        yield (sum(math.log10((uni[x] + 0.1) / (all_ + 0.1 * (size + 1))) for x in w),
               sum(math.log10(p2(v, x)) for v, x in zip([("start",), *w[:-1]], w)), len(w), sum(uni[x] > 0 for x in w))


def check(spark, train, texts):
    model = kn.fit(spark.createDataFrame([(t,) for t in train], "text string"))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(kn.score(docs, model).collect())
    for r, (base, score, n, known) in zip(got, brute(train, texts), strict=True):
        assert (r["lm_tokens"], r["lm_known"]) == (n, known)
        assert r["lm_base"] == pytest.approx(base) and r["lm_score"] == pytest.approx(score)


def test_against_dictionaries(spark):
    train = [prose(i, 60, 5) for i in range(120)] + [None, "", "The THE the"]
    check(spark, train, [*train[:20], "unseen words only", None, "the  end", "É é"])


def test_chunks_shards_and_split_contexts(spark, monkeypatch):
    monkeypatch.setattr(kn, "CHUNK", 300)
    monkeypatch.setattr(kn, "SPLIT", 1000)
    check(spark, ["the a the b the c " * 30 + prose(i, 40, 3) for i in range(60)], ["the a the d", prose(1, 40, 3)])


def test_odd_rows(spark):
    model = kn.fit(odd(spark))
    got = kn.score(odd(spark).selectExpr("*", "1 AS lm_score"), model).collect()
    assert len(got) == len(odd_rows()) and all(r["lm_tokens"] == 1 for r in got if not (r["text"] or "").strip())
    nothing = kn.fit(empty(spark))
    assert {r["lm_score"] for r in kn.score(odd(spark), nothing).collect()} == {0.0}
    assert kn.score(empty(spark), model).count() == 0
