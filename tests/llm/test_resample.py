import hashlib
import math
import random
import re
import zlib
from collections import Counter

from ledgerlake.llm import resample
from tests.llm.helpers import empty, odd, odd_rows, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(docs, target, percent=25, least=20):
    rows = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for *_, f in rows for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in s}
    out = []
    for d, w, f in rows:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    drawn = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(drawn[:len(drawn) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def check(spark, docs, target, percent=25):
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string"), percent=percent)
    got = got.select("doc_id", "res_features", "res_weight", "res_score", "res_rank").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, target, percent)


def corpus(seed, n):
    rnd = random.Random(seed)
    shared = ["Shared line, on many pages.", "", "  ", "one", prose(999, 25), "Ünï cödé £5 漢字 x9"]
    docs = []
    for i in range(n):
        lines = [prose(seed * 1000 + i * 10 + j, rnd.randrange(0, 12), 40) for j in range(rnd.randrange(0, 9))] + rnd.choices(shared, k=rnd.randrange(0, 5))
        rnd.shuffle(lines)
        docs.append((i, rnd.choice(["\n", "\n\n", "\r\n"]).join(lines)))
    return docs


def test_against_all_features(spark):
    docs = corpus(1, 150)
    docs += [(500 + i, docs[0][1]) for i in range(60)]      # copies: their lines are hot
    check(spark, docs, [prose(1000, 50), "Shared line, on many pages.\nother", None])
    check(spark, docs, [], 100)


def test_lines_that_are_sent_and_lines_that_are_joined_agree(spark, monkeypatch):
    docs = corpus(2, 80)
    for hot in (1, 20, 10 ** 9):
        monkeypatch.setattr(resample, "HOT", hot)
        check(spark, docs, [prose(2000, 60)])


def test_odd_rows(spark):
    check(spark, [(r[0], r[1]) for r in odd_rows()], ["one two three", "\x00 é", ""], 60)
    target = spark.createDataFrame([("a b",)], "text string")
    docs = odd(spark).selectExpr("*", "1 AS res_rank", "2 AS own", "3 AS row", "4 AS score", "5 AS keys")
    got = resample.resample(docs, target)
    assert got.count() == 12 and {"lang", "own", "row", "score", "keys", "res_rank"} <= set(got.columns) and {r["row"] for r in got.collect()} == {3}
    assert resample.resample(empty(spark), target).count() == 0
